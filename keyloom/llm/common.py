"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once inside a task; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a file of numbers and digests, when so many files would be near empty.
FILE_ROWS = 10_000
#: A key of more than this share of the rows is hot.
HOT_SHARE = 256


def packed(df: DataFrame, rows: int) -> DataFrame:
    """df, a few numbers a row, in no more partitions than so many rows need. Not for stages that read texts."""
    return df.coalesce(max(8, rows // FILE_ROWS))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until they are none of df's columns, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_hot(rows: DataFrame, side: DataFrame, key: str, n: int) -> DataFrame:
    """rows (n of them) joined with `side`, which has one row per key: hot keys by broadcast, the others by shuffle.

    There are at most HOT_SHARE hot keys, so no task gets all the rows of one.
    """
    hot = F.broadcast(rows.groupBy(key).count().where(F.col("count") > n / HOT_SHARE).select(key))
    few = F.broadcast(side.join(hot, key, "left_semi"))
    return rows.join(few, key).unionByName(rows.join(hot, key, "left_anti").join(side, key))


def join_counted(rows: DataFrame, side: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """join_hot for a `side` (key, value, count) that counts the rows of its keys, nothing null: rows with the value of their key."""
    most = n / HOT_SHARE
    marked = rows.join(F.broadcast(side.where(F.col("count") > most).select(key, value)), key, "left")
    cold = marked.where(F.col(value).isNull()).drop(value).join(side.where(F.col("count") <= most).select(key, value), key)
    return marked.where(F.col(value).isNotNull()).unionByName(cold)


def _checkpoints(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where all is one process, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="keyloom-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the cluster's shared checkpoint folder, which cuts its lineage there."""
    _checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared checkpoint folder, for files that driver and executors see."""
    return f"{_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no classifier may learn from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, ends - ends[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES, rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Row ranges, at most `rows` long, whose texts have about `most` bytes together."""
    n, row = len(offsets) - 1, 0
    while row < n:
        end = min(max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1), row + rows, n)
        yield row, end
        row = end


def sampled_labels(docs: DataFrame, labels: DataFrame, target: str, per_class: int) -> DataFrame:
    """Whole texts of at most `per_class` labelled documents of each class that may be learnt from: (doc_id, text, y).

    Ids are ranked by a hash, so that the sample does not depend on partitions. A repeated
    id takes its greatest label; null ids, null labels and labels other than 0 and 1 are left out.
    """
    marked = (
        labels.select(F.col("doc_id"), F.col(target).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .join(docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct(), "doc_id", "left_semi")
    )
    ranked = [marked.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    ids = cut(ranked[0].unionByName(ranked[1]))  # at most 2 * per_class rows
    first = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return cut(packed(first.groupBy("doc_id", "y").agg(F.min("text").alias("text")), 2 * per_class))


def priors(labels: DataFrame, target: str) -> tuple[float, float]:
    """Share of each class among the rows that may be learnt from, smoothed by one row of each."""
    row = (
        labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & ~held_out(F.col("doc_id")))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("long")).alias("k"))
        .first()
    )
    one = ((row["k"] or 0) + 1) / (row["n"] + 2)
    return 1 - one, one
