"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups are the documents of equal text, summed up before anything is placed. Each goes to
the shard whose residual capacity has the highest dot product with the group's vector
(bytes, tokens, rows), the largest first. Groups that hold more than a set share of
all bytes, tokens or rows are placed one by one; there can be only so many. The others fall
into cells of nearly equal vectors. Groups of equal vectors are interchangeable, so how many
of a cell each shard takes follows from the dot products without a loop over its groups. A
group larger than a shard is a cell of its own, of rows. So every group stays whole unless
no shard could hold it, and the driver sees a table of bounded size.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .mixing import running, word_count

SHARDS = 8
#: A group of more than this share of all bytes, tokens or rows is placed on its own: at most three times as many.
LARGE = 2_048
#: Steps of a cell per doubling of bytes and of rows, and steps of tokens per byte: at most 40 * 16 * 40 * 2 * 9 cells.
BYTE_STEPS, ROW_STEPS, TOKEN_STEPS = 16, 2, 16
#: Rows that a bucket of the running counts is planned for, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 200, 8_192


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def deal(left: np.ndarray, item: np.ndarray, count: int) -> np.ndarray:
    """How many of `count` items of one vector each shard takes, when each goes where the dot product with what is left is highest.

    Only shards that the item's bytes fit into are chosen from; when it fits into none, the
    one with the most bytes left. An item lowers its shard's dot product by its own square,
    so a level tells how many each shard has taken when all dot products have come down to it.
    """
    room = np.floor(np.maximum(left[:, 0], 0) / item[0] + 1e-9).astype(np.int64) if item[0] > 0 else np.full(len(left), count)
    taken = _level(left @ item, float(item @ item), room, min(count, int(room.sum())))
    return taken + _level(left[:, 0] - taken * item[0], float(item[0]), np.full(len(left), count), count - int(taken.sum()))


def _level(score: np.ndarray, step: float, most: np.ndarray, count: int) -> np.ndarray:
    """Items by shard if each of `count` goes to the highest score, which then falls by `step`; at most `most` each, ties to the first."""
    taken = np.zeros(len(score), dtype=np.int64)
    if count > 4 * len(score) and step > 0:
        low, high = score.min() - step * (count + 1), score.max() + step
        for _ in range(100):
            middle = (low + high) / 2
            some = np.clip(np.ceil((score - middle) / step), 0, most).astype(np.int64)
            if some.sum() > count - 2 * len(score):
                low = middle
            else:
                high, taken = middle, some
    heap = [(-(s - t * step), j) for j, (s, t, m) in enumerate(zip(score, taken, most)) if t < m]
    heapq.heapify(heap)
    for _ in range(count - int(taken.sum())):
        s, j = heapq.heappop(heap)
        taken[j] += 1
        if taken[j] < most[j]:
            heapq.heappush(heap, (s + step, j))
    return taken


def pack(items: np.ndarray, counts: np.ndarray, shards: int) -> np.ndarray:
    """How many of each item every shard takes. items: one row (bytes, tokens, rows) per kind of item; counts: how many there are.

    Every dimension is scaled so that a shard's fair share is 1. Kinds go by their largest
    dimension, that of all its rows for what is larger than a shard; the greatest first.
    """
    total = np.maximum((items * counts[:, None]).sum(axis=0), 1)
    scaled = items / total * shards
    left = np.ones((shards, items.shape[1]))
    out = np.zeros((len(items), shards), dtype=np.int64)
    for i in np.lexsort((np.arange(len(items)), -scaled.max(axis=1, initial=0))):
        out[i] = deal(left, scaled[i], int(counts[i]))
        left -= out[i][:, None] * scaled[i]
    return out


def _cell(b: Column, t: Column, n: Column) -> Column:
    """A number for groups of nearly equal bytes, tokens and rows."""
    by_bytes = F.floor(F.log2(b.cast("double")) * BYTE_STEPS)
    by_rows = F.floor(F.log2(n.cast("double")) * ROW_STEPS)
    return ((by_bytes * 256 + by_rows) * 32 + F.least(F.floor(t / b * TOKEN_STEPS), F.lit(31))).cast("long")


def assign(docs: DataFrame, shards: int = SHARDS, large: int = LARGE) -> DataFrame:
    """The shard of each document: (doc_id, size, tokens, text_crc32, shard, slot).

    docs needs doc_id and text; other columns are ignored. Null text has size 1, no tokens,
    CRC 0, and is of one group with the empty text. Rows of equal text go to one shard
    unless they are more than a shard's share of all bytes, tokens or rows; such a group is
    dealt by row. Repeated rows get slots of their own. Slots count from 0 without gaps
    within a shard, in the order of (a digest of doc_id, doc_id). An empty table gives an
    empty table.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(
        docs.select(
            "doc_id",
            size_of(F.col("text")).alias("size"),
            word_count(F.col("text")).alias("tokens"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.xxhash64(body).alias("group"),
            F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("spread"),
        )
    )
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"), F.sum("tokens").alias("t")).first()
    groups = rows.groupBy("group").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    over = lambda parts: F.greatest(*[F.col(c) / F.lit(float(max(seen[c] or 0, 1))) for c in "btn"]) > 1 / parts
    # a split group is a cell of rows, a large one a cell of its own; the groups stand in their cells in the order of their digests
    split = groups.where(over(shards) & (F.col("n") > 1)).select("group").collect()  # fewer than 3 * shards rows
    by_row = F.col("group").isin([r["group"] for r in split])
    kind = F.when(by_row, 2).when(over(large), 1).otherwise(0)
    celled = groups.withColumn("kind", kind.cast("int")).withColumn("cell", F.when(F.col("kind") > 0, F.col("group")).otherwise(_cell(F.col("b"), F.col("t"), F.col("n"))))
    celled = cut(celled)
    sums = celled.groupBy("kind", "cell").agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))
    cells = sums.orderBy("kind", "cell").collect()  # at most 3 * large rows and the cells, by their steps
    counts = np.array([r["n"] if r["kind"] == 2 else r["groups"] for r in cells], dtype=np.int64)
    items = np.array([(r["b"], r["t"], r["n"]) for r in cells], dtype=np.float64).reshape(-1, 3) / np.maximum(counts, 1)[:, None]
    ends = np.cumsum(pack(items, counts, shards), axis=1)
    table = [(r["kind"], r["cell"], e.tolist()) for r, e in zip(cells, ends)]
    bounds = F.broadcast(docs.sparkSession.createDataFrame(table, "kind int, cell long, ends array<long>"))  # as many rows as cells
    shard = F.size(F.filter("ends", lambda e: e < F.col("nth"))).cast("int").alias("shard")
    buckets = min(MOST_BUCKETS, max(8, (seen["n"] or 0) // BUCKET_ROWS))
    counted = lambda df, cell, order: running(df.withColumn("bucket", F.pmod(order[0], F.lit(buckets))).withColumn("one", F.lit(1).cast("long")), [cell, "bucket"], order, "one", "nth")
    alone = [(r["cell"], int(np.argmax(e > 0))) for r, e in zip(cells, ends) if r["kind"] == 1]
    known = rows.join(F.broadcast(docs.sparkSession.createDataFrame(alone, "group long, shard int")), "group", "left")  # at most 3 * large rows
    whole = counted(celled.where("kind = 0"), "cell", [F.col("group")]).join(bounds, ["kind", "cell"]).select("group", shard)
    parted = counted(rows.where(by_row).withColumn("cell", F.col("group")), "cell", [F.col("spread"), F.col("doc_id").asc_nulls_last()])
    parted = parted.withColumn("kind", F.lit(2)).join(bounds, ["kind", "cell"]).select("doc_id", "size", "tokens", "text_crc32", "spread", shard)
    placed = parted.unionByName(known.where("shard IS NOT NULL").select(*parted.columns))
    # no group is left here of which a task could get more than a set share of the rows
    placed = placed.unionByName(known.where(F.col("shard").isNull() & ~by_row).drop("shard").join(whole, "group").select(*parted.columns))
    slotted = counted(placed, "shard", [F.col("spread"), F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("size")])
    return slotted.select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("nth") - 1).cast("long").alias("slot"))
