"""SimHash near-duplicates with pigeonring filtering.

Fingerprints of 64 bits are cut into a ring of segments. If two differ in at most `most`
bits, then (pigeonhole) at least segments - most of the segments are equal, and
(pigeonring) from some segment on, every chain of l consecutive segments differs in at most
l * most / segments bits. Equal segments make the join keys; the chain condition, tested
with array operations, prunes the pairs that share a key; the full distance decides.

Documents of equal fingerprint are one item, so copies are never paired. Groups give a
spanning forest of their links, not the pairs. Where many different fingerprints share a
key, close ones are linked first in linear work, and blocks of the group are compared only
across what that has connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_names, join_hot, packed, utf8
from .components import components

#: Words of a shingle, seed of its hash, and bits in which linked fingerprints may differ.
SHINGLE, SEED, MOST = 4, 42, 4
#: A group of fingerprints that share a key is dealt into blocks of about BLOCK beyond HOT of them.
HOT, BLOCK = 2_048, 512


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # on bytes: A-Z only, and exactly the six ASCII white space characters
    if not words:
        return 0
    body = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(body, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    hashes = np.array([xxh64_intdigest(body[a:b], SEED) for a, b in spans], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fingerprint as a signed long, kept columns) of every whole text; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            out = np.fromiter((fingerprint_of(data[a:b].tobytes(), shingle) for a, b in zip(offsets, offsets[1:])), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fingerprint", *keep])

    source = docs.select("doc_id", "text", *keep)
    types = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join([f"doc_id {types['doc_id']}", "fingerprint long", *[f"{k} {types[k]}" for k in keep]]))


def ring(equal: int, most: int = MOST) -> list[tuple[int, int]]:
    """(shift, width) of most + equal segments that cover 64 bits."""
    bounds = np.linspace(0, 64, most + equal + 1).round().astype(int).tolist()
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def equal_segments(n: int, most: int = MOST) -> int:
    """Segments to make keys of, so that a key has at least as many values as an eighth of the fingerprints."""
    return next(e for e in range(2, 60) if 64 * e / (most + e) >= np.log2(max(n, 2)) - 3)


def _keys(fingerprint: Column, equal: int, most: int) -> Column:
    """One key for each choice of `equal` segments: the choice, then their bits."""
    segments = ring(equal, most)
    out = []
    for number, choice in enumerate(combinations(range(most + equal), equal)):
        key, width = F.lit(number).cast("long"), 0
        bits = F.lit(0).cast("long")
        for shift, w in (segments[i] for i in choice):
            bits = F.shiftleft(bits, w).bitwiseOR(F.shiftrightunsigned(fingerprint, shift).bitwiseAND(F.lit((1 << w) - 1)))
            width += w
        out.append(F.shiftleft(key, width).bitwiseOR(bits) if width + len(segments) < 60 else F.xxhash64(key, bits))
    return F.array(*out)


def near(a: np.ndarray, b: np.ndarray, segments: list[tuple[int, int]], most: int) -> np.ndarray:
    """Whether pairs differ in at most `most` bits: first the chains of the ring, then all bits."""
    differ = a ^ b
    parts = [np.bitwise_count((differ >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int8) for s, w in segments]
    m = len(parts)
    some = np.zeros(len(a), dtype=bool)
    for start in range(m):
        chain, ok = np.zeros(len(a), dtype=np.int8), np.ones(len(a), dtype=bool)
        for length in range(1, m + 1):
            chain = chain + parts[(start + length - 1) % m]
            ok &= chain * m <= length * most
        some |= ok
    at = np.flatnonzero(some)
    out = np.zeros(len(a), dtype=bool)
    out[at] = np.bitwise_count(differ[at]) <= most
    return out


def forest(key: np.ndarray, fingerprint: np.ndarray, segments: list[tuple[int, int]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected within each run of equal keys: (fingerprint, its least linked one)."""
    n = len(key)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if n else np.zeros(0, int)
    size = np.diff(np.append(first, n))
    last = np.repeat(first + size - 1, size)
    label = np.arange(n)
    rows = np.arange(n)
    step = 1
    while True:
        rows = rows[rows + step <= last[rows]]
        if not len(rows):
            break
        a, b = rows, rows + step
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        linked = near(fingerprint[a], fingerprint[b], segments, most)
        a, b = a[linked], b[linked]
        while len(a):
            # hook the greater root on the lesser, then flatten
            x, y = label[a], label[b]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(label, label[label]):
                label = label[label]
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
        step += 1
    moved = np.flatnonzero(label != np.arange(n))
    return fingerprint[moved], fingerprint[label[moved]]


def _dealt(keyed: DataFrame, hot: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Rows of hot keys under the keys of pairs of blocks, and links that hold already.

    In a dense group most fingerprints are two bits at most from some other. Those meet at a
    fingerprint one bit from both: each member goes to 65 such meeting points, at most 65
    members to each, and is linked to the least one there. What is then connected needs no
    comparison within itself: blocks of one class are paired only with blocks of others, so
    the work follows the links that are still open, not the square of the group.
    """
    marked = cut(keyed.join(hot, "key"))
    points = [F.lit(0)] + [F.shiftleft(F.lit(1).cast("long"), b) for b in range(64)]
    near = marked.select("fingerprint").distinct()
    near = near.select(F.explode(F.array(*[F.col("fingerprint").bitwiseXOR(p) for p in points])).alias("point"), "fingerprint")
    least = near.groupBy("point").agg(F.min("fingerprint").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    held = cut(near.join(least, "point").where("fingerprint <> v").select(F.col("fingerprint").alias("u"), "v").distinct())
    classes = components(held, n).select(F.col("u").alias("fingerprint"), F.col("v").alias("class"))
    rows = cut(marked.join(classes, "fingerprint", "left").withColumn("class", F.coalesce("class", "fingerprint")))
    sizes = rows.groupBy("key", "class").count()
    pure = sizes.where(F.col("count") > BLOCK)
    mixed = sizes.where(F.col("count") <= BLOCK).groupBy("key").agg(F.sum("count").alias("count")).withColumn("class", F.lit(None).cast("long"))
    by_key = Window.partitionBy("key")
    blocks = pure.unionByName(mixed).withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
    allotted = blocks.select(
        "key", F.col("class").alias("own"), "blocks", F.sum("blocks").over(by_key.orderBy(F.col("class").asc_nulls_last())).cast("int").alias("end"), F.sum("blocks").over(by_key).cast("int").alias("all")
    )
    named = rows.join(pure.select("key", "class", F.col("class").alias("own")), ["key", "class"], "left").select("key", "fingerprint", F.col("own").alias("__own"))
    placed = named.withColumnRenamed("key", "__key").join(allotted, (F.col("__key") == F.col("key")) & F.col("__own").eqNullSafe(F.col("own")))
    mine = F.col("end") - F.col("blocks") + F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    open_ = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda y: F.col("own").isNull() | (y < F.col("end") - F.col("blocks")) | (y >= F.col("end")))
    pairs = F.transform(open_, lambda y: F.xxhash64("key", F.least(mine, y), F.greatest(mine, y)))
    return placed.select(F.explode(pairs).alias("key"), "fingerprint"), held


def links(distinct: DataFrame, n: int, most: int = MOST) -> DataFrame:
    """(u, v) that connect different fingerprints which differ in at most `most` bits. distinct: (fingerprint)."""
    equal = equal_segments(n, most)
    segments = ring(equal, most)
    keyed = distinct.select(F.explode(_keys(F.col("fingerprint"), equal, most)).alias("key"), "fingerprint")
    hot = cut(packed(keyed.groupBy("key").count().where(F.col("count") > HOT).select("key"), n))
    held = None
    if most >= 2 and hot.first() is not None:
        dealt, held = _dealt(keyed, hot, n)
        keyed = keyed.join(hot, "key", "left_anti").unionByName(dealt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate((held_key, batch.column(0).to_numpy()))
            item = np.concatenate((held, batch.column(1).to_numpy().view(np.uint64)))
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on
            yield _edges(*forest(key[:whole], item[:whole], segments, most))
            held_key, held = key[whole:], item[whole:]
        yield _edges(*forest(held_key, held, segments, most))

    found = keyed.repartition("key").sortWithinPartitions("key", "fingerprint").mapInArrow(run, "u long, v long").distinct()
    return found if held is None else found.unionByName(held)


def _edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def classes(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST) -> DataFrame:
    """Each document's fingerprint and class: (doc_id, fingerprint as 16 hex digits, component_id).

    docs needs doc_id and text; other columns are ignored. Texts are lower-cased in A-Z and
    split at ASCII white space; a text of fewer than `shingle` words is one shingle, one
    without words (null too) has fingerprint 0, linked like any other. component_id is the
    smallest doc_id reachable; null ids count for nothing, so it is null where a class has
    no other. Repeated rows give repeated results; an empty table gives an empty one.
    """
    rows = cut(fingerprints(docs, shingle))
    count = rows.count()
    named = _named(rows, count, most).select("fingerprint", "component_id")
    return packed(join_hot(rows, named, "fingerprint", count), count).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def _named(rows: DataFrame, count: int, most: int) -> DataFrame:
    """(fingerprint, root, component_id): the least fingerprint of each one's class, which names the class, and the least doc_id there."""
    distinct = cut(packed(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), count))
    n = distinct.count()
    joined = components(links(distinct.select("fingerprint"), n, most), n).select(F.col("u").alias("fingerprint"), F.col("v").alias("root"))
    rooted = cut(packed(distinct.join(joined, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint")), n))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return cut(packed(join_hot(rooted, least, "root", n).select("fingerprint", "root", "component_id"), n))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST) -> DataFrame:
    """docs with one document of each class: that of the smallest doc_id, once. Columns are unchanged.

    Of a class without any doc_id one row stays. Where a class has its smallest doc_id over
    several texts, that of the least digest stays; of rows that repeat id and text, any one.
    Classes stay apart whatever their ids: a doc_id over texts of two classes may stay twice.
    """
    doc_id = F.col("doc_id").cast("string")
    own = F.sha2(F.concat(F.coalesce(F.concat(F.length(doc_id).cast("string"), F.lit(":"), doc_id), F.lit("-")), F.coalesce("text", F.lit(""))), 256)
    (row,) = free_names(docs, "__row")
    keyed = docs.withColumn(row, own)
    rows = cut(fingerprints(keyed, shingle, (row,)))
    count = rows.count()
    least = join_hot(rows, _named(rows, count, most), "fingerprint", count).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = cut(packed(least.groupBy("root").agg(F.min(row).alias(row)).select(row), count))
    joined = keyed.join(kept, row, "left_semi").dropDuplicates([row])
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])
