"""Document fingerprints from closed syncmers.

A k-mer of bytes is an anchor if its smallest s-mer, by hash, is its first or its last. That
depends on the k-mer alone, so an edit changes no anchor beyond k bytes of it. Anchors are
dealt by hash to BINS bins; the fingerprint keeps each bin's anchor of smallest hash as a
tag and its position. Two fingerprints match in a bin if the tags are equal and the shift of
the position agrees with the typical shift; their likeness is the share of matching bins
among those that either fills.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, utf8

K, S = 16, 8
#: Bins of a fingerprint; bits of a tag and of a position in it; shift in bytes that still agrees.
BINS, TAG_BITS, POSITION_BITS, SLACK = 128, 16, 32, 64
#: Rows that a range of ids is planned for, the most ranges, and bounds that a search passes over at once.
RANGE_ROWS, MOST_RANGES, STRIDE = 500, 16_384, 64
_EMPTY = (1 << (TAG_BITS + POSITION_BITS)) - 1
_HEX = (TAG_BITS + POSITION_BITS) // 4


def _mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers so that order and leading bits are as good as random."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _packed(data: np.ndarray, width: int) -> np.ndarray:
    """The integer of each run of `width` (a power of two, at most 8) bytes."""
    out, have = data.astype(np.uint64), 1
    while have < width:
        out = (out[:-have] << np.uint64(8 * have)) | out[have:]
        have *= 2
    return out


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of `width` values."""
    have = 1
    while have * 2 <= width:
        values, have = np.minimum(values[:-have], values[have:]), have * 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def sketch(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of BINS cells (tag and position, _EMPTY if none) per text of the chunk.

    A text of fewer than K bytes, but not none, counts as one anchor at position 0.
    """
    n = len(offsets) - 1
    cells = np.full(n * BINS, np.iinfo(np.uint64).max, dtype=np.uint64)
    lengths = np.diff(offsets)
    if len(data) >= K:
        s_mers = _mix(_packed(data, S))
        low = _smallest(s_mers, K - S + 1)
        starts = np.flatnonzero((low == s_mers[: len(low)]) | (low == s_mers[K - S : K - S + len(low)]))
        row = np.searchsorted(offsets, starts, side="right") - 1
        inside = starts + K <= offsets[row + 1]
        starts, row = starts[inside], row[inside]
        halves = _packed(data, 8)
        anchors = _mix(halves[starts] * np.uint64(0x9E3779B97F4A7C15) ^ _mix(halves[starts + 8]))
        _put(cells, row, anchors, starts - offsets[row])
    for r in np.flatnonzero((lengths > 0) & (lengths < K)):
        digest = hashlib.sha256(data[offsets[r] : offsets[r + 1]].tobytes()).digest()
        _put(cells, np.array([r]), np.frombuffer(digest[:8], np.uint64), np.array([0]))
    return np.where(cells == np.iinfo(np.uint64).max, np.uint64(_EMPTY), cells & np.uint64(_EMPTY)).reshape(n, BINS)


def _put(cells: np.ndarray, row: np.ndarray, anchors: np.ndarray, position: np.ndarray) -> None:
    """Keep each bin's smallest anchor; the first where it occurs again."""
    bins = row * BINS + (anchors >> np.uint64(57)).astype(np.int64)
    tag = (anchors >> np.uint64(57 - TAG_BITS)) & np.uint64((1 << TAG_BITS) - 1)
    # a rank of 16 bits decides which anchor stays, then the tag, then the position, which no text of an Arrow column exceeds
    rank = anchors & np.uint64((1 << (64 - TAG_BITS - POSITION_BITS)) - 1)
    place = position.astype(np.uint64)
    np.minimum.at(cells, bins, (rank << np.uint64(TAG_BITS + POSITION_BITS)) | (tag << np.uint64(POSITION_BITS)) | place)


def written(cells: np.ndarray) -> list[str]:
    """Each row as hex digits, 12 for a bin."""
    table = cells.astype(">u8").view(np.uint8).reshape(len(cells), BINS, 8)[:, :, 8 - _HEX // 2 :]
    return [r.tobytes().hex() for r in np.ascontiguousarray(table)]


def read(strings: list[str]) -> np.ndarray:
    table = np.zeros((len(strings), BINS, 8), dtype=np.uint8)
    if strings:
        table[:, :, 8 - _HEX // 2 :] = np.frombuffer(bytes.fromhex("".join(strings)), np.uint8).reshape(len(strings), BINS, -1)
    return table.reshape(-1, 8).view(">u8").astype(np.uint64).reshape(len(strings), BINS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for each pair of rows; two empty fingerprints are alike."""
    empty = np.uint64(_EMPTY)
    filled = (a != empty) | (b != empty)
    tags = np.uint64(POSITION_BITS)
    same = (a != empty) & (b != empty) & ((a >> tags) == (b >> tags))
    place = np.uint64((1 << POSITION_BITS) - 1)
    shift = np.where(same, (b & place).astype(np.int64) - (a & place).astype(np.int64), np.iinfo(np.int64).max)
    ordered, found = np.sort(shift, axis=1), same.sum(axis=1)
    typical = ordered[np.arange(len(a)), np.maximum(found - 1, 0) // 2][:, None]
    agree = same & (np.abs(shift - np.where(found[:, None] > 0, typical, 0)) <= SLACK)
    total = filled.sum(axis=1)
    return np.where(total == 0, 1.0, agree.sum(axis=1) / np.maximum(total, 1))


def _sketches(texts: pa.Array) -> tuple[np.ndarray, list[str]]:
    data, offsets = utf8(texts)
    rows = []
    for a, b in chunks(offsets):
        part = offsets[a : b + 1]
        rows.append(sketch(data[part[0] : part[-1]], part - part[0]))
    cells = np.concatenate(rows) if rows else np.zeros((0, BINS), dtype=np.uint64)
    return cells, written(cells)


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every whole text; null text is empty. Equal texts have equal fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sketches(batch.column(1))[1], pa.string())], names=["doc_id", "fingerprint"])

    source = docs.select("doc_id", "text")
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, fingerprint string")


def _constant(values: list, kind: str) -> Column:
    """A constant array of any length, as one literal of the plan."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def against_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its edited text and how alike they are:
    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    docs needs doc_id, a whole number, and text; other columns are ignored. Null text is
    empty. The edited text has its last floor(n_chars / 2) code points replaced by the first
    as many, or all, of the next document's, in descending doc_id; after the last comes the
    first, so that a lone document follows itself. Rows that repeat a doc_id all have the
    same next document, and as a next document they stand as the one of least text. Rows
    without a doc_id have no next document: they are edited with an empty text. An empty
    table gives an empty one.

    Ids are cut into ranges at quantiles, and each range is read in ascending order, so that
    a row's next document has gone by and no row waits. The rows of a range's greatest id are
    also guests of the range above, before its first document; those of the greatest id of
    all are guests of the lowest range. So texts are moved once, no range waits for another,
    and a task holds one chunk of texts and two documents.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    seen = source.agg(F.count("doc_id").alias("n")).first()["n"]
    ranges = min(MOST_RANGES, max(1, seen // RANGE_ROWS))
    steps = [k / ranges for k in range(1, ranges)]
    found = source.agg(F.percentile_approx("doc_id", _constant(steps, "array<double>"), min(50 * ranges, 500_000)).alias("b")).first()["b"] if steps else []
    bounds = sorted(set(found or []))  # at most MOST_RANGES
    # an id's range is the number of bounds that are not above it: first by every STRIDE-th bound, then among those between
    at_most = lambda table: F.size(F.filter(table, lambda b: b <= F.col("doc_id")))
    leap = at_most(_constant(bounds[STRIDE - 1 :: STRIDE], "array<bigint>")) * STRIDE
    number = leap + at_most(F.slice(_constant(bounds, "array<bigint>"), leap + 1, STRIDE))
    spread = F.pmod(F.xxhash64("text"), F.lit(ranges))
    ranged = source.withColumn("range", F.when(F.col("doc_id").isNotNull(), number).otherwise(-1 - spread).cast("int"))
    tops = ranged.where("range >= 0").groupBy("range").agg(F.max("doc_id").alias("top")).orderBy("range").collect()  # one row per range
    above = {r["range"]: (tops[k + 1] if k + 1 < len(tops) else tops[0])["range"] for k, r in enumerate(tops)}
    greatest = {r["range"]: r["top"] for r in tops}
    top, host = (_constant([table.get(k) for k in range(ranges)], "array<bigint>") for table in (greatest, above))
    guest = (F.col("range") >= 0) & (F.get(top, F.col("range")) == F.col("doc_id"))
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("guest"))
    both = F.array(own, F.struct(F.get(host, F.col("range")).cast("int").alias("range"), F.lit(1).alias("guest")))
    seated = ranged.withColumn("seat", F.explode(F.when(guest, both).otherwise(F.array(own))))
    ordered = (
        seated.select("seat.range", "seat.guest", "doc_id", "text")
        .repartition("range")
        .sortWithinPartitions("range", F.col("guest").desc(), F.col("doc_id").asc_nulls_last(), "text")
    )
    return ordered.mapInArrow(_follow, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads ranges in order: of the id at hand and of the one before it, the first row, of least text, is kept."""
    at, first, below = None, None, None  # (range, guest, doc_id) at hand, its first row, the first row of the id before
    for batch in batches:
        _, offsets = utf8(batch.column(3))
        for a, b in chunks(offsets):
            part = batch.slice(a, b - a)
            cells, _ = _sketches(part.column(3))
            ready: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in part.columns), cells):
                if row[2] is None:
                    ready.append((row, None))
                    continue
                if row[:3] != at:
                    below = first if at is not None and at[0] == row[0] else None
                    at, first = row[:3], row
                if not row[1]:
                    ready.append((row, below))
            yield from _compare(ready)


def _compare(pairs: list[tuple]) -> Iterator[pa.RecordBatch]:
    if not pairs:
        return
    own = np.array([w[4] for w, _ in pairs])
    nothing = np.full(BINS, _EMPTY, dtype=np.uint64)
    after = np.array([nothing if n is None else n[4] for _, n in pairs])
    edited = []
    for w, n in pairs:
        half = len(w[3]) // 2
        edited.append(w[3][: len(w[3]) - half] + ("" if n is None else n[3][:half]))
    cells, shown = _sketches(pa.array(edited, pa.string()))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([w[2] for w, _ in pairs], pa.int64()),
            pa.array([len(w[3]) for w, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(written(own), pa.string()),
            pa.array(shown, pa.string()),
            pa.array(likeness(own, cells), pa.float64()),
            pa.array(likeness(own, after), pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
