"""Audit of how filters interact: what each removes in every order in which they could run.

Documents come down to cells: how many of a part (a source) fail exactly which filters. The
orders are visited so that each differs from the one before by a swap of two neighbours.
Such a swap changes two steps only, by what fails both of the swapped filters and none
before them, which is a sum of cells. A filter's Shapley value is the sum of what it removes
over the walk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import WORD

#: The filters, in the order of their bits in a mask.
FILTERS = "ABCDE"
#: Thresholds: least words; least distinct words and most capitals, in percent; the symbols.
WORDS, DISTINCT, CAPITALS, SYMBOLS = 50, 65, 5, "[#$%&*|]"
#: Parts whose cells a task walks through together.
PARTS_AT_ONCE = 256
SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: the filters A to D that a text (not null) fails, each by the text alone."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    count = lambda c: c.cast("long")
    fails = (
        F.size(words) < WORDS,
        100 * count(F.size(F.array_distinct(words))) < DISTINCT * count(F.size(words)),
        100 * count(F.regexp_count(text, F.lit("[A-Z]"))) > CAPITALS * count(F.char_length(text)),
        text.rlike(SYMBOLS),
    )
    return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0)).cast("int")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """How many documents of each part fail exactly which filters: (part, mask, n, good, toxic).

    Equal texts are one by their SHA-256. Bit 4 of the mask is filter E: a smaller doc_id has
    the same text. Rows are summed up by (doc_id, text, part) before anything is joined, and
    by (text, part) before the ids of a text meet, so no task gets all the copies of a text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(
        F.col("doc_id").alias("id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        text_mask(text).alias("mask"),
    )
    rows = read.groupBy("id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marked = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("id"))
        .agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in ("quality", "toxic")])
        .where("quality = 1 OR toxic = 1")
    )
    counted = rows.where(F.col("id").isNotNull()).join(marked, "id", "left").select(
        "id", "digest", "part", "mask", "n", *[F.coalesce(F.col(c) * F.col("n"), F.lit(0)).alias(out) for c, out in (("quality", "good"), ("toxic", "toxic"))]
    )
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    # the first of a part's copies with its counts; the first of all parts is spared by E
    copies = counted.groupBy("digest", "part").agg(F.first("mask").alias("mask"), *sums, F.min(F.struct("id", "n", "good", "toxic")).alias("least"))
    spared = F.col("least.id") == F.min("least.id").over(Window.partitionBy("digest"))
    of = lambda c: F.when(spared, F.col(f"least.{c}")).otherwise(F.lit(0))
    split = copies.select("part", "mask", "n", "good", "toxic", *[of(c).alias(f"first_{c}") for c in ("n", "good", "toxic")])
    by_mask = split.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic", "first_n", "first_good", "first_toxic")])
    cell = lambda mask, n: F.struct(mask.alias("mask"), *[n(c).cast("long").alias(c) for c in ("n", "good", "toxic")])
    first = cell(F.col("mask"), lambda c: F.col(f"first_{c}"))
    later = cell(F.col("mask").bitwiseOR(F.lit(1 << FILTERS.index("E"))), lambda c: F.col(c) - F.col(f"first_{c}"))
    known = by_mask.select("part", F.inline(F.array(first, later)))
    zero = F.lit(0).cast("long")
    without = rows.where(F.col("id").isNull()).select("part", "mask", "n", zero.alias("good"), zero.alias("toxic"))
    return known.unionByName(without).groupBy("part", "mask").agg(*sums)


def swaps(n: int) -> Iterator[int]:
    """Places to swap with the next one, one after the other, so that all orders of n things are visited once."""
    place, ahead = list(range(n)), [-1] * n  # where each thing is and which way it moves
    order = list(range(n))
    while True:
        for thing in range(n - 1, -1, -1):
            at, to = place[thing], place[thing] + ahead[thing]
            if 0 <= to < n and order[to] < thing:
                break
        else:
            return
        other = order[to]
        order[at], order[to] = other, thing
        place[thing], place[other] = to, at
        for larger in range(thing + 1, n):
            ahead[larger] = -ahead[larger]
        yield min(at, to)


def walk(table: np.ndarray, filters: str = FILTERS) -> dict[str, np.ndarray]:
    """All orders, each with its steps, from cells: table[part, mask, (n, good, toxic)] of whole numbers.

    Returns `order` (order, step: a filter's number) and (part, order, step) arrays of `kept`,
    `removed`, `redundant`, `unique_fails`, `good_lost`, `toxic_lost` and `shapley`.
    """
    parts, masks, _ = table.shape
    n = len(filters)
    mask = np.arange(masks)
    fails = [(mask >> f & 1).astype(bool) for f in range(n)]
    all_failing = np.stack([table[:, fails[f], 0].sum(axis=1) for f in range(n)], axis=1)
    alone = np.stack([table[:, 1 << f, 0] for f in range(n)], axis=1)
    order = list(range(n))
    lost = np.empty((parts, n, 3), table.dtype)  # what each filter removes at its place now
    before = 0
    for f in order:
        lost[:, f] = table[:, fails[f] & (mask & before == 0)].sum(axis=1)
        before |= 1 << f
    many = math.factorial(n)
    orders = np.empty((many, n), np.int64)
    out = {c: np.empty((parts, many, n), table.dtype) for c in ("kept", "removed", "good_lost", "toxic_lost")}
    kept = table[:, :, 0].sum(axis=1)[:, None] - np.cumsum(lost[:, order, 0], axis=1)  # after each step
    shapley = np.zeros((parts, n), table.dtype)
    since = np.zeros(n, np.int64)  # the first order that has counted with what a filter removes now
    step = swaps(n)
    for k in range(many):
        orders[k] = order
        out["kept"][:, k] = kept
        for c, name in enumerate(("removed", "good_lost", "toxic_lost")):
            out[name][:, k] = lost[:, order, c]
        at = next(step, None)
        if at is None:
            break
        first, second = order[at], order[at + 1]
        before = sum(1 << f for f in order[:at])
        both = table[:, fails[first] & fails[second] & (mask & before == 0)].sum(axis=1)
        for f in (first, second):
            shapley[:, f] += lost[:, f, 0] * (k + 1 - since[f])
            since[f] = k + 1
        lost[:, first] -= both
        lost[:, second] += both
        kept[:, at] += lost[:, first, 0] + both[:, 0] - lost[:, second, 0]
        order[at], order[at + 1] = second, first
    shapley += lost[:, :, 0] * (many - since)
    out["redundant"] = all_failing[:, orders] - out["removed"]
    out["unique_fails"] = alone[:, orders]
    out["shapley"] = shapley[:, orders]
    return {"order": orders, **out}


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every order of the filters, step by step, by part: SCHEMA.

    docs needs doc_id, text and source, labels doc_id, quality and toxic; other columns are
    ignored. Null text is empty; an empty text fails A alone, and E if it isn't the first of
    the empty ones. A null source is the part '', with the sources of that name. Repeated rows
    are documents of their own; those of one id and text are all first or all later. A null
    doc_id is smaller than none, larger than none and has no labels. A repeated id in labels
    has each label that any of its rows has; labels other than 1, null too, count for nothing.
    Ties of texts go by doc_id. A part has 120 * 5 rows, zeros included; no documents, no rows.
    """
    part = F.collect_list(F.struct("mask", "n", "good", "toxic"))  # at most 32 of a part
    table = cells(docs, labels).groupBy("part").agg(part.alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), PARTS_AT_ONCE):
                some = batch.iloc[a : a + PARTS_AT_ONCE]
                grid = np.zeros((len(some), 1 << len(FILTERS), 3), np.int64)
                for k, found in enumerate(some["cells"]):
                    for c in found:
                        grid[k, c["mask"]] = c["n"], c["good"], c["toxic"]
                seen = walk(grid)
                many, n = seen["order"].shape
                names = ["".join(FILTERS[f] for f in o) for o in seen.pop("order")]
                frame = {
                    "part": np.repeat(some["part"].to_numpy(), many * n),
                    "filter_order": np.tile(np.repeat(names, n), len(some)),
                    "step": np.tile(np.arange(1, n + 1, dtype=np.int32), many * len(some)),
                }
                yield pd.DataFrame(frame | {c: v.reshape(-1) for c, v in seen.items()})

    return table.mapInPandas(run, SCHEMA)
