"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are runs of N bytes of the folded text, so that parts of words count and unseen
compounds are met. The vocabulary is all terms of the labelled sample that set its classes
apart significantly, as many as there are; document frequencies are those of the whole corpus.
Labelled examples stand in an inverted index: posting lists of (example, weight) by term, cut
into blocks. Each term knows its greatest weight in a block, so that a bound on a block's
cosines tells whether its postings must be read. Blocks are read from the highest bound down
until none can hold a nearer example: the neighbours are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, free_names, held_out, priors, sampled_labels, utf8
from .neighbours import Calibration, votes

#: Bytes of a term; labelled examples of each class at most; neighbours that vote.
N, PER_CLASS, NEIGHBOURS = 5, 2_048, 15
#: Terms are tested by chi-square at this level, divided by how many terms there are (Bonferroni).
LEVEL = 0.05
#: Examples of a block of the index; texts that are compared with it at once; neighbours given as evidence by the query.
BLOCK, AT_ONCE, EVIDENCE = 256, 256, 3
#: A text is toxic from this score on.
THRESHOLD = 0.5
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)


def _packed(data: np.ndarray) -> np.ndarray:
    """The term that starts at each byte, as an integer."""
    n = max(len(data) - N + 1, 0)
    folded = _FOLD[data].astype(np.uint64)
    packed = folded[:n].copy()
    for k in range(1, N):
        packed <<= np.uint64(8)
        packed |= folded[k : n + k]
    return packed


def _within(start: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each start, and which terms don't reach into the next text."""
    row = np.searchsorted(offsets, start, side="right") - 1
    return row, start + N <= offsets[row + 1]


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All terms of a chunk of texts, and the row of each."""
    packed = _packed(data)
    row, inside = _within(np.arange(len(packed)), offsets)
    return packed[inside], row[inside]


class Lookup:
    """Finds the terms of a vocabulary among many: a bit table first, then a search."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = np.sort(vocabulary.astype(np.uint64))
        self.bits = np.zeros(1 << 18, dtype=bool)
        self.bits[self._slot(self.vocabulary)] = True

    @staticmethod
    def _slot(terms: np.ndarray) -> np.ndarray:
        return ((terms * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, number of the term, how often) of a chunk of texts."""
        found = _packed(data)
        near = np.flatnonzero(self.bits[self._slot(found)])
        row, inside = _within(near, offsets)
        found, row = found[near[inside]], row[inside]
        at = np.minimum(np.searchsorted(self.vocabulary, found), max(len(self.vocabulary) - 1, 0))
        real = self.vocabulary[at] == found if len(self.vocabulary) else np.zeros(0, bool)
        key, count = np.unique(row[real] * np.int64(len(self.vocabulary)) + at[real], return_counts=True)
        return key // max(len(self.vocabulary), 1), key % max(len(self.vocabulary), 1), count


def weighted(rows: int, row: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weight of each entry, so that a row with any has length 1."""
    weight = (1 + np.log(count)) * idf[term]
    norm = np.sqrt(np.bincount(row, weights=weight**2, minlength=rows))
    return (weight / np.where(norm > 0, norm, 1)[row]).astype(np.float32)


class Index:
    """Block-max inverted index of labelled examples, given as entries (example, term, weight)."""

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, label: np.ndarray, ids: np.ndarray, size: int):
        n = len(label)
        # examples that share their heaviest term stand together, so that bounds are tight
        heaviest, greatest = np.full(n, size), np.zeros(n)
        by_weight = np.lexsort((-term, weight))
        heaviest[row[by_weight]], greatest[row[by_weight]] = term[by_weight], weight[by_weight]
        order = np.lexsort((ids, -greatest, heaviest))
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        self.label, self.ids, self.size = label[order].astype(np.float64), ids[order], size
        example = place[row]
        self.most = np.zeros((size, -(-n // BLOCK)), dtype=np.float32)
        np.maximum.at(self.most, (term, example // BLOCK), weight)
        # postings of a block: those of a term lie between two bounds
        self.blocks = []
        for b in range(self.most.shape[1]):
            own = np.flatnonzero(example // BLOCK == b)
            own = own[np.lexsort((example[own], term[own]))]
            self.blocks.append((np.searchsorted(term[own], np.arange(size + 1)), example[own] - b * BLOCK, weight[own]))
        self.entries = example, term, weight

    def cosines(self, b: int, rows: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Cosines of texts, given as entries, with all examples of a block, by its postings."""
        bounds, example, held = self.blocks[b]
        size = min(BLOCK, len(self.label) - b * BLOCK)
        many = bounds[term + 1] - bounds[term]
        at = np.arange(many.sum()) + np.repeat(bounds[term] - (np.cumsum(many) - many), many)
        sums = np.bincount(np.repeat(row * np.int64(size), many) + example[at], weights=np.repeat(weight, many) * held[at], minlength=rows * size)
        return np.round(sums.reshape(rows, size), 6)

    def nearest(self, n: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(cosine, place in the index) of the k nearest of n texts, ties to the first place; skip: a place to leave out.

        Texts are given as entries in the order of their rows. Cosines count to six digits; an
        example without a common term is no neighbour (place -1).
        """
        best, place = np.zeros((n, k)), np.full((n, k), -1)
        for start in range(0, n, AT_ONCE):
            end = min(n, start + AT_ONCE)
            a, b = np.searchsorted(row, [start, end])
            if a < b:
                own = None if skip is None else skip[start:end]
                best[start:end], place[start:end] = self._nearest(end - start, row[a:b] - start, term[a:b], weight[a:b], k, own)
        return best, place

    def _nearest(self, n, row, term, weight, k, skip):
        best, place = np.zeros((n, k)), np.full((n, k), -1)
        heads = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        bound = np.zeros((n, len(self.blocks)))
        bound[row[heads]] = np.add.reduceat(weight[:, None] * self.most[term], heads, axis=0) + 1e-5  # covers the rounding
        # first each text's most promising block, then the others in the order of their bounds
        first = bound.argmax(axis=1) if len(self.blocks) else np.zeros(n, int)
        for turn, b in [(0, b) for b in np.unique(first)] + [(1, b) for b in np.argsort(-bound.sum(axis=0), kind="stable")]:
            live = (bound[:, b] > 2e-5) & ((first == b) if turn == 0 else (first != b)) & (bound[:, b] >= best.min(axis=1))
            rows = np.flatnonzero(live)
            if not len(rows):
                continue
            mine = live[row]
            cosine = self.cosines(b, len(rows), (np.cumsum(live) - 1)[row[mine]], term[mine], weight[mine])
            start = b * BLOCK
            if skip is not None:
                own = skip[rows] - start
                some = np.flatnonzero((own >= 0) & (own < cosine.shape[1]))
                cosine[some, own[some]] = 0
            where = np.where(cosine > 0, np.arange(start, start + cosine.shape[1]), -1)
            # the place breaks ties far below the sixth digit
            every = np.concatenate([best[rows], np.where(where >= 0, cosine - where * 1e-11, 0)], axis=1)
            where = np.concatenate([place[rows], where], axis=1)
            top = np.argpartition(-every, k - 1, axis=1)[:, :k]
            best[rows], place[rows] = np.take_along_axis(every, top, 1), np.take_along_axis(where, top, 1)
        order = np.argsort(-best, axis=1, kind="stable")
        return np.round(np.take_along_axis(best, order, 1), 6), np.take_along_axis(place, order, 1)


class Model:
    def __init__(self, lookup: Lookup, idf: np.ndarray, index: Index, share: tuple[float, float], k: int):
        self.lookup, self.idf, self.index, self.k = lookup, idf, index, k
        self.middle = float(index.label.mean()) if len(index.label) else 0.5
        if len(index.label):
            row, term, weight = index.entries
            order = np.argsort(row, kind="stable")
            near, place = index.nearest(len(index.label), row[order], term[order], weight[order], k, skip=np.arange(len(index.label)))
            self.calibration = Calibration(self.vote(near, place), index.label, share)
        else:
            self.calibration = Calibration(np.zeros(0), np.zeros(0), share)

    def vote(self, near: np.ndarray, place: np.ndarray) -> np.ndarray:
        return votes(np.where(place >= 0, near, 0), self.index.label[place], self.middle)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, cosines, places) of a chunk of texts."""
        rows = len(offsets) - 1
        if not len(self.index.label):
            return self.calibration(np.zeros(rows)), np.zeros((rows, 0)), np.zeros((rows, 0), int)
        row, term, count = self.lookup.counts(data, offsets)
        near, place = self.index.nearest(rows, row, term, weighted(rows, row, term, count, self.idf), self.k)
        return self.calibration(self.vote(near, place)), near, place


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = utf8(batch.column(column))
    for a, b in chunks(offsets):
        part = offsets[a : b + 1]
        yield a, b, data[part[0] : part[-1]], part - part[0]


def _class_frequencies(sample: DataFrame) -> DataFrame:
    """(term, n0, n1): examples of each class that hold a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy()
            for a, _, data, offsets in _texts(batch, 0):
                term, row = terms(data, offsets)
                order = np.lexsort((row, term))
                term, row = term[order], row[order]
                new = np.ones(len(term), dtype=bool)
                new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
                term, one = term[new], label[a + row[new]]
                start = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, int)
                ones = np.add.reduceat(one, start).astype(np.int64) if len(start) else np.zeros(0, np.int64)
                every = np.diff(np.append(start, len(term)))
                yield pa.RecordBatch.from_arrays([pa.array(term[start].view(np.int64)), pa.array(every - ones), pa.array(ones)], names=["term", "n0", "n1"])

    return sample.select("text", "y").mapInArrow(run, "term long, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def least_chi_square(level: float) -> float:
    """The chi-square of one degree of freedom that chance exceeds with this probability."""
    low, high = 0.0, 1_400.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if math.erfc(math.sqrt(middle / 2)) > level else (low, middle)
    return high


def _vocabulary(sample: DataFrame, level: float) -> np.ndarray:
    """The terms whose chi-square between the sample's classes is significant, all of them."""
    total = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n0, n1 = float(total.get(0, 0)), float(total.get(1, 0))
    if not n0 or not n1:
        return np.zeros(0, np.uint64)
    share = (F.col("n1") + F.col("n0")) / (n0 + n1)
    chi = (F.col("n1") / n1 - F.col("n0") / n0) ** 2 / (share * (1 - share) * (1 / n0 + 1 / n1) + F.lit(1e-9))
    tested = cut(_class_frequencies(sample))
    rows = tested.where(chi >= least_chi_square(level / max(1, tested.count()))).select("term").orderBy("term").toArrow()  # terms of many examples of the bounded sample
    return rows["term"].to_numpy().view(np.uint64)


def _frequencies(docs: DataFrame, lookup: Lookup) -> tuple[np.ndarray, int]:
    """Documents of the whole corpus that hold each term of the vocabulary, and how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(len(lookup.vocabulary), dtype=np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, data, offsets in _texts(batch, 0):
                df += np.bincount(lookup.counts(data, offsets)[1], minlength=len(df))
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(df)), -1]), pa.array([*df.tolist(), rows])], names=["term", "n"])

    counted = {r["term"]: r["n"] for r in docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return np.array([counted.get(t, 0) for t in range(len(lookup.vocabulary))], dtype=np.float64), counted.get(-1, 0)


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", per_class: int = PER_CLASS, level: float = LEVEL, k: int = NEIGHBOURS) -> Model:
    """Learn from at most `per_class` labelled documents of each class; term frequencies are those of all docs.

    The model is bounded by the terms of 2 * per_class examples. Without a label of one class
    all texts get the other's share of the labels.
    """
    sample = cut(sampled_labels(docs, labels, target, per_class).groupBy("text").agg(F.max("y").alias("y"), F.min("doc_id").alias("doc_id")))  # copies are one example
    lookup = Lookup(_vocabulary(sample, level))
    df, n = _frequencies(docs, lookup) if len(lookup.vocabulary) else (np.zeros(0), 0)
    idf = np.log((1 + n) / (1 + df)) + 0.1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _texts(batch, 0):
                row, term, count = lookup.counts(data, offsets)
                bounds = pa.array(np.searchsorted(row, np.arange(b - a + 1)), pa.int32())
                listed = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int64())) for x in (term, count)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), *listed], names=["y", "doc_id", "term", "count"])

    share = priors(labels, target)
    examples = sample.select("text", "y", F.col("doc_id").cast("string").alias("doc_id"))
    none = np.zeros(0, np.int64)
    if not len(idf):
        return Model(lookup, idf, Index(none, none, np.zeros(0, np.float32), np.zeros(0), np.zeros(0, str), 0), share, k)
    found = examples.mapInArrow(run, "y int, doc_id string, term array<long>, count array<long>").orderBy("doc_id").toArrow()  # bounded by the sample
    sizes = found["term"].combine_chunks().value_lengths().to_numpy()
    term, count = (found[c].combine_chunks().flatten().to_numpy() for c in ("term", "count"))
    row = np.repeat(np.arange(len(sizes)), sizes)
    weight = weighted(len(sizes), row, term, count, idf)
    return Model(lookup, idf, Index(row, term, weight, found["y"].to_numpy(), np.array(found["doc_id"].to_pylist(), dtype=object), len(idf)), share, k)


def score(docs: DataFrame, model: Model, into: str = "toxicity", evidence: str | None = None, most: int = NEIGHBOURS) -> DataFrame:
    """docs with a column `into`, 0 to 1, and, if named, `evidence`: (doc_id, cosine, label) of the nearest that voted, at most `most`.

    Only text is read; null text counts as empty. A text without a term of the vocabulary
    gets the calibrated score of no evidence. Rows are independent; columns are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the settings of fit
    names = [f"_{i}" for i in range(len(docs.columns))]
    text = docs.columns.index("text")
    made = [into, *([evidence] if evidence else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for a, b, data, offsets in _texts(batch, text):
                got, near, place = own.score(data, offsets)
                columns = [pa.array(got, pa.float64())]
                if evidence:
                    near, place = near[:, :most], place[:, :most]
                    voted = (place >= 0) & (near > 0)
                    bounds = np.concatenate(([0], np.cumsum(voted.sum(axis=1))))
                    seen = place[voted]
                    parts = [pa.array(own.index.ids[seen], pa.string()), pa.array(near[voted], pa.float64()), pa.array(own.index.label[seen].astype(np.int32))]
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(parts, ["doc_id", "cosine", "label"])))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), *columns], names=[*names, "toxicity", *["evidence"] * bool(evidence)])

    schema = ", ".join(f"{n} {kind}" for n, (_, kind) in zip(names, docs.dtypes)) + ", toxicity double" + ", evidence array<struct<doc_id: string, cosine: double, label: int>>" * bool(evidence)
    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns, *made)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every document, learnt from `labels.toxic`.

    Labels of documents whose crc32(doc_id as text) mod 5 is 0, and null labels, are never
    learnt from. A null doc_id counts as not held out. evidence: the nearest labelled examples
    and their cosines. Repeated rows give repeated results; an empty table gives an empty table.
    """
    rows = docs.select("doc_id", "text")
    scored = score(rows, fit(rows, labels), "score", "evidence", EVIDENCE)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score is under the threshold, columns unchanged.

    Null and empty texts have no evidence and are scored so; rows with a null, repeated or
    unlabelled doc_id are scored like any other, since ids only find labels. Repeated rows
    stay or go together. Without labels of both classes all rows get one score. An empty
    table gives an empty one.
    """
    (into,) = free_names(docs, "__toxicity")
    scored = score(docs, fit(docs.select("doc_id", "text"), labels), into)
    return scored.where(F.col(into) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
