"""Quality from the nearest labelled examples in a latent-semantic space.

Terms are trigrams of character classes (letters by case, digits, white space, each common
punctuation mark) and words that repeat one of the two before them: how a text is written,
not what about. TF-IDF vectors of a bounded labelled sample give the latent axes by a
truncated singular value decomposition; document frequencies are those of the whole corpus.
The labelled vectors are broadcast; every document's cosines with all of them are exact
matrix products, block by block, and its nearest vote with their similarity as weight: its
16th power, since cosines lie close together in this space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, free_names, held_out, priors, sampled_labels, utf8
from .neighbours import Calibration, votes

#: Labelled examples of each class at most; latent axes; neighbours that vote.
PER_CLASS, AXES, NEIGHBOURS = 2_048, 32, 15
#: Labelled vectors of a block of products; texts whose counts are held at once.
BLOCK, AT_ONCE = 1_024, 512
#: A text is good from this score on.
THRESHOLD = 0.3
#: Classes of bytes, in order: other, lower, upper, beyond ASCII, digit, blank, line end, then a class for each mark.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[]_{|}"
CLASSES = 7 + len(_MARKS)
TERMS = CLASSES**3 + 3


def _class_of(b: int) -> int:
    c = chr(b)
    if b >= 128:
        return 3
    if c.isalpha():
        return 2 if c.isupper() else 1
    if c.isdigit():
        return 4
    if c in "\n\r":
        return 6
    if c in " \t\v\f":
        return 5
    return 7 + _MARKS.index(c) if c in _MARKS else 0


_CLASS = np.array([_class_of(b) for b in range(256)], dtype=np.int32)
_SPREAD = np.random.default_rng(11).integers(1, 1 << 63, size=(256,), dtype=np.uint64)
_PLACE = np.random.default_rng(12).integers(1, 1 << 63, size=(64,), dtype=np.uint64) | np.uint64(1)


def _keys(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(terms, where each starts): all trigrams that lie within a text, then the repeated words, then all words."""
    kind = _CLASS[data]
    if len(kind) >= 3:
        gram = (kind[:-2] * CLASSES + kind[1:-1]) * CLASSES + kind[2:]
        ends = offsets[1:-1]
        across = np.concatenate([ends - 1, ends - 2])
        gram[across[(across >= 0) & (across < len(gram))]] = -1
        yield gram, np.arange(len(gram))
    # a word is the sum of a number for each of its bytes at its place
    word = (kind != 5) & (kind != 6)
    new = word.copy()
    new[1:] &= ~word[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    new[heads] = word[heads]
    starts = np.flatnonzero(new)
    if len(starts):
        place = np.arange(len(data), dtype=np.int32)
        place -= np.maximum.accumulate(np.where(new, place, 0))
        value = _SPREAD[data] * _PLACE[place & 63]
        value[~word] = 0
        hashed = np.add.reduceat(value, starts)
        row = np.searchsorted(offsets, starts, side="right") - 1
        for back in (1, 2):
            again = np.flatnonzero((hashed[back:] == hashed[:-back]) & (row[back:] == row[:-back])) + back
            yield np.full(len(again), CLASSES**3 + back - 1), starts[again]
        yield np.full(len(starts), CLASSES**3 + 2), starts


def counts(data: np.ndarray, offsets: np.ndarray, number: np.ndarray, kept: int) -> np.ndarray:
    """How often each kept term occurs in each text of a chunk. number: each term's column, -1 if not kept."""
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(offsets))
    out = np.zeros(rows * kept)
    for term, start in _keys(data, offsets):
        column = number[term]
        column[term < 0] = -1
        held = np.flatnonzero(column >= 0)
        out += np.bincount(row[start[held]] * np.int64(kept) + column[held], minlength=rows * kept)
    return out.reshape(rows, kept)


def frequencies(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many texts of a chunk hold each term."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keys = [row[start] * np.int64(TERMS) + np.where(term < 0, -TERMS * len(offsets), term) for term, start in _keys(data, offsets)]
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return np.bincount(key[key >= 0] % TERMS, minlength=TERMS)


def weighted(count: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length 1; tf is the root of a term's occurrences per byte."""
    out = (np.sqrt(count / np.maximum(np.diff(offsets), 1)[:, None]) * idf).astype(np.float32)
    return _unit(out)


def latent_axes(vectors: np.ndarray, axes: int) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    axes = min(axes, *vectors.shape)
    base = np.random.default_rng(0).standard_normal((vectors.shape[1], axes + min(8, max(0, min(vectors.shape) - axes)))).astype(np.float32)
    for _ in range(6):
        base, _ = np.linalg.qr(vectors.T @ (vectors @ base))
    _, _, turn = np.linalg.svd(vectors @ base, full_matrices=False)
    return (base @ turn.T)[:, :axes].astype(np.float32)


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    return vectors / np.where(norm > 0, norm, 1)


class Model:
    def __init__(self, number: np.ndarray, idf: np.ndarray, vectors: np.ndarray, label: np.ndarray, share: tuple[float, float], axes: int, k: int):
        self.number, self.idf, self.label, self.k = number, idf, label.astype(np.float64), k
        self.middle = float(label.mean()) if len(label) else 0.5
        if not len(label):
            self.calibration = Calibration(np.zeros(0), np.zeros(0), share)
            return
        self.axes = latent_axes(vectors, axes)
        self.examples = _unit(vectors @ self.axes)
        self.calibration = Calibration(self.vote(self.examples, np.arange(len(label))), label, share)

    def vote(self, latent: np.ndarray, skip: np.ndarray | None = None) -> np.ndarray:
        """The neighbours' vote for rows of unit length; skip: an example to leave out."""
        n, k = len(latent), self.k
        best, place = np.zeros((n, 0)), np.zeros((n, 0), dtype=np.int64)
        for start in range(0, len(self.examples), BLOCK):
            part = self.examples[start : start + BLOCK]
            # six digits count; the place breaks ties
            cosine = np.round((latent @ part.T).astype(np.float64), 6) - np.arange(start, start + len(part)) * 1e-11
            if skip is not None:
                mine = np.flatnonzero((skip >= start) & (skip < start + len(part)))
                cosine[mine, skip[mine] - start] = -2
            top = np.argpartition(-cosine, min(k, len(part)) - 1, axis=1)[:, :k]
            best, place = np.concatenate([best, np.take_along_axis(cosine, top, 1)], axis=1), np.concatenate([place, top + start], axis=1)
        top = np.argpartition(-best, min(k, best.shape[1]) - 1, axis=1)[:, :k]
        best, place = np.take_along_axis(best, top, 1), np.take_along_axis(place, top, 1)
        return votes(np.maximum(best, 0) ** 8, self.label[place], self.middle)  # votes squares it: the 16th power

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not len(self.label):
            return self.calibration(np.zeros(len(offsets) - 1))
        found = weighted(counts(data, offsets, self.number, len(self.idf)), offsets, self.idf)
        return self.calibration(self.vote(_unit(found @ self.axes)))


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = utf8(batch.column(column))
    for a, b in chunks(offsets, rows=AT_ONCE):
        part = offsets[a : b + 1]
        yield a, b, data[part[0] : part[-1]], part - part[0]


def _vocabulary(sample: DataFrame, least: int = 5) -> np.ndarray:
    """Each term's column, -1 for the terms that fewer than `least` labelled examples hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(TERMS, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in _texts(batch, 0):
                df += frequencies(data, offsets)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["term", "n"])

    found = sample.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    kept = sorted(r["term"] for r in found.where(F.col("n") >= least).collect())  # at most TERMS
    number = np.full(TERMS, -1, dtype=np.int32)
    number[kept] = np.arange(len(kept))
    return number


def _document_frequencies(docs: DataFrame, number: np.ndarray) -> tuple[np.ndarray, int]:
    """Documents of the whole corpus that hold each kept term, and how many documents there are."""
    kept = int(number.max(initial=-1)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(kept, dtype=np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, data, offsets in _texts(batch, 0):
                df += (counts(data, offsets, number, kept) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([*range(kept), -1]), pa.array([*df.tolist(), rows])], names=["term", "n"])

    summed = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in summed.collect()}  # at most TERMS rows
    return np.array([found.get(t, 0) for t in range(kept)], dtype=np.float64), found.get(-1, 0)


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", per_class: int = PER_CLASS, axes: int = AXES, k: int = NEIGHBOURS) -> Model:
    """Learn from at most `per_class` labelled documents of each class; term frequencies are those of all docs.

    The model is bounded by 2 * per_class vectors of `axes` numbers and the axes.
    """
    found = sampled_labels(docs, labels, target, per_class)
    # copies are one example, else each would be its own copy's nearest neighbour when the votes are calibrated
    sample = cut(found.groupBy("text").agg(F.max("y").alias("y"), F.min("doc_id").alias("doc_id")))
    number = _vocabulary(sample)
    kept = int(number.max(initial=-1)) + 1
    df, n = _document_frequencies(docs, number)
    idf = (np.log((1 + n) / (1 + df)) + 0.5).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _texts(batch, 0):
                found = weighted(counts(data, offsets, number, kept), offsets, idf)
                row, term = np.nonzero(found)
                bounds = pa.array(np.searchsorted(row, np.arange(b - a + 1)), pa.int32())
                listed = [pa.ListArray.from_arrays(bounds, x) for x in (pa.array(term, pa.int32()), pa.array(found[row, term]))]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), *listed], names=["y", "doc_id", "term", "weight"])

    kind = dict(sample.dtypes)["doc_id"]
    found = sample.select("text", "y", "doc_id").mapInArrow(run, f"y int, doc_id {kind}, term array<int>, weight array<float>").orderBy("doc_id", "y").toArrow()  # bounded by the sample
    label = found["y"].to_numpy() if kept else np.zeros(0)
    vectors = np.zeros((len(label), kept), np.float32)
    if len(label):
        row = np.repeat(np.arange(len(label)), found["term"].combine_chunks().value_lengths().to_numpy())
        term, weight = (found[c].combine_chunks().flatten().to_numpy() for c in ("term", "weight"))
        vectors[row, term] = weight
    return Model(number, idf, vectors, label, priors(labels, target), axes, k)


def score(docs: DataFrame, model: Model, into: str = "quality") -> DataFrame:
    """docs with a column `into`, 0 to 1; columns are kept. Only text is read; null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the settings of fit
    names = [f"_{i}" for i in range(len(docs.columns))]
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for a, b, data, offsets in _texts(batch, text):
                got = pa.array(own.score(data, offsets), pa.float64())
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), got], names=[*names, "quality"])

    schema = ", ".join(f"{n} {kind}" for n, (_, kind) in zip(names, docs.dtypes)) + ", quality double"
    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns, into)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learnt from `labels.quality`.

    Labels of documents whose crc32(doc_id as text) mod 5 is 0, and null labels, are never
    learnt from. A null doc_id counts as not held out. Repeated rows give repeated results;
    an empty table gives an empty table. Without labels of both classes every score is the
    smoothed share of label 1.
    """
    rows = docs.select("doc_id", "text")
    scored = score(rows, fit(rows, labels), "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_poor(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score reaches the threshold, columns unchanged.

    Null and empty texts are scored like any other; rows with a null, repeated or unlabelled
    doc_id too, since ids only find labels. Repeated rows stay or go together. Without labels
    of both classes the share of label 1 decides for all. An empty table gives an empty one.
    """
    (into,) = free_names(docs, "__quality")
    scored = score(docs, fit(docs.select("doc_id", "text"), labels), into)
    return scored.where(F.col(into) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
