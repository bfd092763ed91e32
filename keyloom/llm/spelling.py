"""Spelling variants: words that differ by one code point, and the frequent form of each.

Two words differ by a replaced code point exactly if they give the same string when that
position is deleted from both, and by an inserted one exactly if one of them is the other with
a position deleted. So every word has a key for itself and one for each of its positions: a
polynomial hash of the string without it, which is the hash of what is before plus that of
what is behind, shifted by one. All positions of a batch of words are hashed at once by sums
over whole arrays.

Keys are dealt to partitions by their leading bits and sorted there. Only words whose keys
meet get their strings again, which then decide, so a collision of hashes links nothing.
A group of one key gives each member the number of its partners and the best of them, in
linear work; pairs aren't written out. Each pair of near words meets in one key.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Runs of these are words; runs of fewer letters than LETTERS never become one.
LETTERS_OF_A_WORD = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least code points and occurrences of a word; runs whose digest this divides lose a letter; how much more frequent a form is.
LETTERS, OCCURRENCES, SLIPS, FACTOR = 7, 2, 31, 10
#: Base of the hash, odd, and constants that mix its values.
BASE, MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Code points hashed at once, and rows of a batch given back.
CHUNK, ROWS = 1 << 20, 1 << 16


def words(docs: DataFrame, letters: int = LETTERS, least: int = OCCURRENCES, slips: int = SLIPS) -> DataFrame:
    """(word, n) of docs (doc_id, text): the runs of letters after their slips, with their occurrences."""
    run = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS_OF_A_WORD}]{{{letters},}}"), F.lit(0))
    lowered = docs.select(F.col("doc_id").cast("string").alias("id"), F.explode(runs).alias("run")).select("id", run.alias("run"))
    digest = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    told = lowered.withColumn("h", digest).select(F.when(F.col("h") % slips == 0, slipped).otherwise(F.col("run")).alias("word"))
    return told.where(F.char_length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _mixed(h: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes with the length of what was hashed, spread over all bits."""
    h = h + length.astype(np.uint64) * MIX2
    h = (h ^ (h >> np.uint64(30))) * MIX
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def deletion_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of words: (row of the word, position deleted or -1 for none, key, whether the letter before is the same)."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), length)
    start = np.concatenate(([0], np.cumsum(length)))
    place = np.arange(len(code)) - start[row]
    powers = np.ones(int(length.max(initial=0)) + 1, np.uint64)
    powers[1:] = BASE
    powers = np.cumprod(powers, dtype=np.uint64)
    value = (code + np.uint64(1)) * MIX
    whole = np.zeros(len(code) + 1, np.uint64)  # sums of value * base ** place
    np.cumsum(value * powers[place], out=whole[1:])
    behind = np.zeros(len(code) + 1, np.uint64)  # the same with every place one less
    np.cumsum(value * powers[np.maximum(place - 1, 0)], out=behind[1:])
    at = np.arange(len(code))
    without = whole[at] - whole[start[row]] + behind[start[row + 1]] - behind[at + 1]
    own = whole[start[1:]] - whole[start[:-1]]
    again = np.zeros(len(code), bool)
    again[1:] = (code[1:] == code[:-1]) & (place[1:] > 0)
    return (
        np.concatenate((np.arange(len(texts)), row)),
        np.concatenate((np.full(len(texts), -1), place)),
        np.concatenate((_mixed(own, length), _mixed(without, length[row] - 1))),
        np.concatenate((np.zeros(len(texts), bool), again)),
    )


def _keyed(vocabulary: DataFrame) -> DataFrame:
    """(key, place, again, id) of every word and position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            ends = np.cumsum([len(t) for t in texts])
            a = 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, side="right")))
                row, place, key, again = deletion_keys(texts[a:b])
                for k in range(0, len(row), ROWS):
                    s = slice(k, k + ROWS)
                    arrays = [pa.array(key[s].view(np.int64)), pa.array(place[s].astype(np.int32)), pa.array(again[s]), pa.array(ids[a + row[s]])]
                    yield pa.RecordBatch.from_arrays(arrays, names=["key", "place", "again", "id"])
                a = b

    return vocabulary.select("id", "word").mapInArrow(run, "key long, place int, again boolean, id long")


def _by_leading_bits(df: DataFrame, key: str, *order: str) -> DataFrame:
    """df dealt to partitions by the leading bits of `key`, and sorted in them by key and `order`."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.shiftright(F.shiftrightunsigned(F.col(key), 32) * F.lit(n).cast("long"), 32).cast("int")
    return df.repartitionById(n, bucket).sortWithinPartitions(key, *order)


def meeting(key: np.ndarray, place: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by (key, place), whole keys only: which may have partners by replacement, and which by insertion.

    By replacement: place and key are another row's too. By insertion: some row of the key is
    a word itself; a word that gives it by several places (a letter repeated) counts once.
    """
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    new_key = np.concatenate(([True], key[1:] != key[:-1]))
    new = new_key | np.concatenate(([True], place[1:] != place[:-1]))
    group = np.cumsum(new) - 1
    replaced = (np.bincount(group)[group] > 1) & (place >= 0)
    of = np.cumsum(new_key) - 1
    once = ~again
    itself = np.bincount(of, weights=place < 0) > 0
    several = np.bincount(of, weights=once) > 1
    return replaced, (itself & several)[of] & once


def _candidates(keyed: DataFrame) -> DataFrame:
    """(key, inserted, place, id) of the rows that share their key in a way that may make words near."""
    schema = pa.schema({"key": pa.int64(), "inserted": pa.bool_(), "place": pa.int32(), "id": pa.int64()})

    def some(key, place, again, ids):
        for inserted, keep in enumerate(meeting(key, place, again)):
            k = np.flatnonzero(keep)
            arrays = [pa.array(key[k]), pa.array(np.full(len(k), bool(inserted))), pa.array(place[k]), pa.array(ids[k])]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in (np.int64, np.int32, bool, np.int64)]
        for batch in batches:
            rows = [np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, batch.columns)]
            whole = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0  # the last key may go on
            yield from some(*[r[:whole] for r in rows])
            held = [r[whole:] for r in rows]
        yield from some(*held)

    return _by_leading_bits(keyed, "key", "place").mapInArrow(run, "key long, inserted boolean, place int, id long")


def partners(members: list[tuple[int, str, int, int]], inserted: bool) -> Iterator[tuple[int, int, int, str]]:
    """(id, near words, n of the best, the best) from one key's members (id, word, n, place); strings decide who belongs together."""
    groups: dict[str, list] = defaultdict(list)
    for member in members:
        _, word, _, place = member
        groups[word if place < 0 else word[:place] + word[place + 1 :]].append(member)
    for group in groups.values():
        if inserted:
            centre = [m for m in group if m[3] < 0]
            longer = [m for m in group if m[3] >= 0]
            if centre and longer:
                (c,) = centre  # words are distinct
                best = min(longer, key=lambda m: (-m[2], m[1]))
                yield c[0], len(longer), best[2], best[1]
                for m in longer:
                    yield m[0], 1, c[2], c[1]
        elif len(group) > 1:
            first, second = sorted(group, key=lambda m: (-m[2], m[1]))[:2]
            for m in group:
                best = second if m is first else first
                yield m[0], len(group) - 1, best[2], best[1]


def _partners(candidates: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, near, best_n, best): a row per word and key by which it has near words."""
    schema = pa.schema({"id": pa.int64(), "near": pa.int64(), "best_n": pa.int64(), "best": pa.string()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, name, out = [], None, []
        for batch in batches:
            for key, inserted, place, id_, word, n in zip(*[c.to_pylist() for c in batch.columns]):
                at = key, inserted, -1 if inserted else place
                if at != name:
                    out += partners(group, bool(name and name[1]))
                    group, name = [], at
                    if len(out) >= ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                        out = []
                group.append((id_, word, n, place))
        out += partners(group, bool(name and name[1]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    told = candidates.join(vocabulary, "id").select("key", "inserted", "place", "id", "word", "n")
    return _by_leading_bits(told, "key", "inserted", "place").mapInArrow(run, "id long, near long, best_n long, best string")


def _roots(found: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form. A form is `factor` times as frequent, so there are few rounds."""
    links = cut(found.where("form IS NOT NULL").select("word", "form"))
    following = links.select(F.col("word").alias("root"), F.col("form").alias("next"))
    moving, settled = links.select("word", F.col("form").alias("root")), []
    while True:
        moved = cut(moving.join(following, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")))
        settled.append(moved.where("NOT on").select("word", "root"))
        moving = moved.where("on").select("word", "root")
        if moving.isEmpty():
            break
    roots = settled[0]
    for more in settled[1:]:
        roots = roots.unionByName(more)
    return roots


def variants(docs: DataFrame, letters: int = LETTERS, least: int = OCCURRENCES, slips: int = SLIPS, factor: int = FACTOR) -> DataFrame:
    """Every word with its frequent form and its root: (word, form, root, n, n_near, form_n).

    docs needs doc_id and text; other columns are ignored. Null and empty texts have no
    words; a null doc_id counts as an empty one. Repeated rows count as often as they come.
    A form is the near word of largest n, of equal ones the first by code points, if its n is
    at least `factor` (over 1) times the word's. A word of any length is taken whole. An
    empty table gives an empty one.
    """
    if factor <= 1:
        raise ValueError("factor must be over 1, else forms may go round in circles")
    counted = words(docs, letters, least, slips)
    vocabulary = cut(counted.select("word", "n", F.monotonically_increasing_id().alias("id")))
    near = _partners(_candidates(_keyed(vocabulary)), vocabulary)
    best: Column = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    summed = near.groupBy("id").agg(F.sum("near").alias("n_near"), best.alias("best"))
    form = F.when(-F.col("best.less") >= F.lit(factor) * F.col("n"), F.struct(F.col("best.word").alias("word"), (-F.col("best.less")).alias("n")))
    found = cut(
        vocabulary.join(summed, "id", "left")
        .withColumn("form", form)
        .select("word", F.col("form.word").alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("form.n").alias("form_n"))
    )
    rooted = found.join(_roots(found), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
