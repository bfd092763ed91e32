"""BPE encoding and decoding by speculation and verification.

For a word, greedy longest match proposes tokens. A sequence of tokens is what the merges
give exactly if each token is what the merges make of its own text and each pair of
neighbours stays apart when merged on its own. Both are checked for all proposals of a
batch with array operations; only the words that fail are merged step by step.

Works on vocabularies in the `tokenizers` JSON format whose words end in a suffix, with the
normalizers NFC, white space to one space, and lower case.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import chunks, utf8

#: Stands for the word end inside this module; not a character of the byte alphabet.
END = "￿"
#: A worker forgets its words beyond so many bytes of them.
REMEMBERED = 256 << 20
#: Symbols of a word beyond which it is merged on its own.
LONG = 64
NOT_SPACE, SPACE = "\x1c\x1d\x1e\x1f", regex.compile(r"\s+")


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else extra))
        extra += b not in shown
    return out


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.shown = [""] * (1 + max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in model["vocab"].items():
            self.shown[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.shown[i] = token
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern).findall
        self.bytes = byte_alphabet()
        own = {self._inner(token): i for token, i in model["vocab"].items()}
        self.ids = own
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            a, b = self._inner(a), self._inner(b)
            if a in own and b in own and a + b in own:
                self.pairs[own[a], own[b]] = rank, own[a + b]
        self.tables()
        self.known: dict[str, tuple[bytes, str]] = {}
        self.run_ids: dict[str, bytes] = {}
        self.run_shown: dict[str, str] = {}
        self.held = 0

    def _inner(self, token: str) -> str:
        return token[: -len(self.suffix)] + END if token.endswith(self.suffix) and len(token) > len(self.suffix) else token

    def letters(self, word: str) -> list[int]:
        """The ids of a word's single symbols; the last carries the word end."""
        body = word[:-1] if word.endswith(END) else word
        out = [self.ids[c] for c in body]
        if word.endswith(END):
            out[-1] = self.ids[body[-1] + END]
        return out

    def tables(self) -> None:
        """For every token that merges make: the rank that made it and the two parts it was made of."""
        size = len(self.shown)
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.made = np.full(size, -1)
        for (a, b), (rank, i) in self.pairs.items():
            if self.made[i] < 0 or rank < self.made[i]:
                self.made[i], self.left[i], self.right[i] = rank, a, b
        keys = np.array([a * size + b for a, b in self.pairs], dtype=np.int64)
        ranks = np.array([r for r, _ in self.pairs.values()], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], ranks[order]
        self.pair_made = np.array([i for _, i in self.pairs.values()], dtype=np.int64)[order]
        tokens = [(t, i) for t, i in self.ids.items() if t != END]
        self.lengths = np.zeros(size, dtype=np.int64)
        self.finder = ahocorasick.Automaton()
        for (t, i), made in zip(tokens, self.merge_all([self.letters(t) for t, _ in tokens])):
            self.lengths[i] = len(t)
            if made == [i]:
                self.finder.add_word(t, i)
        self.finder.make_automaton()

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; a number above all ranks where there is no such merge."""
        key = a.astype(np.int64) * len(self.shown) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.int64(1) << 60)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave each pair of neighbouring tokens as it is.

        Undo the later of the two tokens' last merges, again and again. Just before that
        merge, the two parts at the seam stood next to each other; had their own merge come
        earlier, the token would not have been made. For equal ranks the left one is first.
        """
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        limit = np.full(len(a), np.int64(1) << 59)
        ok = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            bad = self.rank_of(x, y) < limit[live]
            ok[live[bad]] = False
            rx, ry = self.made[x], self.made[y]
            on = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[on], x[on], y[on], rx[on], ry[on]
            undo_left = rx > ry
            # before the left token's merge the seam pair must not have come first, at its rank or below: the left part's
            # own merge stands further left and wins ties; on the right a tie goes to the seam
            limit[live] = np.where(undo_left, rx, ry + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
        return ok

    def merge_long(self, symbols: list[int]) -> list[int]:
        """Merge one word exactly, in about its length: the pair of lowest rank, the leftmost of them, comes off a heap."""
        pairs, n = self.pairs, len(symbols)
        symbols, after, before = list(symbols), [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(pairs[p][0], k, *p) for k, p in enumerate(zip(symbols, symbols[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, k, x, y = heapq.heappop(heap)
            j = after[k]
            if symbols[k] != x or j < 0 or symbols[j] != y:
                continue  # one of them has gone into another merge
            symbols[k], symbols[j] = pairs[x, y][1], -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right >= 0 and (p := (symbols[left], symbols[right])) in pairs:
                    heapq.heappush(heap, (pairs[p][0], left, *p))
        return [s for s in symbols if s >= 0]

    def merge_all(self, words: list[list[int]]) -> list[list[int]]:
        """Merge exactly: every round merges, in all short words at once, the leftmost of the pairs of lowest rank."""
        if any(len(w) > LONG for w in words):
            short = iter(self.merge_all([w for w in words if len(w) <= LONG]))
            return [self.merge_long(w) if len(w) > LONG else next(short) for w in words]
        never = np.int64(1) << 60
        symbols = np.array([i for w in words for i in w], dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), list(map(len, words)))
        ranks = np.full(len(symbols), never)
        same = np.flatnonzero(owner[:-1] == owner[1:])
        ranks[same] = self.rank_of(symbols[same], symbols[same + 1])
        done: list[list[int]] = [[] for _ in words]
        while len(symbols):
            start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            length = np.diff(np.append(start, len(symbols)))
            low = np.minimum.reduceat(ranks, start)
            for k in np.flatnonzero(low == never):
                done[owner[start[k]]] = symbols[start[k] : start[k] + length[k]].tolist()
            each = np.repeat(low, length)
            live = each < never
            hit = np.flatnonzero(live & (ranks == each))
            hit = hit[np.unique(owner[hit], return_index=True)[1]]
            symbols[hit] = self.pair_made[np.searchsorted(self.pair_keys, symbols[hit] * len(self.shown) + symbols[hit + 1])]
            live[hit + 1] = False
            ranks[hit] = ranks[hit + 1]
            moved = np.cumsum(live) - 1
            at = moved[hit]
            symbols, owner, ranks = symbols[live], owner[live], ranks[live]
            before = at[(at > 0) & (owner[at - 1] == owner[at])] - 1
            after = at[at + 1 < len(owner)]
            after = after[owner[after + 1] == owner[after]]
            ranks[at] = never
            for seam in (before, after):
                ranks[seam] = self.rank_of(symbols[seam], symbols[seam + 1])
        return done

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet."""
        inner = ["".join(map(self.bytes.__getitem__, w.encode())) + END for w in words]
        ids: list[int] = []
        ends: list[int] = []
        for w in inner:
            ids.extend([i for _, i in self.finder.iter_long(w)])
            ends.append(len(ids))
        flat, stop = np.array(ids, dtype=np.int64), np.array(ends, dtype=np.int64)
        start = np.concatenate(([0], stop[:-1]))
        inside = np.ones(max(0, len(flat) - 1), dtype=bool)
        inside[stop[(stop > 0) & (stop < len(flat))] - 1] = False
        at = np.flatnonzero(inside)
        wrong = at[~self.apart(flat[at], flat[at + 1])]
        covered = np.concatenate(([0], np.cumsum(self.lengths[flat])))
        bad = covered[stop] - covered[start] != np.array(list(map(len, inner)))
        bad[np.searchsorted(stop, wrong, side="right")] = True
        failed = np.flatnonzero(bad).tolist()
        exact = dict(zip(failed, self.merge_all([self.letters(inner[k]) for k in failed])))
        shown = self.shown
        for k, word in enumerate(words):
            got = exact[k] if k in exact else ids[start[k] : stop[k]]
            self.known[word] = np.array(got, dtype="<u4").tobytes(), " ".join([shown[i] for i in got])
            self.held += 8 * len(word) + 200

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def pieces(self, text: str) -> list[str]:
        """The runs of a text between white space, which no word crosses; special tokens stand as themselves."""
        if any(s in text for s in self.special):
            out = []
            for part in self.split_special.split(text):
                out += [part] if part in self.special else self.runs(self.normal(part))
            return out
        return self.runs(self.normal(text))

    def runs(self, text: str) -> list[str]:
        # str.split also splits at the separators 1C to 1F, which are not white space to the pattern
        return SPACE.split(text) if any(c in text for c in NOT_SPACE) else text.split()

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and the decoded text."""
        if self.held > REMEMBERED:
            self.known, self.run_ids, self.run_shown, self.held = {}, {}, {}, 0
        for s, i in self.special.items():
            self.run_ids[s], self.run_shown[s] = np.array([i], dtype="<u4").tobytes(), s
        split = [self.pieces(t) for t in texts]
        ids, shown = self.run_ids, self.run_shown
        words = {r: self.words(r) for r in set().union(*split) if r not in ids}
        unknown = {w for ws in words.values() for w in ws if w not in self.known}
        if unknown:
            self.learn(list(unknown))
        known = self.known
        for r, ws in words.items():
            got = [known[w] for w in ws]
            self.held += 8 * len(r) + 300
            ids[r], shown[r] = got[0] if len(got) == 1 else (b"".join([g[0] for g in got]), " ".join([g[1] for g in got]))
        for runs in split:
            yield b"".join(map(ids.__getitem__, runs)), " ".join(filter(None, map(shown.__getitem__, runs)))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """A worker reads a vocabulary once."""
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("n_tokens", "ids_sha256", "decoded_sha256"), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode every whole text and decode it again.

    docs needs text and the columns in `keep`, which are carried along. outputs: any of ids
    (array<int>), decoded (string), n_tokens, ids_sha256, decoded_sha256. Null text is encoded
    as an empty one; the empty text has no tokens and decodes to an empty text. Rows are
    independent, so repeated rows give repeated results and an empty table an empty one.
    path is read on the executors.
    """
    kinds = {"ids": "array<int>", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    arrow = {"ids": pa.list_(pa.int32()), "decoded": pa.string(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    outputs, keep = list(outputs), list(keep)
    source = docs.select(*[docs[f"`{c}`"].alias(f"__{i}") for i, c in enumerate(keep)], docs["text"].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            _, offsets = utf8(texts)
            for a, b in chunks(offsets):
                got = {name: [] for name in outputs}
                for ids, decoded in vocab.encode([t or "" for t in texts.slice(a, b - a).to_pylist()]):
                    for name, column in got.items():
                        if name == "n_tokens":
                            column.append(len(ids) // 4)
                        elif name == "ids_sha256":
                            column.append(hashlib.sha256(ids).hexdigest())
                        elif name == "decoded_sha256":
                            column.append(hashlib.sha256(decoded.encode()).hexdigest())
                        else:
                            column.append(np.frombuffer(ids, "<u4").astype(np.int32) if name == "ids" else decoded)
                kept = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                made = [pa.array(got[name], arrow[name]) for name in outputs]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*[f"__{i}" for i in range(len(keep))], *[f"_{n}" for n in outputs]])

    types = dict(source.dtypes)
    schema = ", ".join([*[f"__{i} {types[f'__{i}']}" for i in range(len(keep))], *[f"_{n} {kinds[n]}" for n in outputs]])
    return source.mapInArrow(run, schema).toDF(*keep, *outputs)
