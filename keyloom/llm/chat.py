"""Chat formatting at token level.

Each turn's text is escaped and encoded on its own; the marks of a turn are reserved ids,
which no text can produce, spliced around it. The loss mask comes from the running sums of
the segment lengths. The rendered text shows the reserved ids as control strings; where a
text itself contains such a string, it gets an escaping backslash, which reading takes off.

Turns are encoded and read back where they lie, a bounded part of a batch at a time. Only
then are they brought together by conversation, to stream by in order, so a task of that
stage holds one batch of turns and the running digests, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, utf8

#: Reserved ids, counted from the end of the vocabulary, and what they look like in the rendered text.
BEGIN, END = "<s>", "</s>"
INST, END_INST = "[INST] ", " [/INST]"
SYS, END_SYS = "<<SYS>>\n", "\n<</SYS>>\n"
OTHER, END_OTHER = "[ROLE=", "[/ROLE]"
CONTROL = (BEGIN, END, INST, END_INST, SYS, END_SYS, OTHER, "]", END_OTHER)
#: What is escaped in contents: anything that reads like a control string, with the backslashes before it.
_LIKE = re.compile(r"(\\*)(</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE[=\]])")
_ESCAPED = re.compile(r"\\(\\*)(</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE[=\]])")
#: The words of a byte-level tokenizer that splits by its standard pattern; white space and classes are Unicode's, spelt out where ASCII will do.
_WORDS = regex.compile(r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_ASCII_WORDS = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_SPLITS = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Bytes of words and their ids that a worker remembers.
REMEMBERED = 64 << 20


def escape(text: str) -> str:
    return _LIKE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def token_bytes(vocabulary: dict[str, int]) -> list[bytes]:
    """What each id of a byte-level vocabulary stands for: printable Latin-1 shows as itself, the other bytes as U+0100 and on."""
    shown = {b for lo, hi in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(lo), ord(hi) + 1)}
    others = (b for b in range(256) if b not in shown)
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    return out


class Codec:
    """Encodes segments; reserved ids follow the vocabulary.

    A tokenizer that only splits at byte-level words gives each word the same ids wherever it
    stands, so the library encodes a word once while it is remembered. Others encode whole segments.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.first = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.reserved = {c: self.first + i for i, c in enumerate(CONTROL)}
        made = json.loads(self.tokenizer.to_str())
        splits = {**(made["pre_tokenizer"] or {})}
        splits.pop("trim_offsets", None)
        self.by_word = splits == _SPLITS and made["normalizer"] is None and all(t["special"] for t in made["added_tokens"])
        self.bytes = token_bytes(self.tokenizer.get_vocab(with_added_tokens=True)) if self.by_word and (made["decoder"] or {}).get("type") == "ByteLevel" else None
        self.known, self.held = {}, 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.by_word:
            return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        words = [(_ASCII_WORDS if t.isascii() else _WORDS).findall(t) for t in texts]
        new = [w for w in set().union(*words) if w not in self.known]
        made = self.tokenizer.encode(new, is_pretokenized=True, add_special_tokens=False)
        at = np.searchsorted(np.array(made.word_ids, np.int64), np.arange(len(new) + 1)).tolist()
        ids = made.ids
        for word, a, b in zip(new, at, at[1:]):
            self.known[word] = ids[a:b]
        self.held += sum(map(len, new)) * 4 + 200 * len(new) + 40 * len(ids)
        out = [list(chain.from_iterable(map(self.known.__getitem__, own))) for own in words]
        if self.held > REMEMBERED:
            self.known, self.held = {}, 0
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        if self.bytes is None:
            return self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        return [b"".join(map(self.bytes.__getitem__, own)).decode("utf-8", "replace") for own in ids]

    def turn(self, role: str | None, content: list[int]) -> tuple[list[int], np.ndarray]:
        """The ids of a turn and the mask of those that count in the loss."""
        r = self.reserved
        if role == "assistant":
            before, after = [], [r[END]]
        elif role == "user":
            before, after = [r[BEGIN], r[INST]], [r[END_INST]]
        elif role == "system":
            before, after = [r[BEGIN], r[SYS]], [r[END_SYS]]
        else:
            name = self.encode([escape(role or "")])[0] if role else []
            before, after = [r[BEGIN], r[OTHER], *name, r["]"]], [r[END_OTHER]]
        bounds = np.cumsum([0, len(before), len(content), len(after)])
        mask = np.zeros(bounds[-1] + 1, dtype=np.int8)
        if role == "assistant":
            mask[bounds[1]] += 1
            mask[bounds[2]] -= 1
        return [*before, *content, *after], np.cumsum(mask)[:-1].astype(bool)

    def read(self, turns: list[tuple[list[int], np.ndarray]]) -> list[tuple[str, str, str, str]]:
        """Back from each turn's ids and mask: (role, text, text under the mask, rendered text)."""
        names, heads = {i: c for c, i in self.reserved.items()}, {self.reserved[INST]: "user", self.reserved[SYS]: "system", self.reserved[OTHER]: None}
        spans = []
        for ids, _ in turns:
            plain = np.concatenate(([False], np.array(ids) < self.first, [False]))
            spans.append(np.flatnonzero(plain[1:] != plain[:-1]).reshape(-1, 2).tolist())
        texts = iter(self.decode([ids[a:b] for (ids, _), own in zip(turns, spans) for a, b in own]))
        out = []
        for (ids, mask), own in zip(turns, spans):
            parts = {a: (b, next(texts)) for a, b in own}
            close = ids.index(self.reserved["]"]) if heads.get(ids[min(1, len(ids) - 1)], "") is None else -1
            role = heads.get(ids[1], "assistant") if ids[0] == self.reserved[BEGIN] else "assistant"
            if close >= 0:
                role = unescape("".join(t for a, (_, t) in parts.items() if a < close))
            body = "".join(t for a, (_, t) in parts.items() if a > close)
            loss = "".join(t for a, (b, t) in parts.items() if mask[a:b].all())
            shown, at = [], 0
            while at < len(ids):
                end, text = parts.get(at) or (at + 1, names[ids[at]])
                shown.append(text)
                at = end
            out.append((role, unescape(body), unescape(loss), "".join(shown)))
        return out


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _made(conversations: DataFrame, path: str, kinds: dict[str, str], columns) -> DataFrame:
    """conv_id, turn and more columns of every turn, which `columns` makes of (role, text, loss, shown) and (ids, mask) lists."""
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            _, offsets = utf8(batch.column(3))
            for a, b in chunks(offsets):
                part = batch.slice(a, b - a)
                made = [own.turn(role, ids) for role, ids in zip(part.column(2).to_pylist(), own.encode(list(map(escape, part.column(3).to_pylist()))))]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *columns(part, own.read(made), made)], names=["conv_id", "turn", *kinds])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([f"conv_id {types['conv_id']}", f"turn {types['turn']}", *[f"{n} {k}" for n, k in kinds.items()]]))


def format_turns(conversations: DataFrame, path: str) -> DataFrame:
    """Each turn assembled: (conv_id, turn, role, ids array<int>, loss_mask array<boolean>, formatted)."""

    def columns(part, read, made):
        ids, mask = pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1].tolist() for m in made], pa.list_(pa.bool_()))
        return [part.column(2), ids, mask, pa.array([r[3] for r in read], pa.string())]

    return _made(conversations, path, {"role": "string", "ids": "array<int>", "loss_mask": "array<boolean>", "formatted": "string"}, columns)


def read_back(conversations: DataFrame, path: str) -> DataFrame:
    """What the assembled conversations hold: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    conversations needs conv_id, turn, role, text; other columns are ignored. Null text is
    empty; a null role reads back as an empty one. Turns go by number, null first, and ties
    by role and text; repeated rows are turns of their own. All rows of a null conv_id are
    one conversation. Roles other than user, assistant and system are written out in full.
    Digests are over UTF-8. An empty table gives an empty table.
    """

    def columns(part, read, made):
        role, text, loss, shown = zip(*read) if read else ((),) * 4
        # the text under the mask only where it isn't the text
        other = [None if x == t else x for x, t in zip(loss, text)]
        return [pa.array(role, pa.string()), pa.array(text, pa.string()), pa.array(other, pa.string()), pa.array(list(map(len, shown)), pa.int64())]

    turns = _made(conversations, path, {"role": "string", "text": "string", "loss": "string", "shown": "long"}, columns)
    ordered = turns.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        at, state = None, None

        def close(key, s):
            return key, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]

        for batch in batches:
            kinds[0] = batch.column(0).type
            out = []
            for key, _, role, text, loss, shown in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or key != at:
                    if state is not None:
                        out.append(close(at, state))
                    at, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                loss = text if loss is None else loss
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += shown
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(close(at, state), kinds)], names=names)

    kind = dict(ordered.dtypes)["conv_id"]
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
