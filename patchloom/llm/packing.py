"""Pack tokenised documents into sequences, in order, by dynamic programming.

The documents of a partition form one token stream. Cuts may fall at document
ends (free), sentence ends (small penalty) and, inside long sentences, at word
ends (larger penalty). ``best_cuts`` picks the cuts that minimise padding plus
penalties; every window holds at most ``max_tokens``. With positions p and
costs f, ``f[j] = min(f[i] + p[i]) + max_tokens - p[j] + penalty[j]`` over the
window's cuts i, so the minimum slides and a monotone queue serves each cut in
amortised constant time. What is left at the end of a partition is cut into
windows whose lengths are powers of two, which need no padding.

One map over the scan: no shuffle, and memory of a chunk of documents. Sequence
ids hold the partition number in the high 32 bits; a retried task reads the
same rows and gives the same ids.

Defined results: a null or empty text is the end token alone; repeated rows are
separate documents; a null doc_id is kept; other columns are not read. A word
longer than ``max_tokens`` ids is cut inside.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

MAX_TOKENS = 2048
END_ID = 1
SENTENCE_PENALTY = 1
WORD_PENALTY = 6
#: Inside a sentence a cut is offered after this many ids.
WORD_STEP = 24
#: Tokens that one run of the dynamic program looks at.
CHUNK_TOKENS = 400_000
CACHED_WORDS = 400_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: The normaliser and pre-tokeniser for which ``_Parts`` holds.
PLAIN_NORMALIZER = ["NFC", "Replace", "Lowercase"]
PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Parts:
    """Ids of plain words by the tokenizer's model alone, each distinct part encoded once.

    Plain are words of ASCII and Latin-1 letters, digits and ASCII marks: they are in NFC, lower-cased
    letter by letter, and split here as the tokenizer splits them. Other words, and words that may hold
    a special token, go through the whole tokenizer.
    """

    split = staticmethod(re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+").findall)

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.known: dict[str, tuple[int, ...]] = {}
        # a byte's letter in the vocabulary: itself if printable, else the next from U+0100 on
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letter = {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(sorted({*range(256)} - {*printable}))}
        self.letters = {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}

    @staticmethod
    def fit(tokenizer: Tokenizer) -> bool:
        """Whether the tokenizer is of the kind that this class knows."""
        spec = json.loads(tokenizer.to_str())
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        same = len(cuts) == 2 and cuts[0].get("pattern") == {"Regex": PLAIN_SPLIT} and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
        bytes_only = same and cuts[1]["type"] == "ByteLevel" and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]
        special = all(t["content"].startswith("<|") for t in spec["added_tokens"])
        return bool(bytes_only and special and steps == PLAIN_NORMALIZER and spec["post_processor"] is None)

    def of(self, words: list[str]) -> tuple[list[int], list[int]]:
        """The ids of all words, one after the other, and the number of each word's."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        flat, sizes = [], []
        known, split, tokenize, letters = self.known, self.split, self.tokenizer.model.tokenize, self.letters
        for w in words:
            low, before = w.lower(), len(flat)
            parts = (low,) if low.isascii() and low.isalpha() else split(low)
            if "".join(parts) != low or "<|" in w:
                flat += self.tokenizer.encode(w, add_special_tokens=False).ids
            else:
                for p in parts:
                    got = known.get(p)
                    if got is None:
                        got = known[p] = tuple([t.id for t in tokenize(p if p.isascii() else p.translate(letters))])
                    flat += got
            sizes.append(len(flat) - before)
        return flat, sizes


class _Codes(dict):
    """Words' numbers, given out in the order of their first lookup; ``fresh`` lists the new ones."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class WordTokenizer:
    """Ids of white-space separated words, each distinct word encoded once.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its words.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.parts = _Parts(self.tokenizer) if _Parts.fit(self.tokenizer) else None
        self.clear()

    def clear(self) -> None:
        self.code = _Codes()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.size, self.stop = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, bool)

    def learn(self) -> None:
        """Encode the words that have a number but no ids yet."""
        words, self.code.fresh = self.code.fresh, []
        if not words:
            return
        texts = [w.decode() for w in words]
        if self.parts:
            ids, sizes = self.parts.of(texts)
        else:
            each = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            ids, sizes = list(chain.from_iterable(each)), list(map(len, each))
        size = np.array(sizes, np.int64)
        n = len(self.code)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n > len(self.first):
            self.first, self.size, self.stop = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size, self.stop))
        self.flat[self.used : self.used + len(ids)] = ids
        here = slice(n - len(words), n)
        self.first[here] = self.used + np.cumsum(size) - size
        self.size[here] = size
        self.stop[here] = [w.rstrip(b"\"')]").endswith((b".", b"!", b"?")) for w in words]
        self.used += len(ids)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids with an end id after each text; each text's count; word ends; which of these end sentences."""
        if len(self.code) > CACHED_WORDS:
            self.clear()
        split = [(t or "").encode().split() for t in texts]
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        codes = np.fromiter(map(self.code.__getitem__, chain.from_iterable(split)), np.int64, int(n_words.sum()))
        self.learn()
        # one more pseudo word for each text: the end id
        ends = np.cumsum(n_words)
        first, size, stop = np.insert(self.first[codes], ends, -1), np.insert(self.size[codes], ends, 1), np.insert(self.stop[codes], ends, True)
        word_end = np.cumsum(size)
        at = np.repeat(first - (word_end - size), size) + np.arange(word_end[-1] if len(word_end) else 0)
        ids = self.flat[np.maximum(at, 0)]
        doc_end = word_end[ends + np.arange(len(ends))] if len(ends) else ends
        ids[doc_end - 1] = END_ID
        return ids, np.diff(doc_end, prepend=0), word_end, stop


def cut_points(doc_end: np.ndarray, word_end: np.ndarray, stop: np.ndarray, total: int, max_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, with penalties; no two neighbours are over ``max_tokens`` apart."""
    penalty = np.full(total + 1, -1, np.int64)
    inner = word_end[(word_end // WORD_STEP) != ((np.concatenate([[0], word_end[:-1]])) // WORD_STEP)] if len(word_end) else word_end
    penalty[inner] = WORD_PENALTY
    penalty[word_end[stop]] = SENTENCE_PENALTY
    penalty[doc_end] = 0
    penalty[0] = 0
    if penalty[total] < 0:
        penalty[total] = WORD_PENALTY
    at = np.flatnonzero(penalty >= 0)
    for i in np.flatnonzero(np.diff(at) > max_tokens):  # a single very long word
        penalty[np.arange(at[i], at[i + 1], max_tokens)[1:]] = 2 * WORD_PENALTY
    at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, max_tokens: int) -> list[int]:
    """Positions of the cheapest cuts from ``at[0]`` to ``at[-1]``, both included."""
    pos, pen = at.tolist(), penalty.tolist()
    n = len(pos)
    back = [0] * n
    queue_i, queue_v = [0] * n, [0] * n  # values rise from head to tail
    queue_v[0] = pos[0]
    head, tail = 0, 1
    for j in range(1, n):
        p = pos[j]
        low = p - max_tokens
        while pos[queue_i[head]] < low:
            head += 1
        back[j] = queue_i[head]
        v = queue_v[head] + max_tokens + pen[j]  # f[j] + p[j]
        while tail > head and queue_v[tail - 1] >= v:
            tail -= 1
        queue_i[tail], queue_v[tail] = j, v
        tail += 1
    cuts, j = [], n - 1
    while j:
        cuts.append(pos[j])
        j = back[j]
    return [*reversed([*cuts, pos[0]])]


def binary_lengths(n: int) -> list[int]:
    """``n`` as a sum of falling powers of two."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class _Stream:
    """The tokens of a partition that are not yet in a sequence."""

    def __init__(self, max_tokens: int, base: int):
        self.max, self.sequence = max_tokens, base
        self.ids = np.zeros(0, np.uint32)
        self.docs: list[tuple[object, int, int, int]] = []  # doc_id, first id here, ids left, all ids of the document
        self.word_end, self.stop = np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, doc_ids: list, ids, counts, word_end, stop) -> None:
        self.docs += [(d, 0, c, c) for d, c in zip(doc_ids, counts.tolist(), strict=True)]
        self.word_end = np.concatenate([self.word_end, word_end + len(self.ids)])
        self.stop = np.concatenate([self.stop, stop])
        self.ids = np.concatenate([self.ids, ids])

    def take(self, last: bool) -> list[tuple]:
        """Pieces of the windows that are settled; ``last``: of all that is left."""
        total = len(self.ids)
        if not total:
            return []
        doc_end = np.cumsum([d[2] for d in self.docs])
        at, pen = cut_points(doc_end, self.word_end, self.stop, total, self.max)
        cuts = best_cuts(at, pen, self.max)
        if last:
            tail = cuts.pop()
            for n in binary_lengths(tail - cuts[-1]):
                cuts.append(cuts[-1] + n)
        else:  # later text may move the last cuts
            while len(cuts) > 1 and cuts[-1] > total - 8 * self.max:
                cuts.pop()
        return self._emit(cuts)

    def _emit(self, cuts: list[int]) -> list[tuple]:
        out, d, done = [], 0, 0  # done: position up to which pieces are out
        for end in cuts[1:]:
            offset = 0
            while done < end:
                doc, start, left, whole = self.docs[d]
                n = min(left, end - done)
                out.append((doc, start, n, zlib.crc32(self.ids[done : done + n].astype("<u4").tobytes()), whole, self.sequence, offset))
                done, offset = done + n, offset + n
                if n == left:
                    d += 1
                else:
                    self.docs[d] = (doc, start + n, left - n, whole)
            self.sequence += 1
        self.docs, self.ids = self.docs[d:], self.ids[done:]
        keep = self.word_end > done
        self.word_end, self.stop = self.word_end[keep] - done, self.stop[keep]
        return out


def pack_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces ``SCHEMA`` of all documents: which ids of which document lie where in which sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(tokenizer_path)
        stream = _Stream(max_tokens, TaskContext.get().partitionId() << 32)
        types = [pa.int64()] * 7
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def table(pieces):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pieces, strict=True), types, strict=True)], names)

        for batch in batches:
            ids, texts = (batch.column(i).to_pylist() for i in (0, 1))
            for i in range(0, len(ids), 256):
                stream.add(ids[i : i + 256], *tokenizer.encode(texts[i : i + 256]))
                if len(stream.ids) >= CHUNK_TOKENS and (pieces := stream.take(False)):
                    yield table(pieces)
        if pieces := stream.take(True):
            yield table(pieces)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)
