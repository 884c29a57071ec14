"""Find benchmark items inside training texts: BM25 with block-max bounds, then overlap.

The items (questions with answers) are the indexed side: for each term the
items that hold it and its BM25 impact there, and for each block of items the
largest impact. Every training text is cut into overlapping passages. An item is
retrieved when a passage reaches its threshold: the least score of any set of
words that verification accepts (``least_score``), or ``share`` of the item's own
score if that is lower. So nothing that would be verified is missed. Runs of
passages are scored first, as they hold all that each passage holds: block bounds,
then scores and numbers of common words, drop most items; what is left is scored
passage by passage. Every retrieved passage, best score first, is verified until
one passes: a leak holds most of the question in order and close together, in runs
of three words or more, and of the answer (the item's last sentence) a good
part; a question of eight words or more may stand alone. Words scattered over
a passage of the same vocabulary are no leak. A passage is twice ``size`` words, every half
``size``, so an item of up to 1.5 ``size`` words stands whole in one.

The index goes to the tasks in shards of at most ``SHARD_ITEMS`` items, so the
broadcast is bounded whatever the benchmark's size; each shard is one scan of
the documents. No shuffle. Statistics of terms are those of all items, whatever
their shard and passage length, so results don't depend on the number of shards.

Defined results: items without words match nothing; texts that are null or
empty hold nothing; repeated rows of documents give repeated rows, repeated
items are items of their own; columns other than ids and texts are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.wordbytes import folded_words

SHARD_ITEMS = 20_000
BLOCK_ITEMS = 16
K1, B = 1.2, 0.75
#: A passage need not reach more than this share of the score that the item reaches itself.
SHARE = 0.5
#: Passages scored together before each by itself.
RUN = 8
MIN_PASSAGE = 64
#: Texts that are searched together, and runs times items that are scored together.
TEXTS, CELLS = 64, 1_000_000
QUESTION_OVERLAP, ANSWER_OVERLAP = 0.6, 0.5
QUESTION_ALONE = 0.8
#: A shorter question passes with its answer only, if it has one.
ALONE_WORDS = 8
#: Only runs of so many words count as held, on a span of at most so many times the part's words.
RUN_WORDS, SPAN = 3, 1.5

SCHEMA = "doc_id long, item_id long, first_word long, score double, question_overlap double, answer_overlap double"


def split_item(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer: the last sentence, if there is more than one."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", (text or "").strip()) if folded_words(p)]
    if len(parts) < 2:
        return folded_words(text), []
    return [w for p in parts[:-1] for w in folded_words(p)], folded_words(parts[-1])


def accepted(question_overlap: float, answer_overlap: float, question: list[bytes], answer: list[bytes]) -> bool:
    if not answer:
        return question_overlap >= (QUESTION_OVERLAP if len(question) >= ALONE_WORDS else QUESTION_ALONE)
    alone = question_overlap >= QUESTION_ALONE and len(question) >= ALONE_WORDS
    return alone or question_overlap >= QUESTION_OVERLAP and answer_overlap >= ANSWER_OVERLAP


def _least_cover(counts: Counter, impact: dict[bytes, float], share: float) -> float:
    """The least sum of impacts of terms whose words make up ``share`` of all words."""
    n = sum(counts.values())
    spare = max((k for k in range(n + 1) if (n - k) / n >= share), default=0)
    dropped = np.zeros(spare + 1)  # by number of words dropped: the largest impact that can go
    for t, m in counts.items():
        if m <= spare:
            dropped[m:] = np.maximum(dropped[m:], dropped[: spare + 1 - m] + impact[t])
    return sum(impact[t] for t in counts) - float(dropped[-1])


def least_score(question: list[bytes], answer: list[bytes], impact: dict[bytes, float]) -> float:
    """No set of words that verification accepts has a lower score."""
    q, a = Counter(question), Counter(answer)
    long = len(question) >= ALONE_WORDS
    if not a:
        return _least_cover(q, impact, QUESTION_OVERLAP if long else QUESTION_ALONE)
    both = _least_cover(q, impact, QUESTION_OVERLAP) + _least_cover(a, {t: 0.0 if t in q else impact[t] for t in a}, ANSWER_OVERLAP)
    return min(_least_cover(q, impact, QUESTION_ALONE), both) if long else both


class Statistics:
    """Number of items with words, their mean length, and for each term the number of items that hold it."""

    def __init__(self):
        self.items, self.words, self.df = 0, 0, Counter()

    def add(self, question: list[bytes], answer: list[bytes]) -> None:
        if question or answer:
            self.items += 1
            self.words += len(question) + len(answer)
            self.df.update(set(question + answer))


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


class ItemIndex:
    """BM25 impacts of the items of one passage length, with the largest by block of items."""

    def __init__(self, items: list[tuple], size: int, share: float, statistics: Statistics | None = None):
        if statistics is None:
            statistics = Statistics()
            for _, q, a in items:
                statistics.add(q, a)
        self.size = size
        self.items = items
        self.parts = [(Counter(q), Counter(a)) for _, q, a in items]
        counts = [q + a for q, a in self.parts]
        mean, df = statistics.words / statistics.items, statistics.df
        self.postings: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        self.threshold = np.zeros(len(items))
        self.impacts: list[dict[bytes, float]] = []
        for i, c in enumerate(counts):
            n = sum(c.values())
            own = {}
            for t, f in c.items():
                idf = math.log(1 + (statistics.items - df[t] + 0.5) / (df[t] + 0.5))
                own[t] = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * n / mean))
                self.postings[t].append((i, own[t]))
            self.impacts.append(own)
            self.threshold[i] = min(share * sum(own.values()), least_score(*items[i][1:], own))
        self.lengths = np.array([[max(1, len(q)), max(1, len(a))] for _, q, a in items], float)
        self.open = np.array([not a for _, _, a in items])
        blocks = -(-len(items) // BLOCK_ITEMS)
        self.block_lowest = np.array([self.threshold[b * BLOCK_ITEMS : (b + 1) * BLOCK_ITEMS].min() for b in range(blocks)])
        # postings of all terms one after the other: item, impact, words of the question and of the answer; then the blocks'
        flat, tops, self.row, ends = [], [], {}, [(0, 0)]
        for t, p in self.postings.items():
            top: dict[int, float] = {}
            for i, x in p:
                top[i // BLOCK_ITEMS] = max(top.get(i // BLOCK_ITEMS, 0.0), x)
            self.row[t] = len(self.row)
            flat += [(i, x, self.parts[i][0][t], self.parts[i][1][t]) for i, x in p]
            tops += top.items()
            ends.append((len(flat), len(tops)))
        self.ends = np.array(ends, np.int64)
        self.item, self.impact, self.in_question, self.in_answer = (np.array(c, k) for c, k in zip(zip(*flat, strict=True), (np.int64, float, float, float), strict=True))
        self.block, self.block_top = (np.array(c, k) for c, k in zip(zip(*tops, strict=True), (np.int64, float), strict=True))

    def _scored(self, passage) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items whose threshold the passage reaches, their scores, and the numbers of the postings met."""
        none = np.zeros(0, np.int64)
        rows = [r for r in map(self.row.get, set(passage)) if r is not None]
        if not rows:
            return none, np.zeros(0), none
        rows = np.array(rows)
        b = _ranges(self.ends[rows, 1], self.ends[rows + 1, 1])
        live = np.bincount(self.block[b], self.block_top[b], len(self.block_lowest)) >= self.block_lowest - 1e-9
        if not live.any():
            return none, np.zeros(0), none
        p = _ranges(self.ends[rows, 0], self.ends[rows + 1, 0])
        if not live.all():
            p = p[live[self.item[p] // BLOCK_ITEMS]]
        score = np.bincount(self.item[p], self.impact[p], len(self.items))
        hit = np.flatnonzero((score >= self.threshold - 1e-9) & (score > 0))
        return hit, score[hit], p

    def retrieve(self, passage: list[bytes]) -> list[tuple[int, float]]:
        """(item, score) of all items whose threshold the passage reaches."""
        hit, score, _ = self._scored(passage)
        return list(zip(hit.tolist(), score.tolist(), strict=True))

    def hopeful(self, runs: list[list[bytes]]) -> dict[int, list[int]]:
        """For each run the items that a passage inside it may hold: by score, and by the numbers of common words.

        All runs are scored at once: the bounds of blocks first, then postings of the blocks that are left.
        """
        rows = [[r for r in map(self.row.get, set(run)) if r is not None] for run in runs]
        terms = np.fromiter(chain.from_iterable(rows), np.int64)
        who = np.repeat(np.arange(len(runs)), list(map(len, rows)))
        blocks, items = len(self.block_lowest), len(self.items)
        starts, ends = self.ends[terms], self.ends[terms + 1]
        b, of = _ranges(starts[:, 1], ends[:, 1]), np.repeat(who, ends[:, 1] - starts[:, 1])
        tops = np.bincount(of * blocks + self.block[b], self.block_top[b], len(runs) * blocks)
        live = tops.reshape(len(runs), blocks) >= self.block_lowest - 1e-9
        p, of = _ranges(starts[:, 0], ends[:, 0]), np.repeat(who, ends[:, 0] - starts[:, 0])
        keep = live[of, self.item[p] // BLOCK_ITEMS]
        p, of = p[keep], of[keep]
        cell = of * items + self.item[p]
        score, q, a = (np.bincount(cell, w[p], len(runs) * items).reshape(len(runs), items) for w in (self.impact, self.in_question, self.in_answer))
        q, a = q / self.lengths[:, 0], a / self.lengths[:, 1]
        enough = (q >= QUESTION_ALONE) | (q >= QUESTION_OVERLAP) & (self.open | (a >= ANSWER_OVERLAP))
        found: dict[int, list[int]] = defaultdict(list)
        for r, i in np.argwhere((score >= self.threshold - 1e-9) & (score > 0) & enough).tolist():
            found[r].append(i)
        return found

    def may_pass(self, i: int, held: Counter) -> bool:
        """Whether the words of a passage, in whatever order, are enough of the item's."""
        q, a = (sum(min(m, held[t]) for t, m in part.items() if t in held) for part in self.parts[i])
        return accepted(q / self.lengths[i, 0], a / self.lengths[i, 1], *self.items[i][1:])

    def passages(self, texts: list[list[bytes]]) -> Iterator[tuple[int, int, int, float]]:
        """(text, item, start, score) of every retrieved passage whose words are enough."""
        step = self.size // 2
        runs = [(d, range(0, max(1, len(words) - step), step)[k : k + RUN]) for d, words in enumerate(texts) for k in range(0, len(range(0, max(1, len(words) - step), step)), RUN)]
        together = max(1, CELLS // len(self.items))
        for c in range(0, len(runs), together):
            some = runs[c : c + together]
            found = self.hopeful([texts[d][max(0, own[0] - step) : own[-1] + 3 * step] for d, own in some])
            for r, items in found.items():
                d, own = some[r]
                for start in own:
                    held = Counter(texts[d][max(0, start - step) : start + 3 * step])
                    for i in items:
                        score = sum(x for t, x in self.impacts[i].items() if t in held)
                        if score >= self.threshold[i] - 1e-9 and self.may_pass(i, held):
                            yield d, i, start, score


def overlap(part: list[bytes], region: list[bytes]) -> float:
    """Share of ``part`` that stands in ``region`` in the same order, in runs of ``RUN_WORDS`` words close together."""
    if not part:
        return 0.0
    least = min(RUN_WORDS, len(part))
    grams = {tuple(part[k : k + least]) for k in range(len(part) - least + 1)}
    if not any(tuple(region[k : k + least]) in grams for k in range(len(region) - least + 1)):
        return 0.0
    runs = [m for m in SequenceMatcher(None, part, region, autojunk=False).get_matching_blocks() if m.size >= least]
    room, best, total, first = SPAN * len(part) + RUN_WORDS, 0, 0, 0
    for m in runs:
        total += m.size
        while m.b + m.size - runs[first].b > room:
            total -= runs[first].size
            first += 1
        best = max(best, total)
    return best / len(part)


def build_indexes(items: list[tuple], share: float, statistics: Statistics | None = None) -> list[ItemIndex]:
    """An index for each passage length: the power of two from 1.5 times the item's words, 64 at least."""
    by_size: dict[int, list[tuple]] = defaultdict(list)
    for item_id, text in items:
        q, a = split_item(text)
        if q or a:
            by_size[max(MIN_PASSAGE, 1 << math.ceil(math.log2(1.5 * len(q + a))))].append((item_id, q, a))
    return [ItemIndex(x, size, share, statistics) for size, x in sorted(by_size.items())]


def leaks_in_texts(texts: list[list[bytes]], indexes: list[ItemIndex]) -> list[tuple]:
    """(text, item, first word, score, question and answer overlap) of the verified items in texts, the best passage that passes."""
    out = []
    for index in indexes:
        retrieved: dict[tuple[int, int], list[tuple[float, int]]] = defaultdict(list)
        for d, i, start, score in index.passages(texts):
            retrieved[d, i].append((-score, start))
        step = index.size // 2
        for (d, i), passages in retrieved.items():
            item_id, q, a = index.items[i]
            for score, start in sorted(passages):
                region = texts[d][max(0, start - step) : start + 3 * step]
                qo = overlap(q, region)
                ao = overlap(a, region) if qo >= QUESTION_OVERLAP else 0.0
                if accepted(qo, ao, q, a):
                    out.append((d, item_id, start, -score, qo, ao))
                    break
    return out


def leaks_in(words: list[bytes], indexes: list[ItemIndex]) -> list[tuple]:
    """The same for one text, without its number."""
    return [x[1:] for x in leaks_in_texts([words], indexes)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, shard_items: int = SHARD_ITEMS, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``SCHEMA``: a row for each document and each item that it holds."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    n = items.count()
    shards = 1 if n <= shard_items else -(-n * 5 // (shard_items * 4))  # room for uneven hashing
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def own(shard: int) -> list[tuple]:
        rows = items if shards == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard)
        return sorted(map(tuple, rows.collect()), key=str)

    statistics = Statistics()
    for shard in range(shards):
        for _, x in own(shard):
            statistics.add(*split_item(x))
    found = []
    for shard in range(shards):
        index = spark.sparkContext.broadcast(build_indexes(own(shard), share, statistics))
        found.append(source.mapInArrow(_matcher(index), SCHEMA))
    return reduce(DataFrame.unionAll, found)


def _matcher(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = index.value
        kinds = [pa.int64()] * 3 + [pa.float64()] * 3
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(0, len(ids), TEXTS):
                rows += [(ids[k + d], *x) for d, *x in leaks_in_texts([folded_words(t) for t in texts[k : k + TEXTS]], indexes)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names)

    return run
