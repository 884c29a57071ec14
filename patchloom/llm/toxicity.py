"""Toxicity by a support vector machine on a gap-weighted subsequence string kernel, with Nyström landmarks.

Words are compared by the kernel of all common subsequences of three letters,
each weighed by lambda to the length it spans, normalised to 1 for equal words:
an insult with letters put in between, left out, or with another ending stays close.
A word of more than ``MAX_LETTERS`` letters counts as overlapping pieces that cover
it, so text written without spaces is compared to its end.
Landmarks are the words that labelled toxic documents have and others hardly
do, with their closest harmless words. A sentence is the greatest kernel value of
its words with each landmark, mapped by the inverse root of the landmarks' own
kernel matrix (Nyström), and a linear SVM is trained on sentences: from toxic
documents the sentence with the most telling word, from others the one that comes
closest to a landmark. A document is its worst sentence; scores
are calibrated on the training documents.

Word statistics use all labelled training rows; the SVM a sample of at most
``SAMPLE`` of them. Labels, lang, source and ids are no input of a score. Scoring
is one map over whole texts. Each worker computes a distinct word once.

Defined results: null and empty texts get the score of a text without any
suspicious word; without labels of both classes every score is 0; repeated rows
score alike; rows without a doc_id are scored, and never trained on.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import staged

LANDMARKS = 96
NEIGHBOURS = 32
SAMPLE = 6000
DECAY, ORDER, MAX_LETTERS = 0.7, 3, 20
#: Pieces of longer words: letters, and from start to start; any PIECE - STEP + 1 letters in a row are in one.
PIECE, STEP = 12, 4
#: A word counts as suspicious from this kernel value with a toxic landmark on.
CLOSE = 0.45
THRESHOLD = 0.3
CACHED_WORDS = 300_000

_SENTENCE = re.compile(r"[.!?\n]+(?:\s|$)|\n")
_LEET = str.maketrans("013457@$", "oieastas")
_SPACED = re.compile(r"(?:(?:^|\s)\w){3}(?=\s|$)")
_NO_LETTER = re.compile(r"[\W\d_]+")


def normal(token: str) -> str:
    """Letters of a token: signs between letters go, and digits that stand for letters become them."""
    if token.isalpha():
        return token
    if any(c.isalpha() for c in token):
        token = token.strip(".,;:!?()[]\"'»«*#%&|<>-").translate(_LEET)
    return _NO_LETTER.sub("", token)


def pieces(word: str) -> list[str]:
    """The word, or overlapping pieces that cover one of more than MAX_LETTERS."""
    if len(word) <= MAX_LETTERS:
        return [word]
    return [word[i : i + PIECE] for i in range(0, len(word) - PIECE + STEP, STEP)]


def _words(tokens: list[str]) -> list[str]:
    """Normalised words of a sentence's tokens, long ones in pieces; runs of single letters are joined."""
    words, run = [], ""
    for t in tokens:
        w = normal(t)
        if len(w) == 1:
            run += w
            continue
        if len(run) > 2:
            words += pieces(run)
        run = ""
        if w:
            words += pieces(w)
    if len(run) > 2:
        words += pieces(run)
    return words


def sentence_words(text: str | None) -> list[list[str]]:
    """The words of each sentence."""
    return [words for s in _SENTENCE.split((text or "").lower()) if (words := _words(s.split()))]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, words), np.int64, len(words))
    a = np.zeros((len(words), max(MAX_LETTERS, size.max(initial=0))), np.int32)
    a[np.arange(a.shape[1]) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
    return a, size


def _raw_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Kernel of the words in equal rows of two code tables (0: no letter), by the usual recursion over prefixes."""
    n = len(a)
    la, lb = (int((x != 0).sum(1).max(initial=0)) for x in (a, b))
    prior = np.ones((la + 1, lb + 1, n), np.float32)
    match = [[(a[:, i] == b[:, j]) & (a[:, i] != 0) for j in range(lb)] for i in range(la)]
    for _ in range(ORDER - 1):
        nxt = np.zeros((la + 1, lb + 1, n), np.float32)
        for i in range(1, la + 1):
            run = np.zeros(n, np.float32)
            for j in range(1, lb + 1):
                run = DECAY * run + np.where(match[i - 1][j - 1], DECAY * DECAY * prior[i - 1, j - 1], 0)
                nxt[i, j] = DECAY * nxt[i - 1, j] + run
        prior = nxt
    total = np.zeros(n, np.float32)
    for i in range(la):
        for j in range(lb):
            total += np.where(match[i][j], DECAY * DECAY * prior[i, j], 0)
    return total


class Kernel:
    """Normalised kernel of words with fixed landmarks; pairs without common letter pairs are 0 unseen."""

    def __init__(self, landmarks: list[str], toxic: int = 0):
        self.landmarks, self.toxic = landmarks, toxic
        self.codes, self.size = _codes(landmarks)
        self.own = np.sqrt(np.maximum(_raw_kernel(self.codes, self.codes), 1e-9)) if landmarks else np.zeros(0)
        self.bits = self._pairs(self.codes, 1)
        self.need = np.bitwise_count(self.bits).sum(1) * 0.6

    @staticmethod
    def _pairs(codes: np.ndarray, reach: int) -> np.ndarray:
        """256 bits: the letter pairs at distances up to ``reach``."""
        bits = np.zeros((len(codes), 4), np.uint64)
        rows = np.arange(len(codes))
        for d in range(1, reach + 1):
            for i in range(codes.shape[1] - d):
                x, y = codes[:, i], codes[:, i + d]
                h = (x * 37 + y * 101) % 256
                bits[rows, h // 64] |= np.where((x != 0) & (y != 0), np.uint64(1) << (h % 64).astype(np.uint64), np.uint64(0))
        return bits

    def of(self, words: list[str], first: int = 0, last: int | None = None) -> np.ndarray:
        """Kernel rows of the words with the landmarks from ``first`` to ``last``."""
        last = len(self.landmarks) if last is None else last
        out = np.zeros((len(words), last - first), np.float32)
        if not words or first == last:
            return out
        codes, size = _codes(words)
        bits = self._pairs(codes, 2)
        hit = [np.flatnonzero(np.bitwise_count(bits & self.bits[m]).sum(1) >= self.need[m]) for m in range(first, last)]
        i = np.concatenate(hit)
        m = np.repeat(np.arange(first, last), [len(x) for x in hit])
        order = np.argsort(size[i], kind="stable")  # words of like length together
        i, m = i[order], m[order]
        rows, place = np.unique(i, return_inverse=True)
        rows_own = np.zeros(len(rows), np.float32)
        by_size = np.argsort(size[rows], kind="stable")
        for p in range(0, len(rows), 4000):
            r = by_size[p : p + 4000]
            rows_own[r] = np.sqrt(np.maximum(_raw_kernel(codes[rows[r]], codes[rows[r]]), 1e-9))
        for p in range(0, len(i), 4000):
            a, b = i[p : p + 4000], m[p : p + 4000]
            out[a, b - first] = _raw_kernel(codes[a], self.codes[b]) / (rows_own[place[p : p + 4000]] * self.own[b])
        return out

    def suspicious(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that are close to a toxic landmark, and their whole kernel rows."""
        rows = self.of(words, 0, self.toxic)
        close = np.flatnonzero(rows.max(1, initial=0) >= CLOSE)
        return close, np.hstack([rows[close], self.of([words[i] for i in close], self.toxic)])


def train_svm(x: np.ndarray, y: np.ndarray, rounds: int = 300, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss and balanced classes, by accelerated gradient steps."""
    sign = np.where(y > 0, 1.0, -1.0)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    z = np.hstack([x, np.ones((len(x), 1))])
    step = 1 / (penalty + 2 * np.linalg.norm(z * np.sqrt(weight)[:, None], 2) ** 2)
    w = last = np.zeros(z.shape[1])
    for k in range(rounds):
        v = w + k / (k + 3) * (w - last)
        slack = np.maximum(0, 1 - sign * (z @ v))
        grad = penalty * np.append(v[:-1], 0) - 2 * z.T @ (weight * sign * slack)
        last, w = w, v - step * grad
    return w[:-1], float(w[-1])


def fit_sigmoid(f: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of a logistic curve for scores f, by Newton steps on softened labels."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    z = np.stack([f, np.ones_like(f)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
        d = np.linalg.solve(h, z.T @ (t - p) - 1e-6 * w)
        w = w + d * min(1.0, 4 / (np.abs(d).max() + 1e-9))
    return float(w[0]), float(w[1])


class Model:
    """Landmarks (the first ``toxic`` are toxic words), weights on their kernel values, and calibration."""

    def __init__(self, landmarks, toxic, weights, bias, slope, offset):
        self.landmarks, self.toxic, self.weights, self.bias, self.slope, self.offset = landmarks, toxic, weights, bias, slope, offset

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -30, 30)))


class Scorer:
    """Features of documents; remembers each word's kernel row if it is suspicious, else None.

    Words of many documents are computed at once. A document is split into sentences only if it has a
    suspicious word or letters spaced out; a token in several pieces has the greatest values of its suspicious ones.
    """

    DOCUMENTS = 400

    def __init__(self, landmarks: list[str], toxic: int):
        self.kernel, self.toxic = Kernel(landmarks, toxic), toxic
        self.forget()

    def forget(self) -> None:
        #: Rows of tokens and words; those with a row; those that are a single letter.
        self.rows, self.close, self.single = {}, set(), set()

    def learn(self, words: set[str]) -> None:
        fresh = {w: pieces(normal(w)) for w in words.difference(self.rows)}
        plain = sorted({p for ps in fresh.values() for p in ps}.difference(self.rows))
        for k in range(0, len(plain), 50_000):
            part = plain[k : k + 50_000]
            close, rows = self.kernel.suspicious(part)
            self.rows.update(dict.fromkeys(part))
            self.rows.update((part[i], r) for i, r in zip(close.tolist(), rows, strict=True))
            self.close.update(part[i] for i in close.tolist())
        for w, ps in fresh.items():
            if len(ps[0]) == 1:
                self.single.add(w)
            found = [self.rows[p] for p in ps if p in self.close]
            self.rows[w] = np.max(found, axis=0) if found else None
            if found:
                self.close.add(w)

    def sentences(self, texts: list[str | None]) -> list[list[np.ndarray]]:
        """Of each text, the features of its sentences with a suspicious word."""
        out = []
        for k in range(0, len(texts), self.DOCUMENTS):
            if len(self.rows) > CACHED_WORDS:
                self.forget()
            part = [(t or "").lower() for t in texts[k : k + self.DOCUMENTS]]
            words = [set(t.split()) for t in part]
            self.learn(set().union(*words))
            split = [[s.split() for s in _SENTENCE.split(t)] if not self.close.isdisjoint(ws) or _SPACED.search(t) else [] for t, ws in zip(part, words, strict=True)]
            self.learn({w for doc in split for s in doc for w in s})
            # three single letters or more may be a run
            split = [[_words(s) if sum(map(self.single.__contains__, s)) > 2 else s for s in doc] for doc in split]
            self.learn({w for doc in split for s in doc for w in s})
            for doc in split:
                out.append([np.max([self.rows[w] for w in s if w in self.close], axis=0) for s in doc if not self.close.isdisjoint(s)])
        return out


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on the labelled rows that are not held out. ``docs``: (doc_id, text); ``labels``: (doc_id, toxic)."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # shuffled at any size: the ids of all labels are no broadcast
    rows = docs.filter("doc_id is not null").join(marks.hint("merge"), "doc_id")

    def words(batches):
        for b in batches:
            out = [(sorted({w for s in sentence_words(t) for w in s}), y) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.list_(pa.string())), pa.array([o[1] for o in out], pa.int32())], ["words", "toxic"])

    size = marks.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    n_toxic, n = int(size[0] or 0), int(size[1])
    if not 0 < n_toxic < n:
        return None
    seen = staged(rows.select("text", "toxic").mapInArrow(words, "words array<string>, toxic int").select(F.explode("words").alias("w"), "toxic").groupBy("w").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")), "toxic_words")
    # how surely the word's documents are toxic, by its lower bound
    telling = ((F.col("t") + 0.5) / (F.col("n") + 1 + 2 / F.lit(n_toxic / n))).alias("telling")
    top = seen.filter("t >= 2 and length(w) >= 4").select("w", "t", telling).filter(f"telling > {min(0.5, 3 * n_toxic / n)}").orderBy(F.desc("t"), "w").limit(LANDMARKS).collect()
    toxic = [r["w"] for r in top]
    if not toxic:
        return None
    tells = {r["w"]: r["telling"] for r in top}
    harmless = seen.filter(f"t * {n} <= n * {n_toxic} and length(w) >= 3 and n >= 3")

    def nearest(batches):
        kernel = Kernel(toxic)
        for b in batches:
            ws = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), pa.array(kernel.of(ws).max(1, initial=0).astype(float), pa.float64())], ["w", "k"])

    close = harmless.select("w").mapInArrow(nearest, "w string, k double").filter("k > 0.2").orderBy(F.desc("k"), "w").limit(NEIGHBOURS).collect()
    landmarks = toxic + [r["w"] for r in close]

    def features(batches):
        scorer = Scorer(landmarks, len(toxic))
        for b in batches:
            out = []
            for found, y in zip(scorer.sentences(b.column(0).to_pylist()), b.column(1).to_pylist(), strict=True):
                found.sort(key=lambda v: -float(v[: len(toxic)].max()))
                out.append((y, [v.tolist() for v in found[:4]]))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.list_(pa.list_(pa.float32())))], ["toxic", "f"])

    share = min(1.0, SAMPLE / n)
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("text", "toxic")
    data = sample.mapInArrow(features, "toxic int, f array<array<float>>").collect()
    none = np.zeros(len(landmarks))
    x = np.array([r["f"][0] if r["f"] else none for r in data], float).reshape(len(data), -1)
    y = np.array([r["toxic"] for r in data])
    if not 0 < y.sum() < len(y):
        return None
    gram = Kernel(landmarks).of(landmarks).astype(float)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
    w, bias = train_svm(x @ root, y)
    weights = root @ w
    margins = np.array([max([float(np.dot(v, weights)) + bias for v in r["f"]], default=bias) for r in data])
    slope, offset = fit_sigmoid(margins, y)
    return Model(landmarks, len(toxic), weights, bias, slope, offset)


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id long, held_out boolean, score double, predicted int), a row for each row of ``docs``."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    model = fit(source, labels)

    def run(batches):
        scorer = Scorer(model.landmarks, model.toxic) if model else None
        for b in batches:
            if model:
                margins = np.array([max([float(np.dot(v, model.weights)) + model.bias for v in found], default=model.bias) for found in scorer.sentences(b.column(1).to_pylist())], float)
                score = model.score(margins)
            else:
                score = np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = source.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
