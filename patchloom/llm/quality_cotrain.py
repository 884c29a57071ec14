"""Document quality by co-training: a text view and a metadata view teach each other.

View one is measures of the text (symbols, separators, capitals, repeats,
sentence ends, word lengths); view two is what is known without reading it
(source, lang, size). Both are logistic models. In each round a view labels the
unlabelled documents it is surest about, and the other view learns from them too. At
the end each view is calibrated on labelled rows kept apart, and a small
logistic model of both calibrated views gives the score of every document.

Measures come from one map over whole texts and are written once. Fitting uses
a sample of at most ``LABELLED`` labelled and ``POOL`` unlabelled rows (parameters).

Defined results: null and empty texts have zero measures; null source, lang or
n_chars count as a value of their own; without labels of both classes every
score is 0.5; repeated rows score alike; rows without a doc_id are scored only;
other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import staged

LABELLED, POOL = 15_000, 15_000
ROUNDS = 4
#: Share of the pool that a view labels in a round, in both directions.
SURE = 0.05
SOURCE_SLOTS, LANG_SLOTS = 64, 16
MEASURES = 13


def text_measures(text: str | None) -> list[float]:
    """Measures of a text, each between 0 and about 1."""
    t = text or ""
    words = t.split()
    n, chars = len(words), max(1, len(t))
    if not n:
        return [0.0] * MEASURES
    b = t.encode()
    lines = [x for x in t.split("\n") if x.strip()]
    counts = Counter(words)
    symbols = sum(b.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"<", b">"))
    letters = sum(map(len, words))
    upper = sum(map(str.isupper, words))
    same = sum(a == c for a, c in zip(words, words[1:]))
    ends = sum(x.rstrip()[-1:] in ".!?:;…" for x in lines)
    return [
        min(1.0, 5 * symbols / chars), min(1.0, 5 * b.count(b"|") / n), upper / n, min(1.0, b.count(b"!!") / n), len(counts) / n,
        min(1.0, 3 * same / n), max(counts.values()) / n, min(2.0, letters / n / 10), 1 - len(set(lines)) / max(1, len(lines)), ends / max(1, len(lines)),
        min(1.0, np.log1p(n) / 10), float(n < 10), min(1.0, 10 * sum(map(str.isdigit, words)) / n),
    ]


def metadata_features(lang, source, n_chars) -> np.ndarray:
    out = np.zeros((len(lang), SOURCE_SLOTS + LANG_SLOTS + 4))
    for i, (a, s, c) in enumerate(zip(lang, source, n_chars, strict=True)):
        out[i, zlib.crc32(str(s).encode()) % SOURCE_SLOTS] = 1
        out[i, SOURCE_SLOTS + zlib.crc32(str(a).encode()) % LANG_SLOTS] = 1
        z = np.log1p(max(0, c or 0)) / 10
        out[i, -4:] = z, z * z, c is None, (c or 0) < 100
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights, the last for the constant, by Newton steps with a ridge."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    weight = np.ones(len(x)) if weight is None else weight
    ridge = penalty * np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge
        d = np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge @ w)
        w = w + d * min(1.0, 5 / (np.abs(d).max() + 1e-9))
    return w


def logit(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def co_train(views: list[np.ndarray], y: np.ndarray, pools: list[np.ndarray], rounds: int = ROUNDS, sure: float = SURE) -> list[np.ndarray]:
    """A logistic model for each view. Each round every view hands its surest pseudo-labels, in the labels' proportion, to the other."""
    given: list[dict[int, float]] = [{}, {}]
    share = y.mean()
    models = [fit_logistic(v, y) for v in views]
    for _ in range(rounds):
        for k in (0, 1):
            if not len(pools[k]):
                continue
            f = logit(models[k], pools[k])
            order = np.argsort(f, kind="stable")
            low, high = max(1, int(sure * len(f) * (1 - share))), max(1, int(sure * len(f) * share))
            for i in order[:low]:
                if f[i] < 0:
                    given[1 - k].setdefault(int(i), 0.0)
            for i in order[-high:]:
                if f[i] > 0:
                    given[1 - k].setdefault(int(i), 1.0)
        for k in (0, 1):
            own = given[k]
            x = np.vstack([views[k], pools[k][list(own)]]) if own else views[k]
            t = np.concatenate([y, list(own.values())]) if own else y
            # a pseudo-label is worth half a label, and all of them at most a fifth of the labels
            each = min(0.5, 0.2 * len(y) / max(1, len(own)))
            models[k] = fit_logistic(x, t, np.concatenate([np.ones(len(y)), np.full(len(own), each)]))
    return models


def measured(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, m): the measures of all documents."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            m = [text_measures(t) for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(m, pa.list_(pa.float32()))], ["doc_id", "lang", "source", "n_chars", "m"])

    return source.mapInArrow(run, "doc_id long, lang string, source string, n_chars long, m array<float>")


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", labelled: int = LABELLED, pool: int = POOL) -> DataFrame:
    """(doc_id, text_score, metadata_score, score double, predicted int), a row for each row of ``docs``; 1: good."""
    facts = staged(measured(docs, text, doc_id), "measures")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    n_marks, n_docs = marks.count(), facts.count()
    h = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000))
    train = facts.join(marks, "doc_id").filter(h < int(1_000_000 * min(1.0, labelled / max(1, n_marks)))).select("y", "m", "lang", "source", "n_chars", h.alias("h")).collect()
    free = facts.join(marks, "doc_id", "left_anti").filter(h < int(1_000_000 * min(1.0, pool / max(1, n_docs)))).select("m", "lang", "source", "n_chars").collect()

    def two(rows):
        return [np.array([r["m"] for r in rows], float).reshape(len(rows), MEASURES), metadata_features([r["lang"] for r in rows], [r["source"] for r in rows], [r["n_chars"] for r in rows])]

    y = np.array([r["y"] for r in train], float)
    apart = np.array([r["h"] % 4 == 0 for r in train], bool)
    fitted = len(y) > 0 and all(0 < y[k].sum() < k.sum() for k in (apart, ~apart))
    if fitted:
        views = two(train)
        models = co_train([v[~apart] for v in views], y[~apart], two(free))
        curves = [fit_logistic(logit(m, v[apart])[:, None], y[apart], penalty=1e-3) for m, v in zip(models, views, strict=True)]
        both = np.stack([logit(c, logit(m, v[apart])[:, None]) for c, m, v in zip(curves, models, views, strict=True)], 1)
        blend = fit_logistic(both, y[apart], penalty=1e-2)

    def run(batches):
        for b in batches:
            n = b.num_rows
            if fitted:
                v = [np.array(b.column(4).to_pylist(), float).reshape(n, MEASURES), metadata_features(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
                f = np.stack([logit(c, logit(m, x)[:, None]) for c, m, x in zip(curves, models, v, strict=True)], 1)
                s = [1 / (1 + np.exp(-k)) for k in (f[:, 0], f[:, 1], logit(blend, f))]
            else:
                s = [np.full(n, 0.5)] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(k, pa.float64()) for k in s)], ["doc_id", "text_score", "metadata_score", "score"])

    scored = facts.select("doc_id", "lang", "source", "n_chars", "m").mapInArrow(run, "doc_id long, text_score double, metadata_score double, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
