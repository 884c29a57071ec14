"""Hard negatives against scores of all pairs."""

import math
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.llm import angular_negatives as N
from patchloom.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, every):
    """rows: (id, label, vector), valid, ids unique."""
    q = {i: [math.floor(256 * float(x)) for x in v] for i, _, v in rows}
    label = {i: n for i, n, _ in rows}
    out = []
    for a in (i for i in q if i % every == 0):
        score = {i: sum(x * y for x, y in zip(q[a], v)) for i, v in q.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if label[i] == label[a]][:5]:
            fits = [i for i in order if label[i] != label[a] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(fits[:5])]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("window", [N.WINDOW, 7])
def test_equals_all_pairs(spark, window, monkeypatch):
    if window == 7:
        monkeypatch.setattr(N, "ANCHORS", 4)
        monkeypatch.setattr(N, "RUNS", 3)
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 12))
    rows = []
    for i in range(400):
        c = centres[int(r.integers(6))]
        rows.append((i, int(r.integers(4)), [float(x) for x in np.float32(c + r.normal(size=12) * r.choice([0, 0.05, 1.0]))]))
    rows += [(400 + i, i % 3, [0.0] * 12) for i in range(25)]  # zeros
    rows += [(425 + i, i % 3, [float(x) for x in centres[0]]) for i in range(60)]  # equal vectors
    rows += [(490, 1, [1.0, -1.0]), (500, 1, []), (-10, 2, [0.5] * 12), (510, 3, [-float(x) for x in centres[0]])]
    odd = [(None, 1, [1.0] * 12), (600, None, [1.0] * 12), (610, 1, None), (620, 1, [None] + [1.0] * 11), (630, 1, [float("nan")] * 12), (640, 1, [float("inf")] * 12)]
    again = [rows[20], (rows[30][0], rows[30][1] + 5, rows[30][2])]
    df = spark.createDataFrame([(v, n, i, 1, "x") for i, n, v in rows + odd + again], "embedding array<double>, label int, vec_id long, cell int, theta string").repartition(5)
    want = plain(rows, 10)
    assert len(want) > 300
    assert got(N.hard_negatives(df, anchor_every=10, window=window)) == want


def test_large_components(spark):
    """Scores beyond 53 bits are exact; beyond 62 bits they are refused."""
    r = np.random.default_rng(4)
    rows = [(i, i % 3, [float(x) for x in r.integers(-(10**6), 10**6, 5) + 0.5]) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert got(N.hard_negatives(df, anchor_every=10)) == plain(rows, 10)
    with pytest.raises(ValueError):
        N.hard_negatives(df.withColumn("embedding", F.transform("embedding", lambda x: x * 1e6)))


def test_query_equals_all_pairs(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got(queries.op11_hard_negatives(spark, SF)) == plain(rows, 100)


def test_empty_table(spark):
    df = spark.createDataFrame([(1, None, None)], "vec_id long, label int, embedding array<float>")
    for d in (df, df.limit(0)):
        assert got(N.hard_negatives(d)) == []
    assert got(N.hard_negatives(spark.createDataFrame([(0, 1, [1.0])], df.schema))) == []
