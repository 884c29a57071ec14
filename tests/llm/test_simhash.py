"""SimHash near-duplicates against the plain definition: every hash by the library, every pair compared."""

import re

import numpy as np
import pytest
import xxhash

from patchloom.llm import simhash_join as S

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps):
    x = np.array(fps, np.uint64)
    parent = list(range(len(x)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 4) + i + 1:
            parent[find(i)] = find(int(j))
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return [least[find(i)] for i in range(len(x))]


def rows_of(df):
    return sorted((r.doc_id, r.fingerprint, r.component_id) for r in df.select("doc_id", "fingerprint", "component_id").collect())


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    odd = [None, "", " \n\t", "one", "a b c", "A b C", "a b c d", "Ä ä É", "word " * 70_000, "x" * 100_000, rows[3][1], rows[3][1], rows[3][1] + " more", "a b c d e"]
    return rows + [(5000 + i, t) for i, t in enumerate(odd)] + [rows[5], (rows[6][0], "another text of the same id")]


@pytest.mark.parametrize("limit", [S.LIST, 3])
def test_equals_all_pairs(spark, texts, limit):
    docs = spark.createDataFrame([(t, i, "k", 7, 8) for i, t in texts] + [("no id", None, "k", 7, 8)], "text string, doc_id long, fp string, key long, n long").repartition(5)
    fps = [plain_fingerprint(t) for _, t in texts]
    want = sorted(zip([i for i, _ in texts], [f"{f:016x}" for f in fps], plain_components([i for i, _ in texts], fps)))
    assert rows_of(S.simhash_duplicates(docs, list_limit=limit)) == want


@pytest.mark.parametrize("limit", [S.LIST, 40])
def test_links_join_what_lies_near(spark, limit):
    """Dense balls, chains at exactly 4 bits, pairs at 5 bits, and random fingerprints."""
    r = np.random.default_rng(3)
    flip = lambda f, n: int(f) ^ sum(1 << int(b) for b in r.choice(64, n, replace=False))
    x = [0, (1 << 64) - 1, 0b1111, 0b11111]
    for _ in range(6):
        centre = int(r.integers(0, 1 << 63))
        x += [flip(centre, int(r.integers(0, 4))) for _ in range(150)]
    for _ in range(60):
        now = int(r.integers(0, 1 << 63))
        for n in (4, 4, 5, 4, 3, 5):
            x.append(now)
            now = flip(now, n)
    x = sorted({f % (1 << 64) for f in x})
    fps = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in x], "fp long").repartition(6)
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in S.near_fingerprints(fps, limit).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    got, parent = {}, {f: f for f in x}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = plain_components(x, x)
    assert [find(f) for f in x] == want
    assert len(links) < 64 * len(x) + 66 * len(x)  # never all pairs of a ball


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_duplicates(docs).collect() == []
