"""Parallel hunk split (two nodes per line, pointer doubling) against the sequential rule,
on blank-heavy random sections where back-tracks often leave the next piece full."""

import random

from pyspark.sql import functions as F

from patchloom.operators.split_parallel import cut_starts


def rule(flags, H, m):
    T = max(m * 0.8, 200)
    start = c = 0
    lh, nl, cuts = -1, 0, []
    for i, (hk, nb) in enumerate(flags):
        if hk and i > start and c + H >= T:
            cuts.append(i)
            start, c, lh = i, 0, -1
        if hk:
            lh, nl = i, 0
        if nb:
            c += 1
            nl += 1
        if c + H >= m:
            if lh > start:
                cuts.append(lh)
                start, c = lh, nl
            else:
                cuts.append(i + 1)
                start, c, lh = i + 1, 0, -1
    return sorted(set([0] + [x for x in cuts if x < len(flags)]))


def test_random_blank_heavy_sections(spark):
    rnd = random.Random(9)
    rows, meta = [], {}
    for k in range(150):
        flags = [(True, True)]
        for _ in range(rnd.randint(1, 80)):
            r = rnd.random()
            flags.append((True, True) if r < 0.15 else ((False, False) if r < 0.45 else (False, True)))
        H, m = rnd.choice([1, 2, 3, 4, 6]), rnd.choice([2, 3, 5, 8, 20, 260])
        meta[f"d{k}"] = (flags, H, m)
        rows += [(f"d{k}", 1, j, H, len(flags), hk, nb, m) for j, (hk, nb) in enumerate(flags)]
    df = spark.createDataFrame(rows, "diff_id string, sec int, bi long, h int, n long, hk boolean, nb boolean, m int")
    for m in sorted({v[2] for v in meta.values()}):
        got = {}
        for r in cut_starts(df.where(F.col("m") == m).drop("m"), m).collect():
            got.setdefault(r.diff_id, []).append(r["__pos"])
        for d, (flags, H, mm) in meta.items():
            if mm == m:
                assert sorted(got[d]) == rule(flags, H, m), (d, m, H)
