"""Packing (E1/E2/E1g) and in-section splitting (E3) against plain statements of the rules."""

import random
import re
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.operators.pack import pack
from patchloom.operators.split import split_oversized
from patchloom.operators import sections as S


def next_fit(weights, cap):
    """A new slot when the open one is non-empty and would overflow; heavy items sit alone."""
    out, slot, fill, prev_heavy = [], 0, 0, False
    for k, w in enumerate(weights):
        heavy = w > cap
        if k == 0 or heavy or prev_heavy or fill + w > cap:
            slot, fill = slot + 1, w
        else:
            fill += w
        prev_heavy = heavy
        out.append(slot)
    return out


def test_golden_next_fit(spark):
    rows = [("a", i, w) for i, w in enumerate([30, 40, 50, 10, 90, 5])] + \
           [("b", i, w) for i, w in enumerate([10, 150, 10, 20])]
    df = spark.createDataFrame(rows, "g string, o int, w int")
    got = {}
    for r in pack(df, ["g"], ["o"], "w", 100).collect():
        got.setdefault(r.g, {})[r.o] = r.slot
    assert [got["a"][i] for i in range(6)] == [1, 1, 2, 2, 3, 3]
    assert [got["b"][i] for i in range(4)] == [1, 2, 3, 3]


def test_random_next_fit_fold_and_parallel(spark):
    rnd = random.Random(7)
    rows, expect = [], {}
    for g in range(40):
        n = rnd.randint(1, 60)
        ws = [rnd.choice([0, 1, 5, 20, 50, 99, 100, 101, 250]) for _ in range(n)]
        for i, w in enumerate(ws):
            rows.append((g, i * 3 + 1, w))
        for i, s in enumerate(next_fit(ws, 100)):
            expect[(g, i * 3 + 1)] = s
    df = spark.createDataFrame(rows, "g int, o int, w bigint")
    fold = {(r.g, r.o): r.slot for r in pack(df, ["g"], ["o"], "w", 100).collect()}
    par = {(r.g, r.o): r.slot for r in pack(df, ["g"], ["o"], "w", 100, max_fold_items=0).collect()}
    assert fold == expect
    assert par == expect


def test_hot_group_parallel_equals_fold(spark):
    rnd = random.Random(3)
    ws = [rnd.randint(1, 40) for _ in range(5000)] + [500] + [rnd.randint(1, 40) for _ in range(2000)]
    rows = [(1, i, w) for i, w in enumerate(ws)] + [(2, i, 7) for i in range(30)]
    df = spark.createDataFrame(rows, "g int, o int, w int")
    got = {(r.g, r.o): r.slot for r in pack(df, ["g"], ["o"], "w", 100, max_fold_items=100).collect()}
    assert [got[(1, i)] for i in range(len(ws))] == next_fit(ws, 100)
    assert [got[(2, i)] for i in range(30)] == next_fit([7] * 30, 100)


def test_one_rule_at_any_size(spark):
    """Fractional weights, ties on the order key, null keys and odd weights: the fold and the parallel path agree."""
    rnd = random.Random(5)
    rows = []
    for g in (None, "a", "b", "c"):
        for _ in range(600):
            w = rnd.choice([0.1, 0.2, 0.7, 33.3333333, 1 / 3, 99.999999, 100.0, 100.0000001, 250.5, 0.0])
            rows.append((g, rnd.randrange(40), w, rnd.choice(["x", "y", None])))
    rows += [("a", 3, None, "x"), ("a", 4, float("nan"), "y"), ("b", 1, -5.0, "x"), ("b", 2, float("inf"), "y"), ("c", 1, 1e300, None)]
    df = spark.createDataFrame(rows, "g string, o int, w double, note string").repartition(7)

    def slots(**kw):
        return sorted(pack(df, ["g"], ["o"], "w", 100.0, **kw).collect(), key=str)

    fold = slots(max_fold_items=None)
    assert str(fold) == str(slots(max_fold_items=601))  # NaN differs from itself
    order = lambda r: (r.o, r.w is not None, (r.w != r.w, r.w) if r.w is not None else 0, r.note is not None, r.note or "")
    for g in (None, "a", "b", "c"):
        mine = sorted((r for r in fold if r.g == g), key=lambda r: (r.slot, order(r)))
        assert mine == sorted(mine, key=order)  # slots follow the total order
        units = [0 if r.w is None or r.w != r.w or r.w < 0 else min(round(min(r.w, 1e6) * 10**6), 10**8 + 1) for r in mine]
        assert [r.slot for r in mine] == next_fit(units, 10**8)


def test_decimal_weights_and_wide_sums(spark):
    rows = [(1, i, Decimal(f"{i % 7}.{i % 10}{i % 3}")) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, o int, w decimal(20,2)")
    want = next_fit([int(w * 100) for _, _, w in rows], 1000)
    for m in (None, 10):
        got = {r.o: r.slot for r in pack(df, ["g"], ["o"], "w", 10, max_fold_items=m).collect()}
        assert [got[i] for i in range(400)] == want
    big = spark.createDataFrame([(1, i, 2**60) for i in range(50)], "g int, o int, w bigint")
    for m in (None, 10):  # prefix sums pass 64 bits
        got = {r.o: r.slot for r in pack(big, ["g"], ["o"], "w", 2**61, max_fold_items=m).collect()}
        assert [got[i] for i in range(50)] == next_fit([2**60] * 50, 2**61)
    with pytest.raises(ValueError):
        pack(df, ["g"], ["o"], "w", 2.0**62)


HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def split_rule(body, H, mx):
    """Cut positions over the body, as stated in split.py's docstring."""
    T = max(mx * 0.8, 200)
    start, c, lh, nl, cuts = 0, 0, -1, 0, []
    for i, line in enumerate(body):
        hk, nb = bool(HUNK.match(line)), bool(line.strip())
        if hk and i > start and c + H >= T:
            cuts.append(i)
            start, c, lh = i, 0, -1
        if hk:
            lh, nl = i, 0
        if nb:
            c += 1
            nl += 1
        if c + H >= mx:
            if lh > start:
                cuts.append(lh)
                start, c = lh, nl
            else:
                cuts.append(i + 1)
                start, c, lh = i + 1, 0, -1
    bounds = [0] + [x for x in cuts if x < len(body)] + [len(body)]
    head_nb = H  # headers below have no blank lines
    return [head_nb + sum(1 for l in body[a:b] if l.strip()) for a, b in zip(bounds, bounds[1:])]


def random_section(rnd, k):
    body = []
    for h in range(rnd.randint(1, 12)):
        body.append(f"@@ -{h + 1},5 +{h + 1},5 @@")
        for _ in range(rnd.randint(0, 120)):
            body.append(rnd.choice(["+x", "-y", " z", "", " ", "+"]))
    head = [f"diff --git a/f{k}.c b/f{k}.c", "index 1..2 100644", f"--- a/f{k}.c", f"+++ b/f{k}.c"]
    return head, body


def test_random_split_matches_rule(spark, make_diffs):
    rnd = random.Random(11)
    texts, expect = {}, {}
    for k in range(30):
        head, body = random_section(rnd, k)
        mx = rnd.choice([4, 20, 60, 100, 250])
        texts[f"d{k}"] = "\n".join(head + body)
        n = sum(1 for l in head + body if l.strip())
        if n > mx:
            expect[f"d{k}"] = (mx, split_rule(body, len(head), mx))
    secs = S.sections(make_diffs(**texts))
    for diff_id, (mx, pieces) in expect.items():
        got = split_oversized(secs.where(F.col("diff_id") == diff_id), mx).orderBy("sub").collect()
        assert [r.lines for r in got] == pieces, diff_id
        if len(pieces) > 1:
            assert [r.sub_chunk_index for r in got] == list(range(1, len(pieces) + 1))


def test_golden_split_vectors(spark, make_diffs):
    head = ["diff --git a/v.c b/v.c", "index 1..2 100644", "--- a/v.c", "+++ b/v.c"]

    def hunks(n):
        return [l for h in range(n) for l in [f"@@ -{h},60 +{h},60 @@"] + [f"+l{j}" for j in range(60)]]

    cases = {"v14": (hunks(8), 250, [244, 244]), "v15": (hunks(4), 100, [61, 61, 61, 61]),
             "v16": (["@@ -1 +1 @@", "+a", "+b"], 4, [1, 1, 1])}
    secs = S.sections(make_diffs(**{k: "\n".join(head + b) for k, (b, _, _) in cases.items()}))
    for k, (_, mx, body_pieces) in cases.items():
        got = split_oversized(secs.where(F.col("diff_id") == k), mx).orderBy("sub").collect()
        assert [r.lines - 4 for r in got] == body_pieces, k


def test_paths_cross_blocks_of_positions(spark):
    """A path over many blocks of positions, found with few rounds: the jumps are walked inside their blocks."""
    from patchloom.operators import pack_parallel as P

    rng = np.random.default_rng(3)
    rows, want = [], set()
    for g in ("a", "b", None):
        n = 300
        nx = [int(p + rng.integers(1, 60 if p % 7 == 0 else 6)) for p in range(1, n + 1)]
        rows += [((g,), p, x if x <= n else n + 1, n) for p, x in enumerate(nx, 1)]
        p = 1
        while p <= n:
            want.add((g, p))
            p = nx[p - 1]
    jump = spark.createDataFrame(rows, "__g struct<k: string>, __pos long, __nx long, __N long")
    for size in (16, 1 << 18):
        got = P.reachable(jump, ["__g"], jump.where("__pos = 1").select("__g", "__pos"), 300, positions_per_block=size).collect()
        assert len(got) == len(want) and {(r[0].k, r[1]) for r in got} == want
