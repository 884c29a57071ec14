"""The versioned store: edits, late and repeated arrivals, failures, lookups and errors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from patchloom.options import LoadOptions
from patchloom.plans.corpus_plan import DiffCorpus
from patchloom.sources import versions
from patchloom.sources.versions import CorpusStore

T0 = dt.datetime(2024, 5, 1, 12)


def diff(name, n, word="line"):
    body = "\n".join([f"@@ -1,{n} +1,{n} @@"] + [f"+{word} {k}" for k in range(n)])
    return f"diff --git a/src/{name}.py b/src/{name}.py\nindex 1..2 100644\n{body}"


def rows(spark, *items):
    """items: (diff_id, content, minutes after T0 [, status, error])"""
    full = [(d, c, T0 + dt.timedelta(minutes=m), *(rest or (None, None))) for d, c, m, *rest in items]
    return spark.createDataFrame(full, "diff_id string, content string, modification_time timestamp, status string, error string")


def stored(store):
    return sorted(map(tuple, store.table("chunks").select("diff_id", "chunk", "lines", F.md5("content")).collect()))


def fresh(spark, options, **texts):
    d = spark.createDataFrame(list(texts.items()), "diff_id string, content string")
    return sorted(map(tuple, DiffCorpus(d, options).chunks.select("diff_id", "chunk", "lines", F.md5("content")).collect()))


def registry(store):
    return sorted((r.diff_id, r.version, r.status, r.generation) for r in store.table("registry").collect())


def test_edits_replays_and_late_arrivals(spark, tmp_path):
    o = LoadOptions(max_chunk_lines=5)
    s = CorpusStore(spark, str(tmp_path / "store"), n_buckets=4)
    assert s.generation() == 0 and s.list_chunks().count() == 0
    first = rows(spark, ("a", diff("a", 12), 0), ("b", diff("b", 3), 0), ("c", diff("c", 4), 0), ("d", "no diff", 0))
    assert s.load(first, o) == 1
    want = dict(a=diff("a", 12), b=diff("b", 3), c=diff("c", 4), d="no diff")
    assert stored(s) == fresh(spark, o, **want)
    before = s.manifest()
    assert s.load(first, o) == 1 and s.manifest() == before  # a replay changes nothing

    # an edit, a new diff, an older version of b that arrives late, and c landed twice: the newer counts
    second = rows(spark, ("a", diff("a", 2, "new"), 5), ("b", diff("b", 9), -5), ("c", diff("c", 7), 6), ("c", diff("c", 8), 7), ("e", diff("e", 1), 5), ("e", diff("e", 1), 5))
    assert s.load(second, o) == 2
    want |= dict(a=diff("a", 2, "new"), c=diff("c", 8), e=diff("e", 1))
    assert stored(s) == fresh(spark, o, **want)
    assert registry(s) == [("a", 1, "ok", 1), ("a", 2, "ok", 2), ("b", 1, "ok", 1), ("c", 1, "ok", 1), ("c", 2, "ok", 2), ("d", 1, "no_diff_content", 1), ("e", 1, "ok", 2)]
    assert s.load(second, o) == 2 and s.load(first, o) == 2
    assert sorted((r.diff_id, r.version) for r in s.current().collect()) == [("a", 2), ("b", 1), ("c", 2), ("d", 1), ("e", 1)]

    # buckets without a changed diff keep their folders
    moved = {s.bucket(x) for x in "ace"}
    for name, gens in s.manifest()["tables"].items():
        assert all(g == (2 if int(b) in moved else 1) for b, g in gens.items()), name

    # other options reload; a diff that loses all chunks leaves none behind
    assert s.load(rows(spark, ("b", diff("b", 3), 0)), LoadOptions(max_chunk_lines=2)) == 3
    assert s.load(rows(spark, ("e", "gone", 9)), o) == 4
    want["e"] = "gone"
    assert [x for x in stored(s) if x[0] != "b"] == [x for x in fresh(spark, o, **want) if x[0] != "b"]
    assert s.list_chunks("b").count() > 1 and s.list_chunks("e").count() == 0
    assert s.vacuum(keep=1) > 0
    assert [x for x in stored(s) if x[0] != "b"] == [x for x in fresh(spark, o, **want) if x[0] != "b"]


def test_a_failed_load_leaves_no_trace(spark, tmp_path, monkeypatch):
    o = LoadOptions(max_chunk_lines=5)
    s = CorpusStore(spark, str(tmp_path / "store"), n_buckets=3)
    s.load(rows(spark, ("a", diff("a", 12), 0), ("b", diff("b", 3), 0)), o)
    held = stored(s)
    write = s._write
    monkeypatch.setattr(s, "_write", lambda name, g, x: write(name, g, x) if name != "diff_stats" else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        s.load(rows(spark, ("a", diff("a", 1), 5), ("z", diff("z", 3), 5)), o)
    assert stored(s) == held and s.generation() == 1  # readers still see the first load
    monkeypatch.undo()
    assert s.load(rows(spark, ("b", diff("b", 30), 5)), o) == 2
    assert stored(s) == fresh(spark, o, a=diff("a", 12), b=diff("b", 30))
    with pytest.raises(RuntimeError):  # a second writer of the same generation
        s._commit(s.manifest())


def test_lookups_and_errors(spark, tmp_path):
    o = LoadOptions(max_chunk_lines=5)
    s = CorpusStore(spark, str(tmp_path / "store"), n_buckets=3)
    trivial = "diff --git a/x b/x\nindex 1..2 100644"
    s.load(rows(spark, ("a", diff("a", 12), 0), ("t", trivial, 0), ("n", "text", 0), ("z", "", 0, "empty", None), ("u", None, 0, "unreadable", "no permission")), o)
    c = DiffCorpus(spark.createDataFrame([("a", diff("a", 12))], "diff_id string, content string"), o)
    assert s.get_chunk("a", 2) == c.get_chunk("a", 2).collect()[0].text
    assert [r.chunk for r in s.find_chunks("a", "src/*.py").collect()] == [r.chunk for r in c.find_chunks("src/*.py").orderBy("chunk").collect()]
    n = c.stats.first().chunks_count
    for diff_id, k, message in [("a", 99, f"Chunk 99 not found. Available chunks: 1-{n}"), ("t", 1, "No chunks created"), ("n", 1, "No valid diff content found"),
                                ("z", 1, "File is empty"), ("u", 1, "no permission"), ("q", 1, "Diff not loaded: q"), ("a", 0, "chunk_number must be a positive integer")]:
        with pytest.raises(ValueError, match=message):
            s.get_chunk(diff_id, k)
    asked = spark.createDataFrame([("a", 1), ("a", 99), ("a", 0), ("t", 1), ("q", 1), (None, 1), ("a", 1)], "diff_id string, chunk int")
    got = {(r.diff_id, r.chunk): (r.content is not None, r.error) for r in s.get_chunks(asked).collect()}
    assert got == {("a", 1): (True, None), ("a", 99): (False, f"Chunk 99 not found. Available chunks: 1-{n}"), ("a", 0): (False, "chunk_number must be a positive integer"),
                   ("t", 1): (False, "No chunks created"), ("q", 1): (False, "Diff not loaded: q"), (None, 1): (False, "Diff not loaded: ")}
    # an unreadable version leaves the chunks of the one before
    s.load(rows(spark, ("a", None, 9, "unreadable", "gone")), o)
    assert s.get_chunk("a", 2) == c.get_chunk("a", 2).collect()[0].text
    assert [tuple(r) for r in s.sessions().collect()] == [("a", n, 1, c.stats.first().total_lines)]


def test_lookup_reads_one_bucket(spark, tmp_path):
    s = CorpusStore(spark, str(tmp_path / "store"), n_buckets=8)
    s.load(rows(spark, *[(f"d{k}", diff("x", 5), 0) for k in range(40)]))
    plan = s._of("chunks", "d7").where("chunk = 1")
    assert len(plan.inputFiles()) == 1
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(diff_id,d7)" in text and "EqualTo(chunk,1)" in text
    assert versions.SCHEMAS["chunks"].count("content") == 1 and "content" not in s.list_chunks("d7")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
