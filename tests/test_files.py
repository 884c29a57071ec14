"""Files of every kind come out with a status, under one name in batch, stream and line form."""

import os

from pyspark.sql import functions as F

from patchloom.options import LoadOptions
from patchloom.operators.line_table import read_diff_lines
from patchloom.plans.corpus_plan import DiffCorpus, load_path
from patchloom.sources.files import read_diff_files
from patchloom.sources.versions import CorpusStore
from patchloom.streaming.ingest import ingest_into

NAMES = ["plain.diff", "two words.diff", "a+b%20c.diff", "ünï #1.diff", "x[1]{2}.diff"]


def diff(name, n=3):
    return "\n".join([f"diff --git a/{name}.c b/{name}.c", "index 1..2 100644", "@@ -1 +1 @@"] + [f"+{name} {k}" for k in range(n)])


def folder_of(tmp_path):
    f = tmp_path / "landing"
    f.mkdir()
    for k, n in enumerate(NAMES):
        (f / n).write_text(diff(f"f{k}", 3 + k))
    (f / "zero.diff").write_bytes(b"")
    (f / "text.diff").write_text("hello")
    (f / "trivial.diff").write_text("diff --git a/t b/t\nindex 1..2 100644")
    (f / "other.txt").write_text(diff("other"))
    return f


def names(df):
    return {os.path.basename(r.diff_id) for r in df.select("diff_id").distinct().collect()}


def test_every_file_has_a_row(spark, tmp_path):
    f = folder_of(tmp_path)
    (f / "gone.diff").write_text(diff("gone"))
    d = read_diff_files(spark, str(f))
    os.remove(f / "gone.diff")  # listed, but not there when it is read
    got = {os.path.basename(r.diff_id): (r.status, r.length, r.content) for r in d.collect()}
    assert set(got) == {*NAMES, "zero.diff", "text.diff", "trivial.diff", "gone.diff"}
    assert got["zero.diff"] == ("empty", 0, "") and got["gone.diff"][0] == "unreadable"
    assert all(got[n][0] is None and got[n][2] == (f / n).read_text() for n in NAMES)
    status = {os.path.basename(r.diff_id): r.status for r in DiffCorpus(read_diff_files(spark, str(f))).status().collect()}
    assert status == dict.fromkeys(NAMES, "ok") | {"zero.diff": "empty", "text.diff": "no_diff_content", "trivial.diff": "all_filtered"}
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "z.diff").write_bytes(b"")
    assert [(r.status, r.length) for r in read_diff_files(spark, str(empty)).collect()] == [("empty", 0)]


def test_one_name_and_result_in_every_regime(spark, tmp_path):
    f = folder_of(tmp_path)
    rows = read_diff_files(spark, str(f))
    by_row = {r.diff_id for r in rows.where("length > 0").collect()}
    assert by_row == {r.diff_id for r in read_diff_lines(spark, str(f)).select("diff_id").distinct().collect()}
    o = LoadOptions(max_chunk_lines=4)
    want = None
    for limit in (None, 75, 10):  # all in rows, some as lines, all but the shortest as lines
        c = load_path(spark, str(f), o, row_bytes=limit)
        assert (c.lines is None) == (limit is None)
        got = (sorted(map(str, c.chunks.select("diff_id", "chunk", "files", "lines", "parent_file", "sub_chunk_index", "content").collect())),
               sorted(map(tuple, c.status().collect())), sorted(map(str, c.stats.collect())),
               sorted(map(tuple, c.find_chunks("f*.c").collect())))
        want = want or got
        assert got == want
    assert dict(want[1])[next(x for x in by_row if x.endswith("plain.diff"))] == "ok" and len(want[1]) == 8


def test_stream_edits_in_place_and_empty_files(spark, tmp_path):
    f = folder_of(tmp_path)
    store = CorpusStore(spark, str(tmp_path / "store"), n_buckets=4)

    def run(reconcile=False):
        ingest_into(store, str(f), str(tmp_path / "ckpt"), reconcile=reconcile).awaitTermination()

    def state():
        return {os.path.basename(r.diff_id): (r.version, r.status) for r in store.current().collect()}

    run()
    first = dict.fromkeys(NAMES, (1, "ok")) | {"text.diff": (1, "no_diff_content"), "trivial.diff": (1, "all_filtered")}
    assert state() == first
    assert store.generation() == 1
    (f / "plain.diff").write_text(diff("edited", 9))
    os.utime(f / "plain.diff", (2**31, 2**31))
    run()  # the stream reports no edit in place
    assert state() == first
    (f / "new.diff").write_text(diff("new"))
    run(reconcile=True)
    assert state() == first | {"plain.diff": (2, "ok"), "new.diff": (1, "ok"), "zero.diff": (1, "empty")}
    g = store.generation()
    assert store.sync(str(f)) == g  # nothing has changed
    want = DiffCorpus(read_diff_files(spark, str(f))).chunks.select("diff_id", "chunk", F.md5("content"))
    assert sorted(map(tuple, store.table("chunks").select("diff_id", "chunk", F.md5("content")).collect())) == sorted(map(tuple, want.collect()))
