"""Golden vectors: small inline diffs with results derived by hand from the tool's rules."""

import pytest
from pyspark.sql import functions as F

from patchloom.options import LoadOptions, check_chunk_number, check_pattern
from patchloom.plans.corpus_plan import DiffCorpus


def sec(path, body, index=True, pm=True, hunk="@@ -1 +1 @@", path_b=None):
    pb = path_b or path
    out = [f"diff --git a/{path} b/{pb}"]
    if index:
        out.append("index 1234567..abcdefg 100644")
    if pm:
        out += [f"--- a/{path}", f"+++ b/{pb}"]
    if hunk:
        out.append(hunk)
    return out + body


def text(*sections, trailing=""):
    return "\n".join(l for s in sections for l in s) + trailing


def stats(corpus: DiffCorpus, diff_id="d"):
    r = corpus.stats.where(F.col("diff_id") == diff_id).collect()
    return (r[0].chunks_count, r[0].total_files, r[0].total_lines) if r else (0, 0, 0)


def test_v1_binary_and_text(make_diffs):
    binary = ["diff --git a/media/intro.ogg b/media/intro.ogg", "new file mode 100644", "index 0000000..9a1c3d2",
              "Binary files /dev/null and b/media/intro.ogg differ", "", ""]
    t = text(binary, sec("docs/notes.rst", ["-first draft", "+second draft", "+ends here", " unchanged"], hunk="@@ -7,2 +7,3 @@"))
    d = make_diffs(d=t)
    assert stats(DiffCorpus(d)) == (1, 1, 9)  # five header lines and four body lines
    assert stats(DiffCorpus(d, LoadOptions(skip_trivial=False))) == (1, 2, 13)  # and four of the binary section


def test_v2_unicode(make_diffs):
    t = text(sec("příklad/číslo.txt", ["-größer", "+größer als 千", "+🚲 ß", " ende"], hunk="@@ -3,2 +3,3 @@"))
    c = DiffCorpus(make_diffs(d=t))
    assert stats(c) == (1, 1, 9)
    assert "+🚲 ß" in c.get_chunk("d", 1).collect()[0].text
    assert [r.chunk for r in c.find_chunks("příklad/*").collect()] == [1]


def test_v3_quoted_header_is_preamble(make_diffs):
    """A header with quoted paths isn't one: its lines belong to the preamble, or to the section before it."""
    quoted = ['diff --git "a/my notes/to do.md" "b/my notes/to do.md"', "index 55aa55a..66bb66b 100644",
              '--- "a/my notes/to do.md"', '+++ "b/my notes/to do.md"', "@@ -2 +2 @@", "-buy milk", "+buy bread"]
    plain = sec("lib/shop.lua", ["-return 1", "+return 2", "+-- done"], hunk="@@ -1 +1,2 @@")
    c = DiffCorpus(make_diffs(d=text(quoted, plain)))
    assert stats(c) == (1, 1, 8)
    assert [r.chunk for r in c.find_chunks("*.lua").collect()] == [1]
    assert c.find_chunks("*.md").count() == 0
    assert stats(DiffCorpus(make_diffs(d=text(plain, quoted)))) == (1, 1, 15)


def test_v4_include(make_diffs):
    t = text(sec("main.py", ["-old line", "+new line"]), [""], sec("config.json", ["-old config", "+new config"]))
    c = DiffCorpus(make_diffs(d=t), LoadOptions.from_strings(include_patterns="*.py"))
    assert stats(c) == (1, 1, 7)


def test_v5_no_hunks(make_diffs):
    t = text(sec("unchanged.txt", [], hunk=None))
    d = make_diffs(d=t)
    assert stats(DiffCorpus(d)) == (0, 0, 0)
    assert DiffCorpus(d).status().collect()[0].status == "all_filtered"
    assert stats(DiffCorpus(d, LoadOptions(skip_trivial=False))) == (1, 1, 4)


def test_v6_large_hunk_split(make_diffs):
    body = []
    for i in range(1000):
        body += [f"-old line {i}", f"+new line {i}"] if i % 2 == 0 else [f" unchanged line {i}"]
    t = text(sec("large.txt", body, hunk="@@ -1,1000 +1,1000 @@"))
    c = DiffCorpus(make_diffs(d=t), LoadOptions(max_chunk_lines=500))
    assert stats(c) == (4, 1, 1517)
    rows = c.list_chunks().orderBy("chunk").collect()
    assert [r.lines for r in rows] == [500, 500, 500, 17]
    assert [r.sub_chunk_index for r in rows] == [1, 2, 3, 4]
    assert rows[0].parent_file == "large.txt" and rows[0].summary == "large.txt (part 1), 500 lines"
    assert c.sections.collect()[0].n_lines == 1505


def test_v7_generated(make_diffs):
    """Markers are substrings of the lower-cased path; a marker with capitals (".DS_Store") therefore never matches."""
    generated = {"tools/Gemfile.LOCK", "web/site.min.css", "web/site.js.map", "app/__pycache__/run.txt", "a/node_modules/b/index.ts", "out/dist/x.txt",
                 "sub/.git/config", "rebuild/all.mk"}
    regular = {"web/site.css", "app/run.py", "maps/world.txt", "distance.c", "pics/.DS_Store", "builder.py"}
    parts = [sec(name, [f"-was {k}", f"+is {k}"]) for k, name in enumerate(sorted(generated | regular))]
    d = make_diffs(d=text(*parts))
    c = DiffCorpus(d)
    assert set(c.chunk_meta.collect()[0].files) == regular
    assert stats(c) == (1, 6, 42)
    assert stats(DiffCorpus(d, LoadOptions(skip_generated=False))) == (1, 14, 98)


def test_v8_whitespace_edits(make_diffs):
    """A changed line counts unless nothing but white space follows its sign."""
    spaces = sec("fmt.c", ["-if (x) {", "+if (x)  {", " }"], hunk="@@ -9,2 +9,2 @@")  # text on changed lines
    blank = sec("gap.c", ["-", "+  ", "+\t", " int y;"], hunk="@@ -4,2 +4,3 @@")  # white space only
    d = make_diffs(d=text(spaces, blank))
    assert stats(DiffCorpus(d)) == (1, 1, 8)
    assert stats(DiffCorpus(d, LoadOptions(skip_trivial=False))) == (1, 2, 17)


def test_v9_invalid_utf8(spark, tmp_path):
    raw = ("diff --git a/test.txt b/test.txt\nindex 1234567..abcdefg 100644\n--- a/test.txt\n+++ b/test.txt\n"
           "@@ -1 +1 @@\n-old line\n").encode() + b"+new line with \xff\xfe invalid bytes\n"
    (tmp_path / "x.diff").write_bytes(raw)
    c = DiffCorpus.from_files(spark, str(tmp_path))
    diff_id = c.diffs.collect()[0].diff_id
    assert stats(c, diff_id) == (1, 1, 7)
    content = c.get_chunk(diff_id, 1, include_context=False).collect()[0].text
    assert content.count("�") == 2


def test_v10_short_header(make_diffs):
    t = text(sec("incomplete.txt", ["-old line", "+new line"], pm=False))
    c = DiffCorpus(make_diffs(d=t))
    assert stats(c) == (1, 1, 5)
    assert c.sections.collect()[0].header_len == 2


def test_v11_no_diff_content(make_diffs):
    d = make_diffs(d="This is not a valid diff file\nRandom content\n", e="")
    c = DiffCorpus(d)
    assert {r.diff_id: r.status for r in c.status().collect()} == {"d": "no_diff_content", "e": "no_diff_content"}


def test_v17_rename_and_v18_greedy_paths(make_diffs):
    ren = sec("x.py", ["-a", "+b"], path_b="y.py")
    odd = ["diff --git a/foo b/bar b/foo b/bar", "@@ -1 +1 @@", "-q", "+r"]
    c = DiffCorpus(make_diffs(d=text(ren, odd)))
    files = c.sections.orderBy("sec").select("files").collect()
    assert files[0].files == ["x.py", "y.py"] and files[1].files == ["foo b/bar b/foo", "bar"]
    assert stats(c)[1] == 4


def test_v17_oversized_rename_parent(make_diffs):
    body = [f"+l{i}" for i in range(30)]
    c = DiffCorpus(make_diffs(d=text(sec("x.py", body, path_b="y.py"))), LoadOptions(max_chunk_lines=10))
    assert {r.parent_file for r in c.list_chunks().collect()} == {"2 files"}


def test_v19_plus_plus_plus_edit_is_trivial(make_diffs):
    c = DiffCorpus(make_diffs(d=text(sec("i.c", ["+++i"]))))
    assert c.sections.collect()[0].is_trivial is True


def test_v20_repeated_path(make_diffs):
    a = sec("s.js", ["-a", "+b"])
    t = text(a, sec("t.js", ["-a", "+b"]), a)
    c = DiffCorpus(make_diffs(d=t))
    assert c.chunk_meta.collect()[0].files == ["s.js", "t.js"]
    c2 = DiffCorpus(make_diffs(d=t), LoadOptions(max_chunk_lines=7))
    idx = {r.path: r.chunks for r in __import__("patchloom.operators.chunks", fromlist=["x"]).file_chunk_index(
        c2.chunk_meta).collect()}
    assert idx["s.js"] == [1, 3]


def test_render_header(make_diffs):
    c = DiffCorpus(make_diffs(d=text(sec("a.py", ["-x", "+y"]))))
    got = c.get_chunk("d", 1).collect()[0].text
    assert got.startswith("=== Chunk 1 of 1 ===\nFiles: a.py\nLines: 7\n" + "=" * 50 + "\ndiff --git a/a.py b/a.py")


def test_validation():
    with pytest.raises(ValueError):
        LoadOptions(max_chunk_lines=0)
    with pytest.raises(ValueError):
        check_chunk_number(0)
    with pytest.raises(ValueError):
        check_pattern("  ")
    assert LoadOptions.from_strings(include_patterns=" *.py, ,src/* ").include_patterns == ("*.py", "src/*")


def test_g2_missing_path(spark, tmp_path):
    with pytest.raises(ValueError, match="Diff file not found"):
        DiffCorpus.from_files(spark, str(tmp_path / "nope.diff"))
    with pytest.raises(ValueError, match="non-empty"):
        DiffCorpus.from_files(spark, "  ")


def test_single_named_file(spark, tmp_path):
    f = tmp_path / "change.patch"
    f.write_text(text(sec("a.py", ["-x", "+y"])))
    c = DiffCorpus.from_files(spark, str(f))
    assert stats(c, c.diffs.collect()[0].diff_id) == (1, 1, 7)


def test_hot_diffs_take_the_parallel_pack(spark):
    """Every diff over max_fold_items sections: slots come from the parallel path; same chunks."""
    from patchloom.sources.corpus import load_corpus
    diffs = load_corpus(spark, "/root/testdata/sf0.001")
    opts = LoadOptions(max_chunk_lines=40)
    cols = ["diff_id", "chunk", "lines", "parent_file", "sub_chunk_index"]
    hot = DiffCorpus(diffs, opts, max_fold_items=2).chunks.select(*cols, F.md5("content"))
    base = DiffCorpus(diffs, opts).chunks.select(*cols, F.md5("content"))
    assert sorted(map(tuple, hot.collect())) == sorted(map(tuple, base.collect()))


def test_empty_corpus_overview(spark):
    empty = spark.createDataFrame([], "diff_id string, content string")
    c = DiffCorpus(empty)
    row = c.overview().collect()[0]
    assert row.loaded is False and row.total_sessions == 0 and row.chunks == 0
    assert c.list_chunks().count() == 0
