"""Text semantics (T1-T9) against Python's own behaviour."""

import io

from pyspark.sql import functions as F

from patchloom.functions import text as T
from patchloom.operators import sections as S

TRICKY = ["", " ", "\t", " ", "\u0085", " ", "\x1c", "\x1f", "\x0b\x0c", " x ", "　a", "+", "-", "é",
          "​", "﻿", "a b"]


def py_lines(content: str) -> list[str]:
    return [l.rstrip("\n\r") for l in io.StringIO(content, newline=None).readlines()]


def test_nonblank_matches_python_strip(spark):
    df = spark.createDataFrame([(s,) for s in TRICKY], "s string")
    got = {r.s: r.nb for r in df.select("s", T.is_nonblank("s").alias("nb")).collect()}
    for s in TRICKY:
        assert got[s] == bool(s.strip()), repr(s)


def test_universal_newlines(spark, make_diffs):
    cases = {"a": "x\r\ny\rz\n", "b": "x\n\n", "c": "", "d": "\n", "e": "p\n\rq", "f": "only", "g": "a\r\r\nb"}
    got = {}
    for r in S.diff_lines(make_diffs(**cases)).collect():
        got.setdefault(r.diff_id, []).append((r.ln, r.line))
    for k, v in cases.items():
        assert [l for _, l in sorted(got.get(k, []))] == py_lines(v), k


def test_header_regex_greedy_and_unicode(spark):
    rows = [("diff --git a/foo b/bar b/foo b/bar",), ("diff --git a/x y b/x y",), ("diff --git a/ b/z",),
            ('diff --git "a/q" "b/q"',), ("diff --git a/nob",)]
    df = spark.createDataFrame(rows, "l string")
    pa, pb = T.header_paths("l")
    got = [(r.h, r.a, r.b) for r in df.select(T.is_header("l").alias("h"), pa.alias("a"), pb.alias("b")).collect()]
    assert got[0] == (True, "foo b/bar b/foo", "bar")
    assert got[1] == (True, "x y", "x y")
    assert got[2] == (True, "", "z")
    assert got[3][0] is False and got[4][0] is False


def test_decode_replacement_matches_python(spark):
    samples = [b"ok", b"\xff\xfe", b"a\xe2\x82", b"\xed\xa0\x80x", b"\xf0\x9f\x8c\x8d", b"\xc3("]
    df = spark.createDataFrame([(bytearray(b),) for b in samples], "b binary")
    got = [r.s for r in df.select(T.decode_utf8("b").alias("s")).collect()]
    assert got == [b.decode("utf-8", errors="replace") for b in samples]


def test_line_counts_and_flags(spark, make_diffs):
    text = "\n".join(["diff --git a/w.txt b/w.txt", "index 1..2 100644", "--- a/w.txt", "+++ b/w.txt",
                      "@@ -1,3 +1,3 @@", "-line1   ", "+line1", "-  x", "+\tx", " ", "+++i", "+"])
    s = S.sections(make_diffs(a=text)).collect()[0]
    assert s.n_lines == 11 and s.n_raw == 12 and s.header_len == 4
    assert s.is_trivial is False  # '-line1   ' vs '+line1' still counts as an edit


def test_trivial_counts_only_real_edits(spark, make_diffs):
    text = "\n".join(["diff --git a/t.c b/t.c", "--- a/t.c", "+++ b/t.c", "@@ -1 +1 @@", "+++i", "---j", "+   ", "-",
                      " context"])
    s = S.sections(make_diffs(a=text)).collect()[0]
    assert s.is_trivial is True


def test_generated_markers_are_lowercase_substrings(spark, make_diffs):
    names = ["Pipfile.lock", ".DS_Store", "Thumbs.db", "rebuild/x", "a.mapper.py", "src/main.py", "X.MIN.JS"]
    text = "\n".join(f"diff --git a/{n} b/{n}\n@@ -1 +1 @@\n+x" for n in names)
    got = {r.path_a: r.is_generated for r in S.sections(make_diffs(a=text)).collect()}
    assert got == {"Pipfile.lock": True, ".DS_Store": False, "Thumbs.db": False, "rebuild/x": True,
                   "a.mapper.py": True, "src/main.py": False, "X.MIN.JS": True}


def test_hunk_numbers_beyond_32_and_64_bits(make_diffs):
    from patchloom.operators.sections import hunks, sections
    d = make_diffs(a="diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -99999999999,1 +1 @@\n+y\n@@ -1,99999999999999999999 +2,0 @@\n+z\n")
    rows = [tuple(r)[2:] for r in hunks(sections(d)).orderBy("hunk").collect()]
    assert rows == [(1, 99999999999, 1, 1, 1), (2, 1, None, 2, 0)]
