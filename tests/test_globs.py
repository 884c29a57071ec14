"""Glob -> Java regex against fnmatch, evaluated by Spark's rlike."""

import fnmatch

from pyspark.sql import functions as F

from patchloom.functions.globs import glob_match, glob_to_regex, literal_key, literal_runs
from patchloom.operators.lookup import match_globs, patterns_table

PATTERNS = ["*", "**/*", "*.{js,json}", "**/test/**", "src/**/*.py", "[abc]*", "file[0-9].txt", "[!s]*", "*.py",
            "?x", "[a[]*", "[]a]*", "[!]a]*", "a[b", "[z-a]x", "[^a]*", "a\\b*", "x.y+z", "(a)|b", "[a-]*", "*test*"]
NAMES = ["a", "s", "src/a.py", "src/x/y.py", "file1.txt", "file.txt", "test/x", "a/test/b", "x.{js,json}", "a.js", "b",
         "[x", "a[", "ab", "zx", "^q", "]a", "a\\bc", "x.y+z", "(a)|b", "-q", "sx", "a-b", "a\nb", "src/\n.py", "é",
         "tests/t1_test.go", "lib/a b/1.txt"]


def test_glob_zoo_matches_fnmatch(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    cols = [glob_match("name", p).alias(f"p{i}") for i, p in enumerate(PATTERNS)]
    rows = df.select("name", *cols).collect()
    for r in rows:
        for i, p in enumerate(PATTERNS):
            assert r[f"p{i}"] == fnmatch.fnmatchcase(r.name, p), (p, r.name, glob_to_regex(p))


def test_literal_keys():
    assert literal_runs("src/**/*.py") == ["src/", "", "/", ".py"] and literal_runs("[!]a]x[b") == ["", "x[b"]
    assert literal_key("src/**/*.py") == ("p", "src/") and literal_key("*.py") == ("s", ".py")
    assert literal_key("*tests*") == ("g", "tes") and literal_key("**") == ("n", "") and literal_key("a*") == ("p", "a")


def test_pattern_sets_match_fnmatch(spark):
    paths = spark.createDataFrame([(n,) for n in NAMES + [""]], "path string").distinct()
    want = {(n, p) for n in NAMES + [""] for p in PATTERNS + ["", "**"] if fnmatch.fnmatchcase(n, p)}
    got = [tuple(r) for r in match_globs(paths, patterns_table(spark, PATTERNS + ["", "**", "*"])).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert match_globs(paths, patterns_table(spark, [])).count() == 0


def test_many_patterns_without_nested_loop(spark):
    n = 100_000
    patterns = [f"src/m{k}/*.py" for k in range(n // 2)] + [f"*/t{k}_test.go" for k in range(n // 4)] + [f"*-{k}-*" for k in range(n // 4 - 2)] + ["*", "?*"]
    paths = spark.range(3000).selectExpr("explode(array(concat('src/m', id * 20, '/a.py'), concat('lib/t', id * 9, '_test.go'), concat('x-', id * 8, '-y'))) as path")
    found = match_globs(paths, patterns_table(spark, patterns))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    own = found.where("pattern not in ('*', '?*')")
    assert own.count() == 2500 + 2778 + 3000 and found.count() == 2 * 9000 + own.count()
