"""Section records of giant diffs equal the row path, wherever the byte ranges are cut."""

import pytest
from pyspark.sql import functions as F

from patchloom.operators.section_records import SectionDiffCorpus, read_records
from patchloom.options import LoadOptions
from patchloom.plans.corpus_plan import DiffCorpus
from patchloom.sources.corpus import load_corpus
from patchloom.sources.files import read_diff_files

COLUMNS = ["diff_id", "chunk", "files", "lines", "parent_file", "sub_chunk_index", "content"]
SECTIONS = ["diff_id", "sec", "path_a", "path_b", "n_lines", "n_raw", "header_len", "is_trivial", "is_generated", "text"]


def rows(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.fixture
def small_ranges(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_corpus_equals_row_path(spark, tmp_path, small_ranges):
    for r in load_corpus(spark, "/root/testdata/sf0.001").collect():
        body = r.content.replace("\n", "\r\n") if r.diff_id.endswith(("1-0", "3-0", "5-0")) else r.content
        (tmp_path / f"{r.diff_id}.diff").write_bytes(body.encode())
    assert read_records(spark, str(tmp_path)).select("diff_id", "blk").distinct().count() > 60
    o = LoadOptions(max_chunk_lines=40)
    want = DiffCorpus(read_diff_files(spark, str(tmp_path)), o)
    got = SectionDiffCorpus.from_text_files(spark, str(tmp_path), o, max_fold_items=5)
    assert rows(got.chunks, COLUMNS) == rows(want.chunks, COLUMNS)
    assert rows(got.stats, want.stats.columns) == rows(want.stats, want.stats.columns)
    assert rows(got.status(), ["diff_id", "status"]) == rows(want.status(), ["diff_id", "status"])
    d = sorted(r.diff_id for r in want.stats.collect())[2]
    assert got.get_chunk(d, 2).collect()[0].text == want.get_chunk(d, 2).collect()[0].text
    plan = got.facts._jdf.queryExecution().optimizedPlan().toString()
    assert not any("text#" in x for x in plan.splitlines() if "Window" in x or "Sort" in x or "InMemoryRelation" in x)
    got.unpersist()


def test_odd_texts(spark, tmp_path):
    """Records that only look like sections, blank lines around headers, every line end, files without a section."""
    sec = "diff --git a/{0} b/{0}\nindex 1..2 100644\n@@ -1 +1 @@\n-old {0}\n+new {0}"
    mark = "diff --git a/no header here\n+more of the section before"
    texts = {
        "plain": "\n".join(sec.format(n) for n in "xyz"),
        "preamble": "hello\n\n" + sec.format("p") + "\n\n\n" + sec.format("q") + "\n",
        "marks": mark + "\n" + sec.format("m") + "\n" + mark + "\n\n" + mark + "\n" + sec.format("n") + "\n" + mark + "\n",
        "crlf": "\r\n".join(sec.format(n).replace("\n", "\r\n") for n in "rst") + "\r\n",
        "cr": "\r".join(sec.format(n).replace("\n", "\r") for n in "uv"),
        "mixed": sec.format("1") + "\r\r\n" + sec.format("2") + "\n\r" + sec.format("3").replace("\n", "\r\n") + "\n\n",
        "none": "no section\nat all", "blank": "\n\n", "header": "diff --git a/only b/only",
        "long": sec.format("big") + "".join(f"\n@@ -{k} +{k} @@\n+é{k}\n+ß{k}\n" for k in range(300)) + "\n" + sec.format("end"),
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.diff").write_bytes(text.encode() + (b"\n+\xff\xfe" if name == "plain" else b""))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("41", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for m in (3, 50):
                o = LoadOptions(max_chunk_lines=m, skip_trivial=False)
                want = DiffCorpus(read_diff_files(spark, str(tmp_path)), o)
                got = SectionDiffCorpus.from_text_files(spark, str(tmp_path), o)
                assert rows(got.sections, SECTIONS) == rows(want.sections, SECTIONS), size
                assert rows(got.chunks, COLUMNS) == rows(want.chunks, COLUMNS), (size, m)
                got.unpersist()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
