"""The line-table path (giant diffs split over file blocks) equals the row path."""

from pyspark.sql import functions as F

from patchloom.operators.line_table import LineDiffCorpus, number_lines, read_diff_lines
from patchloom.options import LoadOptions
from patchloom.plans.corpus_plan import DiffCorpus
from patchloom.sources.corpus import load_corpus


def test_line_path_equals_row_path(spark, tmp_path):
    rows = load_corpus(spark, "/root/testdata/sf0.001").collect()
    for r in rows:
        # CRLF in half the files: the text reader must treat every terminator alike
        body = r.content.replace("\n", "\r\n") if r.diff_id.endswith(("1-0", "3-0", "5-0")) else r.content
        (tmp_path / f"{r.diff_id}.diff").write_bytes(body.encode("utf-8"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many blocks per file
    try:
        lines = read_diff_lines(spark, str(tmp_path))
        assert lines.select("diff_id", "blk").distinct().count() > 3 * len(rows)
        opts = LoadOptions(max_chunk_lines=40)
        lc = LineDiffCorpus(lines, opts)
        got = lc.chunks.select(F.regexp_extract("diff_id", r"([^/]+)\.diff$", 1).alias("diff_id"), "chunk", "lines",
                               "parent_file", "sub_chunk_index", F.md5("content").alias("m"))
        want = DiffCorpus(load_corpus(spark, "/root/testdata/sf0.001"), opts).chunks.select(
            "diff_id", "chunk", "lines", "parent_file", "sub_chunk_index", F.md5("content").alias("m"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        n = number_lines(lines)
        per = n.groupBy("diff_id").agg(F.min("ln"), F.max("ln"), F.count("*")).collect()
        assert all(r[1] == 0 and r[2] == r[3] - 1 for r in per)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_giant_sections_split_in_parallel(spark, make_diffs):
    """Force every oversized section through the parallel split; results equal the fold."""
    from patchloom.operators.line_table import lines_from_diffs
    diffs = load_corpus(spark, "/root/testdata/sf0.001")
    for m in (20, 40):
        opts = LoadOptions(max_chunk_lines=m)
        lc = LineDiffCorpus(lines_from_diffs(diffs), opts, max_section_lines=0)
        assert lc.giant_pieces is not None
        got = lc.chunks.select("diff_id", "chunk", "lines", "parent_file", "sub_chunk_index", F.md5("content"))
        want = DiffCorpus(diffs, opts).chunks.select("diff_id", "chunk", "lines", "parent_file", "sub_chunk_index",
                                                     F.md5("content"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_parallel_split_edge_states(spark, make_diffs):
    """Back-tracks that leave the next piece full (blank lines before a hunk header)."""
    from patchloom.operators.line_table import lines_from_diffs
    head = ["diff --git a/e.c b/e.c", "index 1..2 100644", "--- a/e.c", "+++ b/e.c"]
    body = ["@@ -1 +1 @@", "+a", "+b", "+c", "+d", "+e", "", "", "@@ -9 +9 @@", "+f", "+g", "+h", "+i", "+j", "+k",
            "@@ -20 +20 @@", "+l", "", "@@ -30 +30 @@", "@@ -31 +31 @@", "+m", "+n", "+o", "+p", "+q", "+r", "+s"]
    texts = {"e": "\n".join(head + body), "f": "\n".join(head[:2] + body), "g": "\n".join(head + body[:9])}
    d = make_diffs(**texts)
    cols = ["diff_id", "chunk", "lines", "sub_chunk_index"]
    for m in (3, 4, 5, 6, 10):
        opts = LoadOptions(max_chunk_lines=m)
        lc = LineDiffCorpus(lines_from_diffs(d), opts, max_section_lines=0)
        got = sorted(map(tuple, lc.chunks.select(*cols, F.md5("content")).collect()))
        want = sorted(map(tuple, DiffCorpus(d, opts).chunks.select(*cols, F.md5("content")).collect()))
        assert got == want, m


def test_large_sections_bypass_the_section_shuffle(spark, monkeypatch):
    """With every section counted as large, texts come through the broadcast path; same chunks."""
    from patchloom.operators import line_table
    from patchloom.operators.line_table import lines_from_diffs
    monkeypatch.setattr(line_table, "LARGE_SECTION", 0)
    diffs = load_corpus(spark, "/root/testdata/sf0.001")
    opts = LoadOptions(max_chunk_lines=40)
    got = LineDiffCorpus(lines_from_diffs(diffs), opts).chunks.select("diff_id", "chunk", F.md5("content"))
    want = DiffCorpus(diffs, opts).chunks.select("diff_id", "chunk", F.md5("content"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_line_corpus_persist_and_lookups(spark):
    from patchloom.operators.line_table import lines_from_diffs
    diffs = load_corpus(spark, "/root/testdata/sf0.001")
    lc = LineDiffCorpus(lines_from_diffs(diffs), LoadOptions(max_chunk_lines=40)).persist()
    base = DiffCorpus(diffs, LoadOptions(max_chunk_lines=40))
    assert sorted(map(tuple, lc.stats.collect())) == sorted(map(tuple, base.stats.collect()))
    d = sorted(r.diff_id for r in base.stats.collect())[0]
    assert lc.get_chunk(d, 1).collect()[0].text == base.get_chunk(d, 1).collect()[0].text
    lc.unpersist()
