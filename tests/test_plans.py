"""Plan shape: the row regime adds no exchange after the diffs are partitioned by diff_id."""

from patchloom.options import LoadOptions
from patchloom.plans.corpus_plan import DiffCorpus


def _planner_exchanges(df) -> int:
    """Shuffles the planner had to add (the input's own repartition is REPARTITION_BY_NUM)."""
    return df._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS")


def test_chunk_build_reuses_diff_partitioning(spark, make_diffs):
    body = "\n".join(["diff --git a/a.py b/a.py", "@@ -1 +1 @@", "-x", "+y"] * 3)
    diffs = make_diffs(a=body, b=body, c=body)  # repartition(2, "diff_id"): the only exchange
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c = DiffCorpus(diffs, LoadOptions(max_chunk_lines=5), cache_kept=False)
        assert _planner_exchanges(c.chunks) == 0
        assert _planner_exchanges(c.stats) == 0
        assert c.chunks.count() > 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_facts_carry_no_text(spark, make_diffs):
    """Metadata queries drop the texts in the stage that reads them; neither fold nor cache holds them."""
    body = "\n".join(["diff --git a/a.py b/a.py", "@@ -1 +1 @@", "-x", "+y"] * 3)
    for cached in (False, True):
        c = DiffCorpus(make_diffs(a=body, b=body), LoadOptions(max_chunk_lines=5))
        if cached:
            c.persist()
        for df in (c.list_chunks(), c.stats, c.find_chunks("*.py"), c.status()):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            gathers = [x for x in plan.splitlines() if "collect_list" in x or "InMemoryRelation" in x or "Aggregate" in x]
            assert gathers and not any("text#" in x or "content#" in x for x in gathers), gathers
        c.unpersist()


def test_split_is_linear(spark):
    """One section of 100,000 lines in one row: pieces do not carry the section."""
    import time

    from pyspark.sql import functions as F

    from patchloom.operators import sections as S
    from patchloom.operators.split import split_oversized

    def seconds(n):
        line = F.when(F.col("i") % 50 == 0, F.lit("@@ -1,9 +1,9 @@")).when(F.col("i") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("+line "), F.col("i").cast("string")))
        rows = spark.range(n).withColumnRenamed("id", "i").select(F.sort_array(F.collect_list(F.struct("i", line.alias("x")))).alias("l")).agg(F.first("l").alias("l"))
        diff = rows.select(F.lit("d").alias("diff_id"), F.concat(F.lit("diff --git a/x b/x\n"), F.array_join("l.x", "\n")).alias("content")).checkpoint()
        t = time.perf_counter()
        got = split_oversized(S.sections(diff), 100).agg(F.count("*"), F.sum("lines"), F.sum(F.length("content"))).first()
        assert got[0] >= n // 100 and got[2] > n
        return time.perf_counter() - t

    seconds(2_000)
    small, large = seconds(25_000), seconds(100_000)
    assert large < 10 * small + 5
