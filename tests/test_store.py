"""Stored tables, partition pruning and pushdown for point lookups."""

from pyspark.sql import functions as F

from patchloom.options import LoadOptions
from patchloom.plans.corpus_plan import DiffCorpus
from patchloom.sources import store
from patchloom.sources.corpus import load_corpus


def test_store_roundtrip_and_pruning(spark, tmp_path):
    c = DiffCorpus(load_corpus(spark, "/root/testdata/sf0.001"), LoadOptions(max_chunk_lines=40))
    root = str(tmp_path / "tables")
    store.save(c, root, n_buckets=8)
    want = {(r.diff_id, r.chunk): r.content for r in c.chunks.collect()}
    diff_id, chunk = sorted(want)[3]
    q = store.read_chunk(spark, root, diff_id, chunk, n_buckets=8)
    assert [r.content for r in q.collect()] == [want[(diff_id, chunk)]]
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters" in plan
    listing = store.list_chunks(spark, root)
    assert "content" not in listing._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert listing.count() == len(want)
    found = [r.chunk for r in store.find_chunks(spark, root, diff_id, "src/*", n_buckets=8).collect()]
    expect = sorted({r.chunk for r in c.find_chunks("src/*").where(F.col("diff_id") == diff_id).collect()})
    assert found == expect
