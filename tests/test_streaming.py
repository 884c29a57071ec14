"""H1: streaming ingest in two landings equals the batch result."""

import os

from pyspark.sql import functions as F

from patchloom.options import LoadOptions
from patchloom.plans.corpus_plan import DiffCorpus
from patchloom.sources.corpus import load_corpus
from patchloom.streaming.ingest import ingest_stream, read_output


def test_stream_equals_batch(spark, tmp_path):
    corpus = load_corpus(spark, "/root/testdata/sf0.001").collect()
    landing, out, ckpt = tmp_path / "landing", tmp_path / "out", tmp_path / "ckpt"
    landing.mkdir()
    opts = LoadOptions(max_chunk_lines=40)
    half = len(corpus) // 2
    for rows in (corpus[:half], corpus[half:]):
        for r in rows:
            (landing / f"{r.diff_id}.diff").write_text(r.content, encoding="utf-8")
        q = ingest_stream(spark, str(landing), str(out), str(ckpt), opts)
        q.awaitTermination()
    streamed = read_output(spark, str(out), "chunks").select(
        F.regexp_extract("diff_id", r"([^/]+)\.diff$", 1).alias("diff_id"), "chunk", "lines", F.md5("content").alias("m"))
    batch = DiffCorpus(load_corpus(spark, "/root/testdata/sf0.001"), opts).chunks.select(
        "diff_id", "chunk", "lines", F.md5("content").alias("m"))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    reg = read_output(spark, str(out), "registry")
    assert reg.count() == len(corpus)
    assert {r.status for r in reg.collect()} == {"ok"}
