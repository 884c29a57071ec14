"""Durable tables of a loaded corpus (A6) and pruned reads from them.

``save`` writes chunks, the file index and stats as Parquet partitioned by
``bucket = pmod(xxhash64(diff_id), n_buckets)``. A lookup for one diff (F3,
F5) filters on that bucket, so the scan reads one partition folder
(``PartitionFilters``) and pushes ``diff_id`` / ``chunk`` down to Parquet
(``PushedFilters``); metadata reads never touch ``content`` (column pruning).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.functions.globs import glob_match
from patchloom.operators.chunks import chunk_files

DEFAULT_BUCKETS = 64


def bucket_of(diff_id, n_buckets: int = DEFAULT_BUCKETS) -> Column:
    c = F.col(diff_id) if isinstance(diff_id, str) else diff_id
    return F.pmod(F.xxhash64(c), F.lit(n_buckets)).cast("int")


def save(corpus, root: str, n_buckets: int = DEFAULT_BUCKETS, mode: str = "overwrite") -> None:
    """Write ``chunks``, ``chunk_files`` and ``diff_stats`` under ``root``."""
    tables = {
        "chunks": corpus.chunks.select("diff_id", "chunk", "files", "lines", "parent_file", "sub_chunk_index",
                                       "content"),
        "chunk_files": chunk_files(corpus.chunk_meta),
        "diff_stats": corpus.stats,
    }
    for name, df in tables.items():
        (df.withColumn("bucket", bucket_of("diff_id", n_buckets))
         .write.mode(mode).partitionBy("bucket").parquet(os.path.join(root, name)))


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(root, name))


def read_chunk(spark: SparkSession, root: str, diff_id: str, chunk: int,
               n_buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """F3 on the stored tables: one bucket folder, diff_id and chunk pushed to Parquet."""
    b = spark.createDataFrame([(diff_id,)], "d string").select(bucket_of("d", n_buckets)).first()[0]
    t = _table(spark, root, "chunks")
    return t.where((F.col("bucket") == b) & (F.col("diff_id") == diff_id) & (F.col("chunk") == chunk)).drop("bucket")


def find_chunks(spark: SparkSession, root: str, diff_id: str, pattern: str,
                n_buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """F5 on the stored file index of one diff."""
    b = spark.createDataFrame([(diff_id,)], "d string").select(bucket_of("d", n_buckets)).first()[0]
    t = _table(spark, root, "chunk_files")
    hit = t.where((F.col("bucket") == b) & (F.col("diff_id") == diff_id) & glob_match("path", pattern))
    return hit.select("chunk").distinct().orderBy("chunk")


def list_chunks(spark: SparkSession, root: str) -> DataFrame:
    """F1 on the stored tables (content is pruned from the scan)."""
    return _table(spark, root, "chunks").select("diff_id", "chunk", "files", "lines", "parent_file",
                                                "sub_chunk_index")
