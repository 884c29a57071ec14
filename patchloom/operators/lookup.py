"""Listing, lookup, rendering and search over chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions.globs import glob_match, glob_to_regex, literal_key
from patchloom.operators.chunks import chunk_files, summary_col


def list_chunks(chunks: DataFrame) -> DataFrame:
    """chunk metadata without content."""
    return chunks.select("diff_id", "chunk", "files", "lines", summary_col().alias("summary"),
                         "parent_file", "sub_chunk_index")


def get_chunks(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """F3 (bulk): ``requests(diff_id, chunk)`` joined to chunk contents."""
    return chunks.join(requests.select("diff_id", "chunk"), ["diff_id", "chunk"])


def missing_chunks(chunks: DataFrame, requests: DataFrame, stats: DataFrame) -> DataFrame:
    """F3 misses with the reference's error text."""
    miss = requests.select("diff_id", "chunk").join(chunks.select("diff_id", "chunk"), ["diff_id", "chunk"], "left_anti")
    miss = miss.join(stats.select("diff_id", "chunks_count"), "diff_id", "left")
    err = F.concat(F.lit("Chunk "), F.col("chunk").cast("string"), F.lit(" not found. Available chunks: 1-"),
                   F.coalesce(F.col("chunks_count"), F.lit(0)).cast("string"))
    return miss.select("diff_id", "chunk", err.alias("error"))


def render(chunks: DataFrame, stats: DataFrame, include_context: bool = True) -> DataFrame:
    """chunk text with the ``=== Chunk k of N ===`` context header."""
    if not include_context:
        return chunks.select("diff_id", "chunk", F.col("content").alias("text"))
    c = chunks.join(stats.select("diff_id", "chunks_count"), "diff_id")
    head = F.concat(
        F.lit("=== Chunk "), F.col("chunk").cast("string"), F.lit(" of "), F.col("chunks_count").cast("string"),
        F.lit(" ===\nFiles: "), F.array_join("files", ", "), F.lit("\nLines: "), F.col("lines").cast("string"),
        F.lit("\n"), F.repeat(F.lit("="), 50), F.lit("\n"))
    return c.select("diff_id", "chunk", F.concat(head, F.col("content")).alias("text"))


def find_chunks(chunks: DataFrame, pattern: str) -> DataFrame:
    """distinct ``(diff_id, chunk)`` holding a file that matches the glob."""
    return chunk_files(chunks).where(glob_match("path", pattern)).select("diff_id", "chunk").distinct()


def patterns_table(spark, patterns) -> DataFrame:
    """A request list of globs, translated once: ``(pattern, regex, kind, key)`` (see ``globs.literal_key``)."""
    import pyarrow as pa

    rows = [(p, glob_to_regex(p), *literal_key(p)) for p in dict.fromkeys(patterns)]
    columns = [pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 4
    return spark.createDataFrame(pa.table(columns, ["pattern", "regex", "kind", "key"]))


def match_globs(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(path, pattern)`` for each of ``patterns`` (a ``patterns_table``) that matches a path of ``paths(path)`` (distinct).

    A literal text that a pattern's matches must have is its key: each path is looked up by its own prefixes,
    suffixes and short inner texts of the lengths that occur, so patterns and paths meet in an equi-join, and the
    regular expression runs on those pairs alone. Patterns without any literal share one key.
    """
    by_regex = patterns.groupBy("regex").agg(F.first("kind").alias("kind"), F.first("key").alias("key"))
    lengths: dict[str, list[int]] = {}
    for r in patterns.select("kind", F.length("key").alias("n")).distinct().collect():  # a few dozen at most
        lengths.setdefault(r.kind, []).append(r.n)
    path, size = F.col("path"), F.length("path")

    def entry(kind, text):
        return F.struct(F.lit(kind).alias("kind"), text.alias("key"))

    keys = [F.when(size >= n, entry("p", F.substring(path, 1, n))) for n in lengths.get("p", [])]
    keys += [F.when(size >= n, entry("s", F.right(path, F.lit(n)))) for n in lengths.get("s", [])]
    keys += [entry("n", F.lit(""))] * ("n" in lengths)
    every = F.array_compact(F.array(*keys)) if keys else None
    def inner_texts(n):
        return F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: entry("g", F.substring(path, i, F.lit(n))))

    for n in lengths.get("g", []):
        inner = F.when(size >= n, inner_texts(n))
        inner = F.coalesce(F.array_distinct(inner), F.array().cast("array<struct<kind:string,key:string>>"))
        every = inner if every is None else F.concat(every, inner)
    if every is None:
        return paths.select("path", F.lit("").alias("pattern")).where("false")
    looked = paths.select("path", F.inline(every))
    hits = looked.join(by_regex, ["kind", "key"]).where("path rlike regex").select("path", "regex")
    return hits.join(patterns.select("pattern", "regex"), "regex").select("path", "pattern")


def find_chunks_multi(chunks: DataFrame, patterns: DataFrame) -> DataFrame:
    """the chunks that hold a file matching one of many globs, by pattern: ``(diff_id, pattern, chunk)``."""
    files = chunk_files(chunks)
    found = match_globs(files.select("path").distinct(), patterns)
    return files.join(found, "path").select("diff_id", "pattern", "chunk").distinct()


def overview(stats: DataFrame) -> DataFrame:
    """One row over all loaded diffs (``loaded`` is false when there are none)."""
    return stats.agg(
        (F.count("*") > 0).alias("loaded"),
        F.count("*").cast("bigint").alias("total_sessions"),
        F.coalesce(F.sum("chunks_count"), F.lit(0)).cast("bigint").alias("chunks"),
        F.coalesce(F.sum("total_files"), F.lit(0)).cast("bigint").alias("files"),
        F.coalesce(F.sum("total_lines"), F.lit(0)).cast("bigint").alias("total_lines"),
    )


def diff_status(diffs: DataFrame, secs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ok / no_diff_content (no section) / all_filtered (no chunk) per diff; a ``status`` that ``diffs`` brings goes first."""
    ns = secs.groupBy("diff_id").agg(F.count("*").alias("__s"))
    nc = chunks.groupBy("diff_id").agg(F.count("*").alias("__c"))
    given = F.col("status") if "status" in diffs.columns else F.lit(None).cast("string")
    d = diffs.select("diff_id", given.alias("__given")).join(ns, "diff_id", "left").join(nc, "diff_id", "left")
    st = (F.when(F.col("__s").isNull(), "no_diff_content").when(F.col("__c").isNull(), "all_filtered").otherwise("ok"))
    return d.select("diff_id", F.coalesce("__given", st).alias("status"))


def chunk_json(chunks: DataFrame) -> DataFrame:
    """The list entry of a chunk as JSON text (nulls kept, like the reference)."""
    st = F.struct(F.col("chunk"), F.col("files"), F.col("lines"), summary_col().alias("summary"),
                  F.col("parent_file"), F.col("sub_chunk_index"))
    return chunks.select("diff_id", "chunk", F.to_json(st, {"ignoreNullFields": "false"}).alias("json"))
