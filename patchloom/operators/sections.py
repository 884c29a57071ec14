"""Diff text -> lines and file sections.

A diff is one row; its sections come from a single regex split of the row's
text, so building sections needs neither a shuffle nor a window. Every
per-section fact (paths, nonblank count, trivial flag, header length) is a
regex over the section text, evaluated JVM-side. Inputs stay partitioned by
``diff_id``, so later group-bys / windows keyed by ``diff_id`` add no exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions import text as T


def normalize(diffs: DataFrame) -> DataFrame:
    """``diffs(diff_id, content, ...)`` -> adds ``text`` (universal newlines) and ``has_lines``."""
    return diffs.withColumn("text", T.normalized_text("content")).withColumn(
        "has_lines", F.col("content") != F.lit(""))


def diff_lines(diffs: DataFrame) -> DataFrame:
    """A2: ``(diff_id, ln, line)`` with 0-based ``ln``; an empty file has no lines."""
    d = normalize(diffs).where("has_lines")
    return d.select("diff_id", F.posexplode(T.split_lines("text")).alias("ln", "line")).select(
        "diff_id", F.col("ln").cast("bigint").alias("ln"), "line")


def split_diffs(diffs: DataFrame) -> DataFrame:
    """B1: ``(diff_id, sec, text)``; ``sec`` 0 is the preamble (its text without the leading newline)."""
    d = normalize(diffs)
    parts = d.select("diff_id", "has_lines", F.posexplode(T.split_sections("text")).alias("sec", "text"))
    return parts.select(
        "diff_id",
        F.col("sec").cast("int").alias("sec"),
        F.when(F.col("sec") == 0, F.expr("substring(text, 2)")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("sec") == 0, F.col("has_lines") & (F.col("text") != "")).otherwise(F.lit(True)).alias("has_lines"),
    )


def preamble_lines(diffs: DataFrame) -> DataFrame:
    """B2: lines before the first section header, per diff (they are dropped)."""
    p = split_diffs(diffs).where("sec = 0")
    return p.select("diff_id", F.when(F.col("has_lines"), T.count_lines("text")).otherwise(F.lit(0)).cast("bigint").alias("n"))


def sections(diffs: DataFrame) -> DataFrame:
    """One row per file section with its facts and text.

    Columns: diff_id, sec, path_a, path_b, files, n_lines (nonblank lines),
    n_raw (all lines), header_len (lines before the first hunk; NULL = no hunk),
    is_trivial, is_generated, text.
    """
    return section_columns(split_diffs(diffs).where("sec > 0"), ["diff_id", "sec"])


def section_columns(texts: DataFrame, keys: list[str]) -> DataFrame:
    """The facts of sections given by their ``text``, behind their key columns."""
    first = F.substring_index("text", "\n", 1)
    pa, pb = T.header_paths(first)
    s = texts.select(*keys, pa.alias("path_a"), pb.alias("path_b"), "text")
    return s.select(
        *keys, "path_a", "path_b",
        T.files_of("path_a", "path_b").alias("files"),
        T.count_nonblank_lines("text").alias("n_lines"),
        T.count_lines("text").alias("n_raw"),
        T.header_block_len("text").alias("header_len"),
        (~T.has_meaningful_edit("text")).alias("is_trivial"),
        T.is_generated("path_a", "path_b").alias("is_generated"),
        "text",
    )


def section_lines(secs: DataFrame, carry=()) -> DataFrame:
    """``(diff_id, sec, *carry, i, line)``: the lines of each section, ``i`` 0-based inside it."""
    carry = list(carry)
    return secs.select("diff_id", "sec", *carry, F.posexplode(T.split_lines("text")).alias("i", "line")).select(
        "diff_id", "sec", *carry, F.col("i").cast("bigint").alias("i"), "line")


def hunks(secs: DataFrame) -> DataFrame:
    """Hunk headers with their fields; a missing length means 1, a number beyond 64 bits is null."""
    ln = section_lines(secs).where(T.is_hunk("line"))
    nth = F.row_number().over(Window.partitionBy("diff_id", "sec").orderBy("i"))

    def start(k):
        return F.regexp_extract("line", T.HUNK_RE, k).try_cast("bigint")

    def length(k):
        digits = F.regexp_extract("line", T.HUNK_RE, k)
        return F.when(digits == "", F.lit(1).cast("bigint")).otherwise(digits.try_cast("bigint"))

    return ln.select(
        "diff_id", "sec", nth.cast("int").alias("hunk"),
        start(1).alias("old_start"), length(2).alias("old_len"),
        start(3).alias("new_start"), length(4).alias("new_len"),
    )


def line_kind_counts(diffs: DataFrame) -> DataFrame:
    """Number of lines of each kind per diff."""
    return diff_lines(diffs).groupBy("diff_id", T.line_kind("line").alias("line_kind")).agg(
        F.count("*").alias("n"))


def diffstat(secs: DataFrame) -> DataFrame:
    """H2: added / removed lines per (diff, path) (metadata '+++'/'---' lines excluded)."""
    lk = section_lines(secs, carry=["path_b"])
    kind = T.line_kind("line")
    return lk.groupBy("diff_id", F.col("path_b").alias("path")).agg(
        F.count_if(kind == "add").cast("bigint").alias("added"),
        F.count_if(kind == "del").cast("bigint").alias("removed"),
    )
