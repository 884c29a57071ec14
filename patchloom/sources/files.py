"""Diff files as a table (A1, A3, A4, G2, G3): no file is lost.

``list_files`` is Spark's own (distributed) listing of a folder, zero-byte files
included; no file is opened for it. ``read_diff_files`` reads each file into one row,
decoded as UTF-8 with U+FFFD for bad bytes (never throws), and gives a row to every
file listed: one that is empty, too long for a row, or can't be read comes out with
a ``status`` and ``error`` instead of its content. A file is named by its decoded URI
(``file_id``) in every regime: batch, stream and line table. Corpora of many
files parallelise by file; long files go through the line table
(``line_table.LineDiffCorpus``, chosen by ``corpus_plan.load_path``).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.functions.text import decode_utf8

#: Files longer than this are not read into one row.
ROW_BYTES = 256 << 20
#: Files with a row of their own in a request for some files by name.
NAMED_FILES = 10_000

BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def content_key(path, content) -> Column:
    """A3: ``path#<first 16 hex of sha256(content bytes)>``."""
    p = F.col(path) if isinstance(path, str) else path
    c = F.col(content) if isinstance(content, str) else content
    return F.concat(p, F.lit("#"), F.substring(F.sha2(c, 256), 1, 16))


def file_id(uri) -> Column:
    """The diff_id of a file, from a URI as Spark gives it (``_metadata.file_path``, ``inputFiles``): decoded, no empty host."""
    u = F.col(uri) if isinstance(uri, str) else uri
    return F.regexp_replace(F.url_decode(F.replace(u, F.lit("+"), F.lit("%2B"))), r"^([A-Za-z][A-Za-z0-9+.-]*):///", "$1:/")


def decode_files(raw: DataFrame) -> DataFrame:
    """``binaryFile`` rows -> ``diffs(diff_id, content_key, content, modification_time, length)``."""
    return raw.select(
        F.col("path").alias("diff_id"),
        content_key("path", "content").alias("content_key"),
        decode_utf8("content").alias("content"),
        F.col("modificationTime").alias("modification_time"),
        F.col("length"),
    )


def check_path(spark: SparkSession, path: str) -> str:
    """G1/G2 on the driver: non-blank path that exists (a file or a folder of files)."""
    if not isinstance(path, str) or not path.strip():
        raise ValueError("absolute_file_path must be a non-empty string")
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        raise ValueError(f"Diff file not found: {path}")
    return path


def escaped(path: str) -> str:
    """A literal path for Spark's readers, which take globs."""
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hpath).isDirectory()


def _binary(spark: SparkSession, paths, glob: str | None, recursive: bool) -> DataFrame:
    r = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.option("recursiveFileLookup", str(recursive).lower()).load(paths)


def list_files(raw: DataFrame) -> DataFrame:
    """``(diff_id, length, modification_time)`` of all files of a ``binaryFile`` frame, zero-byte ones (which it has no rows for) included.

    A file that goes between listing and reading has no length.
    """
    import pyarrow as pa

    spark = raw.sparkSession
    # the names in Spark's file index, in one call; the index itself is held by the driver
    names = spark.sparkContext._jvm.org.apache.hadoop.util.StringUtils.join("\n", raw._jdf.inputFiles())
    every = spark.createDataFrame(pa.table({"uri": pa.array(names.split("\n") if names else [], pa.string())})).select(file_id("uri").alias("diff_id"))
    facts = raw.select(F.col("path").alias("diff_id"), "length", F.col("modificationTime").alias("modification_time"))
    # zero-byte files have no row there; neither has one that has gone meanwhile, so their few names are looked up
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    zero = []
    for r in every.join(facts, "diff_id", "left_anti").collect():
        name = path(r.diff_id)
        fs = name.getFileSystem(conf)
        if fs.exists(name) and (st := fs.getFileStatus(name)).getLen() == 0:
            zero.append((r.diff_id, 0, datetime.fromtimestamp(st.getModificationTime() / 1000)))
    if zero:
        facts = facts.unionAll(spark.createDataFrame(zero, facts.schema))
    return every.join(facts, "diff_id", "left").select("diff_id", "length", "modification_time")


def read_diff_files(spark: SparkSession, path: str | list[str], glob: str | None = "*.diff", recursive: bool = False,
                    partitions: int | None = None, row_bytes: int = ROW_BYTES) -> DataFrame:
    """A1: every file under ``path`` (a file, a folder, or a list of files):
    ``diffs(diff_id, content_key, content, modification_time, length, status, error)``.

    ``status`` is null for files with content, else 'empty' (zero bytes), 'long' (more than ``row_bytes``: not read
    here) or 'unreadable' (listed, but gone or failing when read). The result is hash-partitioned by ``diff_id``,
    so per-diff operators downstream reuse that exchange.
    """
    if isinstance(path, str):
        check_path(spark, path)
        if glob and not _is_folder(spark, path):
            glob = None  # a single named file is read whatever its extension
    raw = _binary(spark, path, glob, recursive)
    read = decode_files(raw.where(F.col("length") <= row_bytes)).drop("modification_time", "length")
    by = [partitions, "diff_id"] if partitions else ["diff_id"]
    d = list_files(raw).repartition(*by).join(read.repartition(*by).hint("merge"), "diff_id", "left")
    status = F.when(F.col("length") == 0, "empty").when(F.col("length") > row_bytes, "long").when(F.col("content_key").isNull(), "unreadable")
    text = F.when(F.col("status") == "empty", "").otherwise(F.col("content"))
    error = (F.when(F.col("status") == "empty", "File is empty").when(F.col("status") == "long", F.concat(F.lit("File longer than "), F.lit(str(row_bytes)), F.lit(" bytes")))
             .when(F.col("status") == "unreadable", F.concat(F.lit("Cannot read file: "), F.col("diff_id"))))
    return d.withColumn("status", status).select("diff_id", "content_key", text.alias("content"), "modification_time", "length", "status", error.alias("error"))


def changed(current: DataFrame, registry: DataFrame) -> DataFrame:
    """A4: rows of ``current(diff_id, key, ...)`` whose (diff_id, key) is not registered yet."""
    return current.join(registry.select("diff_id", "key"), ["diff_id", "key"], "left_anti")
