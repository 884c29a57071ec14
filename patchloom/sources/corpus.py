"""A deterministic corpus of unified diffs derived from the ``documents`` table.

One diff per ``(source, doc_id div 1000)``, named ``<source>-<bucket>``, so a diff
holds ~50 documents whatever the scale factor and the number of diffs grows
with the data (below 1,000 documents this is one diff per source, as in
FIXTURES.md section 3). All English documents of a diff form one large
section (``src/big/<source>.c``); every other document is one section whose
path kind is ``doc_id % 12`` (renames, generated files, binaries, trivial
whitespace edits, quoted headers, paths containing " b/", short headers...).
Body line ``i`` of a section is the i-th text line of its documents, prefixed
'+', '-' or ' ' by ``i % 3``; a hunk header precedes every ``hl``-th line.

The result is hash-partitioned by ``diff_id`` (it comes out of a group-by on
``source``); every per-diff operator downstream reuses that partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Order key of the fixed lines inside a section: header, index, ---, +++, binary;
# body lines use 10 + 2*i (hunk header) and 11 + 2*i (the line); the optional
# trailing empty line comes last.
_TRAILER_SEQ = 10**12
DOCS_PER_DIFF = 1000


def _path_a(k, d, source):
    s = d.cast("string")
    return (
        F.when(k == 0, F.concat(F.lit("src/old/f"), s, F.lit(".py")))
        .when(k == 1, F.concat(F.lit("dist/b"), s, F.lit(".js")))
        .when(k == 2, F.concat(F.lit("pkg/p"), s, F.lit(".lock")))
        .when(k == 3, F.concat(F.lit("Assets/X"), s, F.lit(".MIN.CSS")))
        .when(k == 4, F.concat(F.lit("docs/d"), s, F.lit(".md")))
        .when(k == 5, F.concat(F.lit("img/i"), s, F.lit(".png")))
        .when(k == 6, F.lit("src/.DS_Store"))
        .when(k == 7, F.concat(F.lit("tests/t"), s, F.lit("_test.go")))
        .when(k == 8, F.lit("src/common/shared.js"))
        .when(k == 9, F.concat(F.lit("sp ace"), s, F.lit(".txt")))
        .when(k == 10, F.concat(F.lit("lib/a b/"), s, F.lit(".txt")))
        .when(k == 11, F.concat(F.lit("src/k"), s, F.lit(".ts")))
        .otherwise(F.concat(F.lit("src/big/"), source, F.lit(".c")))
    )


def corpus_from_documents(documents: DataFrame) -> DataFrame:
    """``documents(doc_id, text, lang, source)`` -> ``diffs(diff_id, content)``.

    One scan of ``documents``, one window (section id and line number inside
    the section) and one group-by per diff: every body row emits its own diff
    lines, and a section's first row also emits the section's header lines.
    """
    skey = F.when(F.col("lang") == "en", F.lit("en")).otherwise(F.col("doc_id").cast("string"))
    diff_id = F.concat(F.col("source"), F.lit("-"), F.floor(F.col("doc_id") / DOCS_PER_DIFF).cast("string"))
    body = documents.select("source", diff_id.alias("diff_id"), "doc_id", skey.alias("skey"),
                            F.posexplode(F.split("text", "\n", -1)).alias("pos", "txt"))
    by_sec = Window.partitionBy("diff_id", "skey")
    body = body.select(
        "source", "diff_id", "skey", "txt",
        F.min("doc_id").over(by_sec).alias("d"),
        (F.row_number().over(by_sec.orderBy("doc_id", "pos")) - 1).alias("i"),
    )
    d, i = F.col("d"), F.col("i")
    k = F.when(F.col("skey") == "en", F.lit(99)).otherwise(d % 12)
    sn = F.substring("source", 4, 1 << 20).cast("int")
    body = body.select("*", k.alias("k"), sn.alias("sn"))
    k = F.col("k")
    hl = F.when(k != 99, 8).when(F.col("sn") % 3 == 0, 24).when(F.col("sn") % 3 == 1, 100000).otherwise(8)
    pa = _path_a(k, d, F.col("source"))
    body = body.select("*", hl.alias("hl"), pa.alias("pa"))
    body = body.withColumn("pb", F.when(k == 0, F.regexp_replace("pa", "^src/old/", "src/new/")).otherwise(F.col("pa")))

    def line(seq, text, cond=None):
        item = F.struct(d.cast("bigint").alias("d"), F.lit(seq).cast("bigint").alias("seq") if isinstance(seq, int)
                        else seq.cast("bigint").alias("seq"), text.alias("line"))
        return item if cond is None else F.when(cond, item)

    first = i == 0
    header = F.when(k == 9, F.concat(F.lit('diff --git "a/'), F.col("pa"), F.lit('" "b/'), F.col("pb"), F.lit('"'))
                    ).otherwise(F.concat(F.lit("diff --git a/"), F.col("pa"), F.lit(" b/"), F.col("pb")))
    index = F.concat(F.lit("index "), F.lpad(d.cast("string"), 7, "0"), F.lit(".."),
                     F.lpad((d + 1).cast("string"), 7, "0"), F.lit(" 100644"))
    has_pm = ~k.isin(5, 11)
    binary = F.concat(F.lit("Binary files a/"), F.col("pa"), F.lit(" and b/"), F.col("pb"), F.lit(" differ"))
    n = (i + 1).cast("string")
    hunk = F.concat(F.lit("@@ -"), n, F.lit(","), F.col("hl").cast("string"), F.lit(" +"), n, F.lit(","),
                    F.col("hl").cast("string"), F.lit(" @@"))
    sign = F.when(i % 3 == 0, "+").when(i % 3 == 1, "-").otherwise(" ")
    text_line = (
        F.when(k == 4, F.when(i % 3 == 0, F.lit("+  ")).otherwise(F.concat(F.lit(" "), F.col("txt"))))
        .when(i % 17 == 16, F.concat(F.lit("--- "), F.col("txt")))
        .otherwise(F.concat(sign, F.when(i % 11 == 5, F.lit("")).otherwise(F.col("txt"))))
    )
    emitted = F.array_compact(F.array(
        line(0, header, first),
        line(1, index, first),
        line(2, F.concat(F.lit("--- a/"), F.col("pa")), first & has_pm),
        line(3, F.concat(F.lit("+++ b/"), F.col("pb")), first & has_pm),
        line(4, binary, first & (k == 5)),
        line(_TRAILER_SEQ, F.lit(""), first & (d % 2 == 0)),
        line(10 + 2 * i, hunk, (k != 5) & (i % F.col("hl") == 0)),
        line(11 + 2 * i, text_line, k != 5),
    ))
    lines = body.select("diff_id", F.explode(emitted).alias("l"))
    ordered = F.sort_array(F.collect_list("l"))
    # each diff opens with a two-line preamble: "commit <diff_id>" and an empty line
    return lines.groupBy("diff_id").agg(
        F.concat(F.lit("commit "), F.col("diff_id"), F.lit("\n\n"),
                 F.concat_ws("\n", ordered.getField("line"))).alias("content"))


def load_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
