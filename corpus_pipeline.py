"""A training-data pipeline over ``documents``: quality rules, near duplicates, repeated strings, benchmark leaks, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame; ``run`` writes each result to
the shared folder as Parquet and reads it back as the next stage's docs. All
but the last return the columns of ``documents``. Rows without a doc_id are
left out by the second stage on.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm.common import staged, table
from patchloom.llm.decontaminate import find_leaks
from patchloom.llm.fingerprints import BROADCAST_IDS, row_keys
from patchloom.llm.line_quality import clean_lines
from patchloom.llm.ngram_join import near_duplicates
from patchloom.llm.packing import pack_documents
from patchloom.llm.queries import tokenizer_path
from patchloom.llm.suffix_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents with ``text`` in place of the old text."""
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: rejected documents go, failing lines of the others too."""
    return _with_text(clean_lines(docs.select(*COLUMNS)).filter("kept"), "clean_text")


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each class of near duplicates exactly one row stays, that with the smallest id.

    Texts that share a doc_id are documents of their own, with a hash for an id (``row_keys``). Of a row that is
    repeated with other values of lang, source or n_chars the smallest stays.
    """
    rows = row_keys(docs, "text", "doc_id", COLUMNS[2:])
    seen = staged(near_duplicates(rows, doc_id="row", unique_ids=True).filter("doc_id = component_id").groupBy(F.col("doc_id").alias("row")).agg(F.count(F.lit(1)).alias("n")), "kept_rows")
    once = rows.join(seen.filter("n = 1"), "row", "left_semi").select(*COLUMNS)
    again = seen.filter("n > 1")
    n = again.count()
    if not n:
        return once
    # partial aggregates choose the row before the exchange
    chosen = rows.join(F.broadcast(again) if n <= BROADCAST_IDS else again, "row", "left_semi").groupBy("row").agg(F.min(F.struct(*COLUMNS)).alias("m"))
    return once.unionByName(chosen.select("m.*"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: repeated strings go; documents with nothing left go too. A character cut at an edge goes whole."""

    def decode(batches):
        for b in batches:
            left = pa.array([x.decode(errors="ignore") for x in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), left, *b.columns[2:]], ["doc_id", "left", "lang", "source"])

    cut = remove_repeats(docs, carry=("lang", "source")).select("doc_id", "kept", "lang", "source")
    whole = cut.mapInArrow(decode, "doc_id long, left string, lang string, source string")
    return _with_text(whole.filter(F.btrim("left", F.lit(" \t\n\x0b\x0c\r")) != ""), "left")


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that hold a benchmark item go; of texts that share a doc_id only those that do."""
    rows = row_keys(docs, "text", "doc_id", COLUMNS[2:])
    leaks = find_leaks(rows, table(spark, sf_dir, "benchmark"), doc_id="row").select(F.col("doc_id").alias("row")).distinct()
    return rows.join(leaks, "row", "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: sequences of at most 2048 tokens."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", one_of_each_class),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_leaks),
    ("packing", packed),
]

#: Fuzzy retrieval and tokens can't be said in SQL; tests/llm compares every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
