"""Giant diffs read section by section: one diff over many tasks, no line table (A2, B1).

Spark's text reader takes any record separator. With the beginning of a section
header as separator, byte ranges of a file come out as whole sections, whatever
the borders of the ranges; the reader itself finds a record that goes over a border,
and a border in a line end or a character does no harm. A record holds one section; a
normal diff's rules then apply to it in its own row (line ends, facts, cuts),
and only slim facts are sorted and numbered: a running count inside each byte
range, carried over the ranges of a diff by partial aggregates.

The separator is only the beginning of a header. A record whose first line is
not one after all continues the section before it; those few sections are put
together from their records. A section is one row here, so one far longer than a task's
memory still needs ``line_table``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchloom.functions import text as T
from patchloom.operators import chunks as C
from patchloom.operators import filters as FL
from patchloom.operators import sections as S
from patchloom.operators.split import piece_texts
from patchloom.options import LoadOptions
from patchloom.plans.corpus_plan import DiffCorpus
from patchloom.sources.files import file_id

_MARK = "diff --git a/"
#: Rows (one per diff) that may be broadcast.
MAX_BROADCAST_DIFFS = 1_000_000
_PLACE = ["diff_id", "blk", "rid", "p"]


def read_records(spark: SparkSession, path: str | list[str], glob: str | None = "*.diff", recursive: bool = False) -> DataFrame:
    """``(diff_id, blk, rid, value)``: the texts between separators; ``(blk, rid)`` orders those of a file."""
    r = spark.read.option("lineSep", "\n" + _MARK).option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.text(path).select(
        file_id("_metadata.file_path").alias("diff_id"), F.col("_metadata.file_block_start").alias("blk"),
        F.monotonically_increasing_id().alias("rid"), F.make_valid_utf8("value").alias("value"))


def record_ends(records: DataFrame) -> DataFrame:
    """``(diff_id, first, last)``: the first and last record of each diff."""
    at = F.struct("blk", "rid")
    return records.groupBy("diff_id").agg(F.min(at).alias("first"), F.max(at).alias("last"))


def record_parts(records: DataFrame, ends: DataFrame) -> DataFrame:
    """``(diff_id, blk, rid, p, text)``: sections (``p`` > 0), and what precedes a record's first header (``p`` = 0)."""
    at = F.struct("blk", "rid")
    x = records.join(ends, "diff_id")
    # the separator took a line end from the record before it and the mark from the one behind
    text = F.concat(F.when(at == F.col("first"), "").otherwise(_MARK), F.col("value"), F.when(at == F.col("last"), "").otherwise("\n"))
    parts = T.split_sections(T.normalized_text(text))
    x = x.select("diff_id", "blk", "rid", F.posexplode(parts).alias("p", "text")).where("p > 0 or text <> ''")
    return x.withColumn("text", F.when(F.col("p") == 0, F.expr("substring(text, 2)")).otherwise(F.col("text")))


class SectionDiffCorpus(DiffCorpus):
    """``DiffCorpus`` over section records."""

    def __init__(self, records: DataFrame, options: LoadOptions | None = None, **kw):
        ends = record_ends(records)
        super().__init__(ends.select("diff_id"), options, **kw)
        self.records = records
        self._ends = F.broadcast(ends) if ends.count() <= MAX_BROADCAST_DIFFS else ends

    @classmethod
    def from_text_files(cls, spark: SparkSession, path: str, options: LoadOptions | None = None, glob: str | None = "*.diff",
                        recursive: bool = False, **kw) -> "SectionDiffCorpus":
        return cls(read_records(spark, path, glob, recursive), options, **kw)

    @cached_property
    def parts(self) -> DataFrame:
        return record_parts(self.records, self._ends)

    def _keep(self, df: DataFrame) -> DataFrame:
        if self.cache_kept:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
            self._persisted.append(df)
        return df

    @cached_property
    def numbered(self) -> DataFrame:
        """Facts of every part, without text, with the section it begins or (``p`` = 0) continues."""
        f = C.with_pieces(S.section_columns(self.parts, _PLACE), self.options.max_chunk_lines).drop("text")
        f = self._keep(f)
        starts = (F.col("p") > 0).cast("int")
        blocks = f.groupBy("diff_id", "blk").agg(F.sum(starts).alias("__n"))
        before = Window.partitionBy("diff_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.select("diff_id", "blk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"))
        inside = Window.partitionBy("diff_id", "blk").orderBy("rid", "p").rowsBetween(Window.unboundedPreceding, 0)
        x = f.withColumn("__k", F.sum(starts).over(inside)).join(blocks, ["diff_id", "blk"])
        return x.withColumn("sec", (F.col("__n0") + F.col("__k")).cast("int")).drop("__k", "__n0")

    @cached_property
    def _split_sections(self) -> DataFrame | None:
        """``(diff_id, sec)`` of sections in several records, if there are any."""
        s = self._keep(self.numbered.where("p = 0 and sec > 0").select("diff_id", "sec").distinct())
        return s if s.limit(1).count() else None

    def _section_texts(self, wanted: DataFrame) -> DataFrame:
        """``(diff_id, sec, text)`` of the sections in ``wanted(diff_id, sec)``."""
        places = self.numbered.where("sec > 0").select(*_PLACE, "sec").join(wanted.select("diff_id", "sec"), ["diff_id", "sec"], "left_semi")
        rows = self.parts.join(places, _PLACE).select("diff_id", "sec", "blk", "rid", "p", "text")
        if self._split_sections is None:
            return rows.select("diff_id", "sec", "text")
        ordered = F.sort_array(F.collect_list(F.struct("blk", "rid", "p", "text")))
        return rows.groupBy("diff_id", "sec").agg(F.array_join(ordered.getField("text"), "\n").alias("text"))

    @cached_property
    def section_index(self) -> DataFrame:
        whole = self.numbered.where("p > 0").drop("blk", "rid", "p")
        split = self._split_sections
        if split is not None:
            again = C.with_pieces(S.section_columns(self._section_texts(split), ["diff_id", "sec"]), self.options.max_chunk_lines).drop("text")
            whole = whole.join(split, ["diff_id", "sec"], "left_anti").unionByName(again)
        return FL.with_filters(whole, self.options)

    @cached_property
    def sections(self) -> DataFrame:
        index = self.section_index.drop("drop_reason", "pieces")
        return index.join(self._section_texts(index), ["diff_id", "sec"])

    @cached_property
    def filtered(self) -> DataFrame:
        return FL.with_filters(self.sections, self.options)

    @cached_property
    def facts(self) -> DataFrame:
        return self._keep(self.section_index.where(F.col("drop_reason").isNull()).select(*C.FACT_COLUMNS))

    @cached_property
    def chunk_list(self) -> DataFrame:
        return self._keep(C.chunk_list(C.slots_of(self.facts, self.options.max_chunk_lines, self.max_fold_items), giant=True))

    @cached_property
    def chunks(self) -> DataFrame:
        return self._texts(self.chunk_list)

    def _texts(self, listed: DataFrame) -> DataFrame:
        """The texts of some chunks: the sections of each slot are gathered, which its size bounds."""
        slots = C.slots_with_chunks(listed)
        member = slots.select("diff_id", "slot", F.explode("secs").alias("sec"))
        texts = self._section_texts(member).join(member, ["diff_id", "sec"])
        ordered = F.sort_array(F.collect_list(F.struct("sec", "text")))
        whole = texts.groupBy("diff_id", "slot").agg(F.array_join(ordered.getField("text"), "\n\n").alias("text"))
        x = slots.join(whole, ["diff_id", "slot"])
        return C.cut_chunks(x.select("diff_id", "chunks", piece_texts(F.col("text"), F.col("header_len"), F.col("chunks")).alias("texts")))

    def _chunk(self, diff_id: str, chunk_number: int) -> DataFrame:
        return self._texts(self.chunk_list.where((F.col("diff_id") == diff_id) & (F.col("chunk") == chunk_number)))

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK, sections: bool = True) -> "SectionDiffCorpus":
        """Facts and the chunk list are kept as they are first used."""
        self.cache_kept = True
        return self
