"""Giant diffs as a line table: one diff spread over many tasks.

A diff read as one ``binaryFile`` row is processed by one task. For a diff
larger than that, ``read_diff_lines`` reads it with ``spark.read.text``
(split into file blocks, any line terminator) and every later step works on
rows of lines:

1. ``number_lines``: line number ``ln``, section id ``sec`` (running count of
   header lines) and index inside the section ``i`` by two-level running
   counts - a window inside each file block, plus carries from a small
   per-block table (one row per block) - so no window spans a whole diff;
2. ``section_facts``: per-section facts as partial aggregates (a hot section
   is pre-aggregated in every task before the shuffle);
3. ``section_texts``: the text of each *kept* section, gathered per section.
   A kept section is bounded: at most ``max`` nonblank lines, or, if
   oversized, at most ``max_section_lines`` lines (checked). Longer oversized
   sections are split in parallel (``split_parallel``) and their pieces are
   assembled per piece, so they are never gathered whole.

The resulting kept-section rows have the same columns as the row path, so
packing, splitting and chunk assembly are shared (``LineDiffCorpus``).
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchloom.functions import text as T
from patchloom.operators import filters as FL
from patchloom.options import LoadOptions
from patchloom.plans.corpus_plan import DiffCorpus
from patchloom.sources.files import file_id

MAX_SECTION_LINES = 500_000

_MEANINGFUL_LINE = r"(?sU)^(?:\+(?!\+\+)|-(?!--)).*?" + T.NONBLANK_CHAR


def read_diff_lines(spark: SparkSession, path: str | list[str], glob: str | None = "*.diff") -> DataFrame:
    """``(diff_id, blk, rid, line)``: ``(blk, rid)`` orders the lines of a file."""
    r = spark.read
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.text(path)
    return df.select(
        file_id("_metadata.file_path").alias("diff_id"),
        F.col("_metadata.file_block_start").alias("blk"),
        F.monotonically_increasing_id().alias("rid"),
        F.make_valid_utf8("value").alias("line"),
    )


def lines_from_diffs(diffs: DataFrame) -> DataFrame:
    """The same line table from ``diffs(diff_id, content)`` rows (one block per diff)."""
    from patchloom.operators.sections import diff_lines
    return diff_lines(diffs).select("diff_id", F.lit(0).cast("bigint").alias("blk"),
                                    F.col("ln").alias("rid"), "line")


def number_lines(lines: DataFrame) -> DataFrame:
    """Adds ``ln`` (0-based per diff), ``sec`` (0 = preamble) and ``i`` (index in the section)."""
    upto = Window.partitionBy("diff_id", "blk").orderBy("rid").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumn("is_header", T.is_header("line"))
    x = x.select(
        "*",
        (F.row_number().over(Window.partitionBy("diff_id", "blk").orderBy("rid")) - 1).alias("__k"),
        F.sum(F.col("is_header").cast("int")).over(upto).alias("__h"),
    )
    x = x.withColumn("__lk", F.max(F.when(F.col("is_header"), F.col("__k"))).over(upto))
    blocks = x.groupBy("diff_id", "blk").agg(
        F.count("*").alias("__n"), F.sum(F.col("is_header").cast("int")).alias("__hn"),
        F.max(F.when(F.col("is_header"), F.col("__k"))).alias("__last"))
    before = Window.partitionBy("diff_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("diff_id", "blk", "__last",
                           F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"),
                           F.coalesce(F.sum("__hn").over(before), F.lit(0)).alias("__h0"))
    blocks = blocks.select("diff_id", "blk", "__n0", "__h0",
                           F.max(F.col("__n0") + F.col("__last")).over(before).alias("__lh0"))
    y = x.join(blocks, ["diff_id", "blk"])
    ln = F.col("__n0") + F.col("__k")
    hln = F.coalesce(F.col("__n0") + F.col("__lk"), F.col("__lh0"))
    sec = (F.col("__h0") + F.col("__h")).cast("int")
    return y.select("diff_id", "blk", "rid", ln.cast("bigint").alias("ln"), sec.alias("sec"),
                    F.when(sec > 0, ln - hln).cast("bigint").alias("i"), "line")


def section_facts(nl: DataFrame) -> DataFrame:
    """Section facts (no text) by partial aggregation over the numbered lines."""
    b = nl.where("sec > 0")
    first = F.col("i") == 0
    hunk_i = F.when(T.is_hunk("line"), F.col("i"))
    s = b.groupBy("diff_id", "sec").agg(
        F.max(F.when(first, F.regexp_extract("line", T.HEADER_RE, 1))).alias("path_a"),
        F.max(F.when(first, F.regexp_extract("line", T.HEADER_RE, 2))).alias("path_b"),
        F.count_if(T.is_nonblank("line")).cast("bigint").alias("n_lines"),
        F.count("*").cast("bigint").alias("n_raw"),
        F.min(hunk_i).cast("int").alias("header_len"),
        (~F.bool_or(F.col("line").rlike(_MEANINGFUL_LINE))).alias("is_trivial"),
    )
    return s.select("diff_id", "sec", "path_a", "path_b", T.files_of("path_a", "path_b").alias("files"),
                    "n_lines", "n_raw", "header_len", "is_trivial",
                    T.is_generated("path_a", "path_b").alias("is_generated"))


LARGE_SECTION = 100_000
MAX_BROADCAST_KEYS = 1_000_000


def _small_keys(df: DataFrame) -> DataFrame:
    """Broadcast a key set whose size was checked; otherwise leave it to the planner."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_KEYS else df


def section_texts(nl: DataFrame, facts: DataFrame, keys: DataFrame) -> DataFrame:
    """``(diff_id, sec, text)`` for the sections in ``keys(diff_id, sec)`` (a subset of ``facts``).

    Lines of sections longer than ``LARGE_SECTION`` (few: at most lines /
    LARGE_SECTION of them) are first removed with a broadcast anti-join, so the
    shuffle by section never receives a giant or dropped huge section; the
    large sections that are wanted are gathered through a broadcast semi-join.
    """
    g = ["diff_id", "sec"]
    large = _small_keys(facts.where(F.col("n_raw") > LARGE_SECTION).select(*g))
    small_lines = nl.join(large, g, "left_anti").join(keys.select(*g), g, "left_semi")
    wanted_large = keys.select(*g).join(large, g, "left_semi")
    large_lines = nl.join(_small_keys(wanted_large), g, "left_semi")
    lines = small_lines.unionByName(large_lines)
    ordered = F.sort_array(F.collect_list(F.struct("i", "line")))
    return lines.groupBy(*g).agg(F.concat_ws("\n", ordered.getField("line")).alias("text"))


class LineDiffCorpus(DiffCorpus):
    """``DiffCorpus`` over a line table; the chunk plan downstream of ``kept`` is shared."""

    def __init__(self, lines: DataFrame, options: LoadOptions | None = None,
                 max_section_lines: int = MAX_SECTION_LINES, **kw):
        super().__init__(lines.select("diff_id").distinct(), options, **kw)
        self.lines = lines
        self.max_section_lines = max_section_lines

    @classmethod
    def from_text_files(cls, spark: SparkSession, path: str, options: LoadOptions | None = None,
                        glob: str | None = "*.diff", **kw) -> "LineDiffCorpus":
        return cls(read_diff_lines(spark, path, glob), options, **kw)

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> "LineDiffCorpus":
        """Keep the section facts and the chunks (never the texts of all sections)."""
        for name in ("facts", "chunks"):
            df = getattr(self, name).persist(level)
            self.__dict__[name] = df
            self._persisted.append(df)
        self.__dict__["chunk_meta"] = self.chunks.drop("content")
        self.__dict__.pop("stats", None)
        return self

    @cached_property
    def numbered(self) -> DataFrame:
        """Read by the section facts, the text gathering and the giant split: persisted
        once (memory, spilling to disk) instead of re-reading and re-numbering the input."""
        n = number_lines(self.lines)
        if self.cache_kept:
            n = n.persist(StorageLevel.MEMORY_AND_DISK)
            self._persisted.append(n)
        return n

    @cached_property
    def facts(self) -> DataFrame:
        f = section_facts(self.numbered)
        if self.cache_kept:
            f = f.persist(StorageLevel.MEMORY_AND_DISK)
            self._persisted.append(f)
        return f

    @cached_property
    def sections(self) -> DataFrame:
        """All sections with their text (use ``facts`` when the text is not needed)."""
        return self.facts.join(section_texts(self.numbered, self.facts, self.facts), ["diff_id", "sec"])

    @cached_property
    def filtered(self) -> DataFrame:
        return FL.with_filters(self.facts, self.options)

    @cached_property
    def kept_facts(self) -> DataFrame:
        k = self.filtered.where(F.col("drop_reason").isNull()).drop("drop_reason")
        if self.cache_kept:
            k = k.persist(StorageLevel.MEMORY_AND_DISK)
            self._persisted.append(k)
        return k

    def _is_giant(self) -> F.Column:
        return ((F.col("n_lines") > self.options.max_chunk_lines) & (F.col("n_raw") > self.max_section_lines)
                & F.col("header_len").isNotNull())

    @cached_property
    def slots(self) -> DataFrame:
        from patchloom.operators import chunks as C
        s = C.section_slots(self.kept_facts, self.options.max_chunk_lines, max_fold_items=self.max_fold_items)
        if self.cache_kept:
            s = s.persist(StorageLevel.MEMORY_AND_DISK)
            self._persisted.append(s)
        return s

    @cached_property
    def kept(self) -> DataFrame:
        """Kept sections with text, except the giant oversized ones (split in parallel)."""
        facts = self.kept_facts.where(~self._is_giant())
        k = facts.join(section_texts(self.numbered, self.facts, facts), ["diff_id", "sec"])
        if self.cache_kept:
            k = k.persist(StorageLevel.MEMORY_AND_DISK)
            self._persisted.append(k)
        return k

    @cached_property
    def giant_pieces(self) -> DataFrame | None:
        giant = self.kept_facts.where(self._is_giant())
        if not giant.limit(1).collect():
            return None
        p = split_giant(self.numbered, giant, self.options.max_chunk_lines)
        if self.cache_kept:
            p = p.persist(StorageLevel.MEMORY_AND_DISK)
            self._persisted.append(p)
        return p

    @cached_property
    def chunks(self) -> DataFrame:
        from patchloom.operators import chunks as C
        return C.build_chunks(self.kept, self.options.max_chunk_lines, self.slots, extra_pieces=self.giant_pieces)

    @cached_property
    def chunk_meta(self) -> DataFrame:
        """The same plan with ``content`` pruned by Catalyst."""
        return self.chunks.drop("content")

    @cached_property
    def section_index(self) -> DataFrame:
        return self.filtered

    def _chunk(self, diff_id: str, chunk_number: int) -> DataFrame:
        return self.chunks.where((F.col("diff_id") == diff_id) & (F.col("chunk") == chunk_number))


def split_giant(nl: DataFrame, giant: DataFrame, max_lines: int) -> DataFrame:
    """Pieces (``split_oversized`` columns) of oversized sections too long to gather."""
    from patchloom.operators.split import parent_file
    from patchloom.operators.split_parallel import cut_starts, pieces_of
    g = ["diff_id", "sec"]
    # giant sections are few (each has > max_section_lines lines): broadcast their
    # metadata, so no step keys a giant section's lines by the section alone
    meta = _small_keys(giant.select(*g, "files", "header_len", "n_raw"))
    lines = nl.join(meta, g)
    body = lines.where(F.col("i") >= F.col("header_len")).select(
        *g, (F.col("i") - F.col("header_len")).alias("bi"), F.col("header_len").alias("h"),
        (F.col("n_raw") - F.col("header_len")).alias("n"), T.is_hunk("line").alias("hk"),
        T.is_nonblank("line").alias("nb"), "i", "line")
    starts = cut_starts(body.select(*g, "bi", "h", "n", "hk", "nb"), max_lines)
    bp = pieces_of(body, starts).select(*g, "piece", "i", "line")
    pieces = bp.select(*g, "piece").distinct()
    head = lines.where(F.col("i") < F.col("header_len")).select(*g, "i", "line").join(pieces, g)
    allp = bp.unionByName(head.select(*g, "piece", "i", "line"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "line")))
    agg = allp.groupBy(*g, "piece").agg(F.concat_ws("\n", ordered.getField("line")).alias("content"),
                                        F.count_if(T.is_nonblank("line")).cast("bigint").alias("lines"))
    npieces = _small_keys(pieces.groupBy(*g).agg(F.max("piece").alias("pieces")).checkpoint())
    out = agg.join(npieces, g).join(meta, g)
    return out.select(*g, F.col("piece").cast("int").alias("sub"), F.col("pieces").cast("int").alias("pieces"),
                      "files", "lines", parent_file().alias("parent_file"),
                      F.when(F.col("pieces") > 1, F.col("piece")).cast("int").alias("sub_chunk_index"), "content")
