"""Chunk assembly (E1/E2 on sections, E6, D2-D5, D7).

Facts and text are kept apart. Packing, numbering and all metadata work on slim
facts, one row per kept section without its text (``section_facts``); an
oversized section brings the bounds of its pieces with it. Chunk texts are made
only when they are asked for (``chunk_texts``): the chunk list of a diff is one
small row, joined to the diff by ``diff_id``, and the texts are cut out of the
diff in its own row, so section texts are never shuffled, folded or cached.

Giant diffs, whose sections come from a line table, are assembled by
``build_chunks`` from gathered sections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions import text as T
from patchloom.operators.pack import pack
from patchloom.operators.split import PIECES, let, parent_file, piece_bounds, piece_texts, split_oversized

CHUNK_COLUMNS = ["diff_id", "chunk", "files", "lines", "parent_file", "sub_chunk_index", "content"]
FACT_COLUMNS = ["diff_id", "sec", "files", "n_lines", "header_len", "pieces"]

SLOTS_PER_BLOCK = 100_000


def section_slots(kept: DataFrame, max_lines: int, **kw) -> DataFrame:
    """E1+E2: ``(diff_id, sec, slot)`` for kept sections; big sections sit alone."""
    return pack(kept.select("diff_id", "sec", "n_lines"), ["diff_id"], ["sec"], "n_lines", max_lines,
                unique_order=True, **kw).select(
        "diff_id", "sec", "slot")


def with_pieces(sections: DataFrame, max_lines: int) -> DataFrame:
    """Sections (with text) and the bounds of the pieces of oversized ones: ``pieces``."""
    pieces = piece_bounds(T.split_lines("text"), F.col("header_len"), F.col("n_lines"), max_lines)
    return sections.withColumn("pieces", F.when(F.col("n_lines") > max_lines, pieces))


def section_facts(kept: DataFrame, max_lines: int) -> DataFrame:
    """The kept sections (with text) as slim facts: ``FACT_COLUMNS``."""
    return with_pieces(kept, max_lines).select(*FACT_COLUMNS)


def slots_of(facts: DataFrame, max_lines: int, max_fold_items: int | None = None) -> DataFrame:
    """A row per slot: ``(diff_id, slot, secs, files, lines, header_len, pieces)``.

    In the row regime a diff's sections come out of one row, so their facts fit
    in a task as well: each diff is folded, without looking for long groups first
    (``max_fold_items``).
    Everything is keyed by ``diff_id`` first, so no exchange follows the one that
    partitioned the diffs.
    """
    s = pack(facts, ["diff_id"], ["sec"], "n_lines", max_lines, max_fold_items=max_fold_items)
    # sort_array + field projection: no lambdas, so these stay out of the interpreter
    ordered = F.sort_array(F.collect_list(F.struct("sec", "files")))
    return s.groupBy("diff_id", "slot").agg(
        ordered.getField("sec").alias("secs"),
        F.array_distinct(F.flatten(ordered.getField("files"))).alias("files"),
        F.sum("n_lines").cast("bigint").alias("lines"),
        F.max("header_len").alias("header_len"),  # of the only section, if the slot has pieces
        F.first("pieces", ignorenulls=True).alias("pieces"))


def chunk_list(slots: DataFrame, giant: bool = False) -> DataFrame:
    """Chunk metadata, numbered: ``CHUNK_COLUMNS`` without content, with ``slot``, ``secs``, ``header_len``, ``s``, ``e``.

    With ``giant``, chunks are numbered in blocks of slots, so that no task needs all chunks of a diff.
    """
    whole = F.array(F.struct(F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("e"), F.col("lines"))).cast(PIECES)
    is_big = F.col("pieces").isNotNull()
    x = slots.withColumn("__parent", F.when(is_big, parent_file()))
    x = x.select("diff_id", "slot", "secs", "files", "header_len", "__parent", F.size("pieces").alias("__n"),
                 F.posexplode(F.coalesce("pieces", whole)).alias("__k", "__p"))
    if giant:
        from patchloom.operators.pack_parallel import running_count
        x = running_count(x, ["diff_id"], F.floor(F.col("slot") / SLOTS_PER_BLOCK), ["slot", "__k"], "__num")
    else:
        x = x.withColumn("__num", F.row_number().over(Window.partitionBy("diff_id").orderBy("slot", "__k")))
    return x.select("diff_id", F.col("__num").cast("bigint").alias("chunk"), "files", F.col("__p.lines").alias("lines"), F.col("__parent").alias("parent_file"),
                    F.when(F.col("__n") > 1, F.col("__k") + 1).cast("int").alias("sub_chunk_index"),
                    "slot", "secs", "header_len", F.col("__p.s").alias("s"), F.col("__p.e").alias("e"))


def slots_with_chunks(listed: DataFrame) -> DataFrame:
    """``(diff_id, slot, secs, header_len, chunks)``: the chunks of a ``chunk_list``, by slot."""
    fields = ["chunk", "s", "e", "files", "lines", "parent_file", "sub_chunk_index"]
    return listed.groupBy("diff_id", "slot").agg(
        F.first("secs").alias("secs"), F.first("header_len").alias("header_len"), F.sort_array(F.collect_list(F.struct(*fields))).alias("chunks"))


def cut_chunks(d: DataFrame) -> DataFrame:
    """``CHUNK_COLUMNS`` from ``(diff_id, chunks, texts)``, two arrays side by side."""
    d = d.select("diff_id", F.explode(F.arrays_zip("chunks", "texts")).alias("__z"))
    return d.select("diff_id", *[F.col(f"__z.chunks.{c}").alias(c) for c in CHUNK_COLUMNS[1:-1]], F.col("__z.texts").alias("content"))


def chunk_texts(diffs: DataFrame, listed: DataFrame) -> DataFrame:
    """``CHUNK_COLUMNS`` of the chunks in ``listed`` (a ``chunk_list``): texts come straight from ``diffs(diff_id, content)``."""
    plan = slots_with_chunks(listed).groupBy("diff_id").agg(F.collect_list(F.struct("secs", "header_len", "chunks")).alias("slots"))
    d = diffs.select("diff_id", "content").join(plan, "diff_id")

    def with_texts(parts):
        return F.transform("slots", lambda x: F.struct(
            x["header_len"].alias("h"), x["chunks"].alias("chunks"),
            F.concat_ws("\n\n", F.transform(x["secs"], lambda k: F.element_at(parts, k + 1))).alias("text")))

    d = d.select("diff_id", F.inline(let(T.split_sections(T.normalized_text("content")), with_texts)))
    return cut_chunks(d.select("diff_id", "chunks", piece_texts(F.col("text"), F.col("h"), F.col("chunks")).alias("texts")))


def build_chunks(kept: DataFrame, max_lines: int, slots: DataFrame, with_content: bool = True,
                 extra_pieces: DataFrame | None = None) -> DataFrame:
    """Giant diffs: all chunks of the kept sections (with text): ``CHUNK_COLUMNS`` (+ ``slot``, ``sub``).

    ``extra_pieces`` are pieces of oversized sections split elsewhere (rows
    shaped like ``split_oversized`` output; their sections are not in ``kept``)."""
    s = kept.join(slots, ["diff_id", "sec"])
    small = s.where(F.col("n_lines") <= max_lines)
    big = s.where(F.col("n_lines") > max_lines)
    ordered_texts = F.sort_array(F.collect_list(F.struct("sec", "text")))
    ordered_files = F.sort_array(F.collect_list(F.struct("sec", "files")))
    aggs = [
        F.array_distinct(F.flatten(ordered_files.getField("files"))).alias("files"),
        F.sum("n_lines").cast("bigint").alias("lines"),
    ]
    if with_content:
        aggs.append(F.concat_ws("\n\n", ordered_texts.getField("text")).alias("content"))
    normal = small.groupBy("diff_id", "slot").agg(*aggs).select(
        "diff_id", "slot", F.lit(0).alias("sub"), "files", "lines",
        F.lit(None).cast("string").alias("parent_file"), F.lit(None).cast("int").alias("sub_chunk_index"),
        *(["content"] if with_content else []))
    split = split_oversized(big, max_lines, keep=["slot"])
    if extra_pieces is not None:
        split = split.unionByName(extra_pieces.join(slots, ["diff_id", "sec"]).select(*split.columns))
    pieces = split.select(
        "diff_id", "slot", "sub", "files", "lines", "parent_file", "sub_chunk_index",
        *(["content"] if with_content else []))
    allc = normal.unionByName(pieces)
    # number slim (slot, sub) rows in slot blocks, then join the numbers back:
    # no task ever holds all chunks (or their content) of one diff
    from patchloom.operators.pack_parallel import running_count
    keys = allc.select("diff_id", "slot", "sub")
    nums = running_count(keys, ["diff_id"], F.floor(F.col("slot") / SLOTS_PER_BLOCK), ["slot", "sub"], "chunk")
    return allc.join(nums.select("diff_id", "slot", "sub", F.col("chunk").cast("bigint").alias("chunk")),
                     ["diff_id", "slot", "sub"])


def summary_col() -> F.Column:
    """``"{parent} (part k), n lines"`` or ``"{m} files, n lines"``."""
    part = F.concat(F.col("parent_file"), F.lit(" (part "), F.col("sub_chunk_index").cast("string"), F.lit("), "),
                    F.col("lines").cast("string"), F.lit(" lines"))
    files = F.concat(F.size("files").cast("string"), F.lit(" files, "), F.col("lines").cast("string"), F.lit(" lines"))
    return F.when(F.col("parent_file").isNotNull() & F.col("sub_chunk_index").isNotNull(), part).otherwise(files)


def chunk_files(chunks: DataFrame) -> DataFrame:
    """D7 (flat): ``(diff_id, path, chunk)``."""
    return chunks.select("diff_id", F.explode("files").alias("path"), "chunk")


def file_chunk_index(chunks: DataFrame) -> DataFrame:
    """D7 (grouped): path -> ascending chunk numbers."""
    return chunk_files(chunks).groupBy("diff_id", "path").agg(F.sort_array(F.collect_set("chunk")).alias("chunks"))


def diff_stats(chunks: DataFrame) -> DataFrame:
    """Distinct paths, sum of chunk lines, chunk count per diff - one aggregate
    over (chunk, file) rows; a chunk's lines and count are taken from its first file."""
    cf = chunks.select("diff_id", "lines", F.posexplode("files").alias("__k", "path"))
    first = F.col("__k") == 0
    return cf.groupBy("diff_id").agg(
        F.sum(F.when(first, F.col("lines"))).cast("bigint").alias("total_lines"),
        F.count_if(first).cast("bigint").alias("chunks_count"),
        F.count_distinct("path").cast("bigint").alias("total_files"),
    )
