"""In-section split of oversized sections at hunk boundaries.

For a section with ``n_lines > max``, the body (lines from the first hunk
header on) is cut into pieces; every piece repeats the section's header
block. Cut rules, scanning body line ``i`` with the open piece starting at
``start`` holding ``c`` nonblank lines, ``lh`` its last hunk header (or -1) and
``nl`` the nonblank lines from ``lh`` on, ``H`` = header block length (blank
lines included), ``T = max(0.8 * max, 200)``:

* A: at a hunk header with ``i > start`` and ``c + H >= T``: cut before ``i``.
* then append the line (a hunk header sets ``lh = i, nl = 0``; nonblank bumps ``c``, ``nl``).
* C: if ``c + H >= max``: cut before ``lh`` when ``lh > start`` (back-track,
  ``c = nl``), else cut after ``i``.

Everything happens in the section's own row, in time and memory in proportion to
its lines: the lines are classified once into an array of flags, a fold over the
flags carries five ints and the cuts, and pieces are an array of their
own, exploded by itself, so that no piece row carries the section. The bounds and
line counts of the pieces (``piece_bounds``) are all that metadata needs; texts
(``piece_texts``) are cut from the line array by those bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions import text as T

_HUNK, _NONBLANK = 1, 2


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _flags(lines: Column) -> Column:
    """Of each line: bit 0 a hunk header, bit 1 nonblank."""
    return F.transform(lines, lambda x: F.when(x.rlike(T.HUNK_RE), _HUNK).otherwise(0)
                       + F.when(x.rlike(T.NONBLANK_RE), _NONBLANK).otherwise(0))


def _cuts(flags: Column, H: Column, max_lines: int) -> Column:
    """Body lines before which a new piece starts, over the flags of the body."""
    target = F.greatest(F.lit(float(max_lines) * 0.8), F.lit(200.0))
    mx = F.lit(max_lines)

    def step(s, flag):
        i = s["i"]
        hk = flag.bitwiseAND(_HUNK) > 0
        nb = F.when(flag >= _NONBLANK, 1).otherwise(0)
        # rule A
        a = hk & (i > s["start"]) & ((s["c"] + H) >= target)
        start1 = F.when(a, i).otherwise(s["start"])
        lh1 = F.when(a, -1).otherwise(s["lh"])
        cuts1 = F.when(a, F.concat(s["cuts"], F.array(i))).otherwise(s["cuts"])
        # append
        lh2 = F.when(hk, i).otherwise(lh1)
        nl2 = F.when(hk, 0).otherwise(s["nl"]) + nb
        c2 = F.when(a, 0).otherwise(s["c"]) + nb
        # rule C
        full = (c2 + H) >= mx
        back = full & (lh2 > start1)
        forced = full & ~back
        return F.struct(
            (i + 1).alias("i"),
            F.when(back, lh2).when(forced, i + 1).otherwise(start1).alias("start"),
            F.when(back, nl2).when(forced, 0).otherwise(c2).alias("c"),
            F.when(forced, -1).otherwise(lh2).alias("lh"),
            nl2.alias("nl"),
            F.when(back, F.concat(cuts1, F.array(lh2)))
            .when(forced, F.concat(cuts1, F.array(i + 1))).otherwise(cuts1).alias("cuts"),
        )

    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("start"), F.lit(0).alias("c"), F.lit(-1).alias("lh"),
                    F.lit(0).alias("nl"), F.array().cast("array<int>").alias("cuts"))
    return F.aggregate(flags, zero, step, lambda s: s["cuts"])


PIECES = "array<struct<s:int,e:int,lines:bigint>>"


def piece_bounds(lines: Column, H: Column, n_lines: Column, max_lines: int) -> Column:
    """Pieces of an oversized section as structs (s, e, lines): body lines [s, e) and the nonblank lines with the header.

    A section without a hunk is one piece, with null bounds.
    """
    def of(flags):
        def bounds(body):
            head = F.size(F.filter(F.slice(flags, 1, H), lambda f: f >= _NONBLANK))
            starts = F.array_distinct(F.concat(F.array(F.lit(0)), _cuts(body, H, max_lines), F.array(F.size(body))))
            return let(starts, lambda b: F.transform(F.sequence(F.lit(1), F.size(b) - 1), lambda k: piece(body, b, k, head)))

        return let(F.slice(flags, H + 1, F.size(flags) - H), bounds)

    def piece(body, b, k, head):
        s, e = F.element_at(b, k), F.element_at(b, k + 1)
        lines_in = head + F.size(F.filter(F.slice(body, s + 1, e - s), lambda f: f >= _NONBLANK))
        return F.struct(s.alias("s"), e.alias("e"), lines_in.cast("bigint").alias("lines"))

    whole = F.array(F.struct(F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("e"), n_lines.cast("bigint").alias("lines")))
    return F.when(H.isNull(), whole).otherwise(let(_flags(lines), of)).cast(PIECES)


def piece_texts(text: Column, H: Column, pieces: Column) -> Column:
    """The texts of some pieces of a section: the header block and the piece's body lines (the whole text without bounds)."""
    def cut(lines):
        head = F.slice(lines, 1, H)
        return F.transform(pieces, lambda p: F.concat_ws("\n", head, F.slice(lines, H + p["s"] + 1, p["e"] - p["s"])))

    return F.when(F.element_at(pieces, 1)["s"].isNull(), F.array(text)).otherwise(let(T.split_lines(text), cut))


def parent_file() -> Column:
    """E5: the label of a split section: its file, or the number of its files."""
    return F.when(F.size("files") == 1, F.element_at("files", 1)).otherwise(
        F.concat(F.size("files").cast("string"), F.lit(" files")))


def split_oversized(big: DataFrame, max_lines: int, keep=()) -> DataFrame:
    """``big``: sections with ``n_lines > max_lines`` (columns of ``sections``).

    Returns one row per piece: diff_id, sec, sub (1-based), pieces, files,
    lines, parent_file, sub_chunk_index, content.
    """
    keep = list(keep)
    H = F.col("header_len")
    b = big.withColumn("__p", piece_bounds(T.split_lines("text"), H, F.col("n_lines"), max_lines))
    b = b.withColumn("__n", F.size("__p"))
    full = F.arrays_zip(F.col("__p.lines").alias("lines"), piece_texts(F.col("text"), H, F.col("__p")).alias("content"))
    b = b.select("diff_id", "sec", *keep, "files", F.col("__n").alias("pieces"), F.posexplode(full).alias("__k", "__z"))
    return b.select(
        "diff_id", "sec", *keep, (F.col("__k") + 1).alias("sub"), "pieces", "files",
        F.col("__z.lines").alias("lines"), parent_file().alias("parent_file"),
        F.when(F.col("pieces") > 1, F.col("__k") + 1).alias("sub_chunk_index"),
        F.col("__z.content").alias("content"),
    )
