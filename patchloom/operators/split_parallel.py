"""The hunk split (E3) of sections too long to gather, without a sequential scan.

Body line ``j`` of a section has ``hk`` (hunk header) and ``nb`` (nonblank);
``P(j)`` is the number of nonblank body lines before ``j``. ``H`` is the header
length, ``K = max - H`` and ``T = max(0.8 * max, 200)`` as in ``split.py``. A
piece starting at ``s`` ends where the first rule fires:

* rule C fires at ``e(s)``, the ``(P(s) + K)``-th nonblank line (at ``s`` if ``K <= 0``);
* rule A fires earlier at ``a(s)``, the first hunk header ``h`` in ``(s, e(s)]``
  with ``P(h) >= P(s) + ceil(T - H)``: the first hunk header after the
  ``(P(s) + ceil(T - H))``-th nonblank line;
* at ``e(s)`` the cut goes back to ``LH(e)``, the last hunk header ``<= e``, when
  that is after ``s``; otherwise it is forced after ``e``.

So ``next(s)`` depends on ``s`` alone and is found by equi-joins against
per-line lookups (rank of nonblank lines, next / last hunk header), each
computed with two-level running aggregates over blocks of body lines. The
cut starts are the lines reachable from 0 (pointer doubling).

After a back-track the new piece can already be full
(``P(e+1) - P(LH(e)) + H >= max``). That needs every line in ``[s, LH(e))`` to be
blank, so ``e`` is also ``e(LH(e))``: the state is a function of its position
``p = LH(e)`` alone ("edge" state). From it the scan resumes at ``j = e(p) + 1``:
a hunk header at ``j`` starts the next piece at ``j`` (by rule A, or by a
back-track that is again an edge state when ``1 + H >= max``), any other line
forces a cut after ``j``. So the graph has two nodes per line, ``2p`` (fresh)
and ``2p + 1`` (edge), and pointer doubling over it stays exact.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.functions import text as T
from patchloom.operators.pack_parallel import _running, reachable
from patchloom.session import ensure_checkpoint_dir

LINES_PER_BLOCK = 1_000_000


def cut_starts(body: DataFrame, max_lines: int, lines_per_block: int = LINES_PER_BLOCK) -> DataFrame:
    """``body(diff_id, sec, bi, h, n, hk, nb)`` -> piece starts ``(diff_id, sec, __pos)``."""
    g = ["diff_id", "sec"]
    ensure_checkpoint_dir(body.sparkSession)
    target = max(max_lines * 0.8, 200.0)
    b = body.withColumn("__blk", F.floor(F.col("bi") / lines_per_block))
    b = _running(b, g, "__blk", "bi", F.col("nb").cast("long"), "__pi", "sum")            # P(j+1)
    b = _running(b, g, "__blk", "bi", F.when(F.col("hk"), F.col("bi")), "__lh", "max")     # last hunk <= j
    rb = b.withColumn("__rblk", -F.col("__blk")).withColumn("__rbi", -F.col("bi"))
    rb = _running(rb, g, "__rblk", "__rbi", F.when(F.col("hk"), -F.col("bi")), "__nhn", "max")
    lines = rb.select(*g, "bi", "h", "n", "hk", "nb", "__pi", "__lh", (-F.col("__nhn")).alias("__nh"),
                      (F.col("__pi") - F.col("nb").cast("long")).alias("__p")).checkpoint()
    rank = lines.where("nb").select(*g, F.col("__pi").alias("__r"), F.col("bi").alias("__at"))

    k = F.lit(max_lines) - F.col("h")                      # rule C after K nonblank lines
    ka = F.ceil(F.lit(target) - F.col("h"))               # rule A needs ceil(T - H) before the hunk
    q = lines.select(*g, "bi", "h", "n", "__p", (F.col("__p") + k).alias("__ve"),
                     (F.col("__p") + ka).alias("__va"), (k <= 0).alias("__k0"), (ka <= 0).alias("__ka0"))
    # e(s)
    q = q.join(rank.withColumnRenamed("__r", "__ve").withColumnRenamed("__at", "__e0"), g + ["__ve"], "left")
    q = q.withColumn("__e", F.when(F.col("__k0"), F.col("bi")).otherwise(F.col("__e0")))
    # position from which rule A may fire, then the first hunk header there or later
    q = q.join(rank.withColumnRenamed("__r", "__va").withColumnRenamed("__at", "__a0"), g + ["__va"], "left")
    q = q.withColumn("__apos", F.when(F.col("__ka0"), F.col("bi") + 1).otherwise(F.col("__a0") + 1))
    nh = lines.select(*g, F.col("bi").alias("__apos"), F.col("__nh").alias("__a"))
    q = q.join(nh, g + ["__apos"], "left")
    # at e: last hunk header and P(e+1)
    at_e = lines.select(*g, F.col("bi").alias("__e"), F.col("__lh").alias("__lhe"), F.col("__pi").alias("__pe1"))
    q = q.join(at_e, g + ["__e"], "left")
    p_at = lines.select(*g, F.col("bi").alias("__lhe"), F.col("__p").alias("__plh"))
    q = q.join(p_at, g + ["__lhe"], "left")
    a_ok = F.col("__a").isNotNull() & (F.col("__e").isNull() | (F.col("__a") <= F.col("__e")))
    back = F.col("__lhe") > F.col("bi")
    full = (F.col("__pe1") - F.col("__plh") + F.col("h")) >= F.lit(max_lines)
    end = 2 * F.col("n")
    fresh_nx = (F.when(a_ok, 2 * F.col("__a")).when(F.col("__e").isNull(), end)
                .when(back, 2 * F.col("__lhe") + F.when(full, 1).otherwise(0))
                .otherwise(2 * (F.col("__e") + 1)))
    # edge state at p: resume at j = e(p) + 1 with c = P(e+1) - P(p) nonblank lines
    hk_at = lines.select(*g, F.col("bi").alias("__j"), F.col("hk").alias("__hkj"))
    q = q.withColumn("__j", F.col("__e") + 1).join(hk_at, g + ["__j"], "left")
    c_edge = F.col("__pe1") - F.col("__p")
    rule_a = (c_edge + F.col("h")) >= F.lit(target)
    again = (1 + F.col("h")) >= F.lit(max_lines)
    edge_nx = (F.when(F.col("__e").isNull() | (F.col("__j") >= F.col("n")), end)
               .when(F.col("__hkj") & (rule_a | ~again), 2 * F.col("__j"))
               .when(F.col("__hkj"), 2 * F.col("__j") + 1)
               .when(F.col("__j") + 1 >= F.col("n"), end)
               .otherwise(2 * (F.col("__j") + 1)))
    last = (2 * F.col("n") - 1).cast("bigint").alias("__N")
    fresh = q.select(*g, (2 * F.col("bi")).cast("bigint").alias("__pos"), fresh_nx.cast("bigint").alias("__nx"), last)
    edge = q.select(*g, (2 * F.col("bi") + 1).cast("bigint").alias("__pos"), edge_nx.cast("bigint").alias("__nx"), last)
    jump = fresh.unionByName(edge).checkpoint()
    n_max = body.agg(F.max("n")).first()[0] or 1
    first = jump.where("__pos = 0").select(*g, "__pos")
    nodes = reachable(jump, g, first, int(n_max))
    return nodes.select(*g, F.floor(F.col("__pos") / 2).cast("bigint").alias("__pos"))


def pieces_of(body: DataFrame, starts: DataFrame, lines_per_block: int = LINES_PER_BLOCK) -> DataFrame:
    """Piece number (1-based) of every body line: running count of cut starts."""
    g = ["diff_id", "sec"]
    marks = starts.select(*g, F.col("__pos").alias("bi"), F.lit(1).alias("__m"))
    b = body.join(marks, g + ["bi"], "left").withColumn("__blk", F.floor(F.col("bi") / lines_per_block))
    b = _running(b, g, "__blk", "bi", F.coalesce("__m", F.lit(0)), "piece", "sum")
    return b.drop("__m", "__blk")
