"""Next-fit packing for groups too large for one task (hot keys).

Same rule as ``pack`` (see there), computed without ever gathering a group:

1. positions and prefix sums: ``pos`` (1..N) and ``P`` (inclusive weight sum)
   by a two-level running sum (range-partitioned blocks, block totals carried
   forward through a small per-block table);
2. the next slot start of every item: for an item ``i`` that is not big,
   ``next(i)`` is the last item ``j`` whose exclusive prefix ``E_j <= E_i + cap``
   (an as-of lookup done as one sort + running max, also two-level); a big
   item is followed by a new slot; past the end points to ``N + 1``;
3. where a path that enters a block of positions leaves it, followed in the
   block's task, and pointer doubling over these few entries alone;
4. slot starts = items reachable from position 1, walked in each block from
   its entry on the path;
5. ``slot`` = running count of starts (two-level again).

Every step is a join or window over bounded partitions; levels are
checkpointed to the session's checkpoint folder, which also pins the
range-partition block ids against recomputation after executor loss.
Weights are whole numbers (``pack.weight_units``) and rows are dealt by ranges of
the fold's total order, so the slots are the fold's. Prefix sums are 64-bit
while no group can pass that, else 38-digit decimals.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.session import ensure_checkpoint_dir

ROWS_PER_BLOCK = 1_000_000
POSITIONS_PER_BLOCK = 1 << 18
MAX_BROADCAST_GROUPS = 1_000_000


def _blocks(n_rows: int, rows_per_block: int) -> int:
    return max(1, math.ceil(n_rows / rows_per_block))


def _ranged(df: DataFrame, group_cols, order_cols, n_blocks: int) -> DataFrame:
    """Sort globally by (group, order); tag each row with its block and in-block id; pin it."""
    ensure_checkpoint_dir(df.sparkSession)
    s = df.repartitionByRange(n_blocks, *group_cols, *order_cols).sortWithinPartitions(*group_cols, *order_cols)
    s = s.withColumn("__blk", F.spark_partition_id()).withColumn("__rid", F.monotonically_increasing_id())
    return s.checkpoint()


def _running(s: DataFrame, group_cols, block_col: str, order_col, value: Column, out: str, how: str) -> DataFrame:
    """Two-level inclusive running ``sum`` / ``max`` of ``value`` per group along (block, order).

    ``order_col`` is a column name or a list of them; blocks must be ordered
    consistently with it inside each group."""
    agg = F.sum if how == "sum" else F.max
    s = s.withColumn("__rv", value)
    tot = s.groupBy(*group_cols, block_col).agg(agg("__rv").alias("__t"))
    before = Window.partitionBy(*group_cols).orderBy(block_col).rowsBetween(Window.unboundedPreceding, -1)
    carry = tot.select(*group_cols, block_col, agg("__t").over(before).alias("__carry"))
    s = s.join(carry, list(group_cols) + [block_col])
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    upto = Window.partitionBy(*group_cols, block_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = agg("__rv").over(upto)
    if how == "sum":
        res = F.coalesce("__carry", F.lit(0)) + inner
    else:
        res = F.greatest("__carry", inner)
    return s.withColumn(out, res).drop("__rv", "__carry")


def running_count(df: DataFrame, group_cols, block: Column, order_cols, out: str) -> DataFrame:
    """1-based position of every row in (order_cols) order per group, without a
    window over a whole group: ``block`` must be monotone in the order."""
    s = df.withColumn("__blk", block)
    s = _running(s, list(group_cols), "__blk", list(order_cols), F.lit(1), out, "sum")
    return s.drop("__blk")


def reachable(jump: DataFrame, group_cols, first: DataFrame, max_steps: int,
              positions_per_block: int = POSITIONS_PER_BLOCK) -> DataFrame:
    """Positions reachable from ``first(group, __pos)`` by following ``jump(group, __pos, __nx, __N)``
    (``__nx > __pos``; ``__nx > __N`` means past the end).

    Positions are cut into blocks. A path enters a block at ``first`` or where a jump from another block
    lands; a task follows each of these places to where it leaves the block, pointer doubling over these
    few places alone (``_doubled``) finds the entries on the path, and tasks walk each block from them.
    So the jumps themselves are read twice, however long the path is.
    """
    g = list(group_cols)
    ensure_checkpoint_dir(jump.sparkSession)
    block = lambda c: F.floor(F.col(c) / F.lit(positions_per_block)).cast("bigint")
    edges = jump.select(*g, block("__pos").alias("__blk"), "__pos", "__nx", "__N")
    ends = edges.where((F.col("__nx") <= F.col("__N")) & (block("__nx") > F.col("__blk"))).select(*g, F.col("__nx").alias("__pos"))
    ends = ends.distinct().checkpoint()
    entries = first.select(*g, "__pos")
    if not ends.isEmpty():
        places = ends.unionByName(entries).distinct()
        exits = _in_blocks(edges, places, g, block("__pos"), _exits, "__pos bigint, __nx bigint, __N bigint").checkpoint()
        entries = _doubled(exits, g, entries, max_steps)
    return _in_blocks(edges, entries, g, block("__pos"), _walk, "__pos bigint")


def _in_blocks(edges: DataFrame, places: DataFrame, g: list[str], block: Column, follow, out: str) -> DataFrame:
    """``follow(pos, nx, n, places)`` of the jumps and places of each block, with the group's columns."""
    schema = ", ".join(f"`{c}` {edges.schema[c].dataType.simpleString()}" for c in g) + ", " + out
    names = [c.split()[0] for c in out.split(", ")]
    none = F.lit(None).cast("bigint")
    rows = edges.unionByName(places.select(*g, block.alias("__blk"), "__pos", none.alias("__nx"), none.alias("__N")))

    def run(table: pa.Table) -> pa.Table:
        place = pc.is_null(table["__nx"])
        at = np.unique(table.filter(place)["__pos"].to_numpy())
        found = [np.zeros(0, np.int64)] * len(names)
        if len(at):
            t = table.filter(pc.invert(place))
            pos, nx, n = (t[c].to_numpy() for c in ("__pos", "__nx", "__N"))
            order = np.argsort(pos, kind="stable")
            found = follow(pos[order], nx[order], n[order], at)
        group = [table[c].take(pa.array(np.zeros(len(found[0]), np.int64))) for c in g]
        return pa.Table.from_arrays([*group, *map(pa.array, found)], [*g, *names])

    return rows.groupBy(*g, "__blk").applyInArrow(run, schema)


def _inside(pos: np.ndarray, nx: np.ndarray) -> list[int]:
    """Of each jump the number of the jump it leads to, or -1 if that is in no row of the block."""
    to = np.searchsorted(pos, nx)
    hit = to < len(pos)
    hit[hit] = pos[to[hit]] == nx[hit]
    return np.where(hit, to, -1).tolist()


def _exits(pos: np.ndarray, nx: np.ndarray, n: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """Each place that has a jump, with where its path leaves the block."""
    to = _inside(pos, nx)
    last = list(range(len(to)))
    for i in range(len(to) - 1, -1, -1):
        if to[i] >= 0:
            last[i] = last[to[i]]
    at = np.flatnonzero(np.isin(pos, places))
    out = np.array(last, np.int64)[at]
    return [pos[at], nx[out], n[out]]


def _walk(pos: np.ndarray, nx: np.ndarray, n: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """The positions reachable from the places inside the block, and the places."""
    to, seen = _inside(pos, nx), np.zeros(len(pos), bool)
    for i in np.flatnonzero(np.isin(pos, places)).tolist():
        while i >= 0 and not seen[i]:
            seen[i] = True
            i = to[i]
    return [np.union1d(pos[seen], places)]


def _doubled(jump: DataFrame, g: list[str], first: DataFrame, max_steps: int) -> DataFrame:
    """Positions reachable, by pointer doubling interleaved with the enumeration: after round k the
    starts are ``{next^m(first) : m < 2^(k+1)}``; when a round adds none, the
    path has ended, so the rounds (each a checkpointed, evenly keyed equi-join)
    number about log2(path length), at most log2(max_steps) + 1.
    """
    level = jump
    starts = first.select(*g, "__pos").checkpoint()
    found = starts.count()
    k_max = max(1, math.ceil(math.log2(max_steps + 1)))
    for k in range(k_max):
        step = starts.alias("s").join(level.alias("l"), [*(F.col(f"s.{c}") == F.col(f"l.{c}") for c in g),
                                                         F.col("s.__pos") == F.col("l.__pos")])
        step = step.where(F.col("l.__nx") <= F.col("l.__N")).select(*(F.col(f"s.{c}") for c in g),
                                                                   F.col("l.__nx").alias("__pos"))
        starts = starts.unionByName(step).checkpoint()
        now = starts.count()
        if now == found:
            break
        found = now
        if k + 1 < k_max:
            hop = level.select(*g, F.col("__pos").alias("__mid"), F.col("__nx").alias("__nx2"))
            on = [*(F.col(f"a.{c}") == F.col(f"b.{c}") for c in g), F.col("a.__nx") == F.col("b.__mid")]
            level = level.alias("a").join(hop.alias("b"), on, "left").select(
                *(F.col(f"a.{c}") for c in g), F.col("a.__pos").alias("__pos"),
                F.coalesce(F.col("b.__nx2"), F.col("a.__nx")).alias("__nx"), F.col("a.__N").alias("__N")).checkpoint()
    return starts


def pack_parallel(df: DataFrame, group_cols, order_cols, cap: int, slot_col: str = "slot",
                  rows_per_block: int = ROWS_PER_BLOCK, n_rows: int | None = None,
                  max_group: int | None = None, max_total: int | None = None) -> DataFrame:
    """``df`` (weights in units: column ``__w``) with ``slot_col`` added; ``order_cols`` is the total order.

    ``max_group`` and ``max_total`` are the most rows and the greatest sum of weights of a group, if known."""
    group_cols, order_cols = list(group_cols), list(order_cols)
    g = group_cols
    if n_rows is None or max_group is None:
        st = df.groupBy(*g).count().agg(F.sum("count"), F.max("count")).first()
        n_rows, max_group = int(st[0] or 0), int(st[1] or 0)
    nb = _blocks(n_rows, rows_per_block)
    # no weight passes cap + 1, so no sum passes that for each row
    kind = "bigint" if (max_group * (cap + 1) if max_total is None else max_total) + cap < 1 << 62 else "decimal(38,0)"
    capl = F.lit(cap).cast(kind)

    # 1. positions and prefix sums (rows keep their payload)
    payload = [c for c in df.columns if c not in g and c != "__w"]
    s = _ranged(df.withColumn("__w", F.col("__w").cast(kind)), g, order_cols, nb)
    s = _running(s, g, "__blk", "__rid", F.lit(1), "__pos", "sum")
    s = _running(s, g, "__blk", "__rid", F.col("__w"), "__P", "sum")
    items = s.select(*g, *payload, F.col("__pos").cast("bigint").alias("__pos"), "__w",
                     (F.col("__P") - F.col("__w")).alias("__E")).checkpoint()
    totals = items.groupBy(*g).agg(F.max("__pos").alias("__N"), F.sum("__w").alias("__wsum"))
    # one row per hot group; every hot group has > max_fold_items rows, so there are
    # few of them: broadcast instead of shuffling a hot group's rows by its key
    totals = totals.checkpoint()
    if totals.count() <= MAX_BROADCAST_GROUPS:
        totals = F.broadcast(totals)

    # 2. next(i) by an as-of lookup: last j with E_j <= E_i + cap
    data = items.select(*g, F.col("__E").alias("__v"), F.lit(0).alias("__kind"), F.col("__pos").alias("__dpos"),
                        F.lit(None).cast("bigint").alias("__qpos"))
    queries = items.where(F.col("__w") <= capl).select(
        *g, (F.col("__E") + capl).alias("__v"), F.lit(1).alias("__kind"),
        F.lit(None).cast("bigint").alias("__dpos"), F.col("__pos").alias("__qpos"))
    u = _ranged(data.unionByName(queries), g, ["__v", "__kind", "__dpos", "__qpos"], _blocks(2 * n_rows, rows_per_block))
    u = _running(u, g, "__blk", "__rid", F.col("__dpos"), "__j", "max")
    found = u.where(F.col("__kind") == 1).select(*g, F.col("__qpos").alias("__pos"), F.col("__v").alias("__q"), "__j")
    nxt = items.select(*g, "__pos", "__w").join(found, g + ["__pos"], "left").join(totals, g)
    nxt_col = (F.when(F.col("__w") > capl, F.col("__pos") + 1)
               .when(F.col("__q") >= F.col("__wsum"), F.col("__N") + 1)
               .otherwise(F.col("__j")))
    jump = nxt.select(*g, "__pos", nxt_col.cast("bigint").alias("__nx"), "__N").checkpoint()

    # 3-4. pointer doubling, then the slot starts reachable from position 1
    starts = reachable(jump, g, totals.select(*g, F.lit(1).cast("bigint").alias("__pos")), max_group)

    # 5. slot = running count of starts up to each position (blocks by position)
    marks = starts.withColumn("__m", F.lit(1))
    it = items.select(*g, *payload, "__pos").join(marks, g + ["__pos"], "left")
    it = it.withColumn("__blk", F.floor((F.col("__pos") - 1) / F.lit(rows_per_block)))
    it = _running(it, g, "__blk", "__pos", F.coalesce("__m", F.lit(0)), slot_col, "sum")
    return it.select(*g, *payload, F.col(slot_col).cast("bigint").alias(slot_col))
