"""Next-fit packing of ordered items into capped slots (E1, E1g, E2).

Rule (per group, in order): an item opens a new slot when the open slot is
non-empty and ``fill + weight > cap``. An item heavier than ``cap`` ("big")
always sits alone: it closes the open slot and nothing is packed behind it.

One rule at any group size: weights are whole numbers of a fixed unit
(``weight_units``), so sums are exact whatever the order of additions, and
items are taken in one total order: ``order_cols``, then the weight, then the
other columns. Groups up to ``max_fold_items`` items are folded JVM-side with
``aggregate`` (the fold emits only where slots start); longer groups take
``pack_parallel`` (block prefix sums + pointer doubling over ranges of the same
order), so no task collects an unbounded group. Both give the same slots.
"""

from __future__ import annotations

from decimal import ROUND_FLOOR, Decimal
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

DEFAULT_MAX_FOLD_ITEMS = 50_000
#: Decimal places that float weights count; decimals count their own, up to MAX_DIGITS.
FRACTION_DIGITS = 6
MAX_DIGITS = 8
_MAX_CAP = 1 << 62


def weight_units(df: DataFrame, weight_col: str, cap: float, digits: int | None = None) -> tuple[Column, int]:
    """The weight as a whole number (bigint) of units of ``10**-digits``, and the cap in them.

    ``digits`` is 0 for integers, the scale of decimals and FRACTION_DIGITS for
    floats (rounded half up). Weights beyond the cap all count cap + 1 unit: they
    sit alone whatever they weigh. Null, NaN and negative weights count 0.
    """
    kind = df.schema[weight_col].dataType
    whole = isinstance(kind, Ty.IntegralType)
    if digits is None:
        digits = 0 if whole else min(kind.scale, MAX_DIGITS) if isinstance(kind, Ty.DecimalType) else FRACTION_DIGITS
    cap_units = int(Decimal(str(cap)).scaleb(digits).to_integral_value(ROUND_FLOOR))
    if not 0 <= digits <= MAX_DIGITS or not 0 <= cap_units < _MAX_CAP:
        raise ValueError("cap must be at least 0 and below 2**62 units")
    w, heavy = F.col(weight_col), F.lit(cap_units + 1).cast("bigint")
    if whole and not digits:
        return F.greatest(F.lit(0).cast("bigint"), F.least(F.coalesce(w.cast("bigint"), F.lit(0)), heavy)), cap_units
    units = (w.try_cast(Ty.DecimalType(28, digits)) * F.lit(Decimal(10**digits))).try_cast("bigint")
    empty = w.isNull() | (w <= 0)
    if isinstance(kind, (Ty.DoubleType, Ty.FloatType)):
        empty = empty | F.isnan(w)
    return F.when(empty, F.lit(0).cast("bigint")).when(w > F.lit(cap) + 1, heavy).otherwise(F.least(F.coalesce(units, heavy), heavy)), cap_units


def _order(df: DataFrame, group_cols, order_cols, weight_col) -> list[str]:
    """The total order inside a group: the order key, the weight, then the other columns."""
    first = list(dict.fromkeys([*order_cols, weight_col]))
    return first + [c for c in df.columns if c not in group_cols and c not in first]


def _fold_starts(items: Column, cap: int) -> Column:
    """Positions (1-based, in item order) where a slot starts; an item's units are its field ``__w``."""
    capl = F.lit(cap).cast("bigint")

    def step(s, x):
        w = x["__w"]
        big = w > capl
        new = (s["n"] == 0) | big | s["big"] | (s["cur"] + w > capl)
        return F.struct(
            F.when(new, w).otherwise(s["cur"] + w).alias("cur"),
            big.alias("big"),
            (s["n"] + 1).alias("n"),
            F.when(new, F.concat(s["starts"], F.array(s["n"] + 1))).otherwise(s["starts"]).alias("starts"),
        )

    zero = F.struct(
        F.lit(0).cast("bigint").alias("cur"),
        F.lit(False).alias("big"),
        F.lit(0).alias("n"),
        F.array().cast("array<int>").alias("starts"),
    )
    return F.aggregate(items, zero, step, lambda s: s["starts"])


def _slots_from_starts(starts: Column, n: Column) -> Column:
    """[1,1,1,2,2,3,...]: slot number per position, built linearly from the start positions."""
    k = F.sequence(F.lit(1), F.size(starts))
    run = lambda i: F.coalesce(F.try_element_at(starts, i + 1), n + 1) - F.element_at(starts, i)
    return F.flatten(F.transform(k, lambda i: F.array_repeat(i, run(i))))


def pack(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], weight_col: str, cap: float,
         slot_col: str = "slot", max_fold_items: int | None = DEFAULT_MAX_FOLD_ITEMS,
         unique_order: bool = False, digits: int | None = None) -> DataFrame:
    """E1g: every row of ``df`` with ``slot_col`` (1-based, dense per group) added.

    Rows are packed in ``order_cols`` order; rows tying on the order key are
    taken by ascending weight, then by the other columns (identical rows are
    interchangeable), so these must be orderable (no maps). Weights count as
    ``weight_units`` says. Groups longer than ``max_fold_items`` are packed by
    ``pack_parallel``, with the same result; ``None`` folds every group, without
    the aggregate that looks for long ones. With ``unique_order`` (the
    order key is unique per group) the parallel path packs only the key and
    weight and joins the other columns back on the key, so wide payloads never
    go through its sorts and checkpoints.
    """
    group_cols, order_cols = list(group_cols), list(order_cols)
    units, cap_units = weight_units(df, weight_col, cap, digits)
    order = _order(df, group_cols, order_cols, weight_col)
    out = [*df.columns, slot_col]
    df = df.withColumn("__w", units)
    if max_fold_items is None:
        return _pack_fold(df, group_cols, order, cap_units, slot_col).select(*out)
    # one small aggregate decides which groups are too long to fold in one task
    sizes = df.groupBy(*group_cols).agg(F.count("*").alias("__n"), F.sum(F.col("__w").cast("decimal(28,0)")).alias("__total"))
    hot_stats = sizes.where(F.col("__n") > max_fold_items).agg(F.count("*"), F.sum("__n"), F.max("__n"), F.max("__total")).first()
    if not hot_stats[0]:
        return _pack_fold(df, group_cols, order, cap_units, slot_col).select(*out)
    from patchloom.operators.pack_parallel import pack_parallel
    hot_keys = sizes.where(F.col("__n") > max_fold_items).select(*group_cols)
    if hot_stats[0] <= 100_000:  # at most 100k keys: a checked, small broadcast
        hot_keys = F.broadcast(hot_keys)
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"h.{c}")) for c in group_cols]  # a null key is a group, too
    small = df.alias("d").join(hot_keys.alias("h"), same, "left_anti")
    hot = df.alias("d").join(hot_keys.alias("h"), same, "left_semi")
    folded = _pack_fold(small, group_cols, order, cap_units, slot_col)
    # the group as one struct: never null itself, so that null keys join
    hot = hot.select(F.struct(*group_cols).alias("__g"), *[c for c in hot.columns if c not in group_cols])
    keys = ["__g", *order_cols]
    src = hot.select(*keys, "__w") if unique_order else hot
    parallel = pack_parallel(src, ["__g"], order_cols if unique_order else order, cap_units, slot_col,
                             n_rows=int(hot_stats[1]), max_group=int(hot_stats[2]), max_total=int(hot_stats[3]))
    if unique_order:
        parallel = hot.join(parallel.select(*keys, slot_col), keys)
    parallel = parallel.select("__g.*", *[c for c in parallel.columns if c != "__g"])
    return folded.select(*out).unionByName(parallel.select(*out))


def _pack_fold(df: DataFrame, group_cols, order, cap: int, slot_col) -> DataFrame:
    """The rows of a group travel as one sorted array (bounded by ``max_fold_items``)."""
    fields = [*order, "__w"]
    items = F.sort_array(F.collect_list(F.struct(*fields)))
    g = df.groupBy(*group_cols).agg(items.alias("__items"))
    g = g.select(*group_cols, "__items",
                 _slots_from_starts(_fold_starts(F.col("__items"), cap), F.size("__items")).alias("__slots"))
    z = g.select(*group_cols, F.explode(F.arrays_zip("__items", "__slots")).alias("__z"))
    return z.select(*group_cols, *[F.col("__z.__items")[c].alias(c) for c in order],
                    F.col("__z.__slots").cast("bigint").alias(slot_col))
