"""Preference pairs as one prompt with two masked completions.

Conversations are tables of turns (id, turn, role, text). The longest common
prefix of a pair ends before the smallest turn number at which the two sides
differ or one has no turn. Turns before it are rendered once, as the prompt;
the others belong to each side's completion. Loss mask 1 marks the assistant's
turns of a completion. The result has one row for each rendered turn, with its
character offset in its part, so a conversation of any length stays spread
over many rows; offsets are prefix sums in two levels.

Defined results: rows without an id or turn are left out; of rows with equal
id and turn the smallest (role, text) counts; a null text is empty, a null role
is "user"; if one side is a prefix of the other, its completion is empty;
identical sides give a prompt alone; extra columns are not read. A conversation
without a sibling and without an assistant's turn after another turn has no pair:
``preferences_of`` leaves it out, or with ``lone_prompts`` gives its turns as a
prompt with empty completions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm.common import staged

#: Turns for which one task sums offsets.
BLOCK = 1000
SALTS = 64
TEMPLATE = ("<|", "|>\n", "\n")


def turns_of(conversations: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text), unique by the first two."""
    t = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.struct(F.coalesce(F.col("role"), F.lit("user")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("m"))
    return t.filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min("m").alias("m")).select("conv_id", "turn", "m.role", "m.text")


def sibling_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): conversations with the same first turn, two by two in order of a salted rank."""
    opening = turns.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text")).alias("f")).select("conv_id", F.sha2(F.concat_ws("\x1f", "f.role", "f.text"), 256).alias("g"))
    opening = opening.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)))
    inside = opening.withColumn("r", F.row_number().over(Window.partitionBy("g", "salt").orderBy("conv_id")))
    sizes = opening.groupBy("g", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = inside.join(before, ["g", "salt"]).select("g", "conv_id", (F.col("before") + F.col("r") - 1).alias("k"))
    two = ranked.groupBy("g", F.floor(F.col("k") / 2).alias("m")).agg(F.min("conv_id").alias("chosen"), F.max("conv_id").alias("rejected")).filter("chosen <> rejected")
    return two.select(F.col("chosen").alias("pair_id"), "chosen", "rejected")


def echo_sides(turns: DataFrame, alone: DataFrame, lone_prompts: bool = False) -> DataFrame:
    """Sides of pairs for conversations without a sibling: the rejected one answers its last assistant turn with the
    text of the turn that came before. With ``lone_prompts`` both sides are equal where there is no such answer."""
    own = turns.join(alone, "conv_id", "left_semi")
    last = own.filter("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    before = own.join(last, "conv_id").filter("turn < last").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("b"), F.first("last").alias("last")).select("conv_id", "last", F.col("b.text").alias("echo"))
    marked = own.join(before, "conv_id", "left" if lone_prompts else "inner")
    texts = F.create_map(F.lit("chosen"), F.col("text"), F.lit("rejected"), F.when(F.col("turn") == F.col("last"), F.col("echo")).otherwise(F.col("text")))
    return marked.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.explode(texts).alias("side", "text")).select("pair_id", "side", "turn", "role", "text")


def pair_sides(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, side, turn, role, text) of conversation pairs (pair_id, chosen, rejected)."""
    who = pairs.select("pair_id", F.explode(F.create_map(F.lit("chosen"), "chosen", F.lit("rejected"), "rejected")).alias("side", "conv_id"))
    return turns.join(who, "conv_id").select("pair_id", "side", "turn", "role", "text")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TEMPLATE[0]), role, F.lit(TEMPLATE[1]), text, F.lit(TEMPLATE[2]))


def format_preferences(sides: DataFrame) -> DataFrame:
    """(pair_id, part, turn, role, rendered, start, loss_mask) from (pair_id, side, turn, role, text).

    part: prompt, chosen or rejected; start: character offset in the part.
    """
    # written once: both the split and, in two levels, the offsets read it
    at = staged(
        sides.groupBy("pair_id", "turn").agg(
            F.min(F.when(F.col("side") == "chosen", F.struct("role", "text"))).alias("c"), F.min(F.when(F.col("side") == "rejected", F.struct("role", "text"))).alias("r")
        ),
        "paired_turns",
    )
    split = at.filter("not c <=> r").groupBy("pair_id").agg(F.min("turn").alias("split"))
    both = at.join(split, "pair_id", "left")
    shared = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    kind = "array<struct<part:string,m:struct<role:string,text:string>>>"
    sided = F.array(*[F.struct(F.lit(name).alias("part"), F.col(k).alias("m")) for k, name in (("c", "chosen"), ("r", "rejected"))])
    parts = F.when(shared, F.array(F.struct(F.lit("prompt").alias("part"), F.col("c").alias("m"))).cast(kind)).otherwise(sided.cast(kind))
    placed = both.select("pair_id", "turn", F.inline(parts)).filter("m is not null").select("pair_id", "part", "turn", "m.role", "m.text")
    rows = placed.withColumn("rendered", rendered(F.col("role"), F.col("text"))).withColumn("block", F.floor(F.col("turn") / BLOCK))
    inside = rows.withColumn("x", F.coalesce(F.sum(F.length("rendered")).over(Window.partitionBy("pair_id", "part", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = rows.groupBy("pair_id", "part", "block").agg(F.sum(F.length("rendered")).alias("n"))
    carry = blocks.withColumn("y", F.coalesce(F.sum("n").over(Window.partitionBy("pair_id", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    done = inside.join(carry, ["pair_id", "part", "block"])
    mask = F.when((F.col("part") != "prompt") & (F.col("role") == "assistant"), 1).otherwise(0)
    return done.select("pair_id", "part", "turn", "role", "rendered", (F.col("x") + F.col("y")).cast("long").alias("start"), mask.alias("loss_mask"))


def preferences_of(conversations: DataFrame, lone_prompts: bool = False) -> DataFrame:
    """``format_preferences`` of siblings and, where a conversation has none, of its echo pair (``echo_sides``)."""
    turns = turns_of(conversations)
    pairs = staged(sibling_pairs(turns), "sibling_pairs")
    taken = pairs.select(F.col("chosen").alias("conv_id")).unionAll(pairs.select("rejected"))
    alone = turns.select("conv_id").distinct().join(taken, "conv_id", "left_anti")
    return format_preferences(pair_sides(turns, pairs).unionByName(echo_sides(turns, alone, lone_prompts)))
