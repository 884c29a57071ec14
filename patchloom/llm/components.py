"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import staged


def connected_components(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(node, label): the smallest node reachable, for each node of ``edges`` (a, b).

    The edge tables are written in ``parts`` partitions, where given, so that few edges don't make many small files.

    Alternates large-star and small-star steps, each an aggregate and a join on a written edge table; a node of many
    edges is met by partial aggregation and by a join whose other side has one row for it.
    """
    def step(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        near = small.unionAll(low.select("u", F.col("m").alias("v")))
        return near.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    def written(e: DataFrame) -> DataFrame:
        return staged(e.coalesce(parts) if parts else e, "edges")

    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = mark(now)
    while True:
        now = written(step(now))
        last, seen = seen, mark(now)
        if seen == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(now.select("b", "b").distinct())
