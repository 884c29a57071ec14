"""Near-duplicate classes by a grouped prefix join on word n-grams.

Two documents link when the Jaccard similarity of their sets of 5-word
shingles is 0.8 or more. Shingles are ordered from rare to frequent, and linked
documents share one among the first n - ceil(0.8 n) + 1 of each. Steps:

1. Exact copies become one document (``exact_copies``).
2. One exchange of fingerprints finds the shingles that several documents have.
   A document with fewer than ceil(0.8 n) of them links with nothing and is done.
3. The others' shingles get their frequencies, and each document its prefix.
   Documents with equal prefixes and sizes form a group.
4. First pairs: each group's members with its first member, and for each prefix
   shingle the first members of its groups with the one of them whose shingles
   are the most frequent; only sizes and places of the shingle that leave room
   for 0.8. The pairs are verified on the whole sets, and links joined to
   components. What is left of a shingle's documents meets three members of
   their largest component in the same way.
5. The groups are expanded: where a shingle's documents still lie in several
   components, every pair across components that was not verified yet is. A
   document meets its own component's members no more, so a large group of
   near copies takes a number of pairs in proportion to its size.

All links between components are tested, so the components are exact. Sets are
of 64-bit hashes (XXH64) cut to 54 bits; two different shingles of a pair look
equal once in some 10**11 pairs.

Defined results: a null or empty text, or one without words, has an empty set
and is its own component; a text of fewer than 5 words is one shingle; rows
without a doc_id are left out; repeated rows are copies; rows that share a
doc_id but not the text are documents of their own; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import LOWER, UPPER, staged
from patchloom.llm.components import connected_components
from patchloom.llm.fingerprints import COUNTS, ENTRIES, SIZES, exact_copies, repeated, representatives, row_keys, text_bytes

SHINGLE_WORDS = 5
PERCENT = 80
KEY_BITS = 54

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shingle_maker(words: int):
    """In a task: a function from a text to the hashes of its set of shingles."""

    def make():
        import xxhash

        digest = xxhash.xxh64_intdigest

        def shingles(text: str | None):
            parts = (text or "").encode().translate(_FOLD).split()
            if not parts:
                return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
            line = b" ".join(parts)
            sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
            ends = np.cumsum(sizes) - 1
            starts = (ends - sizes + 1)[: max(1, len(parts) - words + 1)].tolist()
            ends = ends[min(words, len(parts)) - 1 :].tolist()
            keys = np.unique(np.array([digest(line[a:b]) for a, b in zip(starts, ends)], np.uint64))
            return keys, np.zeros(len(keys), np.uint32)

        return shingles

    return make


def _unpacked(df: DataFrame, kind: str, columns: str) -> DataFrame:
    """Rows of packed arrays as rows with array columns."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        for b in batches:
            ref, keys, aux = (b.column(i).to_pylist() for i in range(3))
            arrays = {"ref": pa.array(ref, pa.int64()), "keys": pa.array([np.frombuffer(k, np.int64) for k in keys], pa.list_(pa.int64()))}
            if "df" in names:
                arrays["df"] = pa.array([np.frombuffer(a, np.uint32).astype(np.int64) for a in aux], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([arrays[n] for n in names], names)

    return df.filter(f"kind = {kind}").select("ref", "keys", "aux").mapInArrow(run, columns)


def _needed(n):
    """Shared shingles that a document of n shingles needs: ceil(0.8 n)."""
    return F.ceil(n * PERCENT / 100)


def _may_link():
    """Of documents that meet at a shingle, the sizes and what follows it in both leave room for a link."""
    return F.expr(f"least(n, na) * 100 >= greatest(n, na) * {PERCENT} and least(left, left_a) * {100 + PERCENT} >= (n + na) * {PERCENT}")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle_words: int = SHINGLE_WORDS, unique_ids: bool = False) -> DataFrame:
    """(doc_id long, n_shingles long, component_id long), a row for each row of ``docs`` with a doc_id.

    With ``unique_ids``, rows that share a doc_id are known to have the same text.
    """
    if unique_ids:
        return _classes(docs, text, doc_id, shingle_words)
    rows = row_keys(docs, text, doc_id)
    found = _classes(rows, "text", "row", shingle_words)
    ids = rows.filter("row <> doc_id").select("row", F.col("doc_id").alias("own")).distinct()
    if not ids.limit(1).count():
        return found
    # back from rows to doc_ids, and to the least doc_id of each component
    named = staged(found.join(ids.withColumnRenamed("row", "doc_id"), "doc_id", "left").withColumn("own", F.coalesce("own", "doc_id")), "named_rows")
    least = named.groupBy("component_id").agg(F.min("own").alias("least"))
    return named.join(least, "component_id").select(F.col("own").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))


def _classes(docs: DataFrame, text: str, doc_id: str, shingle_words: int) -> DataFrame:
    members = staged(exact_copies(docs, text, doc_id), "members")
    found = staged(repeated(representatives(docs, members, text, doc_id), shingle_maker(shingle_words), text_bytes(members), KEY_BITS, with_keys=True), "shared_shingles")
    sizes = found.filter(f"kind = {SIZES}").groupBy("ref").agg(F.max("n").alias("n_shingles"))
    shared = found.filter(f"kind = {ENTRIES}").groupBy("ref").agg(F.sum("n").alias("shared"))
    hopeful = staged(shared.join(sizes, "ref").filter(F.col("shared") >= _needed(F.col("n_shingles"))), "hopeful")

    own = _unpacked(found.join(F.broadcast(hopeful.select("ref")) if hopeful.count() < 1_000_000 else hopeful.select("ref"), "ref", "left_semi"), ENTRIES, "ref long, keys array<long>")
    places = own.select("ref", F.explode("keys").alias("key"))
    counts = _unpacked(found, COUNTS, "keys array<long>, df array<long>").select(F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("df").alias("df"))))
    sets = staged(
        places.join(counts, "key").groupBy("ref").agg(F.sort_array(F.collect_set(F.struct("df", "key"))).alias("s")).join(hopeful.select("ref", "n_shingles"), "ref")
        .withColumn("alone", F.greatest(F.lit(0).cast("long"), F.col("n_shingles") - F.size("s")))
        .withColumn("n_prefix", F.col("n_shingles") - _needed(F.col("n_shingles")) + 1 - F.col("alone"))
        .filter("n_prefix > 0")
        .select("ref", F.col("n_shingles").alias("n"), F.col("s.key").alias("keys"), F.slice(F.col("s.key"), 1, F.col("n_prefix").cast("int")).alias("prefix"),
                F.aggregate(F.col("s.df"), F.lit(0).cast("long"), lambda a, x: a + x).alias("weight")),
        "sets",
    )
    grouped = sets.select("ref", "n", "prefix", F.xxhash64("n", "prefix").alias("g1"), F.md5(F.concat_ws(",", F.col("prefix").cast("array<string>"))).alias("g2"))
    first = grouped.groupBy("n", "g1", "g2").agg(F.min("ref").alias("first"), F.count(F.lit(1)).alias("size"))
    inside = grouped.join(first.filter("size > 1"), ["n", "g1", "g2"]).filter("ref <> first").select(F.col("first").alias("a"), F.col("ref").alias("b"))
    # left: shingles from this one on in the order; linked documents have so many that they can still share, at the first one that they share
    lists = staged(sets.select("ref", "n", "weight", F.size("keys").alias("size"), F.posexplode("prefix").alias("pos", "key")).select("ref", "n", "weight", "key", (F.col("size") - F.col("pos")).alias("left")), "prefix_lists")
    # groups meet by their first members, each with the one of its list whose shingles are the most frequent
    heads = lists.join(first.filter("size > 1").select(F.col("first").alias("ref")).unionAll(first.filter("size = 1").select(F.col("first").alias("ref"))), "ref", "left_semi")
    pivot = heads.groupBy("key").agg(F.max(F.struct("weight", "ref", "n", "left")).alias("p"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", F.col("p.ref").alias("a"), F.col("p.n").alias("na"), F.col("p.left").alias("left_a"))
    across = heads.join(pivot, "key").filter("ref <> a").filter(_may_link()).select("a", F.col("ref").alias("b"))
    tried = staged(inside.unionAll(across).distinct(), "first_pairs")
    links = staged(_linked(tried, sets), "first_links")
    label = _labels(connected_components(links), sets)

    # what is left of a list meets three members of its largest component before all pairs do
    open_lists = _open(lists, label, "labelled")
    hub = F.struct("ref", "n", "left")
    ends = [F.max_by(hub, F.struct("left", "ref")), F.max_by(hub, F.struct("weight", "ref")), F.max_by(hub, F.struct(F.xxhash64("ref", "key"), "ref"))]
    hubs = open_lists.filter("label = main").groupBy("key").agg(F.array_distinct(F.array(*ends)).alias("hubs")).select("key", F.explode("hubs").alias("p")).select("key", F.col("p.ref").alias("a"), F.col("p.n").alias("na"), F.col("p.left").alias("left_a"))
    more = staged(_new(open_lists.filter("label <> main").join(hubs, "key").filter(_may_link()), tried), "more_pairs")
    links = staged(links.unionAll(_linked(more, sets)), "more_links")
    tried = tried.unionAll(more)

    # expand: pairs across the components that still meet in a list
    open_lists = _open(lists, _labels(connected_components(links), sets), "labelled_again")
    minor = open_lists.filter("label <> main").select("key", F.col("ref").alias("a"), F.col("n").alias("na"), F.col("left").alias("left_a"), F.col("label").alias("la"))
    cross = open_lists.join(minor, "key").filter("ref <> a and label <> la and (label = main or a < ref)").filter(_may_link())
    late = staged(_linked(_new(cross, tried), sets), "late_links")
    nodes = connected_components(links.unionAll(late))

    joined = members.join(sizes, "ref", "left").join(nodes.withColumnRenamed("node", "ref"), "ref", "left")
    n = F.coalesce("n_shingles", F.lit(0).cast("long"))
    return joined.select("doc_id", n.alias("n_shingles"), F.when(n > 0, F.coalesce("label", "ref")).otherwise(F.col("doc_id")).alias("component_id"))


def _open(lists: DataFrame, label: DataFrame, name: str) -> DataFrame:
    """The lists whose members lie in several components, with each one's label and the largest component of the list."""
    labelled = staged(lists.join(label, "ref"), name)
    parts = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    top = parts.groupBy("key").agg(F.max(F.struct("c", "label")).alias("m"), F.count(F.lit(1)).alias("labels")).filter("labels > 1").select("key", F.col("m.label").alias("main"))
    return labelled.join(top, "key")


def _new(met: DataFrame, tried: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of ``met`` (a, ref) that were not verified yet."""
    pairs = met.select(F.least("a", "ref").alias("a"), F.greatest("a", "ref").alias("b")).distinct()
    return pairs.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    one = sets.select(F.col("ref").alias("a"), F.col("keys").alias("ka"), F.col("n").alias("na"))
    two = sets.select(F.col("ref").alias("b"), F.col("keys").alias("kb"), F.col("n").alias("nb"))
    common = F.size(F.array_intersect("ka", "kb"))
    return pairs.join(one, "a").join(two, "b").withColumn("common", common).filter(f"common * 100 >= (na + nb - common) * {PERCENT}").select("a", "b")


def _labels(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    return sets.select("ref").join(nodes.withColumnRenamed("node", "ref"), "ref", "left").select("ref", F.coalesce("label", "ref").alias("label"))
