"""SimHash near-duplicates: fingerprints that differ in few bits, found by pigeonring filtering.

A fingerprint has 64 bits, cut to a ring of 5 consecutive segments (13, 13, 13,
13 and 12 bits). If two fingerprints differ in at most 4 bits, there is a
segment from which every chain of l consecutive segments differs in at most
4 l / 5 bits: in none over one segment, 1 over two, 2 over three, 3 over four.
So linked fingerprints agree, for some place of the ring, in one whole segment
and in all bits of the next but one. Steps:

1. Texts become fingerprints; equal fingerprints become one (a partial
   aggregate, so that a large group of copies costs one row a task).
2. Each fingerprint is sent to 64 keys, one for each bit: the bits of its
   segment and of the one before it, without the bit itself.
3. Rows of a key lie together after a sort. Pairs of a key go through the chains
   of three and of four segments, then the full Hamming check. A pair is written
   at its first key only; of a long list only the links by which a search from
   its middle reaches each member are written, so that a group of n near copies
   gives n - 1 links a key, never all its pairs.
4. Lists of more than ``LIST`` rows, known from the counts of their segment
   pairs, are cut into blocks, and each pair of blocks is searched by itself.
5. Links are joined to components, and labels go back to the documents; labels
   of frequent fingerprints are broadcast.

Defined results: the words of a text are separated by ``[\\x20\\x09-\\x0D]``; a
null or empty text, or one without words, has the fingerprint zero, which links
like any other; rows without a doc_id are left out; repeated rows each give a
row; rows that share a doc_id are documents of their own; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import LOWER, UPPER, staged
from patchloom.llm.components import connected_components

SHINGLE_WORDS = 4
SEED = 42
BITS = 4
#: Starts of the segments, counted from the highest bit.
STARTS = (0, 13, 26, 39, 52)
SEGMENTS = len(STARTS)
#: Longest list of one key that a single search handles.
LIST = 20_000
#: Lists up to this length are compared pair by pair.
SHORT = 12
#: Fingerprints shared by more documents than this are labelled by a broadcast; there is one in so many rows at most.
COMMON = 1_000
#: Documents for each partition of the tables written on the way.
PART_ROWS = 50_000
#: Rows of a table that may be broadcast (some 16 bytes each).
BROADCAST_ROWS = 1_000_000

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_PART = 1 << 16


def fingerprint_of(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit number."""
    import xxhash

    parts = (text or "").encode().translate(_FOLD).split()
    if not parts:
        return 0
    line = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: max(1, len(parts) - words + 1)].tolist()
    ends = ends[min(words, len(parts)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), _PART):
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[k : k + _PART], ends[k : k + _PART])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id long, fp long), a row for each row of ``docs`` with a doc_id."""

    def run(batches):
        for b in batches:
            fps = pa.array([fingerprint_of(t) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["doc_id", "fp"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null")
    return source.mapInArrow(run, "doc_id long, fp long")


# ---- the ring

def _turned(x: np.ndarray, start: int) -> np.ndarray:
    """Fingerprints turned so that the segment at ``start`` comes first."""
    return (x << np.uint64(start)) | (x >> np.uint64(64 - start)) if start else x


def _span(i: int, segments: int) -> int:
    """Bits of so many segments from segment i on."""
    return sum((STARTS[(i + k + 1) % SEGMENTS] - STARTS[(i + k) % SEGMENTS]) % 64 for k in range(segments))


def _chain(x: np.ndarray, i: int) -> np.ndarray:
    """Which differences ``x`` keep the budget in every chain from segment i on, and in full."""
    x = _turned(x, STARTS[i])
    good = np.bitwise_count(x) <= BITS
    for k in range(1, SEGMENTS):
        good &= np.bitwise_count(x >> np.uint64(64 - _span(i, k))) <= BITS * k // SEGMENTS
    return good


def ring_keys(fps: DataFrame) -> DataFrame:
    """(key long, fp long): 64 keys of each fingerprint; the key's highest bits say which."""

    def run(batches):
        for b in batches:
            x = np.asarray(b.column(0)).view(np.uint64)
            for i in range(SEGMENTS):
                two, first = _span(i, 2), _span(i, 1)
                chain = _turned(x, STARTS[i]) >> np.uint64(64 - two)
                for bit in range(two - first):
                    place = (STARTS[i] + two - 1 - bit) % 64
                    keys = (chain & ~np.uint64(1 << bit)) | np.uint64(place << 32)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(x.view(np.int64))], ["key", "fp"])

    return fps.mapInArrow(run, "key long, fp long")


def _long_lists(fps: DataFrame, limit: int) -> DataFrame:
    """(key, n): keys whose lists may be longer than ``limit``; a list holds the fingerprints of two segment pairs."""

    def run(batches):
        for b in batches:
            x = np.asarray(b.column(0)).view(np.uint64)
            pairs = [(_turned(x, STARTS[i]) >> np.uint64(64 - _span(i, 2))) | np.uint64(i << 32) for i in range(SEGMENTS)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(pairs).view(np.int64))], ["pair"])

    def keys(batches):
        for b in batches:
            pair, n = np.asarray(b.column(0)).view(np.uint64), np.asarray(b.column(1))
            for i in range(SEGMENTS):
                mine = (pair >> np.uint64(32)) == i
                two, first = _span(i, 2), _span(i, 1)
                for bit in range(two - first):
                    place = (STARTS[i] + two - 1 - bit) % 64
                    k = (pair[mine] & np.uint64((1 << 32) - 1) & ~np.uint64(1 << bit)) | np.uint64(place << 32)
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n[mine])], ["key", "n"])

    counts = fps.mapInArrow(run, "pair long").groupBy("pair").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * 2 > limit)
    return counts.mapInArrow(keys, "key long, n long").groupBy("key").agg((F.sum("n") * 2).alias("n")).filter(F.col("n") > limit)


_SEGMENT_OF = [max(i for i in range(SEGMENTS) if STARTS[i] <= place) for place in range(64)]


def _short_links(x: np.ndarray, run: np.ndarray, key: np.ndarray, longest: int):
    """Linked pairs within runs of up to ``longest`` members, each at the first of its keys."""
    out = []
    for step in range(1, longest):
        a, b = x[:-step], x[step:]
        same = np.flatnonzero(run[:-step] == run[step:])
        if not len(same):
            break
        a, b, k = a[same], b[same], key[same]
        d = a ^ b
        near = np.flatnonzero(np.bitwise_count(d) <= BITS)
        a, b, d, place = a[near], b[near], d[near], (k[near] >> np.uint64(32)).astype(np.int64)
        segment = np.array(_SEGMENT_OF, np.int64)[place] if len(place) else place
        earlier = np.zeros(len(d), bool)  # a chain from an earlier segment holds: the pair is written there
        write = np.zeros(len(d), bool)
        for j in range(SEGMENTS):  # chains whose second segment is j start at segment j - 1
            holds = _chain(d, (j - 1) % SEGMENTS)
            mine = (segment == j) & holds & ~earlier
            end = STARTS[j + 1] if j + 1 < SEGMENTS else 64
            inside = (d >> np.uint64(64 - end)) & np.uint64((1 << (end - STARTS[j])) - 1)
            bit = np.uint64(1) << (63 - place).astype(np.uint64)
            # in the segment's own bits: the differing one, or the segment's first if none differs
            write |= mine & np.where(inside == 0, place == STARTS[j], (d & bit) != 0)
            earlier |= holds
        out.append((a[write], b[write]))
    return out


def reached(x: np.ndarray, start: int, split: int = 0):
    """Links by which a search reaches every member of the linked parts of ``x``; chains from segment ``start``.

    The search goes on from each member over those not yet reached, so a dense list takes a few comparisons a member.
    With ``split``, only pairs between x[:split] and x[split:] are compared.
    """
    if not len(x):
        return x[:0], x[:0]
    middle = np.packbits(np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(0) * 2 > len(x)).view(np.uint64)[0]
    side = (np.arange(len(x)) >= split) if split else None
    order = np.argsort(np.bitwise_count(x ^ middle), kind="stable")
    left, left_side = x[order], side[order] if split else None
    a, b = [], []
    while len(left):
        queue = [(left[0], left_side[0] if split else None)]
        left, left_side = left[1:], left_side[1:] if split else None
        while queue and len(left):
            now, at = queue.pop()
            hit = _chain(left ^ now, start)
            if split:
                hit &= left_side != at
            if hit.any():
                new = left[hit]
                a.append(np.full(len(new), now))
                b.append(new)
                queue += list(zip(new, left_side[hit] if split else [None] * len(new)))
                left, left_side = left[~hit], left_side[~hit] if split else None
    return (np.concatenate(a), np.concatenate(b)) if a else (x[:0], x[:0])


def _links_in_lists(batches):
    """Batches of (key, fp) sorted by key: links within the keys' lists; lists may go on in the next batch."""
    held_key, held = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def links(key, x):
        if not len(x):
            return
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(cut)
        run = np.repeat(np.arange(len(size)), size)
        short = (size > 1) & (size <= SHORT)
        if short.any():
            mine = short[run]
            yield from _short_links(x[mine], run[mine], key[mine], int(size[short].max()))
        for r in np.flatnonzero(size > SHORT):
            place = int(key[cut[r]] >> np.uint64(32))
            yield reached(x[cut[r] : cut[r + 1]], (_SEGMENT_OF[place] - 1) % SEGMENTS)

    def batch(pairs):
        a, b = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.uint64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        held_key = np.concatenate([held_key, np.asarray(b.column(0)).view(np.uint64)])
        held = np.concatenate([held, np.asarray(b.column(1)).view(np.uint64)])
        before = np.flatnonzero(held_key != held_key[-1])
        last = int(before[-1]) + 1 if len(before) else 0
        yield batch(list(links(held_key[:last], held[:last])))
        held_key, held = held_key[last:], held[last:]
    yield batch(list(links(held_key, held)))


def _links_in_blocks(batches):
    """Batches of (key, one, two, block, fp) sorted by all: links between block ``one`` and block ``two`` of a key."""
    now, parts = None, []

    def links():
        key, one, two = now
        start = (_SEGMENT_OF[key >> 32] - 1) % SEGMENTS
        x = [np.concatenate([v for k, v in parts if k == block] or [np.zeros(0, np.uint64)]) for block in {one, two}]
        a, b = reached(x[0], start) if one == two else reached(np.concatenate(x), start, len(x[0])) if len(x[0]) and len(x[1]) else (x[0][:0], x[0][:0])
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for b in batches:
        key, one, two, block, fp = (np.asarray(c) for c in b.columns)
        if not len(key):
            continue
        cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (block[1:] != block[:-1]), [True]]))
        for s, e in zip(cut[:-1], cut[1:]):
            group = (int(key[s]), int(one[s]), int(two[s]))
            if now is not None and group != now:
                yield links()
                parts = []
            now = group
            parts.append((int(block[s]), fp[s:e].view(np.uint64)))
    if now is not None:
        yield links()


def near_fingerprints(fps: DataFrame, list_limit: int = LIST) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fps`` (fp) that join all that differ in at most ``BITS`` bits.

    Not every linked pair is there, but any two are connected by pairs that are.
    """
    keys = ring_keys(fps)
    hot = staged(_long_lists(fps, list_limit), "long_lists")
    n = hot.count()
    if n:
        hot = F.broadcast(hot) if n <= BROADCAST_ROWS else hot
        usual = keys.join(hot, "key", "left_anti")
    else:
        usual = keys
    found = usual.repartition("key").sortWithinPartitions("key").mapInArrow(_links_in_lists, "a long, b long")
    if not n:
        return found
    blocks = F.ceil(F.col("n") / list_limit).cast("int")
    long = keys.join(hot, "key").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    spread = long.select("key", "block", "fp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "fp")
    spread = spread.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "block")
    return found.unionAll(spread.mapInArrow(_links_in_blocks, "a long, b long"))


def simhash_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", list_limit: int = LIST) -> DataFrame:
    """(doc_id long, fingerprint string, component_id long), a row for each row of ``docs`` with a doc_id."""
    marked = staged(fingerprints(docs, text, doc_id), "simhashes")
    parts = -(-marked.count() // PART_ROWS) or 1  # of tables with at most a few rows a document
    each = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).coalesce(parts), "distinct_simhashes")
    nodes = staged(connected_components(near_fingerprints(each.select("fp"), list_limit), parts).withColumnRenamed("node", "fp").coalesce(parts), "simhash_nodes")
    joined = each.join(nodes, "fp", "left")
    # the smallest doc_id of each component, for the fingerprints whose documents aren't alone
    linked = joined.filter("label is not null")
    least = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    labels = staged(
        linked.join(least, "label").select("fp", "n", "component_id")
        .unionAll(joined.filter("label is null and n > 1").select("fp", "n", F.col("first").alias("component_id")))
        .coalesce(parts),
        "simhash_labels",
    )
    common = labels.filter(F.col("n") > COMMON).select("fp", F.col("component_id").alias("common_id"))
    common = F.broadcast(common) if common.count() <= BROADCAST_ROWS else common
    some = marked.join(common, "fp", "left")
    rest = some.filter("common_id is null").drop("common_id").join(labels.filter(F.col("n") <= COMMON).drop("n"), "fp", "left")
    out = some.filter("common_id is not null").select("doc_id", "fp", F.col("common_id").alias("component_id")).unionByName(rest.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
