"""Find the fingerprints that occur more than once in a corpus, through one compact exchange.

Tasks turn texts into 64-bit fingerprints, sort them in batches and send each
batch's slice of the key space to that slice's bucket as one compressed block,
so a fingerprint costs a few bytes in the shuffle, not a row. Fingerprints that
repeat inside a batch are known to repeat; they go on directly, spread by
batch, and only their count goes to the bucket. So a very frequent fingerprint
adds one entry for each batch, and no bucket holds a row for each place. The
number of buckets follows the size of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import staged

BATCH_KEYS = 600_000
#: Bytes of text for each bucket.
BUCKET_BYTES = 6 << 20
MIN_BUCKETS = 64
#: Ids of rows that may be broadcast, 8 bytes each; beyond it the join is left to the planner.
BROADCAST_IDS = 2_000_000

_MOVED = "bucket int, kind int, ref long, n long, keys binary, refs binary, counts binary"
SCHEMA = "kind int, ref long, n long, keys binary, aux binary"
#: Kinds of result rows: repeated entries of a ref; repeated keys with their counts; entries of a ref in all.
ENTRIES, COUNTS, SIZES = 0, 1, 2
_UNIQUE, _STRONG, _KNOWN, _SIZE = 0, 1, 2, 3

# ---- rolling fingerprints of byte strings

BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out


class Rolling:
    """Fingerprints of substrings from prefix sums of a polynomial modulo 2**64, over a table of random byte values."""

    def __init__(self):
        self.values = np.random.default_rng(7).integers(1, MASK, 256, dtype=np.uint64)
        self.inverse = pow(BASE, -1, 1 << 64)
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        self.up, self.down = _powers(BASE, n), _powers(self.inverse, n)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(data) + 1 > len(self.up):
            self._grow(max(len(data) + 1, 2 * len(self.up)))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.down[: len(data)], dtype=np.uint64, out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (sums[end] - sums[start]) * self.up[start]
        h ^= h >> np.uint64(32)  # mixes, so that ranges of the key are even
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h


# ---- blocks of sorted keys

def _deflate(a: np.ndarray) -> bytes:
    """Byte planes, compressed: the high bytes of small numbers cost next to nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()) if len(a) else b""


def _inflate(b: bytes | None, kind) -> np.ndarray:
    if not b:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def _sorted_block(keys: np.ndarray) -> bytes:
    return _deflate(np.diff(keys, prepend=np.uint64(0)))


def _sorted_keys(block: bytes | None) -> np.ndarray:
    return np.cumsum(_inflate(block, np.uint64), dtype=np.uint64)


def packed_positions(sorted_positions: np.ndarray) -> bytes:
    """Steps between sorted positions, two bytes each if they fit, after a byte that tells the width."""
    steps = np.diff(sorted_positions.astype(np.int64), prepend=0)
    kind = "<u2" if not len(steps) or steps.max() < 1 << 16 else "<u4"
    return kind[2].encode() + steps.astype(kind).tobytes()


def positions(block: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(block, f"<u{block[:1].decode()}", offset=1).astype(np.int64))


def _by_ref(refs: np.ndarray, keys: np.ndarray, aux: np.ndarray, with_keys: bool) -> Iterator[tuple]:
    order = np.lexsort((aux, refs))
    refs, keys, aux = refs[order], keys[order], aux[order]
    cut = np.flatnonzero(np.concatenate([[True], refs[1:] != refs[:-1], [True]])) if len(refs) else np.zeros(1, int)
    for a, b in zip(cut[:-1], cut[1:]):
        yield int(refs[a]), int(b - a), keys[a:b].tobytes() if with_keys else None, None if with_keys else packed_positions(aux[a:b])


def _batch(rows, names, kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names)


def repeated(df: DataFrame, fingerprints: Callable, size_bytes: int, bits: int = 64, with_keys: bool = False) -> DataFrame:
    """``df``: (ref long, further columns). ``fingerprints()`` gives, in a task, a function of the
    further columns' values to (keys uint64, aux uint32). Result rows: ``SCHEMA``:

    * ENTRIES: of ``ref``, ``n`` entries whose keys occur elsewhere too: their packed aux, or with_keys the keys;
    * COUNTS (with_keys): keys that occur twice or more (keys), and how often (aux, uint32);
    * SIZES: ``n`` entries of ``ref`` in all.

    Keys are cut to their highest ``bits``.
    """
    buckets = max(MIN_BUCKETS, size_bytes // BUCKET_BYTES)
    shift = np.uint64(64 - bits)
    names = [c.split()[0] for c in _MOVED.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = fingerprints()
        bounds = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64) >> shift
        state: list[tuple] = []
        held, turn = 0, TaskContext.get().partitionId() * 7919

        def flush():
            nonlocal state, held, turn
            turn += 1
            refs = np.concatenate([np.full(len(k), r, np.int64) for r, k, _ in state])
            keys = np.concatenate([k for _, k, _ in state]) >> shift
            aux = np.concatenate([a for _, _, a in state])
            order = np.argsort(keys, kind="stable")
            refs, keys, aux = refs[order], keys[order], aux[order]
            first = np.ones(len(keys), bool)  # none, if all texts are empty
            first[1:] = keys[1:] != keys[:-1]
            run = np.cumsum(first) - 1
            many = np.bincount(run)
            twice = many[run] > 1
            rows = [(0, _SIZE, r, len(k), None, None, None) for r, k, _ in state]
            state = []
            rows = [(buckets + (turn + i) % buckets, *x[1:]) for i, x in enumerate(rows)]
            for i, (r, n, k, a) in enumerate(_by_ref(refs[twice], keys[twice], aux[twice], with_keys)):
                rows.append((buckets + (turn + i) % buckets, _KNOWN, r, n, k, None, a))
            u = ~twice
            ids, local = np.unique(refs[u], return_inverse=True)
            uk, ua = keys[u], aux[u]
            s = first & twice
            sk, sn = keys[s], many[run[s]]
            for b, (i, j, p, q) in enumerate(zip(*_slices(uk, bounds), *_slices(sk, bounds), strict=True)):
                if j > i:
                    own, index = np.unique(local[i:j], return_inverse=True)
                    blob = _deflate(ids[own]) , _deflate(index.astype(np.uint32))
                    head = len(blob[0]).to_bytes(4, "little")
                    rows.append((b, _UNIQUE, None, j - i, _sorted_block(uk[i:j]), head + blob[0] + blob[1], _deflate(ua[i:j])))
                if q > p:
                    rows.append((b, _STRONG, None, q - p, _sorted_block(sk[p:q]), None, _deflate(sn[p:q].astype(np.uint32))))
            held = 0
            for k in range(0, len(rows), 2000):
                yield _batch(rows[k : k + 2000], names, kinds)

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for ref, *values in zip(*cols, strict=True):
                k, a = make(*values)
                state.append((ref, k, a))
                held += len(k)
                if held >= BATCH_KEYS or len(state) >= 20_000:
                    yield from flush()
        if state:
            yield from flush()

    out_names, out_kinds = [c.split()[0] for c in SCHEMA.split(", ")], [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def settle(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        out = [(SIZES if r["kind"] == _SIZE else ENTRIES, r["ref"], r["n"], r["keys"], r["counts"]) for r in rows if r["kind"] in (_KNOWN, _SIZE)]
        rows = [r for r in rows if r["kind"] in (_UNIQUE, _STRONG)]
        if rows:
            keys = [_sorted_keys(r["keys"]) for r in rows]
            weight = [np.ones(len(k), np.int64) if r["kind"] == _UNIQUE else _inflate(r["counts"], np.uint32).astype(np.int64) for r, k in zip(rows, keys, strict=True)]
            every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(inverse, np.concatenate(weight)).astype(np.int64)
            if with_keys and (total > 1).any():
                out.append((COUNTS, None, int((total > 1).sum()), every[total > 1].tobytes(), np.minimum(total[total > 1], MASK >> 32).astype(np.uint32).tobytes()))
            at = 0
            for r, k in zip(rows, keys, strict=True):
                again = total[inverse[at : at + len(k)]] > 1
                at += len(k)
                if r["kind"] == _UNIQUE and again.any():
                    n = int.from_bytes(r["refs"][:4], "little")
                    refs = _inflate(r["refs"][4 : 4 + n], np.int64)[_inflate(r["refs"][4 + n :], np.uint32)]
                    out += [(ENTRIES, *x) for x in _by_ref(refs[again], k[again], _inflate(r["counts"], np.uint32)[again], with_keys)]
        return pa.Table.from_batches([_batch(out, out_names, out_kinds)])

    return df.mapInArrow(send, _MOVED).groupBy("bucket").applyInArrow(settle, SCHEMA)


def _slices(keys: np.ndarray, bounds: np.ndarray) -> tuple[list, list]:
    cut = np.searchsorted(keys, bounds).tolist()
    return [0, *cut], [*cut, len(keys)]


# ---- exact copies

def row_keys(docs: DataFrame, text: str, doc_id: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(row, doc_id, text, *carry) of the rows with a doc_id: ``row`` is the same for equal doc_id and text only.

    It is the doc_id, or a hash of doc_id and text where a doc_id has several texts (a null text counts as empty).
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *carry).filter("doc_id is not null")
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    several = staged(source.groupBy("doc_id").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).filter("low <> high").select("doc_id", F.lit(True).alias("several")), "several_texts")
    n = several.count()
    if not n:
        return source.select(F.col("doc_id").alias("row"), "doc_id", "text", *carry)
    marked = source.join(F.broadcast(several) if n <= BROADCAST_IDS else several, "doc_id", "left")
    return marked.select(F.when(F.col("several"), F.xxhash64("doc_id", F.coalesce("text", F.lit("")))).otherwise(F.col("doc_id")).alias("row"), "doc_id", "text", *carry)


def exact_copies(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, ref, copies, bytes): ``ref`` is the smallest doc_id with the same text, ``copies`` how many rows have it."""
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).alias("bytes")).filter("doc_id is not null")
    groups = ids.groupBy("h").agg(F.min("doc_id").alias("ref"), F.count(F.lit(1)).alias("copies"), F.max("bytes").alias("size"))
    alone = groups.filter("copies = 1").select(F.col("ref").alias("doc_id"), "ref", "copies", F.col("size").alias("bytes"))
    more = ids.join(groups.filter("copies > 1"), "h").select("doc_id", "ref", "copies", "bytes")
    return alone.unionAll(more)


def text_bytes(members: DataFrame) -> int:
    return int(members.agg(F.sum("bytes")).first()[0] or 0)


def representatives(docs: DataFrame, members: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(ref, text): one row for each distinct text (``members`` from ``exact_copies``, written)."""
    rest = members.filter("doc_id <> ref").select(F.col("doc_id").alias("ref")).distinct()
    if rest.count() <= BROADCAST_IDS:
        rest = F.broadcast(rest)
    source = docs.select(F.col(doc_id).cast("long").alias("ref"), F.col(text).cast("string").alias("text")).filter("ref is not null")
    return source.join(rest, "ref", "left_anti")
