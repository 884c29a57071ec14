"""Remove byte strings that repeat anywhere in the corpus: suffix sorting in blocks over a difference cover.

A string of ``length`` bytes at i that also stands at j has a shift d < v such
that both i + d and j + d are, modulo v, in a difference cover of v. So:

1. Cover sample: only suffixes at cover positions (12 of 133) are looked at, by
   their first length - v + 1 bytes. Equal ones get the same rank (their
   fingerprint), sorted bucket by bucket; a rank held once is dropped.
2. Only suffixes up to v - 1 bytes before a sample whose rank is held again can
   repeat for the whole length. These are sorted by their first ``length`` bytes, one
   block of the key space at a time, and equal neighbours are repeats. The long
   ties (a match of thousands of bytes) never need a longer comparison: the sample's
   ranks have told which suffixes take part, and each start is settled by itself.
3. Every byte covered by a repeating start is removed.

Blocks hold compressed fingerprints (64 bits; a wrong match once in some 10**5
corpora of 10**7 candidate starts), their number follows the input, and no
block grows with a string's frequency (see ``fingerprints``). Exact copies are
settled first: of a text that occurs twice everything repeats.

Defined results: a null or empty text has no bytes; texts shorter than
``length`` lose nothing; matches never cross documents; rows without a doc_id are
left out; rows that share a doc_id but not the text are texts of their own
(``row_keys``); other columns are not read, those of ``carry`` are passed on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import staged
from patchloom.llm.fingerprints import ENTRIES, Rolling, exact_copies, positions, repeated, representatives, row_keys, text_bytes

LENGTH = 200
PERIOD = 133
#: Bits of the samples' ranks: false matches only add candidates.
RANK_BITS = 40


#: A perfect difference set modulo 133, each difference exactly once.
COVER_133 = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)


def difference_cover(v: int) -> np.ndarray:
    """Residues such that every residue modulo v is a difference of two; found greedily, but for v = 133."""
    if v == 133:
        return np.array(COVER_133)
    cover, left = [0], set(range(1, v))
    while left:
        gain = lambda c: {(c - x) % v for x in cover} | {(x - c) % v for x in cover}
        best = max(range(v), key=lambda c: len(left & gain(c)))
        left -= gain(best)
        cover.append(best)
    return np.array(sorted(cover))


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def sample_ranks(length: int, period: int):
    cover = difference_cover(period)
    width = length - period + 1

    def make():
        rolling = Rolling()

        def ranks(text: str | None):
            data = _bytes(text)
            if len(data) < length:
                return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
            at = (np.arange(0, len(data), period)[:, None] + cover).reshape(-1)
            at = at[at <= len(data) - width]
            return rolling.of(rolling.prefix(data), at, at + width), at.astype(np.uint32)

        return ranks

    return make


def candidate_starts(length: int, period: int):
    def make():
        rolling = Rolling()

        def starts(text: str | None, samples: list[bytes]):
            data = _bytes(text)
            n = len(data) - length + 1
            at = np.concatenate([positions(s) for s in samples])
            near = np.zeros(n + 1, np.int64)
            np.add.at(near, np.clip(at - (period - 1), 0, n), 1)
            np.add.at(near, np.clip(at + 1, 0, n), -1)
            s = np.flatnonzero(np.cumsum(near[:n]) > 0)
            return rolling.of(rolling.prefix(data), s, s + length), s.astype(np.uint32)

        return starts

    return make


def _runs(length: int):
    """Kept bytes of each row (doc_id, text, copies, starts, carried columns): ``remove_repeats``' columns."""

    def run(batches):
        for b in batches:
            out = []
            for d, t, copies, starts in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                data = _bytes(t)
                gone = np.zeros(len(data), bool)
                if copies > 1 and len(data) >= length:
                    gone[:] = True
                elif starts:
                    s = np.concatenate([positions(x) for x in starts])
                    edge = np.zeros(len(data) + 1, np.int64)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and bool(gone[0])))
                kept = data[~gone].tobytes()
                out.append((d, len(data), len(data) - len(kept), spans, kept, hashlib.sha256(kept).hexdigest()))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
            kinds = [pa.int64()] * 4 + [pa.binary(), pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays + b.columns[4:], names + b.schema.names[4:])

    return run


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, period: int = PERIOD, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans long, kept binary, kept_sha256 string, *carry), a row for each row with a doc_id.

    ``kept``: the bytes left, in order; at the edge of a removed run a character may be cut.
    """
    if not 0 < period < length:
        raise ValueError("period must be positive and below length")
    rows = row_keys(docs, text, doc_id, carry)
    members = staged(exact_copies(rows, "text", "row"), "members")
    size = text_bytes(members)
    alone = representatives(rows, members, "text", "row")
    ranks = staged(repeated(alone, sample_ranks(length, period), size, RANK_BITS).filter(f"kind = {ENTRIES}").select("ref", "aux"), "cover_ranks")
    flagged = alone.join(ranks.groupBy("ref").agg(F.collect_list("aux").alias("samples")), "ref").select("ref", "text", "samples")
    found = staged(repeated(flagged, candidate_starts(length, period), size).filter(f"kind = {ENTRIES}").select("ref", "aux"), "repeated_starts")

    starts = found.groupBy("ref").agg(F.collect_list("aux").alias("starts")).withColumnRenamed("ref", "row")
    many = members.filter("copies > 1").groupBy(F.col("doc_id").alias("row")).agg(F.max("copies").alias("copies"))
    facts = starts.join(many, "row", "full")
    whole = rows.join(facts, "row", "left").select("doc_id", "text", F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), "starts", *carry)
    carried = "".join(f", {f.name} {f.dataType.simpleString()}" for f in whole.schema[4:])
    return whole.mapInArrow(_runs(length), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string{carried}")
