"""Alignment of two tokenizers over a corpus, with corpus-wide counts of aligned token pairs.

Tokens of A and of B cover the same bytes of a text. Where tokens of both end
together, the text is cut: the tokens between two cuts form a group, and the
last A and B token of a group are linked. Links are counted over the corpus by
inverted pair bitmaps:

1. A map tokenizes the texts and numbers the documents of a task in blocks of at
   most 65,536. For each pair of ids that a block links it writes the bitmap of
   the documents that hold the pair (steps between their numbers, compressed),
   and multiplicity planes: plane k has a bit for each document of the bitmap,
   set where 2**k is part of how often the document links the pair.
2. Bitmaps of a pair are OR-merged. Blocks share no document, so the popcount of
   the union is the sum of the blocks' popcounts: the documents of the pair. The
   popcounts of plane k, times 2**k, add up to its links. Each task adds up its own
   blocks before the exchange.
3. A B id's highest count is taken over the pairs; then the postings are read
   once more, beside the counts of their pairs, and give each document its
   scores. Pairs are dealt by their B id and blocks in runs, so that a frequent
   pair's postings are spread over tasks, each with the counts of its own pairs.
4. A document's scores from all its pairs are added up block by block.

Both tokenizers treat a text independently before and behind a space or a line
end that follows a character other than white space: no pre-token of A and no
piece of B goes on there (``Aligner`` checks B's pieces). So texts are cut there,
and each distinct part is tokenized and aligned once for a while (the last
``MEMO`` to 2 ``MEMO`` parts are remembered). Tests compare this with whole
texts. U+2581 in a text is a space to B, so such texts never equal B's bytes.

Defined results: a text that is null or empty, or whose joined token bytes differ from space and
text for A or B, has no tokens: zeros and an empty string; rows without a doc_id are left out, also
of the counts; repeated rows each count and each give a row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import staged
from patchloom.llm.fingerprints import _deflate, _inflate

#: Documents and links of a block; a document's links stay together.
BLOCK_DOCS = 1 << 16
BLOCK_LINKS = 2_000_000
#: Pairs are dealt to so many buckets by their B id.
BUCKETS = 16
#: Blocks in a run, on average: a task that gives scores reads one bucket of these.
RUN_BLOCKS = 64
#: Distinct parts of texts that a task remembers; then it starts anew.
MEMO = 200_000
#: Longest part that is remembered.
MEMO_CHARS = 64

#: How byte-level tokenizers cut a text before their merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space before a space or line end; without it every one of these begins a part.
_INNER = re.compile(r"\s[ \n]|\x1f")
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def parts_of(text: str) -> list[str]:
    """The parts of space + text; each begins with a space or a line end."""
    text = " " + text
    if _INNER.search(text):
        return _CUT.split(text)
    return text.replace(" ", "\x1f ").replace("\n", "\x1f\n")[1:].split("\x1f")


def _byte_encoder(path: str):
    """A function: text -> ids of the byte-level tokenizer in the file, and its tokens' bytes by id.

    If ids are in the order of the merges, which is so for the usual vocabularies,
    the vocabulary itself serves as the merges' ranks for a faster encoder with
    the same result; otherwise the file's tokenizer is used as it is.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    byte = {c: n for n, c in enumerate(_byte_letters())}
    special = {t["content"] for t in content["added_tokens"]}
    raw = {t: t.encode() if t in special else bytes(byte[c] for c in t) for t in content["model"]["vocab"]}
    vocab, split = content["model"]["vocab"], content["pre_tokenizer"]
    table = {i: raw[t] for t, i in vocab.items()} | {t["id"]: t["content"].encode() for t in content["added_tokens"]}
    merges = [m if isinstance(m, list) else m.split(" ") for m in content["model"]["merges"]]
    order = [vocab["".join(m)] for m in merges]
    usual = split == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if usual and content["normalizer"] is None and order == list(range(256, 256 + len(order))):
        import tiktoken

        ranks = {raw[t]: i for t, i in vocab.items() if t not in special}
        return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, table
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids, table


class Aligner:
    """In a task: the alignment of parts of texts. Pairs are numbered b * n_a + a."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a, bytes_a = _byte_encoder(path_a)
        self.n_a = max(bytes_a) + 1
        self.bytes_a = [bytes_a.get(i, b"") for i in range(self.n_a)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any(re.search("[^▁]▁|\n", p) for p in pieces):
            raise ValueError("a piece of the second tokenizer goes on behind a space or line end")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b))
        self.names_a, self.names_b = list(map(str, range(self.n_a))), list(map(str, range(len(pieces))))
        self.space = self.b.piece_to_id("▁")
        self.memo: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def _aligned(self, raw: bytes, a: list[int], b: list[int]) -> tuple | None:
        if b"".join([self.bytes_a[i] for i in a]) != raw or b"".join([self.bytes_b[i] for i in b]) != raw:
            return None
        groups, links, left, right = [], [], [], []
        end_a = end_b = j = 0
        for x in a:
            end_a += self.sizes_a[x]
            left.append(self.names_a[x])
            while end_b < end_a:
                y = b[j]
                end_b += self.sizes_b[y]
                right.append(self.names_b[y])
                j += 1
            if end_a == end_b:
                groups.append(f"{','.join(left)}|{','.join(right)}")
                links.append(y * self.n_a + x)
                left, right = [], []
        return len(a), len(b), len(groups), ";".join(groups), links

    def parts(self, parts: set[str]) -> dict[str, tuple | None]:
        """For each part: (tokens of A, of B, groups, the groups' text, numbers of the linked pairs), or None if bytes differ."""
        if len(self.memo) > MEMO:
            self.memo, self.older = {}, self.memo
        known, older, out, new = self.memo, self.older, {}, []
        for p in parts:
            if p in known:
                out[p] = known[p]
            elif p in older:
                out[p] = known[p] = older[p]
            else:
                new.append(p)
        for k in range(0, len(new), 4096):
            some = new[k : k + 4096]
            # a space is put before each: the part's own, or one that is a token by itself before a line end
            b = self.b.encode([p[1:] if p[0] == " " else p for p in some], num_threads=1)
            for p, y in zip(some, b, strict=True):
                found = self._aligned(p.encode(), self.a(p), y[1:] if p[0] != " " else y if len(p) > 1 else [self.space])
                out[p] = found
                if len(p) <= MEMO_CHARS:
                    known[p] = found
        return out


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next free one from U+0100."""
    free = iter(range(256, 512))
    return [chr(n) if 0x21 <= n <= 0x7E or 0xA1 <= n <= 0xAC or 0xAE <= n else chr(next(free)) for n in range(256)]


# ---- postings

def _bucket(pair: np.ndarray, n_a: int) -> np.ndarray:
    return (pair // n_a * 2654435761 >> 8) % BUCKETS


def packed_postings(pair: np.ndarray, doc: np.ndarray, times: np.ndarray) -> bytes:
    """Bitmaps and multiplicity planes of entries sorted by (pair, doc)."""
    first = np.concatenate([[True], pair[1:] != pair[:-1]])
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(pair))).astype(np.uint32)
    steps = doc.astype(np.uint16)
    steps[1:] = np.where(first[1:], doc[1:], doc[1:] - doc[:-1])
    planes = [np.packbits((times >> k & 1).astype(bool)).tobytes() for k in range(int(times.max()).bit_length())]
    planes = zstandard.ZstdCompressor(level=1).compress(b"".join(planes))
    blocks = [_deflate(np.diff(pair[starts], prepend=0)), _deflate(sizes), _deflate(steps), planes]
    return np.array([len(b) for b in blocks], "<u4").tobytes() + b"".join(blocks)


def postings(blob: bytes):
    """(pairs, sizes of their bitmaps, documents of all bitmaps, planes as rows of bits)."""
    ends = np.cumsum(np.frombuffer(blob[:16], "<u4")) + 16
    pairs, sizes, steps, planes = (blob[a:b] for a, b in zip([16, *ends[:-1]], ends))
    pairs, sizes = np.cumsum(_inflate(pairs, np.int64)), _inflate(sizes, np.uint32).astype(np.int64)
    steps = _inflate(steps, np.uint16).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    run = np.cumsum(steps)
    docs = run - np.repeat(run[starts] - steps[starts], sizes)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(planes), np.uint8).reshape(-1, -(-len(docs) // 8))
    return pairs, sizes, docs, np.unpackbits(raw, axis=1, count=len(docs))


def _tokenized(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool) -> DataFrame:
    """Rows of documents (bucket null) and of postings (bucket and blob), numbered in blocks."""
    meta = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    names = ["block", "doc", *meta, "groups_sha256", "groups", "bucket", "blob"]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.string(), pa.int32(), pa.binary()]
    schema = "block long, doc int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, bucket int, blob binary"

    def run(batches):
        aligner = Aligner(path_a, path_b)
        block, links, sizes, held = TaskContext.get().partitionId() << 32, [], [], 0

        def rows(columns):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        def flush():
            pair = np.concatenate(links) if links else np.zeros(0, np.int64)
            if not len(pair):
                return
            # one number for pair and document; equal ones are counted
            entry = np.sort(pair * BLOCK_DOCS + np.repeat(np.arange(len(sizes)), sizes))
            at = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
            times, entry = np.diff(np.append(at, len(entry))), entry[at]
            pair, doc = entry // BLOCK_DOCS, entry % BLOCK_DOCS
            bucket = _bucket(pair, aligner.n_a)
            blobs = [(k, packed_postings(pair[m], doc[m], times[m])) for k in range(BUCKETS) if (m := bucket == k).any()]
            n = len(blobs)
            yield rows([[block] * n, *[[None] * n] * 8, [k for k, _ in blobs], [b for _, b in blobs]])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(0, len(texts), 64):
                some = [parts_of(t) if t and "▁" not in t else () for t in texts[k : k + 64]]
                known = aligner.parts(set(chain.from_iterable(some)))
                out = []
                for doc_id, parts in zip(ids[k : k + 64], some, strict=True):
                    if len(sizes) == BLOCK_DOCS or held >= BLOCK_LINKS:
                        if out:
                            yield rows([*zip(*out)])
                            out = []
                        yield from flush()
                        block, links, sizes, held = block + 1, [], [], 0
                    found = [known[p] for p in parts]
                    found = () if None in found else found
                    pair = np.fromiter(chain.from_iterable(f[4] for f in found), np.int64)
                    groups = ";".join([f[3] for f in found])
                    digest = hashlib.sha256(groups.encode()).hexdigest() if found else ""
                    out.append((block, len(sizes), doc_id, sum(f[0] for f in found), sum(f[1] for f in found), sum(f[2] for f in found), len(pair), digest, groups if keep_groups else None, None, None))
                    links.append(pair)
                    sizes.append(len(pair))
                    held += len(pair)
                if out:
                    yield rows([*zip(*out)])
        yield from flush()

    return docs.mapInArrow(run, schema)


def _popcounts(blobs: DataFrame) -> DataFrame:
    """(pair, n_docs, n_links): popcounts of bitmaps and planes, added up within each task."""

    def run(batches):
        held, rows = [], 0

        def added():
            pair, docs, links = (np.concatenate(c) for c in zip(*held))
            every, where = np.unique(pair, return_inverse=True)
            return every, *(np.bincount(where, v, len(every)).astype(np.int64) for v in (docs, links))

        for batch in batches:
            for blob in batch.column(0):
                pairs, sizes, _, planes = postings(blob.as_py())
                starts = np.cumsum(sizes) - sizes
                links = sum(np.add.reduceat(plane.astype(np.int64), starts) << k for k, plane in enumerate(planes))
                held.append((pairs, sizes, links))
                rows += len(pairs)
            if rows > 3_000_000:
                held = [added()]
                rows = len(held[0][0])
                if rows > 2_000_000:  # so many different pairs: passed on
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["pair", "n_docs", "n_links"])
                    held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in added()], ["pair", "n_docs", "n_links"])

    return blobs.mapInArrow(run, "pair long, n_docs long, n_links long")


def _scores(batches):
    """Rows (bucket, run, kind, pair, n_links, best, block, blob) in order: the counts of a bucket's pairs, then its postings.

    Gives (block, blob): documents of the block, and what these postings add to their scores.
    """
    now, counts, table = None, [], None
    for batch in batches:
        bucket, run, kind, pair, links, best = (np.asarray(batch.column(i).fill_null(0)) for i in range(6))
        blocks, blobs = batch.column(6).to_pylist(), batch.column(7)
        unit = bucket.astype(np.int64) << 32 | run
        cut = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (kind[1:] != kind[:-1]), [True]])) if len(unit) else np.zeros(1, int)
        out = []
        for s, e in zip(cut[:-1], cut[1:]):
            if unit[s] != now:
                now, counts, table = unit[s], [], None
            if kind[s] == 0:
                counts.append((pair[s:e], links[s:e], best[s:e]))
                continue
            if table is None:
                table = [np.concatenate(c) for c in zip(*counts)]
                order = np.argsort(table[0])
                table = [c[order] for c in table]
            for i in range(s, e):
                pairs, sizes, docs, planes = postings(blobs[i].as_py())
                at = np.searchsorted(table[0], pairs)
                times = sum(plane.astype(np.int64) << k for k, plane in enumerate(planes))
                every, where = np.unique(docs, return_inverse=True)
                total = np.zeros(len(every), np.int64)
                np.add.at(total, where, times * np.repeat(table[1][at], sizes))
                top = np.bincount(where, times * np.repeat(table[2][at], sizes), len(every)).astype(np.int64)
                blocks_out = [_deflate(every.astype(np.uint16)), _deflate(total), _deflate(top)]
                out.append((blocks[i], np.array([len(b) for b in blocks_out], "<u4").tobytes() + b"".join(blocks_out)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["block", "blob"])


def _added(names: list[str], kinds: list):
    def run(batches):
        """Rows (block, kind, blob, *names) in order: a block's scores, then its documents."""
        now = None
        for batch in batches:
            block, kind = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cut = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (kind[1:] != kind[:-1]), [True]])) if len(block) else np.zeros(1, int)
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if block[s] != now:
                    now, total, top = block[s], np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)
                if kind[s] == 0:
                    for blob in batch.column(2).slice(s, e - s).to_pylist():
                        ends = np.cumsum(np.frombuffer(blob[:12], "<u4")) + 12
                        docs, t, b = (_inflate(blob[x:y], k) for x, y, k in zip([12, *ends[:-1]], ends, (np.uint16, np.int64, np.int64)))
                        total[docs] += t
                        top[docs] += b
                    continue
                doc = np.asarray(batch.column(3).slice(s, e - s))
                rest = [batch.column(4 + i).slice(s, e - s) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(top[doc]), pa.array(total[doc])], [*names, "n_best", "count_sum"])

    return run


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, text: str = "text", doc_id: str = "doc_id", keep_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs).

    documents: doc_id, n_a, n_b, n_groups, n_links, groups_sha256 [, groups], n_best, count_sum: one row for each row of ``docs`` with a doc_id.
    pairs: a_id, b_id, n_docs, n_links, best: a row for each linked pair of ids; ``best`` if no other pair of its B id has more links.
    """
    n_a = max(_byte_encoder(path_a)[1]) + 1
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null")
    rows = staged(_tokenized(source, path_a, path_b, keep_groups), "token_postings")
    blobs = rows.filter("bucket is not null").select("block", "bucket", "blob")

    counts = _popcounts(blobs.select("blob")).groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    counts = staged(counts.withColumn("b_id", F.floor(F.col("pair") / n_a)).withColumn("a_id", F.col("pair") % n_a), "pair_counts")
    highest = counts.groupBy("b_id").agg(F.max("n_links").alias("highest"))
    pairs = counts.join(highest, "b_id").withColumn("best", F.col("n_links") == F.col("highest"))

    blocks = rows.select("block").distinct()
    runs = max(1, -(-blocks.count() // RUN_BLOCKS))
    run = F.pmod(F.xxhash64("block"), F.lit(runs)).cast("int")
    bucket = (F.shiftright(F.col("b_id") * F.lit(2654435761), 8) % BUCKETS).cast("int")
    none = F.lit(None)
    table = pairs.select(bucket.alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), F.lit(0).alias("kind"), "pair", "n_links", F.col("best").cast("long").alias("best"), none.cast("long").alias("block"), none.cast("binary").alias("blob"))
    lists = blobs.select("bucket", run.alias("run"), F.lit(1).alias("kind"), none.cast("long").alias("pair"), none.cast("long").alias("n_links"), none.cast("long").alias("best"), "block", "blob")
    tasks = min(BUCKETS * runs, 20_000)
    scores = table.unionAll(lists).repartition(tasks, "bucket", "run").sortWithinPartitions("bucket", "run", "kind").mapInArrow(_scores, "block long, blob binary")

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if keep_groups else [])]
    held = rows.filter("bucket is null")
    both = scores.select("block", F.lit(0).alias("kind"), "blob", none.cast("int").alias("doc"), *(F.lit(None).cast(held.schema[n].dataType).alias(n) for n in names))
    both = both.unionAll(held.select("block", F.lit(1).alias("kind"), none.cast("binary").alias("blob"), "doc", *names))
    kinds = ", ".join(f"{n} {held.schema[n].dataType.simpleString()}" for n in names)
    out = both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_added(names, kinds), f"{kinds}, n_best long, count_sum long")
    return out, pairs.select("a_id", "b_id", "n_docs", "n_links", "best")
