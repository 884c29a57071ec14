"""Token alignment against whole texts tokenized in one go and counted in plain Python."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from patchloom.llm import token_alignment as T

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain():
    """A function: text -> (A ids, B ids, groups as (A ids, B ids)), nothing if the bytes differ."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(n): n for n in letters} | {chr(256 + i): n for i, n in enumerate(n for n in range(256) if n not in letters)}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def align(text):
        if not text:
            return [], [], []
        x = a.encode(" " + text, add_special_tokens=False)
        y = b.encode(text)
        bx, by = [bytes(byte[c] for c in t) for t in x.tokens], [piece(i) for i in y]
        if b"".join(bx) != (" " + text).encode() or b"".join(by) != (" " + text).encode():
            return [], [], []
        ends = [[sum(map(len, z[: i + 1])) for i in range(len(z))] for z in (bx, by)] if len(bx) < 2000 else [_ends(bx), _ends(by)]
        cuts, groups, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
        for c in cuts:
            p, q = ends[0].index(c, i) + 1, ends[1].index(c, j) + 1
            groups.append((x.ids[i:p], y[j:q]))
            i, j = p, q
        return x.ids, y, groups

    return align


def _ends(parts):
    out, at = [], 0
    for p in parts:
        at += len(p)
        out.append(at)
    return out


def expected(rows, plain):
    found = [(i, *plain(t)) for i, t in rows]
    count = Counter((x[-1], y[-1]) for *_, groups in found for x, y in groups)
    highest = Counter()
    for (x, y), n in count.items():
        highest[y] = max(highest[y], n)
    out = []
    for i, x, y, groups in found:
        links = [(p[-1], q[-1]) for p, q in groups]
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((i, len(x), len(y), len(groups), len(links), sum(count[k] == highest[k[1]] for k in links), sum(count[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out), count, highest, found


def test_parts_equal_whole_texts(plain):
    letters = ["a", "b", "the", "ing", " ", "  ", "\n", "\n", "\r\n", "\t", "é", "ß", "中", "\x1c", "\xa0", " ", "'s", "1", "<s>", "ﬁ", "\x00", "!", "\r", "<|endoftext|>", "᠎", "﻿", "😀", "​", "<0x41>"]
    r, aligner = random.Random(5), T.Aligner(A, B)
    for _ in range(6000):
        text = "".join(r.choice(letters) for _ in range(r.randrange(1, 16)))
        parts = T.parts_of(text)
        known = aligner.parts(set(parts))
        x, y, groups = plain(text)
        if not groups:
            assert any(known[p] is None for p in parts), repr(text)
            continue
        assert ";".join(known[p][3] for p in parts) == ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups), repr(text)


@pytest.mark.parametrize("small", [False, True])
def test_equals_plain_counts(spark, plain, small, monkeypatch):
    if small:  # many blocks and runs
        monkeypatch.setattr(T, "BLOCK_LINKS", 300)
        monkeypatch.setattr(T, "RUN_BLOCKS", 3)
        monkeypatch.setattr(T, "MEMO", 50)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()][:120]
    odd = [None, "", " ", "   ", "a ", " a", "a\n b", "▁", "a ▁b", "<|endoftext|> <s>", "x" * 5000, "word " * 3000, "\x00 \x01", "é" * 300, "ﬁ ﬂ"]
    rows += [(7000 + i, t) for i, t in enumerate(odd)] + [rows[3], rows[3]]
    docs = spark.createDataFrame([(t, i, 1, "s") for i, t in rows] + [("no id", None, 1, "s")], "text string, doc_id long, block long, bucket string").repartition(4)
    got, pairs = T.align_tokenizers(docs, A, B, keep_groups=True)
    want, count, highest, found = expected(rows, plain)
    got = got.collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == want
    assert all((hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256 for r in got)
    assert {((r.a_id, r.b_id), r.n_links, r.best) for r in pairs.collect()} == {(k, n, n == highest[k[1]]) for k, n in count.items()}
    held = Counter(k for *_, groups in found for k in {(x[-1], y[-1]) for x, y in groups})
    assert {((r.a_id, r.b_id), r.n_docs) for r in pairs.collect()} == set(held.items())


def test_empty_table(spark):
    docs, pairs = T.align_tokenizers(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert docs.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert docs.collect() == [] and pairs.collect() == []
