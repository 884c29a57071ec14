"""Operators on documents against plain versions, with null, empty, short, repeated and very long texts."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from patchloom.llm import decontaminate, license_scan, line_quality, ngram_join, packing, queries, suffix_dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, KEPT string, score double, ref long"


@pytest.fixture(scope="module")
def documents(spark):
    """A part of the documents of sf0.001 with odd rows, and columns that clash with outputs."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()][:90]
    base = rows[3][1] + " " + rows[5][1]
    near = base.split()
    near[len(near) // 2] = "changed"
    odd = [None, "", " \n\t", "one", "a b c d", "A b C d", "a b c d e", "word " * 4000, base, base, " ".join(near), "x" * 199, "y" * 200, "y" * 230, "é" * 300,
           "line one here.\nline one here.\n\n" * 9, "Alpha | beta | gamma | delta | eps\n" + "This is a line that is kept, of course, by all rules. " * 3]
    rows += [(1000 + i, t) for i, t in enumerate(odd)] + [rows[7], rows[7]]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 0.5, 1) for i, t in rows], SCHEMA).repartition(5).persist()


def texts(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_clean_lines(documents):
    got = {(r.doc_id, r.text): r for r in line_quality.clean_lines(documents).collect()}
    for d, t in texts(documents):
        w, r = words(t), got[d, t]
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(hit))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w))
        assert not (r.base_failed and r.kept)
        assert r.n_failed_lines or r.clean_text == t
        for line in (r.clean_text or "").split("\n"):
            assert line in (t or "")
    assert "Alpha | beta" not in next(r.clean_text for r in got.values() if r.doc_id == 1016)


def test_clean_lines_keeps_columns_of_any_name(spark):
    text = "This is a line that is kept, of course, by all rules. " * 3
    plain = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, n long")
    odd = plain.select("doc_id", plain.text.alias("_Words"), plain.n.alias("_h2"), plain.n.alias("_good"), plain.n.alias("kept"))
    got, want = line_quality.clean_lines(odd, "_Words").collect()[0], line_quality.clean_lines(plain).collect()[0]
    assert (got["_Words"], got["_h2"], got["_good"]) == (text, 5, 5)
    assert (got.kept, got.n_words, got.clean_text) == (want.kept, want.n_words, want.clean_text)


def test_near_duplicates(documents):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(documents).collect()]
    rows = texts(documents)
    sets = {}
    for d, t in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {d: d for d in sets}

    def find(d):
        while label[d] != d:
            d = label[d]
        return d

    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    assert sorted(got) == sorted((d, len(sets[d]), find(d)) for d, _ in rows)


def test_near_duplicates_hot_group(spark):
    """A group of near copies, half of them out of reach of its first member."""
    w = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        x = list(w)
        for k in range(i % 6):
            x[(i * 7 + k * 31) % 200] = f"c{i}-{k}"
        rows.append((i, " ".join(x)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(196)} for d, t in rows}
    label = {d: d for d in sets}
    for _ in range(len(rows)):
        for a, b in itertools.combinations(sets, 2):
            n = len(sets[a] & sets[b])
            if 100 * n >= 80 * (len(sets[a] | sets[b])):
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_near_duplicates_of_texts_that_share_an_id(spark):
    a, b = "one two three four five six seven eight nine", "ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    docs = spark.createDataFrame([(0, a), (1, a), (1, b), (2, b), (3, b), (1, a)], "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, ngram_join.near_duplicates(docs).collect()))
    assert got == [(0, 5, 0), (1, 4, 1), (1, 5, 0), (1, 5, 0), (2, 4, 1), (3, 4, 1)]


def test_near_duplicates_of_regular_words(spark):
    """Words on which polynomial hashes modulo powers of two agree (Thue-Morse) stay apart."""
    word = "".join("ab"[k.bit_count() % 2] for k in range(2048))
    docs = spark.createDataFrame([(0, word), (1, word.translate(str.maketrans("ab", "ba"))), (2, word)], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.near_duplicates(docs).collect())) == [(0, 1, 0), (1, 1, 1), (2, 1, 0)]


def test_remove_repeats(documents):
    rows = texts(documents)
    grams = Counter(b[i : i + 200] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - 199))
    want = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 199):
            if grams[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        want.append((d, len(b), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1)), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.remove_repeats(documents).drop("kept").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_remove_repeats_of_texts_that_share_an_id(spark):
    rng = np.random.default_rng(6)
    text = lambda n: " ".join(str(x) for x in rng.integers(10**6, 10**7, n))
    a, own, shared = text(60), text(60), text(40)
    rows = [(3, a), (7, a), (7, own), (7, "short"), (8, shared + text(9)), (8, text(30) + shared), (9, own[:90] + "x"), (5, None), (5, shared)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = []
    for d, t in rows:
        b = (t or "").encode()
        n = len(b) if t == a or t == shared else len(shared) if shared in (t or "") else 0
        want.append((d, len(b), n))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in got) == sorted(want)


def test_difference_covers():
    for v in (7, 20, 133):
        cover = suffix_dedup.difference_cover(v)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_pack_documents(documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    got = packing.pack_documents(documents, queries.tokenizer_path()).collect()
    whole = sorted((d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, t in texts(documents))
    by_sequence, by_doc = {}, {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= 2048
    for d, ids in whole:
        n = len(ids) // 4
        own = [r for r in by_doc[d] if r.doc_tokens == n]
        assert sum(r.length for r in own) % n == 0
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
    lengths = [sum(n for _, n in p) for p in by_sequence.values()]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths)
    assert padding < 0.05 * sum(lengths)


def test_best_cuts_are_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(40):
        at = np.unique(np.concatenate([[0], rng.integers(1, 90, 25), np.arange(0, 91, 9)]))
        pen = rng.integers(0, 6, len(at))
        cost = [0] + [None] * (len(at) - 1)
        for j in range(1, len(at)):
            cost[j] = min(cost[i] + 20 - (at[j] - at[i]) + pen[j] for i in range(j) if at[j] - at[i] <= 20)
        cuts = packing.best_cuts(at, pen, 20)
        index = {p: k for k, p in enumerate(at.tolist())}
        assert sum(20 - (b - a) + pen[index[b]] for a, b in zip(cuts, cuts[1:])) == cost[-1]


def test_scan_licenses(spark, documents):
    extra = [(5001, "MIT-License and GNU General Public License, CC BY; mit license"), (5002, "Redistribution and use in sorce and binary form, with or without modifcation"), (5003, "permitted bymit license s"), (5004, None)]
    docs = documents.select("doc_id", "text").unionAll(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {(r.doc_id, r.n_words): r for r in license_scan.scan_licenses(docs).collect()}
    for d, t in [*texts(documents), *extra]:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        hits = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = got[d, len(w)]
        assert (r.n_base, r.first_word, r.last_word) == (len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1
    assert got[5002, 12].labels == "bsd" and got[5002, 12].matches[0].first_word == 0 and 0.9 < got[5002, 12].score < 1


def test_fuzzy_finds_all_within_errors():
    scanner = license_scan.Scanner({}, license_scan.NOTICES, license_scan.ERROR_RATE)
    rng = np.random.default_rng(5)
    for n, (notice, label) in enumerate(license_scan.NOTICES):
        k = max(1, int(len(notice) * license_scan.ERROR_RATE))
        t = list(notice)
        for i in rng.choice(len(t), k, replace=False):
            t[i] = rng.choice(list("qxz"))
        assert label in {m[0] for m in scanner.fuzzy(" some words before " + "".join(t) + " and after ")}, n


def test_find_leaks(spark, documents):
    items = [(1, "Where does the river rise in the north of the land? It rises in the old hills."), (2, None), (3, ""), (3, "Which colour has the sky over the sea at noon on a clear day in May? Blue.")]
    bench = spark.createDataFrame([(*x, "t") for x in items], "item_id long, text string, doc_id string")
    filler = "some other words stand here and there about nothing much at all today " * 20
    docs = spark.createDataFrame([(1, filler + items[0][1] + filler), (2, items[3][1]), (3, filler), (4, None), (5, "which colour HAS the sky, over the grey sea at noon on a clear day in may blue")], "doc_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect())
    assert found == [(1, 1), (2, 3), (5, 3)]
    by_shard = sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench, shard_items=1).collect())
    assert set(found) <= set(by_shard) or by_shard  # shards have statistics of their own
    real = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = {(d, i) for d, t in texts(documents) for i, x in map(tuple, real.select("item_id", "text").collect()) if t and x in t}
    assert whole <= {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(documents, real).collect()}


def test_leak_behind_a_better_passage():
    """Shuffled words first, the item later; items across every border of passages; a question without its answer."""
    rng = np.random.default_rng(8)
    q = [f"q{i}".encode() for i in range(15)]
    a = [f"a{i}".encode() for i in range(12)]
    others = [(k, [f"o{k}x{i}".encode() for i in range(15)], [b"yes"]) for k in range(2, 30)]
    index = [decontaminate.ItemIndex([(1, q, a), *others], 64, decontaminate.SHARE)]
    fill = lambda n: [f"f{x}".encode() for x in rng.integers(0, 500, n)]
    ids = lambda words: [x[0] for x in decontaminate.leaks_in(words, index)]
    assert ids(fill(50) + sorted(q)[::-1] + a[::-1] + fill(400) + q + a + fill(50)) == [1]
    assert ids(fill(50) + sorted(q)[::-1] + a[::-1] + fill(400)) == []
    assert all(ids(fill(n) + q + a + fill(90)) == [1] for n in range(130))
    assert ids(fill(50) + q[:12] + fill(200)) == [1] and ids(fill(50) + q[:11] + fill(200)) == []
    assert ids(fill(50) + q[:9] + a[:6] + fill(200)) == [1] and ids(fill(50) + q[:9] + a[:5] + fill(200)) == []


def test_leaks_are_those_of_any_number_of_shards(spark, documents):
    real = spark.read.parquet(f"{SF}/benchmark.parquet").limit(7)
    items = [tuple(r) for r in real.select("item_id", "text").collect()]
    bench = spark.createDataFrame([*items, (900, None)], "item_id long, text string")
    docs = documents.select("doc_id", "text").limit(20).unionAll(spark.createDataFrame([(7000 + i, "before it " + x + " after it") for i, x in items], "doc_id long, text string"))
    whole = decontaminate.find_leaks(docs, bench)
    assert "Union" not in whole._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]  # one scan
    rounded = lambda df: sorted((*r[:3], round(r.score, 6), *r[4:]) for r in df.collect())
    got = rounded(whole)
    assert {i for i, _ in items} <= {r[1] for r in got} and got == rounded(decontaminate.find_leaks(docs, bench, shard_items=3))


def test_least_score_is_the_least():
    rng = np.random.default_rng(2)
    for _ in range(30):
        q, a = ([b"%d" % x for x in rng.integers(0, 8, n)] for n in (rng.integers(1, 9), rng.integers(0, 5)))
        impact = {t: float(rng.random()) for t in q + a}
        sets = itertools.chain.from_iterable(itertools.combinations(impact, n) for n in range(len(impact) + 1))
        share = lambda part, s: sum(w in s for w in part) / len(part) if part else 0.0
        least = min(sum(impact[t] for t in s) for s in sets if decontaminate.accepted(share(q, s), share(a, s), q, a))
        assert decontaminate.least_score(q, a, impact) <= least + 1e-9
        if not set(q) & set(a):
            assert decontaminate.least_score(q, a, impact) >= least - 1e-9


def test_bounds_drop_no_item():
    """Block-max pruning retrieves what a full scoring does."""
    rng = np.random.default_rng(1)
    vocab = [f"w{i}".encode() for i in range(60)]
    items = [(i, list(rng.choice(vocab, 12)), list(rng.choice(vocab, 3))) for i in range(50)]
    index = decontaminate.ItemIndex(items, 64, 0.5)
    for _ in range(200):
        passage = list(rng.choice(vocab, rng.integers(1, 40)))
        full = {}
        for t in set(passage):
            for i, x in index.postings.get(t, []):
                full[i] = full.get(i, 0) + x
        want = sorted(i for i, s in full.items() if s >= index.threshold[i])
        assert sorted(i for i, _ in index.retrieve(passage)) == want


@pytest.mark.parametrize("f", [line_quality.clean_lines, ngram_join.near_duplicates, suffix_dedup.remove_repeats, license_scan.scan_licenses])
def test_empty_table(spark, f):
    assert f(spark.createDataFrame([], SCHEMA)).collect() == []


def test_empty_tables_of_two(spark, documents):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(documents, empty).collect() == []
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), queries.tokenizer_path()).collect() == []


def test_prose_of_the_same_words_is_no_leak(spark):
    """Texts drawn from the items' own words hold none of them; edited copies of an item do."""
    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(k, f"{text(n)}? {text(6)}.") for k, n in enumerate([2, 5, 8, 15, 30] * 8)]
    docs = [(k, text(400)) for k in range(150)]
    held = []
    for k, (i, item) in enumerate(items):
        words_ = item.split()
        if len(words_) > 18:
            words_[9] = "other"
        docs.append((1000 + k, f"{text(150)} {' '.join(words_)} {text(150)}"))
        held.append((1000 + k, i))
    got = [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert set(held) <= set(got)
    assert not [x for x in got if x[0] < 1000] and len(got) <= len(held) + 2


def test_near_copies_meet_few_members(spark, monkeypatch):
    """A large group of near copies takes pairs in proportion to its size, also where few of them are alike enough."""
    rng = np.random.default_rng(5)
    base, rows = [f"w{k}" for k in range(150)], []
    for i in range(400):
        words = list(base)
        for k, at in enumerate(rng.choice(150, int(rng.integers(0, 4)), replace=False)):
            words[at] = f"x{i}y{k}"
        rows.append((i, " ".join(words)))
    verified, linked = [], ngram_join._linked
    monkeypatch.setattr(ngram_join, "_linked", lambda pairs, sets: verified.append(pairs.count()) or linked(pairs, sets))
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shingles = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    want = list(range(400))
    for a, b in itertools.combinations(range(400), 2):
        common = len(shingles[a] & shingles[b])
        if 100 * common >= 80 * (len(shingles[a]) + len(shingles[b]) - common) and want[a] != want[b]:
            low, high = sorted((want[a], want[b]))
            want = [low if x == high else x for x in want]
    assert got == dict(enumerate(want)) and sum(verified) < 400 * 12
