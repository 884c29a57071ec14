"""Trained operators on held-out rows, URL rules, preferences and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from patchloom.llm import preference, quality_cotrain, queries, toxicity, url_filter

SF = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    p, n = (label == 1).sum(), (label == 0).sum()
    return (rank[label == 1].sum() - p * (p + 1) / 2) / (p * n)


def scored(spark, df, column):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return df.join(labels, "doc_id").select("score", F.col(column).alias("y"), *[c for c in ("held_out",) if c in df.columns]).toPandas()


def test_toxicity_on_held_out(spark):
    t = scored(spark, queries.op7_score_toxicity(spark, SF), "toxic")
    h = t[t.held_out]
    assert auc(h.score.values, h.y.values) > 0.75


def test_kernel_against_definition():
    def plain(a, b):
        total = 0.0
        for i in np.ndindex(*[len(a)] * 3):
            if i[0] < i[1] < i[2]:
                for j in np.ndindex(*[len(b)] * 3):
                    if j[0] < j[1] < j[2] and all(a[x] == b[y] for x, y in zip(i, j)):
                        total += toxicity.DECAY ** (i[2] - i[0] + 1 + j[2] - j[0] + 1)
        return total
    pairs = [("idiot", "idxiot"), ("clown", "low"), ("stupid", "stupid"), ("abc", "xyz"), ("ab", "abc")]
    got = toxicity._raw_kernel(toxicity._codes([a for a, _ in pairs])[0], toxicity._codes([b for _, b in pairs])[0])
    assert np.allclose(got, [plain(a, b) for a, b in pairs], rtol=1e-4)


def test_gapped_insults_stay_close():
    k = toxicity.Kernel(["stupid"], 1)
    values = k.of(["stupid", "stuxpid", "stupids", "thndtion"])[:, 0]
    assert values[0] > 0.99 and values[1] > toxicity.CLOSE and values[2] > toxicity.CLOSE and values[3] < 0.2
    assert toxicity.normal("st*u.pid!") == "stupid" and ["idiot"] in toxicity.sentence_words("you. i d i o t .")


def test_long_words_count_to_their_end():
    scorer = toxicity.Scorer(["stupid"], 1)
    long = "anderenwortenbehrenhaarfeln" * 30
    plain, last, spaced = scorer.sentences([long, long + "stupid", " ".join(long) + " s t u p i d"])
    assert not plain and last[0][0] >= toxicity.CLOSE and spaced[0][0] >= toxicity.CLOSE
    word = "".join(map(chr, range(0x4E00, 0x4E00 + 77)))
    parts = toxicity.pieces(word)
    assert all(word[i : i + 9] in "|".join(parts) for i in range(69)) and max(map(len, parts)) <= toxicity.MAX_LETTERS
    assert toxicity._codes(["a" * 33])[0].all()


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "")], "doc_id long, text string")
    got = toxicity.score_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert sorted(r.score for r in got) == [0.0] * 3


def test_quality(spark):
    t = scored(spark, queries.op9_score_quality(spark, SF), "quality")
    assert auc(t.score.values, t.y.values) > 0.95


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", None, "s", None, 3.0), (2, None, "en", None, 3, 1.0)], "doc_id long, text string, lang string, source string, n_chars long, score double")
    assert {r.score for r in quality_cotrain.score_quality(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()} == {0.5}


def plain_rule(host, path, rules):
    best = (None, None)
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        own, slash, rest = text.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith(slash + rest):
            best = text, what
    return best


def test_urls(spark):
    urls = [None, "", "no scheme", "http://Example.ORG", "http://EXAMPLE.org/es/1?x", "https://a.example.org/en/12#f", "http://x.com/fr/", "http://xcom/fr/", "http://y.com/de/a", "http://casinowin.net/en", "http://a.b?c/d", "http://q.org/a://b/c"]
    pages = spark.createDataFrame([(i, u, None if i % 2 else "<p>casino win and the page</p>", "h") for i, u in enumerate(urls)] + [(4, urls[4], "", "h")], "page_id long, url string, html string, host string")
    got = url_filter.judge_urls(pages, queries.URL_RULES).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        u = urls[r.page_id] or ""
        rest = u[u.index("://") + 3 :] if "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        assert (r.host, r.path) == (host, path)
        rule, verdict = plain_rule(host, path, queries.URL_RULES)
        assert r.rule == rule and (verdict is None or r.verdict == verdict)
    assert next(r for r in got if r.page_id == 9).host_words[:2] == ["casino", "win"]
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string, html string"), queries.URL_RULES).collect() == []


def test_preferences(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "why"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 1, "assistant", "no"),
            (3, 0, "user", "other"), (3, 1, "assistant", "fine"), (4, 0, None, None), (None, 0, "user", "x"), (5, None, "user", "x")]
    got = preference.preferences_of(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")).collect()
    text = {}
    for r in sorted(got, key=lambda r: (r.pair_id, r.part, r.turn)):
        assert r.start == len(text.get((r.pair_id, r.part), ""))
        text[r.pair_id, r.part] = text.get((r.pair_id, r.part), "") + r.rendered
    say = lambda role, x: f"<|{role}|>\n{x}\n"
    assert text == {(1, "prompt"): say("user", "hi"), (1, "chosen"): say("assistant", "yes") + say("user", "why"), (1, "rejected"): say("assistant", "no"),
                    (3, "prompt"): say("user", "other"), (3, "chosen"): say("assistant", "fine"), (3, "rejected"): say("assistant", "other")}
    assert {(r.part, r.role, r.loss_mask) for r in got} == {("prompt", "user", 0), ("chosen", "assistant", 1), ("chosen", "user", 0), ("rejected", "assistant", 1)}
    assert preference.preferences_of(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_preferences_hold_every_conversation(spark, tmp_path):
    """Conversations without an answer come out as prompts; a sibling pair stands for both of its conversations."""
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (3, 0, "system", "be brief"), (3, 1, "user", "why"),
            (4, 0, "assistant", "welcome"), (4, 1, "user", "thanks"), (5, 2, None, None), (6, None, "user", "x"), (7, 0, "user", "a"), (7, 1, "assistant", "b")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op5_preferences(spark, str(tmp_path)).collect()
    assert {r.pair_id for r in got} == {1, 3, 4, 5, 7}
    lone = sorted((r.pair_id, r.part, r.turn, r.role, r.start, r.loss_mask) for r in got if r.pair_id in (3, 4, 5))
    assert lone == [(3, "prompt", 0, "system", 0, 0), (3, "prompt", 1, "user", 20, 0), (4, "prompt", 0, "assistant", 0, 0), (4, "prompt", 1, "user", 22, 0), (5, "prompt", 2, "user", 0, 0)]


def test_pipeline(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.staged(stage(spark, docs, small), name)
        assert docs.columns == before.columns and {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_pipeline_stage_with_odd_rows(spark, stage):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x y", "en", "s", 3), (3, "a b", "en", "s", 3), (3, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    stage[1](spark, docs, "/root/testdata/sf0.001").collect()


def test_pipeline_keeps_one_of_repeated_rows(spark):
    """Rows repeated whole, and texts that share a doc_id, through the stages that drop copies and repeats."""
    rng = np.random.default_rng(4)
    text = lambda: " ".join(str(x) for x in rng.integers(10**6, 10**7, 60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a, "s"), (1, a, "s"), (2, b, "s"), (2, b, "t"), (3, c, "s"), (7, c, "s"), (7, d, "s"), (8, e, "s"), (8, "short", "s")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    one = corpus_pipeline.staged(corpus_pipeline.one_of_each_class(spark, docs, SF), "one")
    assert sorted(r.text for r in one.collect()) == sorted([a, b, c, d, e, "short"])
    assert {(r.doc_id, r.source) for r in one.collect() if r.text in (a, b)} == {(1, "s"), (2, "s")}
    left = corpus_pipeline.without_repeats(spark, one, SF)
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, one.collect())) and left.columns == docs.columns
