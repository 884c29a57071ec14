"""Judge URLs: hand-made rules first, else a naive Bayes score of the words in host and path.

Host names run words together. Each distinct host label is split by a unigram
Viterbi search: its substrings are joined with the corpus' word counts (all
pages' texts and hyphenated host parts), and the split of the highest
probability wins; substrings that are no word cost much for each letter. The
multinomial model is fitted on all distinct hosts and path shapes, with labels
from seed words: a host with a segment among the seeds is to be blocked.
Everything is keyed by distinct label, host or path shape, so a host with a third of the
pages is scored once; no model is broadcast.

Defined results: a null url, or one without ``://``, has empty host and path
and is allowed unless a rule says otherwise; repeated rows are judged alike;
null html adds no words; other columns are not read.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import ascii_lower, staged

#: Words that mark hosts to be blocked.
SEEDS = (
    "adult", "bet", "bets", "betting", "cams", "casino", "dating", "escort", "gambling", "jackpot", "lottery", "nude",
    "payday", "pills", "poker", "porn", "sex", "slots", "spam", "torrent", "viagra", "warez", "xxx",
)
MAX_WORD = 24
SEED_COUNT = 50
SMOOTHING = 0.5

Rule = tuple[str, str]


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return ascii_lower(F.coalesce(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls. A rule is host + path; its host holds for subdomains too."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _segment(batches):
    """Best split of each label (label, words: array of (w, p)) under a unigram model."""
    for b in batches:
        labels, words = b.column(0).to_pylist(), b.column(1).to_pylist()
        out = []
        for label, known in zip(labels, words, strict=True):
            cost = {k["w"]: -k["p"] for k in known or []}
            best, back = [0.0], [0]
            for j in range(1, len(label) + 1):
                options = [(best[i] + cost.get(label[i:j], 12.0 + 8.0 * (j - i)), i) for i in range(max(0, j - MAX_WORD), j)]
                c, i = min(options)
                best.append(c)
                back.append(i)
            parts, j = [], len(label)
            while j:
                parts.append(label[back[j] : j])
                j = back[j]
            out.append(parts[::-1])
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(out, pa.list_(pa.string()))], ["label", "parts"])


def word_counts(pages: DataFrame, hosts: DataFrame, url: str, html: str) -> DataFrame:
    """(w, c): words of all pages' texts and of hyphenated host labels, and the seeds."""
    text = F.lower(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>|&\w+;", " "))
    words = pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("w"))
    parts = hosts.select(F.explode(F.split("host", r"\.")).alias("label")).filter("label like '%-%'").select(F.explode(F.split("label", "-")).alias("w"))
    seeds = pages.sparkSession.createDataFrame([(s,) for s in SEEDS], "w string").withColumn("c", F.lit(SEED_COUNT).cast("long"))
    real = words.unionAll(parts).filter(f"length(w) between 1 and {MAX_WORD}").groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    return real.unionAll(seeds).groupBy("w").agg(F.sum("c").alias("c"))


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, host_words, block_probability), a row for each row of ``pages``."""
    u = F.col(url).cast("string")
    shape = F.regexp_replace(F.lower(F.col("path")), "[0-9]+", "0")
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path")).withColumn("shape", shape)
    hosts = staged(base.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts")
    shapes = staged(base.groupBy("shape").agg(F.count(F.lit(1)).alias("pages")), "shapes")

    # segmentation of the distinct labels
    counts = staged(word_counts(pages, hosts, url, html), "word_counts")
    total = counts.agg(F.sum("c")).first()[0] or 1
    labels = hosts.select("host", F.posexplode(F.split("host", r"[.\-]")).alias("pos", "label"))
    unique = labels.select("label").distinct().filter("label <> ''")
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("label")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(MAX_WORD), F.length("label") - i + 1)), lambda n: F.substring("label", i, n))))
    known = unique.select("label", F.explode(F.array_distinct(cuts)).alias("w")).join(counts, "w")
    # short words need to be frequent to be words at all
    known = known.withColumn("p", F.log(F.col("c") / F.lit(float(total)))).groupBy("label").agg(F.collect_list(F.struct("w", "p")).alias("words"))
    parts = unique.join(known, "label", "left").select("label", "words").mapInArrow(_segment, "label string, parts array<string>")
    host_words = staged(labels.join(parts, "label").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "parts"))), lambda x: x["parts"])).alias("words")), "host_words")

    # naive Bayes over hosts' words; path words count for the hosts that have the path
    marked = host_words.withColumn("block", F.arrays_overlap("words", F.array(*[F.lit(s) for s in SEEDS])))
    pairs = base.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("c")).join(marked.select("host", "block"), "host")
    path_words = F.filter(F.split("shape", r"[^\p{L}\p{N}]+"), lambda x: x != "")
    seen = marked.select("block", F.explode("words").alias("w"), F.lit(1).cast("long").alias("c")).unionAll(
        pairs.groupBy("shape", "block").agg(F.count(F.lit(1)).alias("c")).select("block", F.explode(F.transform(path_words, lambda x: F.concat(F.lit("/"), x))).alias("w"), "c")
    )
    by_word = staged(seen.groupBy("w").agg(F.sum(F.when(F.col("block"), F.col("c")).otherwise(0)).alias("bad"), F.sum(F.when(~F.col("block"), F.col("c")).otherwise(0)).alias("good")), "class_counts")
    sums = by_word.agg(F.sum("bad"), F.sum("good"), F.count(F.lit(1))).first()
    bad, good, kinds = (float(x or 0) for x in sums)
    n = marked.agg(F.count(F.when(F.col("block"), 1)), F.count(F.lit(1))).first()
    prior = math.log((n[0] + 1) / (n[1] - n[0] + 1))
    weight = by_word.select("w", (F.log((F.col("bad") + SMOOTHING) / (bad + SMOOTHING * kinds + 1)) - F.log((F.col("good") + SMOOTHING) / (good + SMOOTHING * kinds + 1))).alias("weight"))
    host_score = host_words.select("host", "words", F.explode_outer("words").alias("w")).join(weight, "w", "left").groupBy("host").agg(F.first("words").alias("host_words"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("hs"))
    path_score = shapes.select("shape", F.explode_outer(path_words).alias("x")).select("shape", F.concat(F.lit("/"), "x").alias("w")).join(weight, "w", "left").groupBy("shape").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("ps"))

    rule, said = matched_rule(F.col("host"), F.col("path"), rules)
    odds = F.lit(prior) + F.coalesce("hs", F.lit(0.0)) + F.coalesce("ps", F.lit(0.0))
    judged = base.join(host_score, "host", "left").join(path_score, "shape", "left").withColumn("block_probability", F.when(F.col("host") == "", 0.0).otherwise(1 / (1 + F.exp(-F.greatest(F.lit(-500.0), odds)))))
    method = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, method).alias("verdict"), "host_words", "block_probability")
