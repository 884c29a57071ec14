"""Line-first cleaning: judge every line, drop the failing ones, then judge the document.

Only DataFrame expressions (JVM): one projection over the scan, no shuffle, no
Python. Each line of a text is held against four rules:

* navigation: three or more separators (``|``, ``»``, ``›``, ``•``), at least one for every three words;
* punctuation: runs of symbols or of exclamation marks on a quarter of the line's words, or
  at most 20 characters without a closing mark (a stray label);
* boilerplate: a line of at most 100 characters with a cookie, login, sharing, or
  legal-footer phrase; or, in a text half of whose words are repeats, a line of twelve words
  or more with one word three times in a row and two thirds of its words repeats;
* repeats: a line equal to an earlier line of the same text.

The lines left make ``clean_text``. A document is rejected when it loses more
than 30 % of its word characters, has too few words, or repeats its own
8-word windows too much.

Defined results: a null or empty text has no words and is rejected
(``base_failed``); blank lines are never judged, and vanish only if the text
loses some other line; repeated rows are judged alike; input columns are kept
except those with the name of an output, which are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import SPACE

SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
MAX_LOSS_PCT = 30
#: Phrases of site furniture.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript", "follow us",
    "forgot password", "javascript is disabled", "log in", "lorem ipsum", "privacy policy", "read more", "share on", "share this",
    "sign in", "sign up", "skip to content", "subscribe now", "terms of service", "terms of use", "uses cookies",
)
BOILERPLATE_MAX_CHARS = 100
STRAY_MAX_CHARS = 20
STUTTER_WORDS = 12
STUTTER = r"(?:^|[ \t-\r])([^ \t-\r]++)[ \t-\r]++\1[ \t-\r]++\1(?:[ \t-\r]|$)"
CLOSING = r"[.!?:;…。»\"'”’)\]]$"

# Patterns run on few lines only: a JVM that has compiled many patterns matches each several
# times slower, so the whole texts are read with plain searches (contains, replace, split).


def _n(c: Column) -> Column:
    return c.cast("long")


def _trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    for c in SPACE[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.filter(F.split(text, " ", -1), lambda w: w != "")


def _any_of(c: Column, chars: str) -> Column:
    return reduce(or_, [c.contains(x) for x in chars])


def _symbols(c: Column, chars: str) -> Column:
    """How many characters of ``c`` are among the ASCII ``chars``."""
    return reduce(add, [F.octet_length(c) - F.octet_length(F.replace(c, F.lit(x), F.lit(""))) for x in chars])


def _count(c: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1)))


def short_line_fails(line: Column) -> Column:
    """The rules for short lines: stray labels and site furniture."""
    stray = F.when(F.length(line) <= STRAY_MAX_CHARS, ~_trimmed(line).rlike(CLOSING)).otherwise(False)
    low = F.lower(line)
    furniture = F.when(F.length(line) <= BOILERPLATE_MAX_CHARS, reduce(or_, [low.contains(x) for x in BOILERPLATE])).otherwise(False)
    return stray | furniture


def marked_line_fails(line: Column) -> Column:
    """The navigation and punctuation rules, for texts with such marks."""
    n = F.size(words_of(line))
    separators = reduce(add, [F.length(line) - F.length(F.replace(line, F.lit(x), F.lit(""))) for x in SEPARATORS])
    noisy = F.when(line.rlike("[#*$%&<>!]{2}"), _count(line, "[#*$%&<>!]{2,}") * 4 >= n).otherwise(False)
    return ((separators >= 3) & (separators * 3 >= n)) | noisy


def stutters(line: Column) -> Column:
    """The repeated-word rule, for texts half of whose words are repeats."""
    words = words_of(line)
    return F.when(line.rlike(STUTTER), (F.size(words) >= STUTTER_WORDS) & (F.size(F.array_distinct(words)) * 3 <= F.size(words))).otherwise(False)


def _hashed_pairs(a: str, step: int, size: Column) -> Column:
    return F.zip_with(F.slice(a, 1, size), F.slice(a, F.lit(1 + step), size), lambda x, y: F.xxhash64(x, y))


def _windows(words: Column) -> Column:
    """All 8-word windows as strings. Single elements are fetched: a slice copies the whole array."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(WINDOW)]))


def _repeated_starts(placed: Column) -> Column:
    """Starts, in order, of the windows that have an equal neighbour in the sorted ``placed``."""
    twice = F.filter(placed, lambda e, j: ((j > 0) & (F.get(placed, j - 1)["g"] == e["g"])) | F.coalesce(F.get(placed, j + 1)["g"] == e["g"], F.lit(False)))
    return F.sort_array(F.transform(twice, lambda e: e["i"]))


def _covered(starts: Column) -> Column:
    """Words covered by 8-word windows at sorted ``starts``."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(starts, zero, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")))["n"]


#: Names of columns on the way.
INTERNAL = ("_words", "_lines", "_uniq", "_h2", "_h4", "_h", "_good", "_placed")


def clean_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed,
    n_failed_lines, kept_chars (long), kept (boolean) and clean_text (string)."""
    clash = {c: f"__own_{k}" for k, c in enumerate(docs.columns) if c.lower() in INTERNAL}
    if clash:  # such columns come through under other names
        cleaned = clean_lines(docs.withColumnsRenamed(clash), clash.get(text, text))
        return cleaned.withColumnsRenamed({v: k for k, v in clash.items()})
    outputs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_failed_lines", "kept_chars", "kept", "clean_text")
    low = {o.lower() for o in outputs}
    source = docs.select(*[c for c in docs.columns if c.lower() not in low or c == text])
    t = F.coalesce(F.col(text), F.lit(""))
    one = source.withColumn("_words", words_of(t)).withColumn("_lines", F.filter(F.split(t, "\n", -1), lambda x: _trimmed(x) != ""))
    two = one.withColumn("n_words", _n(F.size("_words"))).withColumn("_uniq", F.array_distinct("_lines"))
    # windows by hash first: without equal hashes there are no equal windows
    n = F.size("_words")
    long_enough = F.col("n_words") > WINDOW
    # one column for each step: inside one expression an array used twice is built twice
    hashed = two.withColumn("_h2", F.when(long_enough, _hashed_pairs("_words", 1, n - 1)))
    hashed = hashed.withColumn("_h4", F.when(long_enough, _hashed_pairs("_h2", 2, n - 3)))
    hashed = hashed.withColumn("_h", F.when(long_enough, _hashed_pairs("_h4", 4, n - 7))).drop("_h2", "_h4")
    three = hashed.withColumn("_good", F.filter("_uniq", lambda x: ~short_line_fails(x)))
    three = three.withColumn("_good", F.when(_any_of(t, SEPARATORS + "#*$%&<>!"), F.filter("_good", lambda x: ~marked_line_fails(x))).otherwise(F.col("_good")))
    repetitive = F.size(F.array_distinct("_words")) * 2 <= F.col("n_words")
    three = three.withColumn("_good", F.when(repetitive, F.filter("_good", lambda x: ~stutters(x))).otherwise(F.col("_good")))
    placed = F.sort_array(F.transform(_windows(F.col("_words")), lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    three = three.withColumn("_placed", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), placed))
    four = (
        three.withColumn("word_chars", _n(F.length(F.array_join("_words", ""))))
        .withColumn("n_symbols", _n(_symbols(t, SYMBOLS)))
        .withColumn("n_dup_lines", _n(F.size("_lines") - F.size("_uniq")))
        .withColumn("n_repeat_words", _n(F.coalesce(_covered(_repeated_starts(F.col("_placed"))), F.lit(0))))
        .withColumn("n_failed_lines", _n(F.size("_lines") - F.size("_good")))
        .withColumn("clean_text", F.when(F.size("_good") == F.size("_lines"), F.col(text)).otherwise(F.array_join("_good", "\n")))
    )
    five = four.withColumn("kept_chars", F.when(F.col("n_failed_lines") == 0, F.col("word_chars")).otherwise(_n(F.length(F.array_join(words_of(F.col("clean_text")), "")))))
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PCT)
    lost = (F.col("word_chars") - F.col("kept_chars")) * 100 > F.col("word_chars") * MAX_LOSS_PCT
    done = five.withColumn("base_failed", base).withColumn("kept", ~base & ~lost)
    # a generator ends the projections: a later filter on an output isn't pushed below it, into every step
    rest = [c for c in source.columns if c.lower() not in low]
    return done.select(*rest, F.inline_outer(F.array(F.struct(*outputs))))
