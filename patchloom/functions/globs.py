"""Shell-style globs (``fnmatch`` semantics) as anchored Java regular expressions.

Translation happens once on the driver; the executors only run ``rlike``.
Semantics: ``*`` matches any run of characters including '/', ``?`` one
character, ``[seq]`` / ``[!seq]`` a character class, everything else is
literal (braces too), case-sensitive, and the whole string must match.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _class_body(body: str) -> str | None:
    """Java character-class body for an fnmatch class body; None if it can match nothing."""
    negate = body.startswith("!")
    if negate:
        body = body[1:]
    items: list[str] = []
    i = 0
    while i < len(body):
        ch = body[i]
        if i + 2 < len(body) and body[i + 1] == "-":
            lo, hi = ch, body[i + 2]
            if lo <= hi:
                items.append(_lit(lo) + "-" + _lit(hi))
            i += 3
            continue
        items.append(_lit(ch))
        i += 1
    if not items:
        return "." if negate else None
    inner = "".join(items)
    return ("[^" if negate else "[") + inner + "]"


def _lit(ch: str) -> str:
    return ch if ch.isalnum() and ch.isascii() else "\\" + ch if ch.isascii() else re.escape(ch)


def glob_to_regex(pattern: str) -> str:
    out: list[str] = []
    i, n = 0, len(pattern)
    while i < n:
        ch = pattern[i]
        if ch == "*":
            while i < n and pattern[i] == "*":
                i += 1
            out.append(".*")
            continue
        if ch == "?":
            out.append(".")
        elif ch == "[":
            j = i + 1
            if j < n and pattern[j] == "!":
                j += 1
            if j < n and pattern[j] == "]":
                j += 1
            while j < n and pattern[j] != "]":
                j += 1
            if j >= n:
                out.append("\\[")
            else:
                cls = _class_body(pattern[i + 1:j])
                out.append(cls if cls is not None else "(?!)")
                i = j
        else:
            out.append(re.escape(ch) if not ch.isalnum() else ch)
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def literal_prefix(pattern: str) -> str:
    """Leading characters that every match must start with (used for pushdown)."""
    out = []
    for ch in pattern:
        if ch in "*?[":
            break
        out.append(ch)
    return "".join(out)


def literal_runs(pattern: str) -> list[str]:
    """The runs of literal characters between wildcards, in order; the last is empty if the pattern ends in a wildcard."""
    runs, i, n = [""], 0, len(pattern)
    while i < n:
        ch = pattern[i]
        if ch == "[":
            j = i + 1 + pattern[i + 1:].startswith("!")
            end = pattern.find("]", j + 1)  # a bracket right behind the opening one is a member
            if end >= 0:
                runs.append("")
                i = end + 1
                continue
        if ch in "*?":
            runs.append("")
        else:
            runs[-1] += ch
        i += 1
    return runs


#: Longest prefix or suffix, and longest inner run, that serve as a key.
EDGE_KEY, INNER_KEY = 16, 3


def literal_key(pattern: str) -> tuple[str, str]:
    """(kind, key): text that every match has, at its start ('p'), end ('s') or anywhere ('g'); ('n', '') if there is none."""
    runs = literal_runs(pattern)
    options = [(len(runs[0][:EDGE_KEY]), "p", runs[0][:EDGE_KEY]), (len(runs[-1][-EDGE_KEY:]), "s", runs[-1][-EDGE_KEY:])]
    options += [(len(r[:INNER_KEY]), "g", r[:INNER_KEY]) for r in runs]
    size, kind, key = max(options, key=lambda o: o[0])  # of equal ones the first
    return (kind, key) if size else ("n", "")


def glob_match(col, pattern: str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    cond = c.rlike(glob_to_regex(pattern))
    prefix = literal_prefix(pattern)
    if prefix:
        cond = c.startswith(prefix) & cond
    return cond


def any_glob(col, patterns) -> Column:
    cond = F.lit(False)
    for p in patterns:
        cond = cond | glob_match(col, p)
    return cond
