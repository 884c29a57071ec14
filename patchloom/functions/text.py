"""Column expressions for diff text.

All of these are built-in Spark SQL expressions (JVM regex), so they stay in
whole-stage codegen; nothing here calls back into Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: diff syntax recognised by the reference tool -------------
# A file section starts at a line matching  ^diff --git a/(.*) b/(.*)$
# Hunk header:                               ^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@
# Index line:                                ^index [a-f0-9]+\.\.[a-f0-9]+
# Mode line:                                 ^(new|deleted) file mode
# Binary line:                               ^Binary files .* differ$
# Substrings that mark a generated file (tested on the lower-cased path):
GENERATED_MARKERS = (
    ".lock", ".min.js", ".min.css", ".map", "package-lock.json", "yarn.lock",
    "Pipfile.lock", ".pyc", ".pyo", "__pycache__", "node_modules/", "dist/",
    "build/", ".git/", ".DS_Store", "Thumbs.db",
)
# ----------------------------------------------------------------------------

# Java-regex forms. Lines never contain '\n' here; (?s) and \z keep Java's '.'
# and '$' from stopping at U+0085 / U+2028 (Python's '.' only stops at '\n').
HEADER_RE = r"(?s)^diff --git a/(.*) b/(.*)\z"
HUNK_RE = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
INDEX_RE = r"^index [a-f0-9]+\.\.[a-f0-9]+"
MODE_RE = r"^(new|deleted) file mode"
BINARY_RE = r"(?s)^Binary files .* differ\z"

# Python's str.strip() removes Unicode whitespace plus \x1c-\x1f; a line is
# "nonblank" when it holds any other character.
NONBLANK_CHAR = r"[^\s\x1c-\x1f]"
NONBLANK_RE = r"(?U)" + NONBLANK_CHAR

# Multi-line forms used on whole section texts ('\n' is the only terminator).
_NONBLANK_LINE_ML = r"(?mdU)^[^\n]*?" + NONBLANK_CHAR
# an added/removed line ('+'/'-' but not '+++'/'---') with nonblank text after the sign
_MEANINGFUL_EDIT_ML = r"(?mdU)^(?:\+(?!\+\+)|-(?!--))[^\n]*?" + NONBLANK_CHAR
# zero-width split point in front of the first hunk header line
_BEFORE_HUNK_ML = r"(?md)^(?=@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@)"
# a '\n' that ends the line before a section header
_SECTION_SPLIT = r"\n(?=diff --git a/[^\n]* b/)"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalized_text(content) -> Column:
    """Universal newlines: drop one final terminator, then map CRLF / CR to LF."""
    c = col_(content)
    return F.regexp_replace(F.regexp_replace(c, r"(?:\r\n|\r|\n)\z", ""), r"\r\n|\r", "\n")


def split_lines(text) -> Column:
    """Lines of an already normalised text (keeps empty lines)."""
    return F.split(col_(text), "\n", -1)


def split_sections(text) -> Column:
    """Element 0: '' or '\\n' + preamble; elements 1..: one text per file section."""
    return F.split(F.concat(F.lit("\n"), col_(text)), _SECTION_SPLIT, -1)


def is_nonblank(line) -> Column:
    return col_(line).rlike(NONBLANK_RE)


def count_nonblank_lines(text) -> Column:
    return F.regexp_count(col_(text), F.lit(_NONBLANK_LINE_ML)).cast("bigint")


def count_lines(text) -> Column:
    t = col_(text)
    return (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def has_meaningful_edit(text) -> Column:
    return col_(text).rlike(_MEANINGFUL_EDIT_ML)


def header_block_len(text) -> Column:
    """Number of lines before the first hunk header (blank ones too); NULL without a hunk."""
    parts = F.split(col_(text), _BEFORE_HUNK_ML, 2)
    head = F.element_at(parts, 1)
    n = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
    return F.when(F.size(parts) == 2, n.cast("int"))


def is_header(line) -> Column:
    return col_(line).rlike(HEADER_RE)


def is_hunk(line) -> Column:
    return col_(line).rlike(HUNK_RE)


def header_paths(first_line) -> tuple[Column, Column]:
    fl = col_(first_line)
    return F.regexp_extract(fl, HEADER_RE, 1), F.regexp_extract(fl, HEADER_RE, 2)


def files_of(path_a, path_b) -> Column:
    a, b = col_(path_a), col_(path_b)
    return F.when(a == b, F.array(a)).otherwise(F.array(a, b))


def is_generated_path(path) -> Column:
    """The lower-cased path contains one of GENERATED_MARKERS (plain substrings)."""
    low = F.lower(col_(path))
    cond = F.lit(False)
    for m in GENERATED_MARKERS:
        cond = cond | F.contains(low, F.lit(m))
    return cond


def is_generated(path_a, path_b) -> Column:
    """C2 on a section's one or two paths (plain codegen'd expressions, no lambda)."""
    return is_generated_path(path_a) | is_generated_path(path_b)


def line_kind(line) -> Column:
    """Classify one diff line (first matching rule wins)."""
    l = col_(line)
    return (
        F.when(l.rlike(HEADER_RE), "header")
        .when(l.rlike(INDEX_RE), "index")
        .when(l.rlike(MODE_RE), "mode")
        .when(l.rlike(BINARY_RE), "binary")
        .when(l.rlike(HUNK_RE), "hunk")
        .when(l.startswith("+++") | l.startswith("---"), "meta")
        .when(l.startswith("+"), "add")
        .when(l.startswith("-"), "del")
        .when(l.startswith(" "), "context")
        .when(l == "", "empty")
        .otherwise("other")
    )


def decode_utf8(binary) -> Column:
    """UTF-8 decode with U+FFFD replacement (never throws on bad bytes)."""
    return F.make_valid_utf8(col_(binary).cast("string"))
