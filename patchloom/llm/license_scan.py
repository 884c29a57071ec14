"""Find license notices in texts, spelled exactly or with a few errors.

Texts are folded to lower-case words joined by single spaces. Base phrases are
found as consecutive words. For each longer notice with k allowed errors, the
pigeonhole principle splits it into k + 1 parts, one of which stands
unchanged in any text within k errors; one automaton finds all parts of all
notices, and around each hit a count of shared trigrams (k errors break 3k at
most) and then the ``regex`` library's bounded-error matching decide; the
latter counts the errors and gives the span.

One map over the scan, whole texts, no shuffle. Defined results: a null or
empty text has no words, labels "" and score 0; repeated rows are scanned
alike; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.wordbytes import folded_words

#: Phrases that count as places, with their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices searched with errors, with their labels.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("licensed under the gnu general public license version", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("mozilla public license version 2 0", "mpl"),
    ("eclipse public license version", "epl"),
    ("creative commons attribution", "cc-by"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("do what the fuck you want to public license", "wtfpl"),
)
#: Share of a notice's characters that may be inserted, left out or replaced.
ERROR_RATE = 0.1

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
    " matches array<struct<label:string, first_word:long, last_word:long, errors:int>>"
)


class Scanner:
    """Base phrases and fuzzy notices in one folded text."""

    def __init__(self, base: dict[str, str], notices, error_rate: float):
        self.base = [(f" {p} ".encode(), label) for p, label in base.items()]
        self.notices = []
        self.seeds = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for i, (notice, label) in enumerate(notices):
            k = max(1, int(len(notice) * error_rate))
            grams = {notice[j : j + 3] for j in range(len(notice) - 2)}
            self.notices.append((len(notice), k, grams, label, regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}")))
            bounds = [len(notice) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(bounds, bounds[1:]):
                at.setdefault(notice[a:b], []).append((i, a))
        for part, places in at.items():
            self.seeds.add_word(part, (len(part), places))
        self.seeds.make_automaton()

    def places(self, folded: bytes) -> tuple[list[int], set[str]]:
        """Word numbers where base phrases start, and their labels. ``folded`` has a space at both ends."""
        found, labels = [], set()
        for phrase, label in self.base:
            i = folded.find(phrase)
            while i >= 0:
                found.append(folded.count(b" ", 0, i + 1) - 1)
                labels.add(label)
                i = folded.find(phrase, i + 1)
        return found, labels

    def fuzzy(self, folded: str) -> list[tuple[str, int, int, int]]:
        """(label, first word, last word, errors) of the notices within their errors."""
        windows: dict[int, list[list[int]]] = {}
        for end, (n, places) in self.seeds.iter(folded):
            for i, offset in places:
                length, k = self.notices[i][:2]
                start = end - n + 1 - offset
                a, b = max(0, start - k), min(len(folded), start + length + k)
                own = windows.setdefault(i, [])
                if own and a <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], b)
                else:
                    own.append([a, b])
        out = []
        for i, spans in windows.items():
            length, k, grams, label, pattern = self.notices[i]
            for a, b in spans:
                if sum(folded[j : j + 3] in grams for j in range(a, b - 2)) < length - 2 - 3 * k:
                    continue
                for m in pattern.finditer(folded, a, b):
                    last = m.start() + len(m.group().rstrip())
                    out.append((label, folded.count(" ", 0, m.start() + 1) - 1, folded.count(" ", 0, last) - 1, sum(m.fuzzy_counts), length))
        return out


def scan_licenses(docs: DataFrame, base: dict[str, str] | None = None, notices=NOTICES, error_rate: float = ERROR_RATE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``SCHEMA``, a row for each row of ``docs``. score: 1 with a base phrase, else the best notice's share of right characters, else 0."""
    base = BASE if base is None else base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices, error_rate)
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int32())]))]
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = folded_words(t)
                folded = b" " + b" ".join(words) + b" "
                places, base_labels = scanner.places(folded)
                close = scanner.fuzzy(folded.decode("latin-1"))
                labels = base_labels | {m[0] for m in close}
                score = 1.0 if places else max((1 - m[3] / m[4] for m in close), default=0.0)
                rows.append((d, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, [dict(zip(("label", "first_word", "last_word", "errors"), m[:4], strict=True)) for m in close]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)
