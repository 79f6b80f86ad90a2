"""Licence notices by exact phrases and by fuzzy search for short notices.

A notice with up to k edits, cut into k + 1 parts, still has one part unchanged
(pigeonhole), so places of exact parts are the only candidates. A match is made
of whole words: around each candidate, windows that begin and end with a word
within k characters of where the notice would are tested by the ``regex``
library's bounded-error matching, which gives the least edits and the span.

Edits may not swallow the words that tell notices apart: every word of a notice
but function words has to be there within a third of its letters. Of matches of
different labels one inside another, only the better one counts. Texts are
compared as words joined by blanks, so line breaks, punctuation and case don't
matter.
"""

from __future__ import annotations

from bisect import bisect
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import small_batches, words_of

# Phrases and the labels they stand for.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Short notices, labels and the edits (inserted, deleted or changed characters) that are allowed.
NOTICES = (
    ("gnu general public license", "gpl", 3),
    ("this program is free software you can redistribute it and or modify it", "gpl", 6),
    ("spdx license identifier gpl", "gpl", 1),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu library general public license", "lgpl", 3),
    ("spdx license identifier lgpl", "lgpl", 1),
    ("gnu affero general public license", "agpl", 3),
    ("spdx license identifier agpl", "agpl", 1),
    ("gnu free documentation license", "gfdl", 3),
    ("apache license version 2 0", "apache", 3),
    ("spdx license identifier apache 2 0", "apache", 1),
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("spdx license identifier mit", "mit", 1),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("spdx license identifier bsd", "bsd", 1),
    ("mozilla public license", "mpl", 2),
    ("spdx license identifier mpl", "mpl", 1),
    ("eclipse public license", "epl", 2),
    ("eclipse distribution license", "edl", 2),
    ("european union public licence", "eupl", 3),
    ("common development and distribution license", "cddl", 4),
    ("common public license", "cpl", 2),
    ("boost software license", "bsl-1.0", 2),
    ("business source license", "busl", 2),
    ("server side public license", "sspl", 2),
    ("elastic license 2 0", "elastic", 2),
    ("polyform noncommercial license", "polyform", 3),
    ("artistic license", "artistic", 1),
    ("academic free license", "afl", 2),
    ("open software license", "osl", 2),
    ("microsoft public license", "ms-pl", 2),
    ("python software foundation license", "psf", 3),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable", "zlib", 8),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 6),
    ("do what the fuck you want to public license", "wtfpl", 4),
    ("this is free and unencumbered software released into the public domain", "unlicense", 6),
    ("the postgresql license", "postgresql", 2),
    ("university of illinois ncsa open source license", "ncsa", 4),
    ("sil open font license", "ofl", 2),
    ("open database license", "odbl", 2),
    ("licensed under cc by", "cc-by", 2),
    ("creative commons attribution", "cc-by", 3),
    ("creative commons zero", "cc0", 2),
    ("all rights reserved", "all-rights-reserved", 2),
)

# Words that a notice may lack or change within its edits.
FUNCTION_WORDS = frozenset("a an and any as be by can for from hereby in into is it no of or that the this to will with without you 0 2".split())


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int
    telling: tuple[bytes, ...]  # words that have to be there
    seeds: tuple[tuple[bytes, int], ...]  # parts and their offsets
    pattern: object


class Notices(list):
    """Notices and one automaton that finds all their parts in one pass."""

    def __init__(self, rows):
        super().__init__(rows)
        self.finder = ahocorasick.Automaton()
        parts: dict[bytes, list[tuple[int, int]]] = {}
        for i, n in enumerate(self):
            for part, offset in n.seeds:
                parts.setdefault(part, []).append((i, offset + len(part) - 1))
        for part, uses in parts.items():
            self.finder.add_word(part.decode("latin-1"), uses)
        if parts:
            self.finder.make_automaton()

    def spots(self, text: bytes) -> dict[int, set[int]]:
        """Where each notice may begin, by its number."""
        out: dict[int, set[int]] = {}
        # one character a byte, so places are those of bytes
        for end, uses in self.finder.iter(text.decode("latin-1")) if len(self) else ():
            for i, before in uses:
                out.setdefault(i, set()).add(end - before)
        return out


def notices(rows=NOTICES) -> Notices:
    out = []
    for text, label, edits in rows:
        at = np.linspace(0, len(text), edits + 2).astype(int)
        seeds = tuple((text[a:z].encode(), int(a)) for a, z in zip(at, at[1:]))
        telling = tuple(w.encode() for w in text.split() if w not in FUNCTION_WORDS)
        out.append(Notice(text, label, edits, telling, seeds, regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={edits}}}")))
    return Notices(out)


def _places(text: bytes, part: bytes):
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def distance(a: bytes, b: bytes, most: int) -> int:
    """Edits between two words, or ``most`` + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row[-1], most + 1)


@lru_cache(1 << 16)
def resembles(word: bytes, wanted: bytes) -> bool:
    """Whether ``word`` is ``wanted`` with at most a third of its letters edited, one at least."""
    most = max(1, len(wanted) // 3)
    return distance(word, wanted, most) <= most


def tells(n: Notice, window: bytes) -> bool:
    """Whether a window has all words that tell the notice, each as a word or as two that a blank parts."""
    words = window.split(b" ")
    words += [a + b for a, b in zip(words, words[1:])]
    return all(t in words or any(resembles(w, t) for w in words) for t in n.telling)


def _windows(n: Notice, spots: list[int], starts: np.ndarray, ends: np.ndarray):
    """(begin, end) of whole words that begin and end within the edits of where the notice would at each spot."""
    done = set()
    k, length = n.edits, len(n.text)
    for spot in spots:
        first = starts[np.searchsorted(starts, spot - k) : np.searchsorted(starts, spot + k, "right")].tolist()
        if not first:
            continue
        last = ends[np.searchsorted(ends, spot + length - k) : np.searchsorted(ends, spot + length + k, "right")].tolist()
        for a in first:
            for z in last:
                if abs(z - a - length) <= k and (a, z) not in done:
                    done.add((a, z))
                    yield a, z


def fuzzy_spans(text: bytes, wanted: list[Notice], starts: np.ndarray | None = None) -> list[tuple[str, int, int, int, float]]:
    """(label, first byte, end byte, edits, likeness) of matches in words joined by blanks.

    Those of one notice don't overlap: the one of fewest edits stays, the first
    of several. One that lies inside a match of another label that is at least
    as like its notice goes.
    """
    wanted = wanted if isinstance(wanted, Notices) else Notices(wanted)
    if starts is None:
        starts = np.concatenate([[0], np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1])
    ends = np.append(starts[1:] - 1, len(text))
    out, seen = [], {}
    for i, spots in sorted(wanted.spots(text).items()):
        n, found = wanted[i], []
        for a, z in _windows(n, sorted(spots), starts, ends):
            window = text[a:z]
            # texts that repeat themselves ask for the same window again
            edits = seen.get((i, window))
            if edits is None:
                m = n.pattern.fullmatch(window.decode("utf-8", "replace")) if tells(n, window) else None
                edits = sum(m.fuzzy_counts) if m else -1
                if len(seen) >= 10_000:
                    seen.clear()
                seen[i, window] = edits
            if edits >= 0:
                found.append((edits, a, z))
        taken: list[tuple[int, int]] = []
        for edits, a, z in sorted(found):
            at = bisect(taken, (a, z))
            if (at and taken[at - 1][1] > a) or (at < len(taken) and taken[at][0] < z):
                continue
            taken.insert(at, (a, z))
            out.append((n.label, a, z, edits, 1 - edits / len(n.text)))
    return _outermost(out)


def _outermost(spans: list[tuple[str, int, int, int, float]]) -> list[tuple[str, int, int, int, float]]:
    """Spans without those inside one of another label that is as like its notice or more; of equal spans the one more like its notice."""
    spans = sorted(spans, key=lambda s: (s[1], -s[2]))
    kept, open_ = [], []
    for s in spans:
        open_ = [o for o in open_ if o[2] > s[1]]
        if not any(o[0] != s[0] and o[2] >= s[2] and (o[4] > s[4] or o[4] == s[4] and o[1:3] != s[1:3]) for o in open_):
            kept.append(s)
        open_.append(s)
    # a span of the same words that came earlier may be the worse one
    best = {}
    for s in kept:
        best[s[1:3]] = max(best.get(s[1:3], 0.0), s[4])
    return sorted((s for s in kept if s[4] == best[s[1:3]]), key=lambda s: (s[1], s[2], s[0]))


def scan(text: str | None, wanted: list[Notice], base=BASE) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of one text."""
    words = words_of(text)
    if not words:
        return 0, 0, None, None, "", "", 0.0, []
    joined = b" ".join(words)
    padded = b" " + joined + b" "
    # where each word starts, so that the word at a place is one search away
    starts = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - np.fromiter(map(len, words), np.int64, len(words)) - 1
    places, found, labels = [], set(), set()
    for phrase, label in base:
        hits = list(_places(padded, b" " + phrase.encode() + b" "))
        if hits:
            places += np.searchsorted(starts, hits).tolist()
            found.add(label)
    spans, score = [], 1.0 if found else 0.0
    for label, a, z, edits, likeness in fuzzy_spans(joined, wanted, starts):
        labels.add(label)
        score = max(score, likeness)
        spans.append((label, int(np.searchsorted(starts, a)), int(np.searchsorted(starts, z)), edits, joined[a:z].decode("utf-8", "replace")))
    lists = [",".join(sorted(x)) for x in (found, found | labels)]
    return len(words), len(places), min(places, default=None), max(places, default=None), *lists, score, spans


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label: string, first_word: long, end_word: long, edits: int, text: string>>"
)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA, one row per input row. ``spans`` are the fuzzy matches by words (end excluded) with their edits.

    Null and empty texts have no words, no labels and score 0. The score is 1
    for an exact phrase, else the likeness of the best fuzzy match. Long texts
    are searched whole, in time in proportion to them; matches of one notice
    don't overlap. Rows that repeat or have no id are answered each, other
    columns are left aside, and an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32()), ("text", pa.string())]))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
    names = [f.name for f in span.value_type]

    def run(batches):
        wanted = notices()
        for batch in batches:
            rows = [scan(t, wanted) for t in batch.column(1).to_pylist()]
            cols = [[r[i] for r in rows] for i in range(8)]
            cols[7] = [[dict(zip(names, s)) for s in x] for x in cols[7]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
