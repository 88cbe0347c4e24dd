"""License scan: ordered signature rules over a text's words.

A rule (license_rules.py) is a regular expression over the words joined by single spaces, with a label, a priority,
a score and keywords that are in all it matches. One Aho-Corasick pass finds which keywords a text has; only rules
with all of theirs are tried, by their literal beginning. A detection that lies inside a longer one goes; the others
are taken by priority, then length, then place, and one that overlaps a detection already taken goes too.

Every step is linear in the text, or n log n in the number of detections; words are never made into a list.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import frees, small_batches, text_or_empty
from quarry.llm.license_rules import KINDS, SIGNATURES

#: Phrases whose places are counted, with their labels (fixed values).
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Bytes of words as they are (A-Z lower-cased), all others as spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Rule(NamedTuple):
    priority: int
    score: float
    label: str
    keywords: tuple[str, ...]
    pattern: str


def rules() -> list[Rule]:
    """The signatures in order of priority."""
    out, label = [], ""
    for line in filter(None, map(str.strip, SIGNATURES.splitlines())):
        if line.startswith("["):
            label = line[1:-1]
        else:
            kind, pattern = line.split(" ", 1)
            certain = re.sub(r"\(\?:[^()]*\)(?:\?|\{[0-9,]+\})?", " ", pattern)  # without groups: they hold alternatives or may be left out
            keywords = tuple(sorted({w.lower() for w in certain.split(" ") if re.fullmatch("[A-ZÀ-Þ0-9]*[A-ZÀ-Þ][A-ZÀ-Þ0-9]*", w)}))
            out.append(Rule(*KINDS[kind], label, keywords, pattern.lower()))
    return sorted(out, key=lambda r: -r.priority)


def bytewise(text: str) -> str:
    """A character for each byte of the text's UTF-8: what lines, keywords and patterns are compared as."""
    return text.encode("utf-8", "replace").decode("latin-1")


def line_of(data: bytes) -> tuple[str, np.ndarray]:
    """The words with a space before and after each, bytewise; and the places of the spaces."""
    raw = np.frombuffer(b" " + data.translate(FOLD) + b" ", np.uint8)
    blank = raw == 32
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    raw = raw[keep]
    return raw.tobytes().decode("latin-1"), np.flatnonzero(raw == 32)


class Scanner:
    """The rules by keyword, and the automaton that finds keywords; patterns are compiled when first needed."""

    def __init__(self, signatures: list[Rule] | None = None):
        self.rules = rules() if signatures is None else signatures
        self.compiled: dict[int, re.Pattern] = {}
        self.automaton = ahocorasick.Automaton()
        self.by: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            self.by.setdefault(min(r.keywords, key=lambda k: (-len(k), k)), []).append(i)
        for k in {k for r in self.rules for k in r.keywords}:
            self.automaton.add_word(f" {bytewise(k)} ", k)
        self.automaton.make_automaton()

    def pattern(self, i: int) -> re.Pattern:
        if i not in self.compiled:
            self.compiled[i] = re.compile(f" {bytewise(self.rules[i].pattern)}(?= )")
        return self.compiled[i]

    def base(self, line: str, spaces: np.ndarray) -> list[tuple[int, str]]:
        """First word and label of every place of a fixed phrase."""
        out = []
        for phrase, label in PHRASES:
            at, places, wanted = 0, [], f" {phrase} "
            while (at := line.find(wanted, at)) >= 0:
                places.append(at)
                at += 1
            out += [(int(k), label) for k in np.searchsorted(spaces, places)]
        return out

    def detect(self, line: str, spaces: np.ndarray) -> list[tuple[int, int, str, float]]:
        """Detections that stay: first word, one past the last, label, score."""
        have = {k for _, k in self.automaton.iter(line)}
        found = []
        for k in have & self.by.keys():
            for i in self.by[k]:
                r = self.rules[i]
                if have.issuperset(r.keywords):
                    found += [(-r.priority, m.start() - m.end(), m.start(), m.end(), r.label, r.score) for m in self.pattern(i).finditer(line)]
        starts, kept = [], []  # by place; they do not overlap
        for d in sorted(_outermost(found)):
            i = bisect_left(starts, d[2])
            if (i == 0 or kept[i - 1][3] <= d[2]) and (i == len(kept) or d[3] <= starts[i]):
                starts.insert(i, d[2])
                kept.insert(i, d)
        first, last = (np.searchsorted(spaces, [d[j] for d in kept]).tolist() for j in (2, 3))
        return [(a, b, d[4], d[5]) for a, b, d in zip(first, last, kept, strict=True)]


def _outermost(found: list[tuple]) -> list[tuple]:
    """Detections inside no longer one; of those with one interval, the first by priority."""
    out, reach = [], -1
    for d in sorted(found, key=lambda d: (d[2], -d[3], d)):
        if d[3] > reach:
            out.append(d)
            reach = d[3]
    return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Words are runs of characters other than ASCII punctuation, white space and controls, A-Z lower-cased.
    n_base counts the places of the fixed phrases, first_word and last_word are the smallest and largest
    of their first words (null without any); labels joins theirs and the rules'; score is the best
    detection's, 0 without one. Null text counts as empty: no words, no labels. Repeated rows are scanned
    each, a null id stays null; an empty table gives an empty result; other columns are not read. A row
    needs memory in proportion to its own text.
    """
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                line, spaces = line_of(b.column(1)[i].as_py())
                base, kept = scanner.base(line, spaces), scanner.detect(line, spaces)
                places, names = [p for p, _ in base], {x for _, x in base}
                every = names | {x for _, _, x, _ in kept}
                score = max([s for *_, s in kept], default=0.0)
                rows.append((len(spaces) - 1, len(base), min(places, default=None), max(places, default=None), ",".join(sorted(names)), ",".join(sorted(every)), float(score), ",".join(f"{x}:{s}:{e}" for s, e, x, _ in kept)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], NAMES)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    return source.mapInArrow(frees(scan), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections string")


NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
