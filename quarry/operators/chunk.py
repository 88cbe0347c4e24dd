"""Structure-aware chunking of normalised Markdown, as one Arrow pass over documents."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby, pairwise, takewhile
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T

CHUNKER_VERSION = "sections/1"
#: Tokens at which a chunk is closed, that it may not pass, below which a last chunk joins the one before; share that overlaps.
TARGET, MOST, LEAST, OVERLAP = 600, 800, 80, 0.12

_HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*#*\s*$")
_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


class Block(NamedTuple):
    kind: str  # text, code or table
    body: str
    first: int
    last: int
    path: tuple[str, ...]

    @property
    def size(self) -> int:
        return tokens(self.body)


def tokens(body: str) -> int:
    return max(1, round(len(body) / 4))


def code_ends(lines: list[str]) -> dict[int, int]:
    """Of fenced code: the line that opens it, and one past the line that closes it (the end, if none does)."""
    marks = [(n, m[1]) for n, line in enumerate(lines) if (m := _FENCE.match(line))]
    out, free = {}, 0
    for n, mark in marks:
        if n >= free:
            free = next((k + 1 for k, _ in marks if k > n and lines[k].strip().startswith(mark)), len(lines))
            out[n] = free
    return out


def blocks(text: str) -> list[Block]:
    """Paragraphs, tables and fenced code with their line numbers and the headings above them.

    Every line is given a kind first; runs of lines of one kind, and each stretch of code, are blocks.
    """
    lines = text.split("\n")
    kinds: list[object] = ["table" if x.lstrip().startswith("|") else "text" if x.strip() else None for x in lines]
    for a, b in code_ends(lines).items():
        kinds[a:b] = [("code", a)] * (b - a)
    titles: dict[int, tuple[str, ...]] = {}  # the headings above, and that of the line itself, by line
    newest: dict[int, int] = {}  # the last heading of each level
    for n, line in enumerate(lines):
        if not isinstance(kinds[n], tuple) and (m := _HEADING.match(line)):
            kinds[n] = None
            parent = max((k for level, k in newest.items() if level < len(m[1])), default=-1)
            newest[len(m[1])] = n
            titles[n] = (*titles.get(parent, ()), m[2].strip())
    out, above = [], ()
    for kind, run in groupby(range(len(lines)), kinds.__getitem__):
        at = list(run)
        if kind is None:
            above = next((titles[n] for n in reversed(at) if n in titles), above)
            continue
        body = "\n".join(lines[at[0] : at[-1] + 1]).strip("\n")
        out.append(Block(kind if isinstance(kind, str) else kind[0], body, at[0] + 1, at[-1] + 1, above))
    return out


def split(block: Block, most: int) -> list[Block]:
    """A block that is too large in pieces of sentences (text) or lines (code, tables); one unit is never cut."""
    if block.size <= most:
        return [block]
    joint, units = (" ", _SENTENCE_END.split(block.body)) if block.kind == "text" else ("\n", block.body.split("\n"))
    longest = 4 * most + (1 if most % 2 else 2)  # characters that still count as `most` tokens: halves are rounded to even
    ends = list(accumulate(len(u) + 1 for u in units))
    cuts = [0]
    while cuts[-1] < len(units):
        before = ends[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, bisect_right(ends, before + longest + 1)))
    bodies = [joint.join(units[a:b]) for a, b in pairwise(cuts)]
    passed = [0, *accumulate(x.count("\n") + (joint == "\n") for x in bodies)]
    line = lambda n: min(block.first + n, block.last)
    return [Block(block.kind, x, line(n), line(n + x.count("\n")), block.path) for x, n in zip(bodies, passed, strict=False)]


def pack(atoms: list[Block], target: int, most: int) -> list[list[Block]]:
    """Blocks in a row until the target; a short last group joins the one before if both fit."""
    sums, n = [0, *accumulate(a.size for a in atoms)], len(atoms)
    cuts = [0]
    while cuts[-1] < n:  # up to the first block that reaches the target, or the last that fits
        done = sums[cuts[-1]]
        cuts.append(max(cuts[-1] + 1, min(bisect_left(sums, done + target), bisect_right(sums, done + most) - 1, n)))
    if len(cuts) > 2 and n and sums[n] - sums[cuts[-2]] < LEAST and sums[n] - sums[cuts[-3]] <= most:
        del cuts[-2]
    return [atoms[a:b] for a, b in pairwise(cuts)]


def carried(before: list[Block], budget: int) -> list[Block]:
    """The last blocks of prose of a group that fit into the budget."""
    ends = before[::-1]
    fit = takewhile(lambda x: x[0].kind == "text" and x[1] <= budget, zip(ends, accumulate(b.size for b in ends), strict=True))
    return [b for b, _ in fit][::-1]


def chunks(text: str, target: int = TARGET, most: int = MOST, overlap: float = OVERLAP) -> list[tuple[int, str, int, tuple[str, ...], int, int]]:
    """(ordinal, body, tokens, headings, first line, last line) of each chunk. Sections (equal headings in a row) are never mixed."""
    budget, groups = round(target * overlap), []
    for _, section in groupby(blocks(text), lambda b: b.path):
        packed = pack([p for b in section for p in split(b, most)], target, most)
        groups += [carried(before, budget) + g for before, g in zip([[], *packed], packed, strict=False)]
    found = [("\n\n".join(b.body for b in g).strip(), g) for g in groups]
    return [(n, body, tokens(body), g[-1].path, min(b.first for b in g), max(b.last for b in g)) for n, (body, g) in enumerate(found) if body]


_CHUNK = "ordinal INT, text STRING, token_count INT, heading_path ARRAY<STRING>, line_start INT, line_end INT"


def chunk_documents(docs: DataFrame, key: str = "document_id", text_col: str = "text", target: int = TARGET, most: int = MOST, overlap: float = OVERLAP) -> DataFrame:
    """Rows (key, ordinal, text, token_count, heading_path, line_start, line_end) for each chunk of docs' normalised texts.

    Only the key and the text go to Python; join the rest back by key, or keep it in a narrow table.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, n, body, size, list(path), a, b) for k, t in zip(f["key"], f["text"], strict=True) if t for n, body, size, path, a, b in chunks(t, target, most, overlap)]
            yield pd.DataFrame(rows, columns=["key", "ordinal", "text", "token_count", "heading_path", "line_start", "line_end"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text_col).alias("text")).mapInPandas(run, f"key {kind}, {_CHUNK}")
    return out.withColumnRenamed("key", key)


def register_chunk_function(spark: SparkSession, name: str = "chunk_text") -> None:
    """A table function for SQL: SELECT * FROM docs, LATERAL chunk_text(text)."""

    @F.udtf(returnType=_CHUNK)
    class ChunkText:
        def eval(self, text: str):
            for n, body, size, path, a, b in chunks(text or ""):
                yield n, body, size, list(path), a, b

    spark.udtf.register(name, ChunkText)


def locate(line_start, line_end, pages, chapters, fragment):
    """(page, fragment) of a chunk's lines: the first page that overlaps; without one, the first chapter that does names the fragment."""
    meets = lambda p: (p["line_end"] >= line_start) & (p["line_start"] <= line_end)
    page = F.get(F.filter(pages, meets), 0)["page"]
    chapter = F.get(F.filter(chapters, meets), 0)["name"]
    return page, F.coalesce(fragment, F.when(page.isNull(), T.slug(chapter)))
