"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters, digits and non-ASCII characters, lower-cased; dashes, quotes and other punctuation
beyond ASCII part them too, and characters of scripts that are written without spaces are a token each. Test items are joined with
documents on shared seeds (runs of MIN_MATCH tokens). For each document and item that share enough of
them, running Karp-Rabin finds the longest common runs of unmarked tokens, marks them as tiles, longest
first, and goes on with shorter ones down to MIN_MATCH. The share of an item's tokens under tiles is
its coverage; order does not matter, so reordered passages count in full.

Seeds bound what tiles can cover, so items whose shared seeds cover too little are ruled out exactly.
Items are taken in blocks of a fixed number of tokens: every block is one pass over the documents with
a table of bounded size in each task, whatever the size of the benchmark; the driver holds two blocks at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import frees, slices, small_batches, text_or_empty, windows, words_of, written

#: Tokens in a seed and in the shortest tile; the share of an item that has to be covered.
MIN_MATCH, COVERAGE = 5, 0.6
#: The first length that is searched for; tokens of the items of one pass.
FIRST_LENGTH, BLOCK_TOKENS = 20, 2_000_000
_U = np.uint64


def separators() -> np.ndarray:
    table = np.ones(256, bool)
    table[48:58] = table[97:123] = table[128:] = False
    return table


#: Punctuation and spaces beyond ASCII; and characters of scripts without spaces between words (Thai to Burmese, kana, Han).
OTHER_PUNCTUATION = re.compile("[\u0080-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb-\u00bf\u1680\u2000-\u206f\u2e00-\u2e7f\u3000-\u3004\u3008-\u3020\u30fb\ufe30-\ufe6f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]+")
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u3040-\u30fa\u30fc-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


def parted(text: str) -> bytes:
    """Lower-cased, with spaces wherever tokens part beyond ASCII."""
    text = text.lower()
    if not text.isascii():
        text = UNSPACED.sub(r" \1 ", OTHER_PUNCTUATION.sub(" ", text))
    return text.encode("utf-8", "replace")


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed tokens of all texts in turn, and where each text begins."""
    hashes, begins, *_ = words_of([parted(t) for t in texts], separators())
    return hashes, begins


def seeds(hashes: np.ndarray, begins: np.ndarray, size: int = MIN_MATCH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of size tokens at every place, and whether the run lies in one text."""
    every = windows(hashes, size)
    inside = np.zeros(len(every), bool)
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        inside[a : max(a, b - size + 1)] = True
    return every, inside


def tile(pattern: np.ndarray, text: np.ndarray, least: int = MIN_MATCH, first: int = FIRST_LENGTH) -> list[tuple[int, int, int]]:
    """Greedy string tiling with running Karp-Rabin: tiles (place in pattern, place in text, length).

    Zero in text is a gap that matches nothing.
    """
    marked_p, marked_t = np.zeros(len(pattern), bool), text == 0
    tiles, length = [], max(least, first)
    while True:
        longest = _scan(pattern, text, marked_p, marked_t, length, tiles)
        if longest > 2 * length:  # a much longer match: start from there
            length = longest
        elif length > 2 * least:
            length //= 2
        elif length > least:
            length = least
        else:
            return tiles


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Places at which `size` tokens in a row are unmarked."""
    if len(marked) < size:
        return np.zeros(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(sums[size:] == sums[:-size])


def _scan(pattern, text, marked_p, marked_t, length, tiles) -> int:
    """Mark the matches of at least `length`, longest first; if one is longer than twice that, only return its length."""
    at_p, at_t = _free(marked_p, length), _free(marked_t, length)
    if not len(at_p) or not len(at_t):
        return 0
    hash_p, hash_t = windows(pattern, length)[at_p], windows(text, length)[at_t]
    order = np.argsort(hash_t, kind="stable")
    lo, hi = np.searchsorted(hash_t[order], hash_p), np.searchsorted(hash_t[order], hash_p, "right")
    found = []
    for i in np.flatnonzero(hi > lo):
        p = int(at_p[i])
        for j in order[lo[i] : hi[i]]:
            t = int(at_t[j])
            if p and t and not marked_p[p - 1] and not marked_t[t - 1] and pattern[p - 1] == text[t - 1]:
                continue  # inside a match that begins before
            n = 0
            while p + n < len(pattern) and t + n < len(text) and not marked_p[p + n] and not marked_t[t + n] and pattern[p + n] == text[t + n]:
                n += 1
            if n > 2 * length:
                return n
            if n >= length:
                found.append((-n, p, t))
    for n, p, t in sorted(found):
        n = -n
        if not marked_p[p : p + n].any() and not marked_t[t : t + n].any():
            marked_p[p : p + n] = marked_t[t : t + n] = True
            tiles.append((p, t, n))
        else:  # what is left of it is a match of its own
            i = 0
            while i < n:
                j = i
                while j < n and not marked_p[p + j] and not marked_t[t + j]:
                    j += 1
                if j - i >= length:
                    marked_p[p + i : p + j] = marked_t[t + i : t + j] = True
                    tiles.append((p + i, t + i, j - i))
                i = j + 1
    return 0


class Items:
    """Test items of one pass: their tokens and the table of their seeds."""

    def __init__(self, ids: list[int], texts: list[str], least: int = MIN_MATCH):
        self.least = least
        hashes, begins = tokens(texts)
        self.ids, self.tokens = ids, [hashes[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)]
        every, inside = seeds(hashes, begins, least)
        self.short: dict[bytes, list[int]] = {}  # items of fewer tokens than a tile, by all their tokens
        for k, own in enumerate(self.tokens):
            if 0 < len(own) < least:
                self.short.setdefault(own.tobytes(), []).append(k)
        at = np.flatnonzero(inside)
        item = np.searchsorted(begins, at, "right") - 1
        order = np.argsort(every[at], kind="stable")
        self.seed, self.item, self.place = every[at][order], item[order], (at - begins[item])[order]
        bits = max(16, len(at).bit_length() + 4)
        self.mask = _U((1 << bits) - 1)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[(self.seed & self.mask).astype(np.int64)] = True

    def matches(self, texts: list[str], coverage: float) -> list[list[tuple[int, float, int, int]]]:
        """For each text (item id, coverage, tiles, longest tile) of the items that are covered enough."""
        hashes, begins = tokens(texts)
        every, inside = seeds(hashes, begins, self.least)
        out: list[list] = [[] for _ in texts]
        if self.short:
            for d in np.flatnonzero(np.diff(begins) < self.least).tolist():
                out[d] = [(self.ids[k], 1.0, 1, len(self.tokens[k])) for k in self.short.get(hashes[begins[d] : begins[d + 1]].tobytes(), ())]
        hit = np.flatnonzero(self.maybe[(every & self.mask).astype(np.int64)] & inside)
        lo, hi = np.searchsorted(self.seed, every[hit]), np.searchsorted(self.seed, every[hit], "right")
        hit, lo, hi = hit[hi > lo], lo[hi > lo], hi[hi > lo]
        owner = np.searchsorted(begins, hit, "right") - 1
        for d in np.unique(owner):
            a, b = np.searchsorted(owner, d), np.searchsorted(owner, d, "right")
            shared = np.unique(np.concatenate([np.arange(x, y) for x, y in zip(lo[a:b], hi[a:b], strict=True)]))
            text = None
            for k in np.unique(self.item[shared]):
                own = self.tokens[k]
                under = np.zeros(len(own), bool)
                for p in self.place[shared[self.item[shared] == k]]:
                    under[p : p + self.least] = True
                if under.mean() < coverage:
                    continue
                if text is None:  # the tokens under seeds, with gaps of one between runs
                    text = self._under(hashes, begins[d], begins[d + 1], hit[a:b])
                tiles = tile(own, text, self.least)
                share = sum(n for *_, n in tiles) / len(own)
                if share >= coverage:
                    out[d].append((self.ids[k], share, len(tiles), max(n for *_, n in tiles)))
        return out

    def _under(self, hashes, a, b, hit) -> np.ndarray:
        inside = np.zeros(b - a + 1, bool)
        for h in hit - a:
            inside[h : h + self.least] = True
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        text = np.where(inside[:-1], hashes[a:b], _U(0)) if b > a else np.zeros(0, _U)
        return text[keep[:-1]]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int = BLOCK_TOKENS) -> Iterator[Items]:
    """The benchmark's items in blocks of about `most` tokens, one at a time on the driver."""
    ids, texts, held = [], [], 0
    rows = benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    for item, text in rows.toLocalIterator():
        ids.append(item)
        texts.append(text)
        held += len(text) // 4
        if held >= most:
            yield Items(ids, texts)
            ids, texts, held = [], [], 0
    if ids:
        yield Items(ids, texts)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """Pairs over the threshold: doc_id, item_id, coverage, n_tiles, longest; and rows with null item_id, so that every document has one.

    Lazy but for reading the benchmark, if that is one block of items; else each block's pairs are written.
    """
    schema = "doc_id long, item_id long, coverage double, n_tiles long, longest long"
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def one(items: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, texts, rows = b.column(0).to_pylist(), b.column(1).to_pylist(), []
                for i, j in slices(texts, 1 << 20):
                    for doc_id, found in zip(ids[i:j], items.matches(texts[i:j], coverage), strict=True):
                        rows += [(doc_id, *x) for x in found] or [(doc_id, None, None, None, None)]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "coverage", "n_tiles", "longest"])

        return source.mapInArrow(frees(run), schema)

    small_batches(docs.sparkSession)
    none = source.select("doc_id", *(F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in schema.split(", ")[1:])))
    todo = blocks(benchmark, item_col, item_text_col)
    first, second = next(todo, None), next(todo, None)
    if second is None:
        return none if first is None else one(first)
    every, todo = none, chain([first, second], todo)
    del first, second
    while (items := next(todo, None)) is not None:
        every = every.unionByName(written(one(items).where("item_id is not null"), "pass"))
    return every


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """One row per document id: doc_id, contaminated, n_items, item_id (the best covered item's), coverage, n_tiles, longest.

    An item is found in a document if tiles of at least MIN_MATCH tokens cover `coverage` of its tokens; of
    equal coverage, the item with the smallest id is named. Null or empty texts, and items with null or
    empty text or without id, match nothing; an item shorter than a tile is found in documents that have its
    tokens and no others. Rows that share an
    id (also a null one) give one row, contaminated if any of them is. An empty benchmark marks nothing,
    an empty table gives an empty result; other columns are not read.
    """
    pairs = contamination(docs, benchmark, id_col, text_col, item_col, item_text_col, coverage)
    best = F.max(F.when(F.col("item_id").isNotNull(), F.struct("coverage", F.bitwise_not("item_id").alias("not_id"), "n_tiles", "longest"))).alias("best")
    grouped = pairs.groupBy("doc_id").agg(best, F.count_distinct("item_id").alias("n_items"))
    return grouped.select("doc_id", F.col("best").isNotNull().alias("contaminated"), "n_items", F.bitwise_not("best.not_id").alias("item_id"), F.coalesce("best.coverage", F.lit(0.0)).alias("coverage"), "best.n_tiles", "best.longest")
