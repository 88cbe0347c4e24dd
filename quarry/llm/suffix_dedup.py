"""Removal of repeated passages with suffix arrays.

A byte goes if a run of LENGTH bytes that covers it also starts in a document with a smaller id. One
suffix array of everything would not fit a machine, so runs are dealt out by content first:

1. Every run has an anchor: the GRAM bytes in it with the smallest hash. Equal runs have equal anchors.
   Blocks of documents send the hashes of their anchors, packed, to buckets of the hash range, and get
   back a bit for each: whether it occurs in another document. All other runs occur in one document only.
2. Around a repeated anchor, the runs that belong to it form a short segment. A block sends each segment that
   differs once, with the smallest id that has it, to the anchor's bucket; places stay with the block. Runs of
   an anchor that has very many are dealt out one by one, by a hash of all their bytes.
3. A bucket sorts the suffixes of the segments that differ: two-stage sorting sorts only suffixes that
   are smaller than their successors, by LENGTH bytes, and induces the others by scanning the buckets
   of first bytes. Neighbours whose common prefix reaches LENGTH are equal runs, and get the smallest id of all.
4. Blocks get the smallest ids of their segments' runs back, compare them with the ids at each place, unite what
   is covered and cut the texts.

Tasks hold one block or one bucket, whose number follows the bytes of the input; a passage that a third of all
documents share is a row per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import pack, unpack
from quarry.llm.common import digest, frees, frees_group, frees_groups, mix, numbered, pack_ids, powers, prefix_sums, ranges, small_batches, text_bytes, text_or_empty, unpack_ids

LENGTH, GRAM = 50, 20
BLOCK_BYTES = 8 << 20
#: Bytes of text for each bucket; anchors of more than HOT_RUNS runs are dealt out run by run, so what one of them
#: brings into a bucket has fewer than 2^24 bytes.
BUCKET_BYTES, HOT_RUNS = 16 << 20, 200_000
#: Bytes that one vectorised step looks at; of suffixes that are sorted together (more if one anchor has more).
PIECE, SORT_BYTES = 1 << 20, 1 << 20
#: Places of segments that one step looks at; of a passage that is everywhere, a block may have as many as bytes.
STEP_PLACES = 1 << 18
_U = np.uint64


# ---- two-stage suffix sorting ----


def words_at(text: np.ndarray, reach: int) -> np.ndarray:
    """The eight bytes from every place on as a big-endian number; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(reach + 8, np.uint8)]).astype(_U)
    out = np.zeros(len(text) + reach, _U)
    for k in range(8):
        out = out << _U(8) | padded[k : k + len(out)]
    return out


def sort_directly(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The places in the order of their first `depth` bytes at least: by eight bytes, then among those still equal by five more at a time."""
    if not len(at):
        return at
    order = at[np.argsort(words[at])]
    key = words[order]
    new = np.append(True, key[1:] != key[:-1])
    rest = np.arange(len(order))
    for d in range(8, depth, 5):
        alone = new & np.append(new[1:], True)
        rest = rest[~alone]
        if not len(rest):
            break
        group = np.cumsum(new[~alone]).astype(_U)  # of the places that are equal so far; fewer than 2^24
        key = group << _U(40) | words[order[rest] + d] >> _U(24)
        by = np.argsort(key)
        order[rest], key = order[rest[by]], key[by]
        new = np.append(True, key[1:] != key[:-1])
    return order


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last one is not (the end is smaller than any byte)."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])  # last places of runs of one byte
    ends = np.append(change, n - 1)
    run_end = np.repeat(ends, np.diff(ends, prepend=-1))
    after = np.append(text.astype(np.int16), -1)
    return after[run_end + 1] > text[run_end]


def two_stage_sort(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes in the order of at least their first `depth` bytes.

    Suffixes smaller than their successors are sorted directly. The others of a bucket (one first byte)
    follow from the order of their successors: buckets are scanned in ascending order, and the place
    before each suffix scanned is put at the front of its own bucket if it is a larger one. Within a
    bucket, larger suffixes precede the smaller ones, those with shorter runs of the byte first.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    small = smaller_than_next(text)
    direct = sort_directly(words_at(text, depth + 8), np.flatnonzero(small), depth)
    starts = np.searchsorted(text[direct], np.arange(257))
    fronts: list[list[np.ndarray]] = [[] for _ in range(256)]
    fronts[text[n - 1]].append(np.array([n - 1]))  # its successor is the end
    out = []
    for byte in range(256):
        wave = np.concatenate(fronts[byte]) if fronts[byte] else np.zeros(0, np.int64)
        placed = []
        while len(wave):  # larger suffixes of this bucket, then those a run of the byte longer
            placed.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(text[before] == byte) & ~small[before]]
        own = np.concatenate([*placed, direct[starts[byte] : starts[byte + 1]]])
        out.append(own)
        before = own[own > 0] - 1
        before = before[(text[before] > byte) & ~small[before]]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            for a, b in zip(cuts, [*cuts[1:], len(before)], strict=True):
                fronts[first[a]].append(before[a:b])
    return np.concatenate(out)


def equal_runs(text: np.ndarray, wanted: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For the wanted places, a number that is the same for those with equal next `length` bytes, eight at least (-1 elsewhere)."""
    order = two_stage_sort(text, length)
    order = order[wanted[order]]
    words = words_at(text, length + 8)
    same = np.ones(max(0, len(order) - 1), bool)  # the common prefix of neighbours reaches length
    for d in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        w = words[order + d]
        same &= w[1:] == w[:-1]
    group = np.full(len(text), -1, np.int64)
    group[order] = np.cumsum(np.append(True, ~same)[: len(order)]) - 1
    return group


# ---- anchors and segments ----


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of successive windows with one anchor, in the texts data[start:end]: first window, last window, hash of the anchor."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    sums, back = prefix_sums(data), powers(n)[1]
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1])
    key = (grams & ~_U((1 << 24) - 1)) | np.arange(len(grams), dtype=_U)
    span = LENGTH - GRAM + 1
    low, width = key, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    where = (low & _U((1 << 24) - 1)).astype(np.int64)
    valid = np.zeros(len(where), bool)
    change = np.ones(len(where), bool)
    change[1:] = where[1:] != where[:-1]
    for a, b in zip(starts, ends, strict=True):
        if b - a >= LENGTH:
            valid[a : b - LENGTH + 1] = True
            change[a] = True
    edge = change | np.append(True, ~valid[:-1])
    first = np.flatnonzero(valid & edge)
    stop = np.append(edge[1:] | ~valid[1:], True)
    last = np.flatnonzero(valid & stop)
    return first, last, mix(grams[where[first]] + _U(0x9E3779B97F4A7C15))


def pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], bytes, list[int], list[int]]]:
    """The texts in steps of about PIECE bytes: numbers of texts, offsets in them, the bytes, starts, ends. Longer texts
    are cut with an overlap, so that every window is in one piece."""
    own, offset, parts, held = [], [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - LENGTH + 1), PIECE):
            part = t[a : a + PIECE + LENGTH - 1]
            own.append(i)
            offset.append(a)
            parts.append(part)
            held += len(part)
            if held >= PIECE:
                yield _joined(own, offset, parts)
                own, offset, parts, held = [], [], [], 0
    if parts:
        yield _joined(own, offset, parts)


def _joined(own, offset, parts):
    ends = np.cumsum([len(p) for p in parts])
    return own, offset, b"".join(parts), (ends - [len(p) for p in parts]).tolist(), ends.tolist()


class Runs:
    """All runs of windows of a block's texts: owner, first and last window in the text, and the anchor's number (lead + 32 bits).
    Every window of a run of one byte is a run of its own, so there may be as many as bytes."""

    def __init__(self, texts: list[bytes], lead: int):
        found = [(np.zeros(0, np.int32),) * 3 + (np.zeros(0, _U),)]
        for own, offset, data, starts, ends in pieces(texts):
            first, last, hashes = anchors(np.frombuffer(data, np.uint8), np.array(starts), np.array(ends))
            k = np.searchsorted(starts, first, "right") - 1
            shift = np.array(offset)[k] - np.array(starts)[k]
            found.append((*(x.astype(np.int32) for x in (np.array(own)[k], first + shift, last + shift)), hashes >> _U(32 - lead)))
        columns = [list(x) for x in zip(*found, strict=True)]
        del found
        self.number = np.concatenate(columns.pop())
        order = np.argsort(self.number, kind="stable")
        self.number = self.number[order]
        self.last, self.first, self.owner = (np.concatenate(columns.pop())[order] for _ in range(3))
        self.heads = np.flatnonzero(np.append(True, self.number[1:] != self.number[:-1])) if len(order) else np.zeros(0, np.int64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the anchors, ascending, whether each has several owners, and its runs."""
        if not len(self.heads):
            return self.number, np.zeros(0, bool), np.zeros(0, np.int64)
        several = np.minimum.reduceat(self.owner, self.heads) != np.maximum.reduceat(self.owner, self.heads)
        return self.number[self.heads], several, np.diff(np.append(self.heads, len(self.number)))


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes]]]:
    part, n, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids.append(doc_id)
            texts.append(text.as_py())
            held += len(texts[-1])
            if held >= BLOCK_BYTES:
                yield part << 24 | n, ids, texts
                n, ids, texts, held = n + 1, [], [], 0
    if ids:
        yield part << 24 | n, ids, texts


def _by_bucket(numbers: np.ndarray) -> list[tuple[int, int, int]]:
    bucket = (numbers >> _U(32)).astype(np.int64)
    if not len(bucket):
        return []
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True)]


def _low(numbers: np.ndarray) -> np.ndarray:
    return (numbers & _U(0xFFFFFFFF)).astype(np.uint32)


def pack_ascending(values: np.ndarray) -> bytes:
    return pack(np.diff(values.astype(np.int64), prepend=0))


def unpack_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data).astype(np.int64))


def anchor_lists(source: DataFrame, lead: int) -> DataFrame:
    """bucket, block, anchors, several, counts, digest: the distinct anchors of each block and bucket, bits (in several of its documents), and how many runs each has."""

    def run(batches):
        for number, _, texts in blocks_of(batches):
            numbers, several, counts = Runs(texts, lead).distinct()
            rows = [(bucket, number, pack_ascending(_low(numbers[a:b])), np.packbits(several[a:b]).tobytes(), pack(counts[a:b]), digest(numbers[a:b])) for bucket, a, b in _by_bucket(numbers)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["bucket", "block", "anchors", "several", "counts", "digest"])

    return source.mapInArrow(frees(run), "bucket long, block long, anchors binary, several binary, counts binary, digest long")


def repeated_anchors(lists: DataFrame) -> DataFrame:
    """bucket, block, n, repeated, hot, digest: for each of the block's anchors in the bucket a bit, whether another document has it, and one, whether it has more than HOT_RUNS runs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [unpack_ascending(x) for x in pdf["anchors"]]
        several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(o)).astype(bool) for x, o in zip(pdf["several"], own, strict=True)]
        at, n = numbered(np.concatenate(own))
        more = (np.bincount(at, np.concatenate(several)) > 0) | (n > 1)
        many = np.bincount(at, np.concatenate([unpack(x) for x in pdf["counts"]])) > HOT_RUNS
        ends = np.cumsum([len(o) for o in own])[:-1]
        bits, hot = ([np.packbits(x).tobytes() for x in np.split(flag[at], ends)] for flag in (more, many & more))
        return pd.DataFrame({"bucket": pdf["bucket"], "block": pdf["block"], "n": [len(o) for o in own], "repeated": bits, "hot": hot, "digest": pdf["digest"]})

    return lists.groupBy("bucket").applyInPandas(frees_group(run), "bucket long, block long, n long, repeated binary, hot binary, digest long")


def packed_blocks(source: DataFrame) -> DataFrame:
    """block, doc_ids, sizes, texts: documents in a row, compressed."""

    def run(batches):
        for number, ids, texts in blocks_of(batches):
            data = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([pack_ids(ids)], pa.binary()), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([data], pa.binary())], ["block", "doc_ids", "sizes", "texts"])

    return source.mapInArrow(frees(run), "block long, doc_ids binary, sizes array<long>, texts binary")


def _unpacked(row) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(row.texts, max_output_size=max(1, int(sum(row.sizes))))
    ends = np.cumsum(row.sizes).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _one_by_one(texts: list[bytes], owner: np.ndarray, first: np.ndarray, last: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, place and number of every window of the runs, numbered by a hash of the window's bytes. Runs overlap, up to LENGTH times; texts are read once, in pieces."""
    base = np.cumsum([0, *map(len, texts)])
    edges = np.zeros(base[-1] + 1, np.int8)  # of the runs: +1 at the first window, -1 after the last one
    edges[base[owner] + first] += 1
    edges[base[owner] + last + 1] -= 1
    wanted = np.cumsum(edges, dtype=np.int8, out=edges).view(bool)
    found = [(np.zeros(0, np.int32),) * 2 + (np.zeros(0, _U),)]
    for own, offset, data, starts, ends in pieces(texts):
        here = np.zeros(len(data), bool)
        for o, f, a, b in zip(own, offset, starts, ends, strict=True):
            if b - a >= LENGTH:
                here[a : b - LENGTH + 1] = wanted[base[o] + f : base[o] + f + b - a - LENGTH + 1]
        at = np.flatnonzero(here)
        k = np.searchsorted(starts, at, "right") - 1
        sums = prefix_sums(np.frombuffer(data, np.uint8))
        hashes = mix(mix((sums[at + LENGTH] - sums[at]) * powers(len(data))[1][at]) + _U(0x2545F4914F6CDD1D))
        found.append((np.array(own)[k].astype(np.int32), (np.array(offset)[k] + at - np.array(starts)[k]).astype(np.int32), hashes >> _U(32 - lead)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _kinds(number: np.ndarray, owner: np.ndarray, first: np.ndarray, last: np.ndarray, texts: list[bytes]) -> tuple[dict[tuple[int, bytes], int], np.ndarray]:
    """Numbers for segments that differ in anchor or bytes, in the order they are met, and the number at each place."""
    seen: dict[tuple[int, bytes], int] = {}
    places = np.empty(len(number), np.int32)
    for at in range(0, len(number), STEP_PLACES):
        part = slice(at, at + STEP_PLACES)
        places[part] = [seen.setdefault((x, texts[o][f : t + LENGTH]), len(seen)) for x, o, f, t in zip(_low(number[part]).tolist(), owner[part].tolist(), first[part].tolist(), last[part].tolist(), strict=True)]
    return seen, places


def segments(flags: DataFrame, blocks: DataFrame, lead: int) -> DataFrame:
    """Of each block, by bucket, its distinct segments of repeated anchors (anchors, sizes, text) with the smallest id that has each (ids);
    and in a bucket below 0 of its own, where they all stand: how often each occurs (uses), in which documents (docs), from where on (starts)."""
    schema = "bucket long, block long, anchors binary, sizes binary, text binary, ids binary, uses binary, docs binary, starts binary"
    zipped = zstandard.ZstdCompressor

    def run(marks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        marks = marks.sort_values("bucket")
        repeated, hot = (np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(marks[c], marks["n"], strict=True)] or [np.zeros(0, bool)]) for c in ("repeated", "hot"))
        for row in rows.itertuples(index=False):
            texts = _unpacked(row)
            runs = Runs(texts, lead)
            if len(runs.heads) != len(repeated) or digest(runs.number[runs.heads]) != int(marks["digest"].to_numpy(np.int64).sum()):
                raise RuntimeError("two readings of a block differ; write the input to a table first")
            ids, none = unpack_ids(row.doc_ids)
            each = np.diff(np.append(runs.heads, len(runs.number)))
            has_id = ~none[runs.owner]
            take = np.flatnonzero(np.repeat(repeated & ~hot, each) & has_id)
            owner, first, last, number = runs.owner[take], runs.first[take], runs.last[take], runs.number[take]
            if hot.any():
                take = np.flatnonzero(np.repeat(hot, each) & has_id)
                several = runs.owner[take], runs.first[take], runs.last[take]
                del runs, take
                more = _one_by_one(texts, *several, lead)
                del several
                owner, first, last, number = (np.concatenate(x) for x in zip((owner, first, last, number), (more[0], more[1], more[1], more[2]), strict=True))
                del more
                order = np.argsort(number, kind="stable")
                owner, first, last, number = owner[order], first[order], last[order], number[order]
            if not len(number):
                continue
            held = []
            for bucket, a, b in _by_bucket(number):
                seen, places = _kinds(number[a:b], owner[a:b], first[a:b], last[a:b], texts)
                order = np.argsort(places, kind="stable")
                uses = np.bincount(places)
                o = owner[a:b][order]
                least = np.minimum.reduceat(ids[o], np.cumsum(uses) - uses)
                out.append((bucket, row.block, pack(np.array([x for x, _ in seen])), pack(np.array([len(s) for _, s in seen])), zipped(level=1).compress(b"".join(s for _, s in seen)), zipped(level=1).compress(least.tobytes()), None, None, None))
                held.append((uses, o, first[a:b][order]))
            uses, docs, starts = (pack(np.concatenate(x)) for x in zip(*held, strict=True))
            out.append((-1 - row.block, row.block, None, None, None, None, uses, docs, starts))
        return pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return flags.groupBy("block").cogroup(blocks.groupBy("block")).applyInPandas(frees_groups(run), schema)


def judged(found: DataFrame) -> DataFrame:
    """For each block and bucket, of its segments in turn: into how many runs of windows with one smallest id they part, the runs' lengths and ids. A block's places are passed on."""
    schema = "bucket long, block long, parts binary, lengths binary, ids binary, uses binary, docs binary, starts binary"
    unzip, zipped = zstandard.ZstdDecompressor, zstandard.ZstdCompressor

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["bucket"].iloc[0] < 0:
            return pdf.assign(parts=None, lengths=None, ids=None)[[x.split()[0] for x in schema.split(", ")]]
        numbers, texts, ids, held = [], [], [], []
        for row in pdf.itertuples(index=False):
            sizes = unpack(row.sizes).astype(np.int64)
            data, ends = unzip().decompress(row.text, max_output_size=int(sizes.sum()) + 1), np.cumsum(sizes).tolist()
            texts += [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            numbers.append(unpack(row.anchors))
            ids.append(np.frombuffer(unzip().decompress(row.ids, max_output_size=8 * len(sizes) + 1), np.int64))
            held.append(len(sizes))
        numbers, ids = np.concatenate(numbers), np.concatenate(ids)
        known: dict[tuple, int] = {}
        kind = np.fromiter((known.setdefault((n, t), len(known)) for n, t in zip(numbers.tolist(), texts, strict=True)), np.int64, len(texts))
        least = np.full(len(known), 2**63 - 1)
        np.minimum.at(least, kind, ids)
        del texts
        begins, value = smallest_ids([n for n, _ in known], [t for _, t in known], least)
        # runs of windows with one value, by distinct segment
        new = np.append(True, value[1:] != value[:-1])
        new[begins] = True
        heads = np.flatnonzero(new)
        lengths, values = np.diff(np.append(heads, len(value))), value[heads]
        of = np.searchsorted(heads, begins)
        parts = np.diff(np.append(of, len(heads)))
        out, at = [], 0
        for block, n in zip(pdf["block"], held, strict=True):
            k = kind[at : at + n]
            take = np.repeat(of[k] - np.cumsum(parts[k]) + parts[k], parts[k]) + np.arange(parts[k].sum())
            out.append((block, pack(parts[k]), pack(lengths[take]), zipped(level=1).compress(values[take].tobytes())))
            at += n
        result = pd.DataFrame(out, columns=["block", "parts", "lengths", "ids"])
        return result.assign(bucket=pdf["bucket"].iloc[0], uses=None, docs=None, starts=None)[[x.split()[0] for x in schema.split(", ")]]

    return found.groupBy("bucket").applyInPandas(frees_group(run), schema)


def smallest_ids(numbers: list[int], texts: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For distinct segments of anchors: where each one's windows begin in the second result, which has the smallest id of each window in turn."""
    windows_ = np.array([len(t) for t in texts]) - LENGTH + 1
    begins = np.cumsum(windows_) - windows_
    values = np.empty(int(windows_.sum()), np.int64)
    order = np.argsort(numbers, kind="stable").tolist()
    at = 0
    while at < len(order):
        held, total = [], 0
        while at < len(order) and (total < SORT_BYTES or numbers[order[at]] == numbers[held[-1]]):
            held.append(order[at])
            total += len(texts[held[-1]])
            at += 1
        text = np.frombuffer(b"".join([texts[i] for i in held]), np.uint8)
        n = windows_[held]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        places = np.repeat(np.cumsum(n + LENGTH - 1) - n - LENGTH + 1, n) + step
        wanted = np.zeros(len(text), bool)
        wanted[places] = True
        group = equal_runs(text, wanted)[places]
        smallest = np.full(int(group.max()) + 1, 2**63 - 1)
        np.minimum.at(smallest, group, np.repeat(least[held], n))
        values[np.repeat(begins[held], n) + step] = smallest[group]
    return begins, values


def _covered(marks: pd.DataFrame, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: documents (by their number in it), starts and ends of the maximal ranges that go, in order of document and start."""
    if not len(marks):
        return (np.zeros(0, np.int64),) * 3
    own = marks["bucket"] < 0
    uses, docs, starts = (unpack(marks.loc[own, c].iloc[0]) for c in ("uses", "docs", "starts"))
    found = marks[~own].sort_values("bucket")
    parts, lengths = (np.concatenate([unpack(x) for x in found[c]]).astype(np.int64) for c in ("parts", "lengths"))
    values = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int64) for x in found["ids"]])
    head = np.cumsum(parts) - parts
    before = np.cumsum(lengths) - lengths
    offset = before - np.repeat(before[head], parts)  # of each run of windows in its segment
    until = np.cumsum(uses.astype(np.int64))
    out = [(np.zeros(0, np.int64),) * 3]
    for at in range(0, len(docs), STEP_PLACES):
        d, s = docs[at : at + STEP_PLACES].astype(np.int64), starts[at : at + STEP_PLACES].astype(np.int64)
        of = np.searchsorted(until, np.arange(at, at + len(d)), "right")  # the segment at each place
        n = parts[of]
        place = np.repeat(np.arange(len(of)), n)
        run = np.repeat(head[of] - np.cumsum(n) + n, n) + np.arange(len(place))
        gone = values[run] < ids[d[place]]
        place, run = place[gone], run[gone]
        begin = s[place] + offset[run]
        out.append(_united(d[place], begin, begin + lengths[run] + LENGTH - 1))
    return _united(*(np.concatenate(x) for x in zip(*out, strict=True)))


def _united(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same ranges in order of document and start, those that overlap or touch as one."""
    if not len(docs):
        return docs, starts, ends
    order = np.lexsort((starts, docs))
    docs, starts, ends = docs[order], starts[order], ends[order]
    base = docs << 32  # texts have fewer than 2^31 bytes
    reach = np.maximum.accumulate(base + ends)
    new = np.append(True, base[1:] + starts[1:] > reach[:-1])
    return docs[new], starts[new], (reach - base)[np.append(new[1:], True)]


def cut(marks: DataFrame, blocks: DataFrame, with_text: bool) -> DataFrame:
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def run(ranges_: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.itertuples(index=False):
            ids, none = unpack_ids(row.doc_ids)
            docs, starts, ends = _covered(ranges_, ids)
            for i, text in enumerate(_unpacked(row)):
                a, b = np.searchsorted(docs, i), np.searchsorted(docs, i, "right")
                kept, spans, removed, at = [], 0, 0, 0
                for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True):
                    kept.append(text[at:s])
                    spans, removed, at = spans + 1, removed + e - s, e
                kept = b"".join([*kept, text[at:]])
                out.append((None if none[i] else int(ids[i]), len(text), removed, spans, hashlib.sha256(kept).hexdigest(), *([kept] * with_text)))
        result = pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])
        return result.assign(doc_id=pd.array([x[0] for x in out], "Int64"))

    return marks.groupBy("block").cogroup(blocks.groupBy("block")).applyInPandas(frees_groups(run), schema)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with with_text the kept bytes.

    Texts are compared as UTF-8 bytes, within documents only; what counts is the input, not what is left
    of it. Null text counts as empty (no bytes, the digest of nothing); texts of fewer than LENGTH bytes
    keep everything. Rows that share an id do not remove each other's bytes; a row without an id removes
    nothing and loses nothing. An empty table gives an empty result; other columns are not read. docs is
    read three times (once for its size) and has to be a table or another repeatable plan.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    lead = (ranges(spark, text_bytes(source), BUCKET_BYTES, 4) - 1).bit_length()
    blocks = packed_blocks(source)
    flags = repeated_anchors(anchor_lists(source, lead))
    return cut(judged(segments(flags, blocks, lead)), blocks, with_text)
