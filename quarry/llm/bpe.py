"""Byte-level BPE by a global shuffle of distinct words.

1. The texts of a partition are cut into blocks of about BLOCK_BYTES. Within a block every pre-token
   is numbered, and a text becomes the sequence of its pre-tokens' numbers, by position.
2. The distinct pre-tokens of all blocks are dealt by hash into buckets, as packed lists. A bucket
   sees every distinct word of its share of the vocabulary and encodes it once.
3. The ids go back to the blocks, where they are joined with the positions, and texts are put
   together again. Decoding joins the ids with the table of the tokens' bytes.

What is shuffled is a list of distinct words and one of their ids for each block, and about two bytes
for each position; the number of buckets follows the input's bytes. Steps 1 and 2 read the input twice instead
of storing it (and once more for its size); both readings must agree, which a digest of each block's words proves,
so docs has to be a table or another repeatable plan.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import frees, frees_group, frees_groups, pack_ids, ranges, small_batches, text_bytes, text_or_empty, unpack_ids

#: Characters of a block; fewer where the ids are wanted too, which take more memory.
BLOCK_BYTES, BLOCK_BYTES_WITH_IDS = 16 << 20, 6 << 20
#: Bytes of text for each bucket of words.
BUCKET_BYTES = 128 << 20
#: Texts of more characters are matched piece by piece, without a list of all pre-tokens.
LONG_TEXT = 4 << 20
#: Words of more bytes are merged with a heap.
LONG_WORD = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file has a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the neighbours of the lowest rank, leftmost first, until none can be merged."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > LONG_WORD:
        return _encode_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    get = ranks.get
    none = len(ranks) << 8
    pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs:
        low = min(pairs)
        if low == none:
            break
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for long words, in n log n steps: a heap of mergeable neighbours in a linked list."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, to = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if not alive[i] or j >= n or end[j] != to:
            continue  # one of the two has changed since
        end[i], after[i], alive[j] = to, after[j], False
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : to])) is not None:
            heapq.heappush(heap, (r, before[i], to))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


def pack(values: np.ndarray) -> bytes:
    """Numbers below 2^32, byte planes apart, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_strings(words: list[bytes]) -> bytes:
    sizes = pack(np.fromiter(map(len, words), np.int64, len(words)))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.ZstdCompressor(level=1).compress(b"".join(words))


def unpack_strings(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(unpack(data[4 : 4 + n]).astype(np.int64))
    whole = zstandard.ZstdDecompressor().decompress(data[4 + n :])
    return [whole[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(ends) else []


class Block:
    """Texts in a row whose pre-tokens share a numbering."""

    def __init__(self, pattern):
        self.pattern, self.numbers = pattern, defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.ids, self.sizes, self.stream, self.bytes = [], [], array("I"), 0

    def add(self, doc_id, text: str) -> None:
        before = len(self.stream)
        found = self.pattern.findall(text) if len(text) <= LONG_TEXT else (m[0] for m in self.pattern.finditer(text))
        self.stream.extend(map(self.numbers.__getitem__, found))
        self.ids.append(doc_id)
        self.sizes.append(len(self.stream) - before)
        self.bytes += len(text)

    def ordered(self, buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words by bucket, then number; each one's bucket; and the place of every number in that order."""
        words = [w.encode() for w in self.numbers]
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        return [words[i] for i in order.tolist()], bucket[order], place


def blocks_of(batches: Iterator[pa.RecordBatch], pattern_text: str, most: int) -> Iterator[tuple[int, Block]]:
    """Blocks of a partition's rows (doc_id, text), with their ids."""
    pattern, part, n, block = regex.compile(pattern_text), TaskContext.get().partitionId(), 0, None
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            block = block or Block(pattern)
            block.add(doc_id, text.as_py())
            if block.bytes >= most:
                yield part << 24 | n, block
                n, block = n + 1, None
    if block:
        yield part << 24 | n, block


def _digest(words: list[bytes]) -> int:
    h = hashlib.blake2b(digest_size=8)
    for w in words:
        h.update(len(w).to_bytes(4, "little") + w)
    return int.from_bytes(h.digest(), "little", signed=True)


def dictionaries(docs: DataFrame, pattern: str, buckets: int, most: int = BLOCK_BYTES) -> DataFrame:
    """bucket, block, words: each block's distinct pre-tokens of each bucket."""

    def run(batches):
        for number, block in blocks_of(batches, pattern, most):
            words, bucket, _ = block.ordered(buckets)
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if words else []
            ends = [*starts[1:], len(words)] if words else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[s]) for s in starts], pa.int64()), pa.array([number] * len(starts), pa.int64()), pa.array([pack_strings(words[s:e]) for s, e in zip(starts, ends, strict=True)], pa.binary())], ["bucket", "block", "words"]
            )

    return docs.mapInArrow(frees(run), "bucket long, block long, words binary")


def encoded_words(parts: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """bucket, block, ids, sizes: the ids of each list's words, one after another. Every distinct word of a bucket is encoded once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known: dict[bytes, list[int]] = {}
        out = []
        for block, data in zip(pdf["block"], pdf["words"], strict=True):
            lists = []
            for w in unpack_strings(data):
                if (ids := known.get(w)) is None:
                    known[w] = ids = encode_word(w, ranks)
                lists.append(ids)
            out.append((block, pack(np.array([i for x in lists for i in x], np.int64)), pack(np.fromiter(map(len, lists), np.int64, len(lists)))))
        return pd.DataFrame({"bucket": pdf["bucket"], "block": [x[0] for x in out], "ids": [x[1] for x in out], "sizes": [x[2] for x in out]})

    return parts.groupBy("bucket").applyInPandas(frees_group(run), "bucket long, block long, ids binary, sizes binary")


def positions(docs: DataFrame, pattern: str, buckets: int, most: int = BLOCK_BYTES) -> DataFrame:
    """block, doc_ids, sizes, stream, places, digest: a block's texts as sequences of its words' numbers, and the numbers' places in its dictionary."""

    def run(batches):
        for number, block in blocks_of(batches, pattern, most):
            words, _, place = block.ordered(buckets)
            stream = np.frombuffer(block.stream, np.uint32)
            often = np.argsort(-np.bincount(stream, minlength=len(words)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(words), np.int64)
            rank[often] = np.arange(len(words))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([pack_ids(block.ids)], pa.binary()), pa.array([block.sizes], pa.list_(pa.int64())), pa.array([pack(rank[stream])], pa.binary()), pa.array([pack(place[often])], pa.binary()), pa.array([_digest(words)], pa.int64())],
                ["block", "doc_ids", "sizes", "stream", "places", "digest"],
            )

    return docs.mapInArrow(frees(run), "block long, doc_ids binary, sizes array<long>, stream binary, places binary, digest long")


def reassemble(parts: DataFrame, streams: DataFrame, table: list[bytes], with_ids: bool) -> DataFrame:
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(coded: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        coded = coded.sort_values("bucket")
        sizes = np.concatenate([unpack(x) for x in coded["sizes"]] or [np.zeros(0, np.uint32)]).astype(np.int64)
        flat = np.concatenate([unpack(x) for x in coded["ids"]] or [np.zeros(0, np.uint32)]).astype(np.int64)
        ends = np.cumsum(sizes)
        decimal = [str(i).encode() for i in range(len(table))]
        listed = [flat[a:b].tolist() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        raw = [b"".join([table[i] for i in x]) for x in listed]  # the join with the tokens' bytes
        text = [b" ".join([decimal[i] for i in x]) for x in listed]
        out = []
        for row in blocks.itertuples(index=False):
            if row.digest != _digest(raw):
                raise RuntimeError("two readings of a block differ; write the input to a table first")
            places, stream = unpack(row.places).astype(np.int64), unpack(row.stream)
            words = places[stream]
            at = 0
            ids, none = unpack_ids(row.doc_ids)
            for doc_id, n in zip([None if x else i for i, x in zip(ids.tolist(), none.tolist(), strict=True)], row.sizes, strict=True):
                own = words[at : at + n]
                at += n
                each = own.tolist()
                got = (doc_id, int(sizes[own].sum()), hashlib.sha256(b" ".join([text[w] for w in each])).hexdigest(), hashlib.sha256(b"".join([raw[w] for w in each])).hexdigest())
                if with_ids:
                    size = sizes[own]
                    place = np.repeat(ends[own] - size - np.cumsum(size) + size, size) + np.arange(size.sum())
                    got = (*got, flat[place].astype(np.int32))
                out.append(got)
        result = pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])
        return result.assign(doc_id=pd.array([x[0] for x in out], "Int64"))

    return parts.groupBy("block").cogroup(streams.groupBy("block")).applyInPandas(frees_groups(run), schema)


def byte_bpe(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode: doc_id, n_tokens, ids_sha256, decoded_sha256, and with with_ids the ids.

    The digests are of the decimal ids joined by single spaces, and of the decoded bytes. Null text counts
    as empty: no tokens, and the digests of nothing. Repeated rows are encoded each, a null id stays null,
    an empty table gives an empty result; other columns are not read. Tokens of any length, and words of
    any length, are encoded as the ranks say, without special tokens.
    """
    ranks = read_ranks(ranks_path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    buckets, most = ranges(spark, text_bytes(source), BUCKET_BYTES, 2), BLOCK_BYTES_WITH_IDS if with_ids else BLOCK_BYTES
    coded = encoded_words(dictionaries(source, pattern, buckets, most), ranks)
    return reassemble(coded, positions(source, pattern, buckets, most), table, with_ids)
