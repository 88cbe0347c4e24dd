"""Exact deduplication with counting quotient filters.

1. Every partition puts the 64-bit fingerprints of its normalised texts into counting quotient
   filters, one for each range of the leading bits, and emits them as packed blocks.
2. The blocks of a range meet in one task and merge losslessly: a filter is read in the order of
   quotients and remainders, so a merge is a merge of sorted runs that adds the counts.
3. Fingerprints counted once are unique texts. The others' rows go to byte verification: they are
   grouped by the normalised bytes themselves, after partial aggregation within every task.

The number of ranges follows the number of rows, so a range stays small at any size.
Nothing but fingerprints is shuffled for unique texts; of copies a task sends each text once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ASCII_SPACE, ranges, small, text_or_empty, written


#: Rows for each range of leading bits.
RANGE_ROWS = 1 << 20


class CountingQuotientFilter:
    """Keys of `bits` bits with counts, in a table of slots with linear probing.

    A key's leading `q` bits are its quotient (its home slot), the rest its remainder. Remainders of
    a quotient stand together in ascending order (a run); `occupied` marks quotients with a run,
    `run_end` the last slot of each run, and `counter` slots that hold the count of the remainder
    before them (a remainder without one counts 1).
    """

    def __init__(self, bits: int, q: int, slots: np.ndarray, occupied: np.ndarray, run_end: np.ndarray, counter: np.ndarray, used: np.ndarray):
        self.bits, self.q, self.slots, self.occupied, self.run_end, self.counter, self.used = bits, q, slots, occupied, run_end, counter, used

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """keys: ascending and distinct."""
        words = 1 + (counts > 1)
        n = int(words.sum())
        q = min(bits - 1, max(1, int(n * 4 / 3)).bit_length())
        r = bits - q
        quotients = (keys >> np.uint64(r)).astype(np.int64)
        first = np.cumsum(words) - words  # place of each key if all stood without gaps
        home = np.maximum.accumulate(quotients - first) + first  # linear probing of a sorted sequence
        size = max(1 << q, int(home[-1]) + int(words[-1])) if len(keys) else 1 << q
        slots, used, run_end, counter = np.zeros(size, np.uint64), np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, bool)
        slots[home] = keys & np.uint64((1 << r) - 1)
        used[home] = True
        many = counts > 1
        slots[home[many] + 1] = counts[many].astype(np.uint64)
        used[home[many] + 1] = counter[home[many] + 1] = True
        occupied = np.zeros(1 << q, bool)
        occupied[quotients] = True
        last = np.append(quotients[1:] != quotients[:-1], True)[: len(keys)]
        run_end[(home + words - 1)[last]] = True
        return cls(bits, q, slots, occupied, run_end, counter, used)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys in ascending order, and counts."""
        r = self.bits - self.q
        at = np.flatnonzero(self.used)
        run = np.cumsum(self.run_end[at]) - self.run_end[at]  # the k-th run belongs to the k-th occupied quotient
        head = ~self.counter[at]
        keys = (np.flatnonzero(self.occupied)[run[head]].astype(np.uint64) << np.uint64(r)) | self.slots[at[head]]
        counts = np.ones(len(keys), np.int64)
        counted = np.flatnonzero(~head)
        counts[np.cumsum(head)[counted] - 1] = self.slots[at[counted]].astype(np.int64)
        return keys, counts

    def pack(self) -> bytes:
        """Flags as bits, and only the slots in use, each in as many bytes as a remainder or counter needs."""
        held = self.slots[self.used]
        width = max(1, (max(self.bits - self.q, int(held.max()).bit_length() if len(held) else 1) + 7) // 8)
        raw = held.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        flags = b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.used, self.run_end, self.counter))
        return struct.pack("<BBBQQ", self.bits, self.q, width, len(self.slots), len(held)) + flags + raw

    @classmethod
    def unpack(cls, data: bytes) -> CountingQuotientFilter:
        bits, q, width, size, n = struct.unpack_from("<BBBQQ", data)
        at, flags = struct.calcsize("<BBBQQ"), []
        for length in (1 << q, size, size, size):
            step = (length + 7) // 8
            flags.append(np.unpackbits(np.frombuffer(data, np.uint8, step, at), count=length).astype(bool))
            at += step
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        occupied, used, run_end, counter = flags
        slots = np.zeros(size, np.uint64)
        slots[used] = wide.reshape(-1).view("<u8")
        return cls(bits, q, slots, occupied, run_end, counter, used)

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Lossless: sorted runs of keys are merged and the counts of equal keys added."""
        parts = [f.items() for f in filters]
        keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
        order = np.argsort(keys, kind="stable")
        return cls.build(*_summed(keys[order], counts[order]), filters[0].bits)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def repeated_fingerprints(prints: DataFrame, blocks: int) -> DataFrame:
    """(fp, n) of the fingerprints in column fp that occur more than once. blocks: ranges of leading bits, a power of two."""
    lead = blocks.bit_length() - 1
    bits = 64 - lead

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches if b.num_rows]
        if not found:
            return
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        block = keys >> np.uint64(bits) if lead else np.zeros(len(keys), np.uint64)
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        ends = np.append(starts[1:], len(keys))
        mask = np.uint64((1 << bits) - 1) if lead else np.uint64(2**64 - 1)
        for at in range(0, len(starts), 1000):
            some = list(zip(starts[at : at + 1000], ends[at : at + 1000], strict=True))
            packed = [CountingQuotientFilter.build(keys[s:e] & mask, counts[s:e], bits).pack() for s, e in some]
            yield pa.RecordBatch.from_arrays([pa.array([int(block[s]) for s, _ in some], pa.int64()), pa.array(packed, pa.binary())], ["block", "filter"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = CountingQuotientFilter.merge([CountingQuotientFilter.unpack(x) for x in pdf["filter"]])
        keys, counts = whole.items()
        many = counts > 1
        lead_bits = np.uint64(int(pdf["block"].iloc[0]) << bits if lead else 0)
        return pd.DataFrame({"fp": (keys[many] | lead_bits).view(np.int64), "n": counts[many]})

    packed = prints.select("fp").mapInArrow(build, "block long, filter binary")
    return packed.groupBy("block").applyInPandas(merge, "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ASCII white space; of equal texts the longest
    original (in code points), then the smallest id stays. Null text counts as empty; empty texts are
    equal to each other. Rows that repeat an id are separate members of their group, and have the same
    answer. A null id yields to any id at equal length. An empty table gives an empty result; other
    columns are not read.
    """
    spark = docs.sparkSession
    raw = text_or_empty(text_col)
    norm = F.translate(raw, ASCII_SPACE, "")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(raw).cast("long").alias("len"), norm.alias("norm"))
    fp = F.xxhash64("norm").alias("fp")
    slim = written(source.select("doc_id", "len", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), fp), "prints")
    blocks = 1 << (ranges(spark, slim.count(), RANGE_ROWS) - 1).bit_length()
    repeated = written(repeated_fingerprints(slim, blocks).select("fp"), "repeated")
    verified = (
        source.select("doc_id", "len", "norm", fp)
        .join(small(repeated), "fp")
        .groupBy("fp", "norm")
        .agg(F.max(F.struct("len", F.bitwise_not("doc_id").alias("not_id"))).alias("best"), F.count("*").alias("group_size"))
        .select("fp", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.bitwise_not("best.not_id").alias("keep_id"), "group_size", F.lit(True).alias("copied"))
    )
    keep = F.when(F.col("copied"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return slim.join(small(written(verified, "classes")), ["fp", "text_sha256"], "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256"
    )
