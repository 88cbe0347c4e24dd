"""What several operators share: hashed words in numpy, size checks, memory.

Words are maximal runs of bytes that are not ASCII white space (0x20, 0x09-0x0D). Their 64-bit
hashes come from one pass of prefix sums over the bytes, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.plans.shared import scratch, written

__all__ = ["scratch", "written"]

ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Largest tables, in bytes, that are sent to every executor; beyond it joins shuffle.
BROADCAST_BYTES = 16 << 20
#: Bytes of text that one vectorised step looks at.
STEP_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def row_bytes(kind: T.DataType) -> int:
    """What a value takes at most, with strings and binaries of 64 bytes and arrays of 16 values, as digests and signatures have."""
    if isinstance(kind, T.StructType):
        return 8 + sum(row_bytes(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return 16 * row_bytes(kind.elementType)
    return 64 if isinstance(kind, (T.StringType, T.BinaryType)) else 8


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table with a broadcast hint if its rows are within that many bytes, else as it is. (Parquet's footers have the number of rows.)"""
    return F.broadcast(df) if df.count() * row_bytes(df.schema) <= most else df


def release() -> None:
    """Give freed memory back to the system: Python workers live on after a task, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frees(f: Callable) -> Callable:
    """For functions of mapInArrow and mapInPandas: memory is given back when f and all it holds are gone."""

    def run(batches):
        yield from f(batches)
        release()

    return run


def frees_group(f: Callable) -> Callable:
    """The same for applyInPandas."""

    def run(frame):
        out = f(frame)
        release()
        return out

    return run


def frees_groups(f: Callable) -> Callable:
    """The same for applyInPandas of cogrouped frames."""

    def run(left, right):
        out = f(left, right)
        release()
        return out

    return run


#: Most rows of text that go to Python at once. Spark's own bound is in bytes and leaves executors less room.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, what a query shuffled is deleted when the query ends; else that waits for the driver's garbage collection, which may be long in coming.

    It is for queries that run once: one that is made within it and runs again would shuffle again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def text_bytes(source: DataFrame, column: str = "text") -> int:
    """Bytes in a column of texts; one pass over that column, in the JVM."""
    return source.agg(F.sum(F.octet_length(column))).first()[0] or 0


def ranges(spark: SparkSession, n_bytes: int, each: int, factor: int = 1) -> int:
    """Into how many hash ranges that much data is dealt: as many as hold `each` bytes, `factor` times the shuffle partitions at least."""
    return max(factor * shuffle_partitions(spark), -(-n_bytes // each))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit murmur hash."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


class Kept(dict):
    """What a process makes once. Functions travel by value, and a pickled Kept is empty, so tables are not sent along."""

    def __reduce__(self):
        return Kept, ()


_KEPT = Kept()


def _byte_values() -> np.ndarray:
    if "bytes" not in _KEPT:
        _KEPT["bytes"] = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
    return _KEPT["bytes"]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the base, and of its inverse; n + 1 of each at least."""
    n = max(STEP_BYTES * 2, 1 << max(1, n).bit_length())
    if "powers" not in _KEPT or len(_KEPT["powers"][0]) <= n:
        up, down = np.full(n + 1, _BASE, _U), np.full(n + 1, _INVERSE, _U)
        up[0] = down[0] = 1
        _KEPT["powers"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _KEPT["powers"]


def distinct(values: np.ndarray) -> np.ndarray:
    """Ascending. (np.unique hashes numbers of 64 bits, which is far slower than sorting them.)"""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def pack_ids(ids: list) -> bytes:
    """Ids, some of which may be None. (A list with nulls would reach pandas as floats, which large ids do not fit in.)"""
    return len(ids).to_bytes(4, "little") + np.packbits([i is None for i in ids]).tobytes() + np.array([i or 0 for i in ids], "<i8").tobytes()


def unpack_ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids (0 for None), and which are None."""
    n = int.from_bytes(data[:4], "little")
    return np.frombuffer(data, "<i8", n, 4 + (n + 7) // 8), np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, 4), count=n).astype(bool)


def nullable(ids: tuple[np.ndarray, np.ndarray]) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(ids[0].astype(np.int64), ids[1].copy())


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of numbers below 2^32: the rank of each among the distinct ones, and how often each of those occurs."""
    packed = np.sort(values.astype(_U) << _U(32) | np.arange(len(values), dtype=_U))
    if not len(packed):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.append(True, (packed[1:] ^ packed[:-1]) >> _U(32) != 0)
    rank = np.empty(len(packed), np.int64)
    rank[(packed & _U(0xFFFFFFFF)).astype(np.int64)] = np.cumsum(new) - 1
    return rank, np.diff(np.append(np.flatnonzero(new), len(packed)))


def in_order(keys: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of keys below 2^bits: the distinct ones, ascending; the places of all keys in that order; and at which of these another key begins.

    Leading bits and places are sorted as one number each, which is many times faster than sorting places by keys;
    the few keys with equal leading bits are then put in order.
    """
    n = len(keys)
    if not n:
        return keys, np.zeros(0, np.int64), np.zeros(0, bool)
    places = max(1, (n - 1).bit_length())
    low = _U((1 << places) - 1)
    packed = keys << _U(64 - bits) & ~low
    packed |= np.arange(n, dtype=_U)
    packed.sort()
    new = np.ones(n, bool)
    np.greater(packed[1:] ^ packed[:-1], low, out=new[1:])
    order = (packed & low).view(np.int64)
    if bits + places <= 64:  # no bit of a key is missing
        return (packed[new] & ~low) >> _U(64 - bits), order, new
    same = np.flatnonzero(~new)  # leading bits as before
    if len(same) and (keys[order[same]] != keys[order[same - 1]]).any():
        k, group = keys[order], np.cumsum(new) - 1
        some = np.zeros(group[-1] + 1, bool)
        some[group[same][k[same] != k[same - 1]]] = True
        at = np.flatnonzero(some[group])
        order[at] = order[at][np.lexsort((k[at], group[at]))]
        k = keys[order]
        new[1:] = k[1:] != k[:-1]
    return keys[order[new]], order, new


def spread(values: np.ndarray, order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Values of distinct keys, at the places of all keys. (Reading in order and writing to places is faster than looking each place's value up.)"""
    out = np.empty(len(order), values.dtype)
    out[order] = values[np.cumsum(new) - 1]
    return out


def ranked(keys: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys (below 2^bits), ascending, and the rank of each key among them."""
    every, order, new = in_order(keys, bits)
    return every, spread(np.arange(len(every), dtype=np.int32 if len(keys) < 1 << 31 else np.int64), order, new)


def digest(numbers: np.ndarray) -> int:
    """Of a set of numbers, in any order: a signed number of 64 bits. Digests of disjoint parts add up, modulo 2^64."""
    return int(mix(numbers).sum(dtype=_U).astype(np.int64)) if len(numbers) else 0


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """sums[j] - sums[i] times inverse power i is the polynomial hash of data[i:j]."""
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_byte_values()[data] * powers(len(data))[0][: len(data)], out=sums[1:])
    return sums


def is_space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def hash_words(data: bytes, space: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of data. space: the 256 flags of what parts words, if not ASCII white space."""
    space, out, at, n = is_space() if space is None else space, [], 0, len(data)
    while at < n:
        end = min(n, at + STEP_BYTES)
        while end < n and not space[data[end]]:  # up to the end of the word
            end += 1
        part = np.frombuffer(data, np.uint8, end - at, at)
        blank = np.ones(len(part) + 2, bool)
        blank[1:-1] = space[part]
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = edge[::2], edge[1::2]
        sums, back = prefix_sums(part), powers(len(part))[1]
        out.append((starts + at, ends + at, mix((sums[ends] - sums[starts]) * back[starts])))
        at = end
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def words_of(texts: list[bytes], space: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and at which word each text begins (one more: the end);
    the joined bytes with the words' starts and ends follow."""
    data = b"\n".join(texts)
    starts, ends, hashes = hash_words(data, space)
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    return hashes, np.searchsorted(starts, begins), data, starts, ends


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of size words; windows over a text's end have to be left out by the caller."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.zeros(n, _U)
    for k in range(size):
        total = total * _U(_BASE) + hashes[k : k + n]
    return mix(total + _U(size))


def slices(texts: list, most: int = 4 << 20):
    """Runs of texts with about that many bytes at most: (from, to)."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield at, i
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, len(texts)
