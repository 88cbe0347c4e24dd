"""Near-duplicate documents by SuperMinHash, banding, verification on full sets and components.

1. Every text becomes its set of hashed 5-word shingles, a digest of the set, and a SuperMinHash
   signature: in round j an element draws a value in [j, j+1) for the j-th place of its own random
   permutation of the slots, and a document stops once no slot can be lowered any more.
2. Documents with equal sets are one class; its smallest id stands for it.
3. Bands of the signatures put classes into buckets. Each member of a bucket is compared with the
   bucket's smallest member on the full sets (links, not all pairs), and components are formed.
4. Buckets whose members are then still in several components are compared block by block, on
   signatures, on finer signatures that only their members get, and then on the full sets, so no link
   between different texts is lost to step 3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import distinct, frees, frees_group, mix, slices, small, small_batches, text_or_empty, windows, words_of, written
from quarry.llm.graph import components

SHINGLE, PERCENT = 5, 75
#: 32 bands of 4 slots: a pair at similarity 0.75 meets in none of them once in 200,000 times, and seldom above.
BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
#: Step 4: members in a block; slots of the finer signatures, of which two bits each are kept; and how far (in
#: standard deviations) below the threshold an estimate rules a pair out.
BLOCK, FINE_SLOTS, SIGMAS = 512, 1024, 5
_U = np.uint64


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Distinct hashed shingles of each text, ascending; a text of fewer words is one shingle."""
    hashes, begins, *_ = words_of([t.lower() for t in texts])
    every = windows(hashes, SHINGLE)
    out = []
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        out.append(distinct(every[a : b - SHINGLE + 1]) if b - a >= SHINGLE else windows(hashes[a:b], int(b - a)) if b > a else np.zeros(0, _U))
    return out


def superminhash(elements: np.ndarray, owner: np.ndarray, owners: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures, a row of slots for each owner of elements (owner: ascending). Values are round * 2^32 + a 32-bit draw."""
    sig = np.full(owners * slots, ~_U(0))
    perm = picked = None
    for j in range(slots):
        draw = mix(elements + _U((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        k = j + ((draw & _U(0xFFFFFFFF)) * _U(slots - j) >> _U(32)).astype(np.int64)
        if j == 0:
            picked = slot = k
        else:
            if perm is None:  # only what goes beyond the first round needs its permutation
                perm = np.tile(np.arange(slots, dtype=np.int16), (len(elements), 1))
                rows = np.arange(len(elements))
                perm[rows, picked], perm[:, 0] = 0, picked
            rows = np.arange(len(elements))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(sig, owner * slots + slot, (_U(j) << _U(32)) | (draw >> _U(32)))
        open_ = (sig.reshape(owners, slots) >= (_U(j + 1) << _U(32))).any(1)  # early stopping, by document
        go = open_[owner]
        left = int(go.sum())
        if not left:
            break
        if perm is None or left < len(go) // 2:  # elements of documents that have stopped do no harm, but cost time
            elements, owner, picked = elements[go], owner[go], picked[go]
            perm = perm[go] if perm is not None else None
    return sig.reshape(owners, slots)


def signatures(sets: list[np.ndarray], most: int = 100_000, slots: int = SLOTS) -> np.ndarray:
    """In steps of about `most` elements."""
    out, at = [], 0
    while at < len(sets):
        to, held = at, 0
        while to < len(sets) and (to == at or held + len(sets[to]) <= most):
            held, to = held + len(sets[to]), to + 1
        sizes = [len(s) for s in sets[at:to]]
        out.append(superminhash(np.concatenate(sets[at:to]), np.repeat(np.arange(to - at), sizes), to - at, slots))
        at = to
    return np.concatenate(out) if out else np.zeros((0, slots), _U)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    rows = sig.reshape(len(sig), BANDS, ROWS)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        total = mix(total * _U(0x9E3779B97F4A7C15) + rows[:, :, r])
    return total.view(np.int64)


def fine(sets: list[np.ndarray]) -> list[bytes]:
    """Two bits of each of FINE_SLOTS slots: half of the bytes have the first bits, the other half the second ones."""
    sig = mix(signatures(sets, 20_000, FINE_SLOTS))
    return [np.packbits(np.stack([s & _U(1), s >> _U(1) & _U(1)]).astype(np.uint8), axis=1).tobytes() for s in sig]


def _lists(values: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(values).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1] if values.ndim > 1 else 1), pa.int32()), flat)


def sketches(docs: DataFrame) -> DataFrame:
    """Of rows (doc_id, text as binary): doc_id, n_shingles, d1, d2 (a digest of the set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(texts, 1 << 20):
                sets = shingle_sets(texts[i:j])
                n = np.array([len(s) for s in sets], np.int64)
                d = [np.array([mix(s ^ _U(k)).sum(dtype=_U) for s in sets], _U).view(np.int64) for k in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(n), pa.array(d[0]), pa.array(d[1]), _lists(band_keys(signatures(sets)))], ["doc_id", "n_shingles", "d1", "d2", "bands"])

    return docs.mapInArrow(frees(run), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """Of rows (doc_id, text as binary): id, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(texts, 1 << 20):
                sets = shingle_sets(texts[i:j])
                ends = np.cumsum([0] + [len(s) for s in sets])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], lists], ["id", "shingles"])

    return docs.mapInArrow(frees(run), "id long, shingles array<long>")


def fine_signatures(docs: DataFrame) -> DataFrame:
    """Of rows (doc_id, text as binary): id, bands, fine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(texts, 1 << 20):
                sets = shingle_sets(texts[i:j])
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], _lists(band_keys(signatures(sets))), pa.array(fine(sets), pa.binary())], ["id", "bands", "fine"])

    return docs.mapInArrow(frees(run), "id long, bands array<long>, fine binary")


def similar(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return 100 * shared >= PERCENT * (F.size(a) + F.size(b) - shared)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. texts: doc_id, text as binary."""
    ids = written(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    sets = full_sets(texts.join(small(ids), "doc_id", "left_semi"))
    sets = written(sets, "sets")
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    return written(pairs.join(right, "b").join(left, "a").where(similar(F.col("sa"), F.col("sb"))).select("a", "b"), "links")


def floor_at(slots: int, agree: float) -> float:
    """Equal slots below which a pair at the threshold is not to be expected; agree: how often unequal slots look equal."""
    p = PERCENT / 100 + (1 - PERCENT / 100) * agree
    return slots * p - SIGMAS * (slots * p * (1 - p)) ** 0.5


def block_pairs(members: DataFrame, rows: int) -> DataFrame:
    """Candidates (a, b) of different components within each bucket, by blocks of members.

    members: bucket, id, component, bands, fine, and of the bucket main (its largest component), n and
    n_main; rows: how many there are. Members of the main component need no comparison with each other:
    they are dealt into blocks by hash, the rest into other blocks, and every block of the rest meets every
    block in a group of 2 * BLOCK rows or so. A bucket of BLOCK members or fewer is one block, and such
    buckets share groups of about that size. Pairs whose signatures put them SIGMAS deviations below the
    threshold are ruled out; a pair that meets in several buckets is emitted in the one of its first band.
    """
    whole = F.col("n") <= BLOCK
    main = F.col("component") == F.col("main")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    of_main, of_rest = blocks(F.col("n_main")), blocks(F.col("n") - F.col("n_main"))
    deal = lambda n: F.pmod(F.xxhash64("id"), n.cast("long")).cast("int")
    own = F.when(whole, 0).when(main, deal(of_main)).otherwise(of_main + deal(of_rest))
    first = F.when(whole | ~main, 0).otherwise(of_main)
    last = F.when(whole, 0).otherwise(of_main + of_rest - 1)
    rest = ["id", "component", "bands", "fine"]
    every = members.select("bucket", whole.alias("whole"), *rest, own.alias("own"), F.explode(F.sequence(first, last)).alias("other"))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    group = F.when(F.col("whole"), F.pmod(F.xxhash64("bucket"), F.lit(rows // (2 * BLOCK) + 1))).otherwise(F.xxhash64("bucket", i, j))
    keyed = every.select(group.alias("group"), "bucket", i.alias("i"), j.alias("j"), "own", *rest)
    least = floor_at(FINE_SLOTS, 0.25)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "i", "j"], kind="stable")
        key = pdf[["bucket", "i", "j", "own", "id", "component"]].to_numpy(np.int64)
        bands, prints = np.stack(pdf["bands"].to_list()), np.frombuffer(b"".join(pdf["fine"]), np.uint64).reshape(len(pdf), 2, -1)
        cuts = np.flatnonzero(np.append(True, (key[1:, :3] != key[:-1, :3]).any(1)))
        found = [np.zeros((0, 2), np.int64)]
        for a, b in zip(cuts, [*cuts[1:], len(pdf)], strict=True):
            bucket, i, j = key[a, :3]
            first, second = (a + np.flatnonzero(key[a:b, 3] == x) for x in (i, j))
            if not len(first) or not len(second):
                continue
            ids, components_ = key[:, 4], key[:, 5]
            band = int((bands[a] == bucket).argmax())
            for k in first:
                go = second[(components_[second] != components_[k]) & ((ids[second] > ids[k]) if i == j else (ids[second] != ids[k]))]
                if not len(go):
                    continue
                unlike = prints[go] ^ prints[k]
                go = go[FINE_SLOTS - np.bitwise_count(unlike[:, 0] | unlike[:, 1]).sum(1, dtype=np.int64) >= least]
                go = go[~(bands[go, :band] == bands[k, :band]).any(1)]
                found.append(np.stack([np.minimum(ids[k], ids[go]), np.maximum(ids[k], ids[go])], 1))
        pairs = np.concatenate(found)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return keyed.groupBy("group").applyInPandas(frees_group(compare), "a long, b long").distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * shared >= 75 * united shingles; component_id is the smallest id that can
    be reached. A null, empty or blank text has no shingles and is linked with nothing; neither is a row
    without an id (component_id null, kept). Rows that share an id are one document with several texts.
    An empty table gives an empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    sketched = written(sketches(texts), "sketches")
    some = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = written(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")), "classes")
    placed = classes.select("id", F.explode("bands").alias("bucket"))
    pivots = placed.groupBy("bucket").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last").select("bucket", "pivot")
    shared = written(placed.join(pivots, "bucket"), "shared")  # buckets of two classes or more
    pairs = written(shared.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = verified(pairs, texts)
    labels = written(components(links), "labels")
    rest = written(unsettled(shared, labels), "unsettled")
    ids = written(rest.select(F.col("id").alias("doc_id")).distinct(), "ids")
    finer = fine_signatures(texts.join(small(ids), "doc_id", "left_semi")).dropDuplicates(["id", "fine"])  # an id may have several texts
    members = rest.join(written(finer, "fine"), "id").where("array_contains(bands, bucket)")
    more = written(block_pairs(members, rest.count()), "pairs")
    if not more.isEmpty():
        links = links.unionByName(verified(more, texts))
        labels = written(components(links), "labels")
    known = written(classes.select("d1", "d2", "id").join(labels, "id").select("d1", "d2", "component").unionByName(classes.join(labels, "id", "left_anti").select("d1", "d2", F.col("id").alias("component"))), "known")
    in_class = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.when(in_class, F.col("component")).otherwise(F.col("doc_id"))
    return sketched.select("doc_id", "n_shingles", "d1", "d2").join(small(known), ["d1", "d2"], "left").select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def unsettled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (bucket, id, component, main, n, n_main) of buckets whose members are in several components."""
    placed = shared.select("bucket", "id").join(labels, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    largest = F.max(F.struct("size", "component")).alias("largest")
    open_ = sizes.groupBy("bucket").agg(largest, F.sum("size").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    return placed.join(open_.select("bucket", F.col("largest.component").alias("main"), "n", F.col("largest.size").alias("n_main")), "bucket")
