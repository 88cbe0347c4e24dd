"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

Features are unigrams and bigrams of words, unigrams and bigrams of word shapes (runs of one kind of
character collapsed: "Hello!!" is "Aa!"), and words that repeat the one before. They are hashed into
DIM weights; a feature's value is its share of the text's words. Training is on a bounded sample of
the labelled rows: shards of it train in parallel, each in passes over its own rows, and their weights
are averaged. A score is one sparse dot product; every text is scored in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import hash_words, is_space, mix, release, slices, small_batches, text_or_empty, words_of

BITS = 18
DIM = 1 << BITS
#: Bound on the labelled rows that are trained on (those with the smallest hashes of their id); each shard has a share.
TRAIN_ROWS, SHARDS, PASSES = 20_000, 8, 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
HELD_OUT_OF, THRESHOLD = 5, 0.3
#: The share of each kind of feature (word, word pair, shape, shape pair, repeat) in the score.
GAIN = np.array([2.0, 2.0, 4.0, 4.0, 4.0], np.float32)


def _classes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91], table[97:123], table[48:58], table[128:] = 65, 97, 48, 97
    return table


def shapes(data: bytes) -> bytes:
    """The bytes with letters and digits replaced by their kind, and repeated ones collapsed but for white space."""
    kinds = _classes()[np.frombuffer(data, np.uint8)]
    keep = np.ones(len(kinds), bool)
    keep[1:] = (kinds[1:] != kinds[:-1]) | is_space()[kinds[1:]]
    return kinds[keep].tobytes()


def token_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all texts' words in turn: a column of feature numbers for each kind (-1: none), at which word each text begins."""
    words, begins, data, _, _ = words_of(texts)
    _, _, forms = hash_words(shapes(data))
    first = np.zeros(len(words), bool)
    first[begins[:-1][begins[:-1] < begins[1:]]] = True
    out = np.full((len(GAIN), len(words)), -1, np.int64)
    cut = np.uint64(64 - BITS)

    def put(row: int, hashes: np.ndarray, where: np.ndarray | None = None) -> None:
        numbers = (mix(hashes + np.uint64((row + 1) * 0x632BE59BD9B4E019 % 2**64)) >> cut).astype(np.int64)
        out[row] = numbers if where is None else np.where(where, numbers, -1)

    def pairs(x: np.ndarray) -> np.ndarray:
        before = np.concatenate([x[:1], x[:-1]])
        return mix(before * np.uint64(0x9E3779B97F4A7C15) + x)

    put(0, words)
    put(1, pairs(words), ~first)
    put(2, forms)
    put(3, pairs(forms), ~first)
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    put(4, np.zeros(len(words), np.uint64), same & ~first)
    return out, begins, np.diff(begins)


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse vectors: feature numbers, and values."""
    out = []
    numbers, begins, sizes = token_features(texts)
    gain = np.repeat(GAIN[:, None], numbers.shape[1], 1)
    for a, b, n in zip(begins[:-1], begins[1:], sizes, strict=True):
        got, value = numbers[:, a:b].ravel(), gain[:, a:b].ravel()
        value, got = value[got >= 0], got[got >= 0]
        keys, at = np.unique(got, return_inverse=True)
        out.append((keys, np.bincount(at, value, len(keys)).astype(np.float32) / np.float32(max(1, n))))
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Per-coordinate FTRL-proximal with L1 and L2; the last weight is the bias, without L1."""

    def __init__(self, dim: int = DIM):
        self.z, self.n = np.zeros(dim + 1), np.zeros(dim + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == len(self.z) - 1, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def step(self, numbers: np.ndarray, values: np.ndarray, label: int) -> None:
        at, x = np.append(numbers, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        g = (sigmoid(float(w @ x)) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights (DIM, then the bias) from at most `rows` labelled rows; zeros if there are none."""
    small_batches(docs.sparkSession)
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)").withColumn("order", order).orderBy("order", "doc_id", "label").limit(rows)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for i, j in slices(texts):
                got = features(texts[i:j])
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], b.column(1)[i:j], pa.array([n.astype("<i4").tobytes() for n, _ in got], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in got], pa.binary())], ["shard", "label", "numbers", "vals"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        model = Ftrl()
        pdf = pdf.sort_values(["numbers", "vals", "label"])  # a shuffle has no fixed order
        sets = [(np.frombuffer(a, "<i4"), np.frombuffer(b, "<f4")) for a, b in zip(pdf["numbers"], pdf["vals"], strict=True)]
        y = pdf["label"].to_numpy()
        for k in range(PASSES):
            for i in np.random.default_rng(k).permutation(len(sets)):
                model.step(*sets[i], int(y[i]))
        return pd.DataFrame({"w": [model.weights(np.arange(DIM + 1)).astype("<f4").tobytes()], "n": [len(sets)]})

    rows_ = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    shards = rows_.select(F.pmod(F.crc32(F.concat(F.lit("shard"), F.col("doc_id").cast("string"))), F.lit(SHARDS)).cast("int").alias("shard"), "label", "text")
    fitted = shards.mapInArrow(vectors, "shard int, label int, numbers binary, vals binary").groupBy("shard").applyInPandas(fit, "w binary, n long").collect()  # SHARDS rows at most
    total = sum(r.n for r in fitted)
    return sum((np.frombuffer(r.w, "<f4").astype(float) * (r.n / total) for r in fitted), np.zeros(DIM + 1))


def scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Probabilities of label 1."""
    numbers, begins, sizes = token_features(texts)
    each = np.zeros(numbers.shape[1] + 1)
    table = np.append(weights[:DIM], 0.0)  # number -1 is the last: no feature
    for row, gain in zip(numbers, GAIN, strict=True):
        each[:-1] += gain * table[row]
    total = np.add.reduceat(each, begins[:-1]) if len(texts) else np.zeros(0)
    return sigmoid(np.where(sizes > 0, total / np.maximum(1, sizes), 0.0) + weights[DIM])


def held_out(column: str, of: int, remainder: int):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(of)) == remainder


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Labels of ids whose crc32 (of the id as text) leaves remainder 0 by HELD_OUT_OF are not learned from.
    Null text counts as empty; an empty text's score is the prior's, 0.5 if there were no labels. Null
    labels are left out; repeated label rows count each; a null id is held out. predicted is 1 from
    THRESHOLD on. An empty table gives an empty result; other columns are not read.
    """
    out = F.coalesce(held_out("doc_id", HELD_OUT_OF, 0), F.lit(True))
    score = scorer(fitted(docs, labels, id_col, text_col, label_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), score(text_or_empty(text_col).cast("binary")).alias("score"))
    return rows.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights learned from the labels that are not held out."""
    out = F.coalesce(held_out("doc_id", HELD_OUT_OF, 0), F.lit(True))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("quality"))
    return train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), known.where(~out), label_col="quality")


def scorer(weights: np.ndarray):
    """A column function from texts as binary to scores; other columns stay in the JVM."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        listed = texts.to_list()
        got = [scores([bytes(t) for t in listed[i:j]], weights) for i, j in slices(listed, 1 << 20)]
        del listed
        release()
        return pd.Series(np.concatenate(got) if got else np.zeros(0))

    return score


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """docs, with all their columns, without the rows that score below THRESHOLD."""
    score = scorer(fitted(docs, labels, id_col, text_col, label_col))
    return docs.where(score(text_or_empty(text_col).cast("binary")) >= THRESHOLD)
