"""Vectors as arrays of doubles."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import analyze

DIMENSIONS = 256
MODEL = "hashing-sha2/1"
#: Texts that are embedded in one vectorised step.
STEP = 500


def dot(a: Column, b: Column) -> Column:
    """Cosine similarity of unit vectors. Null for vectors of different length."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(F.transform(a, lambda x: x.cast("double")))


def shorten(a: Column, dimensions: int) -> Column:
    """The leading dimensions, as a unit vector."""
    return unit(F.slice(a, 1, dimensions))


def hash_embed(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Signed feature hashing of the terms with weight 1 + ln(count), as a unit vector; zeros for a text without terms.

    A term's bucket is the number of the first eight hexadecimal digits of its SHA-256 by the dimensions,
    its sign the ninth digit's top bit. One Arrow pass over the terms, without a shuffle.
    """

    @F.pandas_udf("array<double>")
    def embed(rows: pd.Series) -> pd.Series:
        out = [np.zeros((0, dimensions))]
        for a in range(0, len(rows), STEP):
            some = [np.asarray(r, object) for r in rows.iloc[a : a + STEP]]
            codes, terms = pd.factorize(np.concatenate([*some, np.zeros(0, object)]))
            digests = [hashlib.sha256(t.encode()).hexdigest() for t in terms]  # a term's once in a step
            bucket = np.array([int(d[:8], 16) % dimensions for d in digests], np.int64)
            sign = np.array([1.0 if d[8] >= "8" else -1.0 for d in digests])
            pair, n = np.unique(np.repeat(np.arange(len(some)), [len(r) for r in some]) * max(1, len(terms)) + codes, return_counts=True)
            row, term = np.divmod(pair, max(1, len(terms)))
            got = np.zeros((len(some), dimensions))
            np.add.at(got, (row, bucket[term]), sign[term] * (1.0 + np.log(n)))
            length = np.sqrt((got * got).sum(1, keepdims=True))
            out.append(got / np.where(length > 0, length, 1.0))
        return pd.Series(list(np.concatenate(out)))

    if dimensions < 8:
        raise ValueError("a hashed vector needs 8 dimensions at least")
    return embed(F.coalesce(analyze(text), F.array().cast("array<string>")))
