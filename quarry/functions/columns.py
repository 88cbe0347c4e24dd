"""Columns that are costly to compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with these columns, each computed once a row.

    A filter on a projected column is pushed below the projection, into the join under it too, and every use repeats the
    expression. The rows of a generator are not seen through: filters on them stay above it.
    """
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))
