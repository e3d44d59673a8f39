"""Labelled rows to learn from: a bounded sample of whole rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_ids(labels: DataFrame, label: str, limit: int, id_col: str = "doc_id") -> DataFrame:
    """(id, y) of at most ``limit`` labelled rows that are not held out, by the order of a hash of the id; one row an id."""
    own = labels.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("double").alias("y"))
    return own.orderBy(F.xxhash64("id"), "id").limit(limit)
