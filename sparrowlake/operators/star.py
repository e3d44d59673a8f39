"""Star joins: what a filtered dimension's keys say about the fact table, applied before the join.

Only inner and left-semi joins may narrow their fact side, and only by the column of that very join. The dimension is
read once for min, max and the distinct count of its keys; dense integer keys become a range, few keys a list, and
other dimensions nothing. What comes out is an ordinary filter, which prunes files of snapshot tables and is pushed
into Parquet scans; the join itself stays as it was, so results never depend on it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowlake.operators.predicate import Always, Predicate, col

#: Facts below so many rows are not worth a look at the dimension; dimensions above it are not read for keys.
LARGE_ROWS = 524_288
MOST_KEYS = 131_072
DENSE = 4


@dataclass(frozen=True)
class Edge:
    """One dimension of a star join: fact.key = dimension.key."""

    dimension: DataFrame
    fact_key: str
    dimension_key: str
    how: str = "inner"


def key_bounds(dimension: DataFrame, dimension_key: str, fact_key: str, most_rows: int = LARGE_ROWS, most_keys: int = MOST_KEYS) -> Predicate:
    """A predicate on ``fact_key`` that every row with a partner in ``dimension`` meets."""
    keys = dimension.select(F.col(dimension_key).alias("k")).where(F.col("k").isNotNull()).distinct()
    found = keys.agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).first()
    if found.n == 0:
        return Always(False)
    if found.n > most_rows:
        return Always(True)
    whole = isinstance(keys.schema["k"].dataType, T.IntegralType)
    if whole and found.hi - found.lo + 1 <= DENSE * found.n:
        return col(fact_key, ">=", found.lo) & col(fact_key, "<=", found.hi)
    if found.n <= most_keys:
        return col(fact_key, "in", sorted(r.k for r in keys.collect()))  # at most ``most_keys`` values
    return Always(True)


def bounds(edges: list[Edge], fact_rows: int | None = None) -> Predicate:
    """The conjunction over the edges that may narrow the fact; nothing for small facts."""
    out: Predicate = Always(True)
    if fact_rows is not None and fact_rows < LARGE_ROWS:
        return out
    for e in edges:
        if e.how in ("inner", "left_semi"):
            out = out & key_bounds(e.dimension, e.dimension_key, e.fact_key)
    return out


def star_join(fact: DataFrame, edges: list[Edge], broadcast_rows: int = LARGE_ROWS) -> DataFrame:
    """Join the dimensions to the fact, smallest first; those of a checked size are broadcast."""
    sized = []
    for e in edges:
        n = e.dimension.limit(broadcast_rows + 1).count()
        sized.append((n, e))
    out = fact
    for n, e in sorted(sized, key=lambda x: x[0]):
        dimension = F.broadcast(e.dimension) if n <= broadcast_rows else e.dimension
        out = out.join(dimension, out[e.fact_key] == dimension[e.dimension_key], e.how)
    return out
