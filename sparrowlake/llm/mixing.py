"""Mixing sources to target weights by Poisson replication.

Each document's number of copies is drawn by inverting a Poisson distribution at a uniform number that is a hash
of seed and id; the mean is its source's target repetition rate. Copies are exploded and dealt to partitions and
sorted by a hash, which is a global shuffle without a second pass for range bounds.

Rates over ``STEP`` are split into equal parts whose independent draws are summed (exp(-rate) stays normal).

Defined results: a null source is a source of its own; rows with the same id are drawn alike; null ids draw as
the text 'null'; sources without a target weight get weight 0 and hence no copy; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 64.0
#: Source tables up to so many rows are broadcast; beyond, the rates are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_count(u: Column, rate: Column) -> Column:
    """The smallest k whose cumulative probability exceeds u; terms end where double precision does."""
    terms = F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int"))
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * rate / i
        return F.when(u < acc["cdf"], acc).otherwise(F.struct(i.alias("k"), p.alias("p"), (acc["cdf"] + p).alias("cdf")))

    return F.aggregate(terms, start, step, lambda acc: acc["k"])


def source_rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, temperature: float, size: float) -> DataFrame:
    """Rate of each source: target share x size x rows / rows of the source.

    Without ``weights`` the target share is in proportion to rows ** temperature.
    """
    counts = docs.groupBy(F.col(source_col).alias("src")).agg(F.count("*").alias("n"))
    if weights is None:
        target = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        target = F.lit(0.0)
        for name, weight in weights.items():
            target = F.when(F.col("src").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(target)
    counts = counts.withColumn("target", target)
    totals = counts.agg(F.sum("target").alias("all_target"), F.sum("n").alias("all_n"))
    rate = F.when(F.col("all_target") > 0, F.col("target") / F.col("all_target") * F.col("all_n") * size / F.col("n")).otherwise(0.0)
    return counts.crossJoin(F.broadcast(totals)).select("src", rate.alias("rate"))  # totals: one row


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    size: float = 1.0,
    seed: int = 7,
) -> DataFrame:
    """The documents' copies in shuffled order: all columns, then copy_no (from 1)."""
    rates = source_rates(docs, source_col, weights, temperature, size)
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    rates = rates.withColumnsRenamed({"src": "_mix_src", "rate": "_mix_rate"})
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    parts = F.ceil(F.col("_mix_rate") / STEP).cast("int")
    draws = F.transform(F.sequence(F.lit(1), parts), lambda j: poisson_count(uniform(F.lit(str(seed)), ident, j.cast("string")), F.col("_mix_rate") / parts))
    copies = F.when(F.col("_mix_rate") > 0, F.aggregate(draws, F.lit(0), lambda a, b: a + b)).otherwise(0)
    drawn = docs.join(rates, docs[source_col].eqNullSafe(F.col("_mix_src"))).withColumn("_mix_copies", copies).where("_mix_copies > 0")
    exploded = drawn.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))))
    order = F.xxhash64(F.lit(seed), ident, F.col("copy_no"))
    columns = [F.col(f"`{c}`") for c in docs.columns if c != "copy_no"]
    return exploded.withColumn("_mix_order", order).repartition("_mix_order").sortWithinPartitions("_mix_order").select(*columns, "copy_no")
