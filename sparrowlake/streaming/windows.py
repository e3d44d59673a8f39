"""Tumbling, sliding and session windows, the same for bounded tables and streams. On streams a watermark bounds the state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, size: str, slide: str | None = None, *, session: bool = False, late: str = "10 minutes", time_col: str = "ts", keys: tuple[str, ...] = ("event_type",), value_col: str = "value") -> DataFrame:
    """Count and total of each window and key. ``session``: windows end after a gap of ``size`` without events of the key."""
    if events.isStreaming:
        events = events.withWatermark(time_col, late)
    window = F.session_window(time_col, size) if session else F.window(time_col, size, slide or size)
    out = events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(F.col(value_col).cast("decimal(18,4)")).cast("double").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), *keys, "n", "total")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def ext_tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(_events(spark, sf_dir), "1 hour")


def ext_sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(_events(spark, sf_dir), "2 hours", "1 hour")


def ext_session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(_events(spark, sf_dir), "30 minutes", session=True)


_TOTALS = "event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total"
ORACLES = {
    "ext_tumbling_window": f"SELECT date_trunc('hour', ts) AS start, {_TOTALS} FROM events GROUP BY ALL",
    "ext_sliding_window": f"SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS start, {_TOTALS} FROM events, (VALUES (0), (1)) t(k) GROUP BY ALL",
    "ext_session_window": f"""WITH marked AS (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 30 MINUTES, true) AS fresh FROM events),
numbered AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM marked)
SELECT min(ts) AS start, {_TOTALS} FROM numbered GROUP BY event_type, s""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (ext_tumbling_window, ext_sliding_window, ext_session_window)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
