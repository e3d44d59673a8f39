"""Exact deduplication by a stateful stream.

A Structured Streaming aggregation without watermark keeps, for ever and on disk (RocksDB state store), one
state row for each digest: the digest, the stable identifier of the row that stays, its content locator (file
and row in that file) and the number of rows seen. Copies are combined before the shuffle, so a text that makes
up a third of all rows costs one row per task. Digest hits are then confirmed on full bytes: each row of a
digest with more than one row is compared with the text at the locator; groups are salted by their size. Rows
whose bytes differ although the digest is equal are regrouped by the bytes themselves.

Defined results: null text counts as empty; of equal texts the row with the largest id stays, between rows with
the same id the one with the largest locator; a null id is smaller than any other; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowlake.llm.common import drop, forget, fresh_path, written

#: Members of a group that are compared with one copy of the kept text.
ROWS_PER_SALT = 1000
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(frame: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    locator = F.struct(F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return frame.select(locator.alias("at"), digest(text).alias("digest"), text.alias("body"))


def stream_state(spark: SparkSession, path: str, id_col: str, text_col: str, digest: Callable[[Column], Column], files_per_batch: int | None) -> DataFrame:
    """Run the stream over all files under ``path``; its state as a table (digest, keep, n)."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # a path that is one file is no base path for a stream; as a pattern, both a file and a folder are read
    plain = re.sub(r"([\[\]{}*?\\])", r"\\\1", path.rstrip("/"))
    rows = _rows(reader.parquet(f"{plain[:-1]}[{plain[-1]}]" if plain == path.rstrip("/") else plain), id_col, text_col, digest)
    state = rows.groupBy("digest").agg(F.max("at").alias("keep"), F.count("*").alias("n"))
    work = fresh_path(spark, "exact-dedup")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/state/batch={batch_id}")

    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    try:
        for k, v in ROCKSDB.items():
            spark.conf.set(k, v)
        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{work}/checkpoint").foreachBatch(store).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    batches = 1 + (query.lastProgress["batchId"] if query.lastProgress else -1)
    forget(spark, f"{work}/checkpoint")
    if not batches:
        return spark.createDataFrame([], state.schema)
    found = spark.read.schema(state.schema).option("recursiveFileLookup", "true").parquet(f"{work}/state")
    if batches == 1:
        return found
    # a digest's count grows with each batch, so its largest row is its last
    last = found.groupBy("digest").agg(F.max(F.struct("n", "keep")).alias("last"))
    return last.select("digest", "last.keep", "last.n")


def exact_dedup(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_digest,
    files_per_batch: int | None = None,
) -> DataFrame:
    """One row for each row under the Parquet ``path``: id, locator, keep_id, group_size, kept, digest."""
    state = stream_state(spark, path, id_col, text_col, digest, files_per_batch)
    rows = _rows(spark.read.parquet(path), id_col, text_col, digest)
    hits = state.where("n > 1")
    grouped = rows.drop("body").join(hits, "digest", "left").select(
        "at", "digest", F.coalesce("keep", "at").alias("keep"), F.coalesce("n", F.lit(1)).alias("n")
    )

    members_table = written(rows.join(hits, "digest"), "exact-members")
    members = members_table.withColumn("salts", F.ceil(F.col("n") / ROWS_PER_SALT).cast("int"))
    kept = members.where(F.col("at") == F.col("keep")).select("digest", F.col("body").alias("kept_body"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    others = members.where(F.col("at") != F.col("keep")).withColumn("salt", F.pmod(F.hash("at"), "salts"))
    differing = others.join(kept, ["digest", "salt"]).where(F.col("body") != F.col("kept_body")).select("digest").distinct()
    collisions = not differing.isEmpty()
    if not collisions:
        drop(members_table)
    else:
        by_bytes = rows.join(differing, "digest", "left_semi")
        classes = by_bytes.groupBy("digest", "body").agg(F.max("at").alias("keep"), F.count("*").alias("n"))
        regrouped = by_bytes.join(classes, ["digest", "body"]).select("at", "digest", "keep", "n")
        grouped = grouped.join(differing, "digest", "left_anti").select("at", "digest", "keep", "n").unionByName(regrouped)
    return grouped.select(
        F.col("at.id").alias(id_col), F.col("keep.id").alias("keep_id"), F.col("n").cast("long").alias("group_size"), F.col("at").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), F.struct("at.file", "at.row").alias("locator"),
    )
