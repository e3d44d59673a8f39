"""The corpus pipeline: quality classifier, line dedup, near dedup, benchmark decontamination, mixing to target weights.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and is written before the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowlake.llm.common import drop, table, written
from sparrowlake.llm.decontaminate import decontaminate
from sparrowlake.llm.line_dedup import dedup_lines
from sparrowlake.llm.mixing import mix
from sparrowlake.llm.near_dedup import near_dedup
from sparrowlake.llm.quality import score_quality, train_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.5) go. Null texts score as empty ones; repeated rows alike."""
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).where("score >= 0.5").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines are taken out of the texts (n_chars follows); documents left without any text go."""
    kept = dedup_lines(docs.select(*COLUMNS).withColumn("_was_empty", F.coalesce(F.trim("text") == "", F.lit(True))))
    return kept.where("_was_empty or text != ''").withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity of 0.85 or more) stays, the one with the smallest id.

    Documents without words, and those without an id, stay. Of rows that share an id each text is judged on its own;
    rows alike in id and text are one document.
    """
    found = near_dedup(docs.select("doc_id", "text"))
    gone = found.where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    return docs.join(gone, same, "left_anti").select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with words inside a benchmark window go. Null and empty texts have no words and stay."""
    judged = decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return judged.where("n_hit = 0").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document by its Poisson count, shuffled; copy_no tells copies apart. Rows with the same id draw alike; a null source is a source."""
    return mix(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Training the classifier and joining paths of minwise tokens is not for SQL; tests hold run() against brute force.
ORACLE_SQL = None
