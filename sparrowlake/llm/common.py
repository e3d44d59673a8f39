"""What several operators share: the shared folder, written tables, row keys, joins that no key can overload."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark deletes what a finished query has shuffled.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A key with over one part in so many of all rows is heavy, so there are fewer heavy keys than this.
HEAVY = 5_000
_OWN_DIR: str | None = None
_WORK: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where that is unset and Spark runs in one process (tests)."""
    global _OWN_DIR
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _OWN_DIR is None:
        _OWN_DIR = tempfile.mkdtemp(prefix="sparrowlake-")
    return "file://" + _OWN_DIR


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the application's own folder, which goes when the driver ends."""
    work = f"{shared_dir(spark)}/sparrowlake-{spark.sparkContext.applicationId}"
    if work not in _WORK:
        _WORK.add(work)
        atexit.register(_leave, spark, work)
    return f"{work}/{tag}-{uuid.uuid4().hex}"


def _leave(spark: SparkSession, work: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        forget(spark, work)


def written(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = path or fresh_path(spark, tag)
    with settings(spark, **{CLEANUP: "true"}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours through Hadoop's file system API, so that any store works."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def drop(*frames: DataFrame | None) -> None:
    """Delete tables that ``written`` made and that nothing reads any more."""
    for df in frames:
        if df is not None:
            forget(df.sparkSession, df._written)


def whole_id(df: DataFrame, id_col: str) -> Column:
    """The id as a long; ids of other kinds than whole numbers are refused."""
    kind = df.schema[id_col].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{id_col} must be a whole number here, not {kind.simpleString()}")
    return F.col(id_col).cast("long")


def join_counted(rows: DataFrame, counted: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``counted``, which has each key once and how many of the rows have it (``n``).

    Keys with more than 1 / HEAVY of the counted rows, fewer than HEAVY of them, are broadcast; the rest is shuffled,
    so that no key fills a task. Both tables are read several times: they should be written ones.
    """
    total = counted.agg(F.sum(n)).first()[0] or 0
    heavy = F.broadcast(counted.where(F.col(n) > total // HEAVY))
    few = rows.join(heavy, key)
    rest = rows.join(heavy.select(key), key, "left_anti").join(counted.where(F.col(n) <= total // HEAVY), key, how)
    return few.unionByName(rest)


def row_key(id_col: str, text_col: str) -> Column:
    """Names a row by 128 bits of a digest of id and text, so that rows which repeat an id with another text stay apart.

    Rows alike in both get alike results, so sharing a key is harmless.
    """
    ident = F.col(id_col).cast("string")
    own = F.concat_ws("|", F.coalesce(F.length(ident), F.lit(-1)).cast("string"), ident, F.col(text_col).isNull().cast("string"), F.col(text_col))
    return F.unhex(F.md5(own.cast("binary")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialised(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column computed once a row: Generate keeps the optimizer from copying ``value`` into its uses."""
    return df.select("*", F.explode(F.array(value)).alias(name))


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings (with _ for .) that hold for the actions inside."""
    names = {k.replace("_", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = 500):
    """Arrow batches of so many rows, so that long texts stay within a worker's memory."""
    return settings(spark, **{"spark_sql_execution_arrow_maxRecordsPerBatch": str(rows)})
