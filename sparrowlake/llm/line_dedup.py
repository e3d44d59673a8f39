"""Line deduplication over content-defined chunks of lines. DataFrame functions only.

Lines are hashed; a rolling hash over the last one or two line hashes closes a chunk wherever it leaves a set
remainder, so that boundaries depend on the lines about them alone and move along with inserted or removed text.
Each of ``CUTS`` cuts the text in its own way: a passage whose edges one of them misses is met by another. Chunks of
two or more lines are known by a 256-bit digest; of those that repeat in all documents, the first place (smallest
id, then line) stays and the lines of the others go, once their bytes have been compared. The first place of any
line is never taken, as each line that goes has an earlier one.

Digests are counted before any text moves; texts are shuffled once to compare bytes, where chunks repeat, and once
to be rebuilt.

Defined results: null text stays null, empty text stays empty; blank chunks are never removed; rows with the same
id count as one document, which keeps what it was the first to have; a null id comes after all others; ids may be
whole numbers or strings; other columns pass unchanged, but for n_lines and n_removed where ``details`` adds them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowlake.llm.common import drop, join_counted, materialised, row_key, written

#: Lines in the rolling hash, divisor, and remainder that closes a chunk.
CUTS = ((1, 2, 0), (1, 2, 1), (2, 2, 0), (2, 2, 1), (1, 3, 0))
BASE, MIN_LINES = 257, 2


def line_hash(line: Column) -> Column:
    """32 bits of the line's MD5, as a long."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def sha256_digest(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def chunks(hashes: Column, cut: tuple[int, int, int]) -> Column:
    """The chunks of one cut: array of (at: first line, from 0; n: lines)."""
    window, divisor, rest = cut
    rolled = lambda i: sum((F.coalesce(F.get(hashes, i - j), F.lit(0)) * (BASE**j) for j in range(1, window)), start=F.get(hashes, i))
    closes = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: (rolled(i) % divisor == rest) | (i == F.size(hashes) - 1))
    before = F.concat(F.array(F.lit(-1)), F.slice(closes, 1, F.size(closes) - 1))
    return F.zip_with(before, closes, lambda a, b: F.struct((a + 1).alias("at"), (b - a).alias("n")))


def chunk_body(at: Column, n: Column) -> Column:
    return F.array_join(F.slice("_ld_lines", at + 1, n), "\n")


def with_chunks(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """A row for each place of a chunk: id, key, at, n, digest."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.split(text_col, "\n", -1).alias("_ld_lines"))
    rows = materialised(rows, "_ld_hashes", F.transform("_ld_lines", line_hash))
    of_all = F.array_distinct(F.filter(F.concat(*[chunks(F.col("_ld_hashes"), cut) for cut in CUTS]), lambda c: c["n"] >= MIN_LINES))
    rows = rows.select("id", "key", "_ld_lines", F.explode(of_all).alias("c"))
    rows = materialised(rows, "body", chunk_body(F.col("c.at"), F.col("c.n")))
    return rows.where(F.trim(F.translate("body", "\n\t\r", "   ")) != "").select("id", "key", "c.at", "c.n", digest(F.col("body")).alias("digest"))


def _place() -> Column:
    return F.struct(F.col("id").isNull().alias("late"), "id", "at")


def _bodies(docs: DataFrame, places: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``places`` (id, key, at, n, digest) with the body that stands there."""
    own = places.groupBy("key", "id").agg(F.collect_set(F.struct("at", "n", "digest")).alias("c"))
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text")).join(own, "key")
    rows = rows.select("id", "key", F.split("text", "\n", -1).alias("_ld_lines"), F.explode("c").alias("c")).select("id", "key", "_ld_lines", "c.*")
    return rows.select("id", "key", "at", "n", "digest", chunk_body(F.col("at"), F.col("n")).alias("body"))


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """One row for each text that loses lines: key, gone (array of at, n)."""
    found = written(with_chunks(docs, id_col, text_col, digest), "line-chunks")
    repeated = written(found.groupBy("digest").agg(F.count("*").alias("copies"), F.min(_place()).alias("first")).where("copies > 1"), "line-repeated")
    places = written(join_counted(found, repeated, "digest", "copies").withColumn("later", _place() != F.col("first")).drop("copies", "first"), "line-places")
    drop(found, repeated)
    # bytes decide: a digest that stands for different bodies is told apart by them
    bodies = _bodies(docs, places, id_col, text_col)
    mixed = written(bodies.groupBy("digest").agg(F.min("body").alias("a"), F.max("body").alias("b")).where("a != b").select("digest"), "line-mixed")
    gone = places.where("later").select("key", "at", "n")
    if not mixed.isEmpty():
        apart = bodies.join(mixed, "digest")
        firsts = apart.groupBy("digest", "body").agg(F.min(_place()).alias("first"))
        later = apart.join(firsts, ["digest", "body"]).where(_place() != F.col("first"))
        gone = places.where("later").join(mixed, "digest", "left_anti").select("key", "at", "n").union(later.select("key", "at", "n"))
    return gone.groupBy("key").agg(F.collect_set(F.struct("at", "n")).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", details: bool = False, digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """``docs`` with the lines of repeated chunks taken out of ``text_col``; ``details`` adds n_lines, n_removed."""
    gone = repeated_chunks(docs, id_col, text_col, digest).withColumnsRenamed({"key": "_ld_key", "gone": "_ld_gone"})
    keyed = docs.withColumn("_ld_key", row_key(id_col, text_col)).join(gone, "_ld_key", "left")
    has = F.col("_ld_gone").isNotNull()
    keyed = materialised(keyed, "_ld_lines", F.split(text_col, "\n", -1))
    lost = F.flatten(F.transform("_ld_gone", lambda g: F.sequence(g["at"], g["at"] + g["n"] - 1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_ld_lines") - 1), lost)
    keyed = materialised(keyed, "_ld_stay", F.when(has, F.transform(stay, lambda i: F.get("_ld_lines", i))).otherwise(F.col("_ld_lines")))
    own = [c for c in docs.columns if not (details and c in ("n_lines", "n_removed"))]
    out = [F.when(has, F.array_join("_ld_stay", "\n")).otherwise(F.col(text_col)).alias(c) if c == text_col else F.col(f"`{c}`") for c in own]
    if details:
        out += [F.coalesce(F.size("_ld_lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("_ld_lines") - F.size("_ld_stay"), F.lit(0)).cast("long").alias("n_removed")]
    return keyed.select(*out)
