"""Benchmark decontamination by a prefix-filtered set join. DataFrame functions only.

Each item gives windows of ``size`` consecutive words (one window if it has fewer). A window can only be contained
in a document that has its rarest word, which is its prefix at containment 1: words are ordered by their count
over the whole corpus, each window is filed under its rarest word and that word's offset, and documents' words are
joined with it. A candidate must lie inside the document (length and position bounds) and is then verified word by
word over a window of the item's size. Windows with a word that no document has are dropped at once.

A window that several items share is filed and verified once; items are looked up for each document afterwards.

The windows are broadcast while they are at most ``broadcast_rows`` and BROADCAST_BYTES; beyond, the same join is
dealt by the word without texts and candidates are verified at their documents, so no size is turned away.

Defined results: A-Z are lower-cased, words are runs of characters other than ASCII non-alphanumerics; null texts
have no words; items without words never occur; rows alike in id and text get alike results; empty tables and
columns with any other names are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowlake.llm.common import row_key

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64_000_000


def words(text: Column) -> Column:
    """The words of a text, lower-cased; an empty array for null."""
    return F.filter(F.split(F.coalesce(F.translate(text, UPPER, LOWER), F.lit("")), GAPS, -1), lambda w: w != "")


def item_windows(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """item (string), wid (digest of the window), win (array of words): each distinct window of each item."""
    split = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    wins = split.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("win"))
    return wins.withColumn("wid", F.unhex(F.sha2(F.array_join("win", " "), 256))).distinct()  # words have no spaces


def _positions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(row_key(id_col, text_col).alias("key"), words(F.col(text_col)).alias("w"))


def prefixes(docs: DataFrame, wins: DataFrame, id_col: str, text_col: str, small: bool) -> DataFrame:
    """Each window with its rarest word (token) and where in the window that stands (off, from 0)."""
    vocabulary = wins.select(F.explode("win").alias("token")).distinct()
    tokens = _positions(docs, id_col, text_col).select(F.explode("w").alias("token"))
    placed = wins.select("wid", "win", F.posexplode("win").alias("off", "token"))
    if small:
        counts = F.broadcast(tokens.join(F.broadcast(vocabulary), "token").groupBy("token").agg(F.count("*").alias("n")))
    else:
        counts = tokens.groupBy("token").agg(F.count("*").alias("n")).join(vocabulary, "token")
    ranked = placed.join(counts, "token", "left").groupBy("wid").agg(F.first("win").alias("win"), F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "off")).alias("p"))
    return ranked.where("p.n > 0").select("wid", "win", "p.token", "p.off")


def occurrences(docs: DataFrame, wins: DataFrame, id_col: str, text_col: str, small: bool) -> DataFrame:
    """key, wid, start (from 0), stop: each place where a window stands in a document."""
    filed = prefixes(docs, wins, id_col, text_col, small)
    at, n = F.col("at"), F.size("win")
    inside = (at >= 0) & (at + n <= F.col("n_words"))
    same = F.slice("w", at + 1, n) == F.col("win")
    if small:
        placed = _positions(docs, id_col, text_col).select("key", "w", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "token"))
        found = placed.join(F.broadcast(filed), "token").withColumn("at", F.col("pos") - F.col("off")).where(inside & same)
    else:
        placed = _positions(docs, id_col, text_col).select("key", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "token"))
        candidates = placed.join(filed, "token").withColumn("at", F.col("pos") - F.col("off")).where(inside).select("key", "wid", "win", "at")
        found = candidates.join(_positions(docs, id_col, text_col).dropDuplicates(["key"]), "key").where(same)
    return found.select("key", "wid", at.alias("start"), (at + n).alias("stop")).distinct()


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    size: int = 10,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside any occurrence), items (sorted array of ids as strings)."""
    windows = item_windows(items, item_col, item_text, size)
    wins = windows.select("wid", "win").distinct()
    taken = wins.limit(broadcast_rows + 1).agg(F.count("*").alias("n"), F.sum(F.octet_length(F.array_join("win", " "))).alias("bytes")).first()
    small = taken.n <= broadcast_rows and (taken.bytes or 0) <= BROADCAST_BYTES
    found = occurrences(docs, wins, id_col, text_col, small)
    spans = F.array_sort(F.collect_set(F.struct("start", "stop")))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    covered = lambda s: F.aggregate(
        s, zero, lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(a["upto"], x["start"]))).alias("n"), F.greatest(a["upto"], x["stop"]).alias("upto")), lambda a: a["n"]
    )
    # found is read once: each window of a document carries the document's hits along to its items
    by_doc = found.groupBy("key").agg(spans.alias("spans"), F.collect_set("wid").alias("wids")).select("key", covered(F.col("spans")).alias("hit"), F.explode("wids").alias("wid"))
    named = by_doc.join(windows.select("wid", "item"), "wid").groupBy("key").agg(F.first("hit").alias("_dc_hit"), F.array_sort(F.collect_set("item")).alias("_dc_items"))
    per_doc = named.withColumnRenamed("key", "_dc_key")
    own = [c for c in docs.columns if c not in ("n_words", "n_hit", "items")]
    base = docs.select(*[F.col(f"`{c}`") for c in own], F.size(words(F.col(text_col))).cast("long").alias("n_words"), row_key(id_col, text_col).alias("_dc_key"))
    return base.join(per_doc, "_dc_key", "left").select(
        *[F.col(f"`{c}`") for c in own], "n_words", F.coalesce("_dc_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("_dc_items", F.array().cast("array<string>")).alias("items")
    )
