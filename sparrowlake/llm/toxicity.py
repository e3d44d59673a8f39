"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of three rows of one hashed table: for the whole word and for its first 4 and 6 bytes,
so that compounds not seen in training share their head. Filters of widths 1, 2 and 3 run over the words, each is
pooled to its maximum over the whole text, and a logistic layer gives the score, which is calibrated on rows that the
gradient steps did not see. The table starts from the log odds of its rows. Since pooling follows a linear map, scoring needs only the filters' responses to each
table row, which are made once and broadcast (a fixed size).

Training collects a bounded sample of labelled rows: at most ``SAMPLE`` whole rows and ``SAMPLE_BYTES`` of text, in the order
of a hash of the id. Thresholds are calibrated by language on the held-back part of that sample; the language is no input
of the score. Labels of held-out rows, sources and ids are never inputs.

Defined results: null texts score as empty ones; without labels of both classes all scores are the smoothed share of
toxic labels (0.5 for none) and all thresholds the default; rows are independent; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowlake.llm import textnp
from sparrowlake.llm.common import drop, whole_id, written
from sparrowlake.llm.labelled import sample_ids

SAMPLE, SAMPLE_BYTES = 8_000, 24_000_000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 12, 8, (1, 2, 3)
EPOCHS, BATCH, RATE, THRESHOLD, PRECISION = 5, 64, 0.05, 0.7, 0.95
HEADS = (4, 6)
GAPS = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))


def buckets(block: textnp.Block) -> np.ndarray:
    """Rows of the hashed table for each word: words x 3."""
    out = np.empty((len(block.starts), 1 + len(HEADS)), dtype=np.int32)
    out[:, 0] = (block.hashes() >> np.uint64(20)) % np.uint64(BUCKETS)
    data = np.concatenate([block.data, np.zeros(8, np.uint8)])
    for j, n in enumerate(HEADS):
        h = np.full(len(block.starts), n, dtype=np.uint64)
        for k in range(n):
            at = block.starts + k
            h = h * np.uint64(1_000_003) + np.where(at < block.ends, data[at], 0).astype(np.uint64)
        out[:, j + 1] = (textnp.mix(h) >> np.uint64(20)) % np.uint64(BUCKETS)
    return out


def texts_buckets(texts: pa.Array) -> Iterator[np.ndarray]:
    seps, fold = textnp.separators(GAPS), textnp.lower_ascii()
    for block in textnp.blocks(texts, seps, fold):
        rows = buckets(block)
        for i in range(block.rows):
            a, b = block.words(i)
            yield rows[a:b]


@dataclass
class TextCNN:
    """table: BUCKETS x DIM; filters: for each width an array width x DIM x FILTERS; then the logistic layer and its calibration."""

    table: np.ndarray
    filters: list[np.ndarray]
    shift: np.ndarray
    out: np.ndarray
    bias: float
    scale: float = 1.0
    offset: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def responses(self) -> list[list[np.ndarray]]:
        return [[(self.table @ f[j]).astype(np.float32) for j in range(len(f))] for f in self.filters]

    def logit(self, rows: np.ndarray, responses: list[list[np.ndarray]]) -> float:
        """Of one text's words x 3 table rows; long texts go in parts that overlap by a filter."""
        pooled = np.zeros(FILTERS * len(WIDTHS))
        for a in range(0, len(rows), 4096):
            part = rows[a : a + 4096 + max(WIDTHS) - 1]
            for i, width in enumerate(WIDTHS):
                n = len(part) - width + 1
                if n <= 0:
                    continue
                total = np.zeros((n, FILTERS), dtype=np.float32)
                for j in range(width):
                    r = responses[i][j]
                    for c in range(part.shape[1]):
                        total += r[part[j : j + n, c]]
                own = slice(i * FILTERS, (i + 1) * FILTERS)
                pooled[own] = np.maximum(pooled[own], total.max(axis=0) + self.shift[own])
        return self.scale * (float(pooled @ self.out) + self.bias) + self.offset

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        responses = self.responses()
        return 1 / (1 + np.exp(-np.array([self.logit(t, responses) for t in texts], dtype=float)))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and offset of the logits by penalised Newton steps."""
    x, w = np.column_stack([z, np.ones(len(z))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2)
        w = w - np.linalg.solve(hessian, x.T @ (p - y) + (w - np.array([1.0, 0.0])))
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def train(texts: list[np.ndarray], y: np.ndarray, langs: list[str | None], seed: int = 5) -> TextCNN:
    rng = np.random.default_rng(seed)
    k = FILTERS * len(WIDTHS)
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    filters = [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    model = TextCNN(table, filters, np.zeros(k), rng.normal(0, 0.5, k), 0.0)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        model.out, model.bias = np.zeros(k), float(np.log(share / (1 - share)))
        return model
    order = rng.permutation(len(y))
    kept, back = order[len(y) // 5 :], order[: len(y) // 5]
    if y[kept].min() == y[kept].max() or y[back].min() == y[back].max():
        kept = back = order
    # a start from what each table row says by itself: smoothed log odds of the texts that have it, in the first dimension
    seen = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for r in kept:
        seen[int(y[r] > 0.5)][np.unique(texts[r])] += 1
    toxic = y[kept].sum()
    odds = np.log((seen[1] + 0.5) / (toxic + 1)) - np.log((seen[0] + 0.5) / (len(kept) - toxic + 1))
    table[:, 0] = odds * (seen[0] + seen[1]) / (seen[0] + seen[1] + 5) / 4
    half = FILTERS // 2
    filters[0][0, 0, :half], filters[0][0, 1:, :half] = 1.0, 0.0
    model.shift[:half], model.out[:half], model.bias = -0.5, 1.0, -2.0
    heavy = np.clip((len(kept) - y[kept].sum()) / max(y[kept].sum(), 1) / 3, 1, 5)
    squares = [np.full(p.shape, 1e-4, dtype=p.dtype) for p in (table, *filters, model.shift, model.out)]
    bias_square = 1e-4
    for _ in range(EPOCHS):
        shuffled = rng.permutation(kept)
        for at in range(0, len(kept), BATCH):
            rows = shuffled[at : at + BATCH]
            grads = [np.zeros_like(f) for f in filters]
            d_shift, d_out, d_bias = np.zeros(k), np.zeros(k), 0.0
            places: list[np.ndarray] = []
            pulls: list[np.ndarray] = []
            for r in rows:
                words = texts[r]
                if not len(words):
                    continue
                if rng.random() < 0.5:
                    words = words[:, 1:]  # heads must do without the whole word
                e = table[words].sum(axis=1)
                pooled, best = np.zeros(k), np.full(k, -1)
                for i, width in enumerate(WIDTHS):
                    n = len(e) - width + 1
                    if n <= 0:
                        continue
                    total = sum(e[j : j + n] @ filters[i][j] for j in range(width))
                    top = total.argmax(axis=0)
                    value = total[top, np.arange(FILTERS)] + model.shift[i * FILTERS : (i + 1) * FILTERS]
                    pooled[i * FILTERS : (i + 1) * FILTERS] = np.maximum(value, 0)
                    best[i * FILTERS : (i + 1) * FILTERS] = np.where(value > 0, top, -1)
                p = 1 / (1 + np.exp(-(pooled @ model.out + model.bias)))
                g = (p - y[r]) * (heavy if y[r] else 1.0) / len(rows)
                d_out += g * pooled
                d_bias += g
                pull = g * model.out * (best >= 0)
                d_shift += pull
                for f in np.flatnonzero(best >= 0):
                    i, own = divmod(int(f), FILTERS)
                    for j in range(WIDTHS[i]):
                        grads[i][j, :, own] += pull[f] * e[best[f] + j]
                        places.append(words[best[f] + j])
                        pulls.append(np.broadcast_to(pull[f] * filters[i][j, :, own], (words.shape[1], DIM)))
            if places:
                at_rows, where = np.unique(np.concatenate(places), return_inverse=True)
                moved = np.zeros((len(at_rows), DIM), dtype=np.float32)
                np.add.at(moved, where, np.concatenate(pulls))
                squares[0][at_rows] += moved**2
                table[at_rows] -= RATE * moved / np.sqrt(squares[0][at_rows])
            for param, square, grad in zip((*filters, model.shift, model.out), squares[1:], (*grads, d_shift, d_out), strict=True):
                grad = grad + 1e-4 * param
                square += grad**2
                param -= RATE * grad / np.sqrt(square)
            bias_square += d_bias**2
            model.bias -= RATE * d_bias / np.sqrt(bias_square)
    responses = model.responses()
    z = np.array([model.logit(texts[r], responses) for r in back])
    model.scale, model.offset = _platt(z, y[back])
    scores = 1 / (1 + np.exp(-(model.scale * z + model.offset)))
    for lang in {langs[r] for r in back} - {None}:
        own = np.array([langs[r] == lang for r in back])
        model.thresholds[lang] = _threshold(scores[own], y[back][own])
    return model


def _threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The least threshold that reaches PRECISION, if that many labels say anything; else the default."""
    if y.sum() < 10:
        return THRESHOLD
    for t in np.linspace(0.3, 0.95, 27):
        if (scores >= t).sum() and y[scores >= t].mean() >= PRECISION:
            return float(t)
    return THRESHOLD


def _fitting(sizes: list[int], limit: int) -> list[bool]:
    """Which rows are taken, in order: those that fit the bytes left; one that does not fit leaves room for later ones."""
    out = []
    for n in sizes:
        out.append(n <= limit)
        limit -= n if out[-1] else 0
    return out


def train_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES
) -> TextCNN:
    ids = sample_ids(labels, label, sample, id_col)
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), lang.alias("lang")).join(F.broadcast(ids), "id")
    # of rows that share an id the one with the least text: at most ``sample`` rows
    rows = written(own.groupBy("id", "y").agg(F.min(F.struct("text", "lang")).alias("r")).select("id", "y", "r.*"), "toxicity-sample")
    sizes = rows.select("id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("id"), "id").toPandas()
    fits = _fitting(sizes["n"].tolist(), sample_bytes)
    taken = [(i,) for i, ok in zip(sizes["id"].tolist(), fits, strict=True) if ok]
    found = rows.join(F.broadcast(docs.sparkSession.createDataFrame(taken, rows.select("id").schema)), "id").toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
    drop(rows)
    texts = [t.copy() for chunk in found.column("text").chunks for t in texts_buckets(chunk)]
    return train(texts, found.column("y").to_numpy().astype(float), found.column("lang").to_pylist())


def score_toxicity(docs: DataFrame, model: TextCNN, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row of ``docs``: id, score, flagged (by the threshold of its language)."""
    shared = docs.sparkSession.sparkContext.broadcast((model, model.responses()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, responses = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                z = np.array([own.logit(t, responses) for t in texts_buckets(part.column("text"))], dtype=float)
                scores = 1 / (1 + np.exp(-z))
                limits = np.array([own.thresholds.get(x, THRESHOLD) for x in part.column("lang").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(scores), pa.array(scores >= limits)], ["id", "score", "flagged"])

    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(whole_id(docs, id_col).alias("id"), F.col(text_col).alias("text"), lang.alias("lang"))
    return rows.mapInArrow(run, "id long, score double, flagged boolean").withColumnRenamed("id", id_col)


__all__ = ["TextCNN", "score_toxicity", "train", "train_toxicity"]
