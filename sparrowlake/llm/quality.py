"""Quality classifier: a sparse ensemble of rules over text statistics (RuleFit).

Statistics are columns of built-in functions over the whole text. On the driver, shallow boosted trees are grown on
a bounded sample of labelled rows, the path to each of their nodes becomes a conjunctive rule, and a lasso logistic
regression keeps few of the rules. The kept rules compile into one column expression, so scoring is a plain
projection without a shuffle.

``SAMPLE`` bounds the rows that the fit collects (statistics only, no text). Labels of held-out rows, languages,
sources and ids are never inputs.

Defined results: null texts have the statistics and score of empty ones; with labels of one class only, or none, all
scores are that class's smoothed share (0.5 for none); rows are scored each on its own, and of rows that share an id
one is learned from, the one with the least statistics; other columns pass unchanged, but for ``score``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowlake.llm.common import materialised
from sparrowlake.llm.labelled import held_out, sample_ids

SAMPLE = 20_000
TREES, DEPTH, BINS, SHRINK, LASSO = 24, 3, 48, 0.5, 2e-3
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "#$%&*@^~<>{}[]\\/_=+"
STATISTICS = ("words", "word_length", "upper", "symbols", "digits", "bars", "shouts", "stops", "lines", "echoes", "variety")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the column _q, a struct of doubles."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialised(docs, "_q_words", F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+", -1), lambda w: w != ""))
    words = F.col("_q_words")
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    size = F.length(text)
    of = lambda some: (size - F.length(F.translate(text, some, ""))).cast("double")
    echoes = F.aggregate(words, F.struct(F.lit("").alias("last"), F.lit(0.0).alias("n")), lambda a, w: F.struct(w.alias("last"), (a["n"] + (a["last"] == w).cast("double")).alias("n")), lambda a: a["n"])
    values = {
        "words": F.size(words).cast("double"), "word_length": size / n, "upper": of(LETTERS) / chars, "symbols": of(SYMBOLS) / chars, "digits": of("0123456789") / chars,
        "bars": of("|") / n, "shouts": of("!?") / n, "stops": of(".,;:") / n, "lines": of("\n") / n, "echoes": echoes / n, "variety": F.size(F.array_distinct(words)) / F.sqrt(n),
    }
    return materialised(rows, "_q", F.struct(*[values[k].alias(k) for k in STATISTICS])).drop("_q_words")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether above, cut), and its weight."""

    parts: tuple[tuple[int, bool, float], ...]
    weight: float

    def column(self) -> Column:
        out = F.lit(True)
        for k, above, cut in self.parts:
            value = F.col(f"_q.{STATISTICS[k]}")
            out = out & ((value > cut) if above else (value <= cut))
        return F.when(out, F.lit(self.weight)).otherwise(0.0)


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[Rule, ...]
    bias: float

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule in self.rules:
            total = total + rule.column()
        return 1 / (1 + F.exp(-total))


def _grow(binned: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, features: np.ndarray) -> list[tuple]:
    """One regression tree: its nodes' paths, each with its rows and its mean."""
    out: list[tuple] = []
    stack = [((), np.arange(len(target)), 0)]
    while stack:
        path, rows, depth = stack.pop()
        if path:
            out.append((path, rows, float(target[rows].mean())))
        if depth == DEPTH or len(rows) < 20:
            continue
        best = (1e-9, None, 0)
        total, n = target[rows].sum(), len(rows)
        for k in features:
            b = binned[rows, k]
            count = np.cumsum(np.bincount(b, minlength=BINS + 1))[:-1]
            left = np.cumsum(np.bincount(b, weights=target[rows], minlength=BINS + 1))[:-1]
            ok = (count >= 5) & (count <= n - 5)
            gain = np.where(ok, left**2 / np.maximum(count, 1) + (total - left) ** 2 / np.maximum(n - count, 1) - total**2 / n, 0)
            at = int(gain.argmax())
            if gain[at] > best[0] and at < len(cuts[k]):
                best = (float(gain[at]), int(k), at)
        if best[1] is None:
            continue
        _, k, at = best
        low = binned[rows, k] <= at
        for above, own in ((False, rows[low]), (True, rows[~low])):
            stack.append(((*path, (k, above, float(cuts[k][at]))), own, depth + 1))
    return out


def _lasso(x: np.ndarray, y: np.ndarray, strength: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights and bias by accelerated proximal gradient steps."""
    n, m = x.shape
    w, b, z, zb, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    rate = 4.0 / max(float(np.linalg.norm(x.T @ x / n, 2)) + 1.0, 1e-9)
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(x @ z + zb))) - y
        step = z - rate * (x.T @ error) / n
        new, new_b = np.sign(step) * np.maximum(np.abs(step) - rate * strength, 0), zb - rate * float(error.mean())
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / later * (new - w), new_b + (t - 1) / later * (new_b - b)
        w, b, t = new, new_b, later
    return w, b


def fit_rules(values: np.ndarray, y: np.ndarray, seed: int = 11) -> RuleEnsemble:
    """Fit on statistics (rows x STATISTICS) and labels 0/1."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble((), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(values[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(values.shape[1])]
    binned = np.column_stack([np.searchsorted(c, values[:, k], "left") for k, c in enumerate(cuts)])
    logit, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        rows = rng.choice(len(y), max(1, min(len(y), 5000 + len(y) // 2)), replace=False)
        features = rng.choice(values.shape[1], max(2, values.shape[1] * 2 // 3), replace=False)
        for path, own, mean in _grow(binned[rows], cuts, (y - p)[rows], features):
            rules.setdefault(tuple(sorted(path)), None)
            if len(path) == DEPTH:
                logit[rows[own]] += SHRINK * mean * 4
    paths = list(rules)
    x = np.ones((len(y), len(paths)), dtype=np.float32)
    for j, path in enumerate(paths):
        for k, above, cut in path:
            x[:, j] *= (values[:, k] > cut) if above else (values[:, k] <= cut)
    w, b = _lasso(x, y, LASSO)
    return RuleEnsemble(tuple(Rule(p, float(v)) for p, v in zip(paths, w, strict=True) if abs(v) > 1e-4), float(b))


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> RuleEnsemble:
    ids = sample_ids(labels, label, sample, id_col)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    one = with_statistics(own, "text").groupBy("id", "y").agg(F.min("_q").alias("_q"))  # of rows that share an id the one with the least statistics
    rows = one.select("id", "y", "_q.*").toPandas().sort_values(["id", *STATISTICS])  # at most ``sample`` rows
    return fit_rules(rows[list(STATISTICS)].to_numpy(dtype=float), rows["y"].to_numpy(dtype=float))


def score_quality(docs: DataFrame, model: RuleEnsemble, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: better)."""
    own = [F.col(f"`{c}`") for c in docs.columns if c != "score"]
    return with_statistics(docs, text_col).select(*own, model.score().alias("score"))


__all__ = ["RuleEnsemble", "fit_rules", "held_out", "score_quality", "train_quality", "with_statistics"]
