"""Quality classifier: a sparse ensemble of rules (Friedman and Popescu 2008).

Boosted trees over text statistics are grown on a bounded labelled sample, every
path to a node becomes a conjunctive rule, a lasso logistic fit picks few rules,
and the rules compile into one Spark column over the statistics.  Statistics of
whole texts come from one Arrow UDF that counts byte classes batch by batch.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of_id, table

#: Rows of labels the model learns from, at most (the least by a hash of their id).
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, PENALTY, SEED = 40, 3, 32, 0.3, 0.002, 5
PROTECTED = 1  # remainder of crc32(id) mod 3 that is held out

STATS = ("log_words", "mean_word", "longest_word", "upper", "digit", "symbol", "exclaim", "sentence", "space", "distinct_words", "top_word", "repeated_lines", "odd_words", "distinct_pairs")

_CLASS = np.zeros(256, np.int64)  # 0: other letters
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"|%$&#*@<>{}[]\\^~`_=+/", b"!", b".,;:?", b" \t\n\r\x0b\x0c"), 1):
    _CLASS[list(_set)] = _k
_ODD = frozenset(b"|%$&#*@<>{}[]\\^~`_=+/!0123456789")


def statistics(text: str | None) -> tuple[float, ...]:
    """STATS of one whole text; null, empty and blank texts give zeros."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return (0.0,) * len(STATS)
    n, k = len(words), len(raw)
    c = np.zeros(7, np.int64)
    for a in range(0, k, 1 << 20):
        c += np.bincount(_CLASS[np.frombuffer(raw[a : a + (1 << 20)], np.uint8)], minlength=7)
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    size = [len(w) for w in seen]
    odd = sum(m for w, m in seen.items() if w[-1] in _ODD)
    pairs = len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0
    return (float(np.log1p(n)), (k - int(c[6])) / n, float(min(max(size), 1000)), c[1] / k, c[2] / k, c[3] / k, c[4] / k, c[5] / k, c[6] / k, len(seen) / n, max(seen.values()) / n, 1 - len(set(lines)) / max(len(lines), 1), odd / n, pairs)


@F.pandas_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATS]))
def text_statistics(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics(t) for t in text], columns=list(STATS), dtype="float64")


@dataclass
class RuleModel:
    """Rules: conjunctions of (statistic, "<=" or ">", bound); weights; intercept."""

    intercept: float = 0.0
    rules: list[tuple[tuple[int, bool, float], ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights):
            z += w * _holds(rule, x)
        return 1 / (1 + np.exp(-z))

    def column(self, stats: Column) -> Column:
        z = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights):
            hold = F.lit(True)
            for f, low, bound in rule:
                s = stats.getField(STATS[f])
                hold = hold & (s <= F.lit(bound) if low else s > F.lit(bound))
            z = z + F.when(hold, F.lit(float(w))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _holds(rule: tuple[tuple[int, bool, float], ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, low, bound in rule:
        out &= (x[:, f] <= bound) == low
    return out


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[tuple[tuple[int, bool, float], ...]]:
    """Paths to all nodes of boosted trees (logistic loss, histogram splits)."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    rng, z, rules = np.random.default_rng(seed), np.zeros(len(x)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        take = rng.random(len(x)) < 0.5
        columns = rng.permutation(x.shape[1])[: max(2, x.shape[1] // 2)]
        todo = [((), take, np.ones(len(x), bool), 0)]
        while todo:
            path, rows, every, level = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = None
            if level < depth and rows.sum() >= 20:
                for f in columns:
                    if not len(edges[f]):
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(edges[f]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(edges[f]) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    k = int(gain.argmax())
                    if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                        best = gain[k], int(f), k
            if path:
                rules[tuple(sorted(path))] = None
            if best is None:
                z[every] += RATE * gs / (hs + 1)
                continue
            _, f, k = best
            low = binned[:, f] <= k
            bound = float(edges[f][k])
            todo += [((*path, (f, True, bound)), rows & low, every & low, level + 1), ((*path, (f, False, bound)), rows & ~low, every & ~low, level + 1)]
    return list(rules)


def fit(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> RuleModel:
    """Rules and their lasso logistic weights (accelerated proximal gradient).

    No rows: score 0.5 everywhere; one class only: its smoothed share.
    """
    n, ones = len(y), float(np.sum(y))
    base = float(np.log((ones + 0.5) / (n - ones + 0.5)))
    if n == 0 or ones in (0, n):
        return RuleModel(base)
    rules = grow_rules(x, y)
    if not rules:
        return RuleModel(base)
    a = np.stack([_holds(r, x) for r in rules], axis=1).astype(np.float64)
    center, scale = a.mean(0), np.maximum(a.std(0), 0.05)
    a = (a - center) / scale
    v = np.ones(a.shape[1])
    for _ in range(20):  # largest curvature by power iteration
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 4 * n / max(float(np.linalg.norm(a @ v) ** 2), 1e-9)
    w = u = np.zeros(a.shape[1])
    b, t = base, 1.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-(a @ u + b)))
        new = u - step * (a.T @ (p - y) / n)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b -= 4 * float(np.mean(p - y))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + (t - 1) / t2 * (new - w), new, t2
    keep = np.flatnonzero(w)
    weights = w[keep] / scale[keep]
    return RuleModel(float(b - (weights * center[keep]).sum()), [rules[k] for k in keep], weights.tolist())


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE_ROWS) -> RuleModel:
    """Learn from labelled rows outside the held-out third, at most `sample` of them.

    The sample is taken from the labels before any text is read; its size is the
    proven bound for the broadcast and for what the driver gathers.  Labels other
    than 0 and 1 and null ids are left out.
    """
    ids = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_id"), F.col(label).cast("int").alias("_y"))
    ids = ids.where(crc_of_id("_id") % 3 != PROTECTED).orderBy(F.xxhash64(F.lit(SEED), "_id"), "_id", "_y").limit(sample)
    rows = docs.select(F.col(key).cast("long").alias("_id2"), F.col(text).alias("_text")).join(F.broadcast(ids), F.col("_id2") == F.col("_id"))
    got = rows.select("_id", "_y", text_statistics("_text").alias("s")).select("_id", "_y", "s.*").toPandas().sort_values(["_id", "_y"], kind="stable")
    return fit(got[list(STATS)].to_numpy(float).reshape(-1, len(STATS)), got["_y"].to_numpy(float))


def scored(docs: DataFrame, model: RuleModel, text: str = "text", into: str = "score") -> DataFrame:
    """docs with its own columns and a score in [0, 1]; nothing but the text is an input."""
    return docs.withColumn(into, model.column(text_statistics(F.col(text))))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row: doc_id, held_out, score, predicted.

    A null id counts as not held out.  Null, empty and blank texts have all statistics
    zero and the score the model gives these; whole texts are read, however long.  A
    document that is labelled twice, or occurs twice, is learned twice.  Equal texts
    score alike.  Without usable labels every score is 0.5; an empty table gives no
    rows; other columns are not read.
    """
    model = train(docs, labels, key, text)
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    out = scored(slim, model).withColumn("held_out", F.coalesce(crc_of_id() % 3 == PROTECTED, F.lit(False)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs predicted good, with their own columns, of any name.

    Without usable labels there is nothing to reject by, so every row stays (score 0.5).
    """
    columns = docs.columns
    name = "_score"
    while name in columns:
        name += "_"
    return scored(docs, train(docs, labels, key, text), text, name).where(F.col(f"`{name}`") >= 0.5).select(*[F.col(f"`{c}`") for c in columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
