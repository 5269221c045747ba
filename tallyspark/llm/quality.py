"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

1. A document classifier (logistic regression, fitted by Newton's method in numpy) turns surface
   features of the whole text into evidence: the log odds of good quality beyond the base rate. It
   is fitted on at most ``max_labels`` labelled rows, those with the smallest hash of their id.
2. The evidence of all documents is summed by path and by host (grouped aggregation with map-side
   sums). Beta priors are fitted by moments: hosts shrink toward the global rate, paths toward their
   host, the more the fewer documents they have.
3. A document's probability combines its evidence with the posterior rate of its path. Documents
   under ``threshold`` are rejected.

For ``documents`` the host is ``source`` and the path is ``source`` with ``lang``.

Defined cases: a null text counts as empty; a null host or path is a site of its own; labels without
a document or a value are not used; if the labels have one class only or none, the evidence is 0
and the rate is that of the labels (1 without labels), so nothing is rejected for want of labels.
Equal rows each count. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, smallest_hashes

_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_CLASS = np.full(256, 6, np.int64)  # what is beyond ASCII
_CLASS[:32] = 5
_CLASS[ord(" ")], _CLASS[ord("\n")] = 3, 4
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 0, 1, 2
for _i, _mark in enumerate(_MARKS):
    _CLASS[ord(_mark)] = 7 + _i
N_CLASSES = 7 + len(_MARKS)
N_FEATURES = N_CLASSES + 6


def features(texts: Iterator[str]) -> np.ndarray:
    """Shares of character classes, and of distinct words and lines; word and text lengths."""
    out = []
    for text in texts:
        data = np.frombuffer((text or "").encode(), np.uint8)
        n = max(1, len(data))
        words, lines = (text or "").split(), (text or "").split("\n")
        n_words = max(1, len(words))
        distinct = set(words)
        row = np.empty(N_FEATURES)
        row[:N_CLASSES] = np.sqrt(np.bincount(_CLASS[data], minlength=N_CLASSES) / n)
        row[N_CLASSES:] = (
            len(distinct) / n_words,
            len(distinct) / np.sqrt(n_words),
            np.log1p(n_words),
            min(40.0, n / n_words),
            len(set(lines)) / len(lines),
            min(40.0, n_words / len(lines)) / 40,
        )
        out.append(row)
    return np.array(out).reshape(-1, N_FEATURES)


@dataclass
class Evidence:
    """Standardised logistic regression; ``rate`` is the share of good rows that it was fitted on."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    rate: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(z @ self.weights[1:] + self.weights[0] - np.log(self.rate / (1 - self.rate)), -20, 20)


def fit_evidence(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Evidence:
    n = len(y)
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if n else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    rate = float(np.clip((y.sum() + (0.5 if 0 < y.sum() < n else 0)) / (n + 1), 1e-3, 1 - 1e-3)) if n and y.sum() < n else 1 - 1e-3
    w = np.zeros(N_FEATURES + 1)
    if n and 0 < y.sum() < n:
        z = np.column_stack([np.ones(n), np.clip((x - mean) / scale, -8, 8)])
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
    else:
        w[0] = np.log(rate / (1 - rate))
    return Evidence(mean, scale, w, rate)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = 20_000) -> Evidence:
    """Fit on a bounded sample of labelled rows; their features, not their texts, come to the driver.

    The sample has at most max_labels rows of two numbers, so it is broadcast and no text is shuffled.
    Of rows that repeat an id one counts, whichever has the smallest features.
    """
    bounded_batches(docs.sparkSession)
    wanted = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null").distinct()
    wanted = smallest_hashes(wanted, max_labels, "id", "y")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(wanted), "id").select("id", "text", "y")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"id": part["id"], "y": part["y"], "x": list(features(part["text"]).astype(np.float32))})

    found = rows.mapInPandas(run, "id long, y double, x array<float>").groupBy("id", "y").agg(F.min("x").alias("x"))
    got = found.toPandas().sort_values(["id", "y"], kind="stable")
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, N_FEATURES)
    return fit_evidence(x, (got["y"].to_numpy() >= 0.5).astype(float))


def evidence_column(model: Evidence, text: Column) -> Column:
    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series(model(features(texts)))

    return evidence(text)


def site_rates(scored: DataFrame, rate: float, scratch: Scratch) -> DataFrame:
    """host, path, host_rate, path_rate from rows (host, path, evidence) of all documents.

    The rows are read once: their sums by path are written, and all else is computed from those.
    """
    prior = float(np.log(rate / (1 - rate)))
    p = 1 / (1 + F.exp(-(F.col("evidence") + prior)))
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("good"), F.sum(p * (1 - p)).alias("noise"))
    paths = scratch.table(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"), F.sum("noise").alias("host_noise"))
    total = hosts.agg(F.sum("host_good").alias("good"), F.sum("host_n").alias("n")).first()
    overall = float(np.clip(total["good"] / total["n"], 1e-4, 1 - 1e-4)) if total["n"] else rate

    def spread(rows: DataFrame, good: str, n: str, noise: str, center: Column) -> float:
        """Variance of the groups' true rates around center: what their own noise doesn't explain."""
        excess = F.pow(F.col(good) / F.col(n) - center, 2) - F.col(noise) / (F.col(n) * F.col(n))
        value = rows.agg((F.sum(excess * F.col(n)) / F.sum(n)).alias("v")).first()["v"]
        return float(np.clip(overall * (1 - overall) / max(1e-6, value or 0.0) - 1, 1.0, 1e6))

    a = spread(hosts, "host_good", "host_n", "host_noise", F.lit(overall))
    hosts = hosts.select("host", ((F.col("host_good") + a * overall) / (F.col("host_n") + a)).alias("host_rate"))
    both = paths.join(hosts.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))).drop("of")
    b = spread(both, "good", "n", "noise", F.col("host_rate"))
    return both.select("host", "path", "host_rate", ((F.col("good") + b * F.col("host_rate")) / (F.col("n") + b)).alias("path_rate"))


def _scored(docs: DataFrame, model: Evidence, host: Column, path: Column, text_col: str) -> DataFrame:
    """docs with columns _host, _path and _evidence."""
    bounded_batches(docs.sparkSession)
    return docs.select("*", F.coalesce(host.cast("string"), F.lit("")).alias("_host"), F.coalesce(path.cast("string"), F.lit("")).alias("_path"), evidence_column(model, F.col(text_col)).alias("_evidence"))


def judged(scored: DataFrame, rates: DataFrame, threshold: float) -> DataFrame:
    """scored with _host_rate, _path_rate, _probability and _kept. Spark broadcasts the rates only if they are small."""
    named = rates.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("host_rate").alias("_host_rate"), F.col("path_rate").alias("_path_rate"))
    odds = F.col("_evidence") + F.log(F.col("_path_rate") / (1 - F.col("_path_rate")))
    return scored.join(named, ["_host", "_path"]).withColumn("_probability", 1 / (1 + F.exp(-odds))).withColumn("_kept", F.col("_probability") >= threshold)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_labels: int = 20_000, host: Column | None = None, path: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, probability, kept for each row."""
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.col("source"), F.col("lang")) if path is None else path
    model = train(docs, labels, id_col, text_col, max_labels=max_labels)
    with Scratch(docs.sparkSession, "quality") as scratch:
        slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"))
        scored = scratch.table(slim.select("doc_id", "host", "path", evidence_column(model, F.col("text")).alias("evidence")), "scored")
        rates = scratch.table(site_rates(scored, model.rate, scratch), "rates")
        renamed = scored.select("doc_id", F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("evidence").alias("_evidence"))
        out = judged(renamed, rates, threshold)
        return scratch.keep(out.select("doc_id", *(F.round(f"_{c}", 6).alias(c) for c in ("evidence", "host_rate", "path_rate", "probability")), F.col("_kept").alias("kept")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_labels: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns.

    Evidence is computed once, in a written copy of docs; no text is shuffled unless the rates of all
    paths are too many for Spark to broadcast.
    """
    host, path = F.col("source"), F.concat_ws("/", F.col("source"), F.col("lang"))
    model = train(docs, labels, id_col, text_col, max_labels=max_labels)
    with Scratch(docs.sparkSession, "quality") as scratch:
        scored = scratch.keep(_scored(docs, model, host, path, text_col), "scored")
        sites = scored.select(F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_evidence").alias("evidence"))
        rates = scratch.keep(site_rates(sites, model.rate, scratch), "rates")
    return judged(scored, rates, threshold).where("_kept").select(docs.columns)
