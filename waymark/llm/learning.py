"""Labelled texts for training, and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; rows with 1 are held out. A null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")) % 3


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """One row (``doc_id``, ``y``) per labelled document outside the held-out fold; the larger label wins a tie."""
    rows = labels.filter((fold() != 1) & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    return rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, longest: int) -> dict[int, list[str]]:
    """Up to ``per_class`` training texts of each label, chosen by a hash of the id, at most ``longest`` characters each.

    Only this bounded sample reaches the driver. A longer text gives the excerpt that starts at a hashed place.
    """
    chosen = training_labels(labels, label)
    order = F.xxhash64(F.col("doc_id"), F.lit(label))
    picks = [chosen.filter(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    few = picks[0].unionByName(picks[1])
    text = F.coalesce(F.col("text"), F.lit(""))
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length(text) - longest + 1, F.lit(1))).cast("int") + 1
    texts = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # at most 2 * per_class ids
    excerpts = texts.select("doc_id", "y", F.substr(text, start, F.lit(longest)).alias("text"))
    # a document that stands in the table many times counts once
    once = excerpts.groupBy("doc_id", "y").agg(F.min("text").alias("text")).orderBy("doc_id").limit(2 * per_class)
    out: dict[int, list[str]] = {0: [], 1: []}
    for row in once.toLocalIterator():
        out[row["y"]].append(row["text"])
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic regression by Newton steps; classes weigh the same."""
    if not len(y):
        return np.zeros(x.shape[1] + 1)
    a = np.column_stack([np.ones(len(x)), x])
    counts = np.bincount(y, minlength=2)
    weight = np.where(y == 1, 0.5 / max(counts[1], 1), 0.5 / max(counts[0], 1))
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(a.shape[1])
    penalty[0, 0] = ridge / 100
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + penalty @ w
        hessian = (a * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + penalty
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
