"""Bounded training samples and small linear learners in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows with the smallest seeded hashes of ``key``; rows should be narrow."""
    total = rows.count()
    drawn = F.xxhash64(F.lit(7), key)
    if total > 2 * limit:
        rows = rows.where(F.pmod(drawn, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.5 * limit / total)))
    return rows.orderBy(drawn, key).limit(limit)


def agreed(labels: DataFrame, target: str, learnable) -> DataFrame:
    """(doc_id, y) of the learnable ids whose labels agree; null labels and null ids are left out."""
    known = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & learnable(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(target).alias("y"), F.max(target).alias("most")).where("y = most")
    return known.select("doc_id", F.col("y").cast("int").alias("y"))


def labelled(docs: DataFrame, labels: DataFrame, target: str, learnable, limit: int) -> DataFrame:
    """(text, y) of at most ``limit`` learnable labelled documents.

    Ids whose labels disagree, null labels and null ids are left out.  The sample of ids is what is broadcast; ``limit`` bounds it.  Of the
    rows under one id, the text with the smallest hash counts, so the rows are as many as the ids however often one occurs.
    """
    ids = F.broadcast(bounded(agreed(labels, target, learnable), "doc_id", limit))
    found = docs.select("doc_id", "text").join(ids, "doc_id").select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text"))
    one = F.min(F.struct(F.xxhash64("text").alias("drawn"), "text"))
    return found.groupBy("doc_id", "y").agg(one.alias("first")).select("first.text", "y")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 25, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Newton steps for soft labels ``y`` in [0, 1]; returns weights and intercept.  For few columns."""
    n, d = x.shape
    a = np.hstack([x, np.ones((n, 1))])
    c = np.ones(n) if weight is None else weight
    w = np.zeros(d + 1)
    penalty = np.full(d + 1, ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (c * (p - y)) + penalty * w
        h = (a * (c * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(h, gradient)
        size = np.abs(step).max()
        w -= step * min(1.0, 5 / max(size, 1e-12))
        if size < 1e-6:
            break
    return w[:-1], float(w[-1])


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 11) -> tuple[np.ndarray, float]:
    """L1-loss linear support vector machine by dual coordinate descent; ``y`` is -1 or 1.  The last weight is the intercept's."""
    n, d = x.shape
    a = np.hstack([x, np.ones((n, 1), x.dtype)]).astype(np.float64)
    q = np.einsum("ij,ij->i", a, a)
    alpha, w = np.zeros(n), np.zeros(d + 1)
    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for i in order.permutation(n):
            g = y[i] * (a[i] @ w) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), c)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * a[i]
                alpha[i] = new
    return w[:-1], float(w[-1])
