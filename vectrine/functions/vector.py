"""Vector arithmetic as columns, and the registry of metrics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING_DISTANCE = 1e9


def dot(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, x) -> s + x)")


def squared_l2(a: str, b: str) -> Column:
    return F.expr(
        f"aggregate(zip_with({a}, {b}, (x, y) -> (cast(x as double) - cast(y as double)) * (cast(x as double) - cast(y as double))), 0D, (s, x) -> s + x)"
    )


def norm(a: str) -> Column:
    return F.expr(f"sqrt(aggregate({a}, 0D, (s, x) -> s + cast(x as double) * cast(x as double)))")


def normalised(a: str) -> Column:
    """Scaled to length 1; a zero vector stays as it is."""
    return F.expr(
        f"transform({a}, x -> cast(x as double) / coalesce(nullif(sqrt(aggregate({a}, 0D, (s, y) -> s + cast(y as double) * cast(y as double))), 0D), 1D))"
    )


def is_finite(a: str) -> Column:
    return F.expr(f"forall({a}, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('inf'))")


@dataclass(frozen=True)
class Metric:
    """score: higher is better; distance: lower is better (the negated score, or the squared distance)."""

    name: str

    def scores(self, queries: np.ndarray, data: np.ndarray) -> np.ndarray:
        if self.name == "cosine":
            queries, data = unit(queries), unit(data)
        products = queries @ data.T
        if self.name != "l2":
            return products
        return -np.maximum((queries**2).sum(axis=1)[:, None] + (data**2).sum(axis=1)[None, :] - 2 * products, 0)

    def score(self, a: str, b: str) -> Column:
        if self.name == "l2":
            return -squared_l2(a, b)
        return dot(a, b) if self.name == "mips" else dot(a, b) / F.coalesce(F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(1.0))

    def distance(self, a: str, b: str) -> Column:
        return -self.score(a, b)


METRICS = {name: Metric(name) for name in ("mips", "l2", "cosine")}


def metric(name: str) -> Metric:
    if name.lower() not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}")
    return METRICS[name.lower()]


def unit(x: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(lengths == 0, 1, lengths)


#: (provider or "" for any, part of the model's name): models that return unit vectors
UNIT_MODELS = (
    ("openai", "text-embedding"), ("openai", "ada"), ("openai", "3-small"), ("openai", "3-large"), ("voyage", ""), ("cohere", "embed")
)


def default_metric(model: str, mode: str) -> str:
    """``cosine`` for models known to return unit vectors, else ``mips``."""
    model, mode = model.lower(), mode.lower()
    return "cosine" if any((provider in mode or provider in model) and part in model for provider, part in UNIT_MODELS) else "mips"


def dimension(df: DataFrame, column: str = "embedding") -> int:
    """The one dimension of all vectors; raises if they differ or there are none."""
    found = df.agg(F.min(F.size(column)).alias("low"), F.max(F.size(column)).alias("high")).first()
    if found["low"] is None or found["low"] != found["high"]:
        raise ValueError(f"vectors have dimensions {found['low']} to {found['high']}")
    return found["low"]
