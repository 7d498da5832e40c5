"""Loss terms per row, to be averaged into evaluation figures. Arguments are SQL text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import doubles_sql, let_sql, total_sql


def log_softmax_sql(logits: str) -> str:
    shifted = let_sql("top", "array_max(v)", "transform(v, x -> x - top)")
    total = "ln(aggregate(s, 0D, (acc, x) -> acc + exp(x)))"
    normed = let_sql("total", total, "transform(s, x -> x - total)")
    return let_sql("s", let_sql("v", doubles_sql(logits), shifted), normed)


def cross_entropy_sql(
    logits: str, label: str, smoothing: float = 0.0, weights: Sequence[float] | None = None
) -> str:
    costs = "transform(logp__, x -> -x)"
    if weights is not None:
        listed = ", ".join(f"{float(w)!r}D" for w in weights)
        costs = f"zip_with(logp__, array({listed}), (x, w) -> -x * w)"
    own = f"costs__[{label}] * {1.0 - smoothing!r}D + {total_sql('costs__')} * {float(smoothing)!r}D / size(costs__)"
    return let_sql("logp__", log_softmax_sql(logits), let_sql("costs__", costs, own))


def cross_entropy(
    logits: str, label: str, smoothing: float = 0.0, weights: Sequence[float] | None = None
) -> Column:
    """Cross-entropy of a row, with label smoothing and optional class weights."""
    return F.expr(cross_entropy_sql(logits, label, smoothing, weights))


def focal_loss(
    logits: str, label: str, gamma: float = 2.0, smoothing: float = 0.0,
    weights: Sequence[float] | None = None,
) -> Column:
    """Cross-entropy scaled down where the model is already sure."""
    ce = cross_entropy_sql(logits, label, smoothing, weights)
    return F.expr(let_sql("ce", ce, f"pow(1 - exp(-ce), {float(gamma)!r}D) * ce"))


def smooth_l1(predicted: str, target: str) -> Column:
    """Quadratic below an error of one, linear above."""
    error = f"CAST({predicted} AS double) - CAST({target} AS double)"
    return F.expr(let_sql("e", f"abs({error})", "if(e < 1, e * e / 2, e - 0.5D)"))
