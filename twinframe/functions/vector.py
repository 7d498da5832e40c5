"""Column expressions on numeric arrays and on scores. Arguments are SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score of a full truncation, and the range a raw score is held in.
TRUNCATION_SCORE = -5.0
SCORE_RANGE = (-10.0, 10.0)


def let_sql(name: str, value: str, body: str) -> str:
    """Work out `value` once under a name and use it in `body`, also inside lambdas."""
    return f"transform(array({value}), {name} -> {body})[0]"


def doubles_sql(vector: str) -> str:
    return f"CAST({vector} AS array<double>)"


def total_sql(vector: str) -> str:
    return f"aggregate({vector}, 0D, (acc, x) -> acc + x)"


def difference_sql(left: str, right: str) -> str:
    return f"zip_with({doubles_sql(left)}, {doubles_sql(right)}, (a, b) -> a - b)"


def pair_vector_sql(ref: str, var: str) -> str:
    product = f"zip_with({doubles_sql(ref)}, {doubles_sql(var)}, (a, b) -> a * b)"
    return f"concat({difference_sql(ref, var)}, {product}, {doubles_sql(ref)}, {doubles_sql(var)})"


def pair_vector(ref: str, var: str) -> Column:
    """`[ref - var, ref * var, ref, var]` as one array."""
    return F.expr(pair_vector_sql(ref, var))


def flat_features(ref_mean: str, var_mean: str, engineered: str | None = None, mode: str = "full") -> Column:
    """One flat feature array per pair: `mean_only`, `diff_only` or `full`."""
    if mode == "mean_only":
        return F.expr(f"concat({doubles_sql(ref_mean)}, {doubles_sql(var_mean)})")
    if mode == "diff_only":
        return F.expr(difference_sql(ref_mean, var_mean))
    if mode != "full":
        raise ValueError(f"Unknown mode: {mode}. Use mean_only, diff_only or full")
    if engineered is None:
        raise ValueError("mode='full' needs the engineered features")
    return F.expr(f"concat({pair_vector_sql(ref_mean, var_mean)}, {doubles_sql(engineered)})")


def layer_norm(vector: str, eps: float = 1e-5) -> Column:
    """Subtract the mean of the vector and divide by its population deviation."""
    centred = let_sql("m", f"{total_sql('v')} / size(v)", "transform(v, x -> x - m)")
    variance = "aggregate(c, 0D, (acc, x) -> acc + x * x) / size(c)"
    scaled = let_sql("sd", f"sqrt({variance} + {eps!r}D)", "transform(c, x -> x / sd)")
    return F.expr(let_sql("c", let_sql("v", doubles_sql(vector), centred), scaled))


def softmax_sql(logits: str) -> str:
    exps = let_sql("top", "array_max(v)", "transform(v, x -> exp(x - top))")
    shares = let_sql("total", total_sql("e"), "transform(e, x -> x / total)")
    return let_sql("e", let_sql("v", doubles_sql(logits), exps), shares)


def softmax(logits: str) -> Column:
    """Class probabilities of a row of logits."""
    return F.expr(softmax_sql(logits))


def argmax(vector: str) -> Column:
    """0-based index of the first largest element."""
    return F.expr(f"CAST(array_position({vector}, array_max({vector})) - 1 AS int)")


def confidence(probabilities: str) -> Column:
    return F.expr(f"array_max({probabilities})")


def pseudo_probabilities(score: str, low: str, high: str) -> Column:
    """Three class shares from one score and its two cut points.

    Logistic below the lower cut, a unit Gaussian around the middle, logistic
    above the upper cut, scaled to sum to one.
    """
    s = f"CAST({score} AS double)"
    raw = (
        f"array(1 / (1 + exp({s} - {low})), exp(-pow({s} - ({low} + {high}) / 2, 2D) / 2),"
        f" 1 / (1 + exp({high} - {s})))"
    )
    return F.expr(let_sql("r", raw, let_sql("total", total_sql("r"), "transform(r, x -> x / total)")))


def length_change_score(ref: str, var: str, external: str = "NULL") -> Column:
    """Score of a pair from its lengths; equal lengths take the external score.

    Shorter variants score in proportion to what is lost, longer and identical
    ones zero.
    """
    r, v = f"coalesce({ref}, '')", f"coalesce({var}, '')"
    return F.expr(
        f"CASE WHEN length({v}) < length({r})"
        f" THEN {TRUNCATION_SCORE}D * (length({r}) - length({v})) / greatest(length({r}), 1)"
        f" WHEN length({v}) > length({r}) OR {r} = {v} THEN 0D ELSE CAST({external} AS double) END"
    )


def clamp(score: str, low: float = SCORE_RANGE[0], high: float = SCORE_RANGE[1]) -> Column:
    """Hold a score within a range; null stays null."""
    return F.expr(f"CASE WHEN {score} IS NOT NULL THEN greatest(least({score}, {high}D), {low}D) END")
