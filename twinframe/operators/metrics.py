"""Evaluation of predictions. Every function takes `by`, the keys to report per.

Class labels and predictions are small integers; `classes` lists them all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import CLASS_NAMES, CLASSES
from ..functions.loss import cross_entropy, focal_loss, smooth_l1
from .spread import average_ranks, exact_percentiles, lookup_join, running_totals

# Fixed value: what the comparison says where the annotators share no gene.
NO_OVERLAP = "No overlapping genes found"


def confusion_matrix(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction",
    classes: Sequence[int] = CLASSES,
) -> DataFrame:
    """Rows per true class and predicted class, zeros kept."""
    cells = F.array(*(
        F.expr(
            f"named_struct('{label}', {t}, '{prediction}', {p},"
            f" 'n', count_if({label} = {t} AND {prediction} = {p}))"
        )
        for t in classes for p in classes
    ))
    return df.groupBy(*by).agg(cells.alias("_cells")).select(*by, F.inline("_cells"))


def _class_counts(df, by, label, prediction, classes):
    """Per group an array with hits, predicted and true rows of each class."""
    per_class = F.array(*(
        F.expr(
            f"named_struct('class', {c}, 'hits', count_if({label} = {c} AND {prediction} = {c}),"
            f" 'predicted', count_if({prediction} = {c}), 'support', count_if({label} = {c}))"
        )
        for c in classes
    ))
    return df.groupBy(*by).agg(
        per_class.alias("_classes"),
        F.coalesce(F.avg((F.col(label) == F.col(prediction)).cast("double")), F.lit(0.0)).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
    )


def _with_scores(counts: DataFrame) -> DataFrame:
    def ratio(top: str, bottom: str) -> str:
        return f"if({bottom} = 0, 0D, {top} / ({bottom}))"

    scores = F.expr(
        "transform(_classes, c -> named_struct('class', c.class,"
        f" 'precision', {ratio('c.hits', 'c.predicted')}, 'recall', {ratio('c.hits', 'c.support')},"
        f" 'f1', {ratio('2 * c.hits', 'c.predicted + c.support')}, 'support', c.support,"
        " 'present', c.predicted + c.support > 0))"
    )
    return counts.withColumn("_scores", scores).drop("_classes")


def class_metrics(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction",
    classes: Sequence[int] = CLASSES,
) -> DataFrame:
    """Precision, recall, F1 and support of every class; 0 where a ratio has no rows."""
    counts = _with_scores(_class_counts(df, by, label, prediction, classes))
    return counts.select(*by, F.inline("_scores")).drop("present")


def _averages(name: str) -> tuple[Column, Column]:
    """Plain and support-weighted mean of a score over the classes that occur."""
    present = "filter(_scores, s -> s.present)"

    def total(term: str) -> str:
        return f"aggregate({present}, 0D, (acc, s) -> acc + {term})"

    plain = f"coalesce(try_divide({total('s.' + name)}, size({present})), 0D)"
    weighted = f"coalesce(try_divide({total(f's.{name} * s.support')}, {total('s.support')}), 0D)"
    return F.expr(plain), F.expr(weighted)


def overall_metrics(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction",
    classes: Sequence[int] = CLASSES,
) -> DataFrame:
    """Accuracy, macro F1 and weighted F1. The F1 means run over classes that occur."""
    counts = _with_scores(_class_counts(df, by, label, prediction, classes))
    macro, weighted = _averages("f1")
    return counts.select(*by, "accuracy", macro.alias("macro_f1"), weighted.alias("weighted_f1"))


def classification_report(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction",
    names: Mapping[int, str] = CLASS_NAMES,
) -> DataFrame:
    """Rows for every class, then accuracy, macro average and weighted average."""
    counts = _with_scores(_class_counts(df, by, label, prediction, list(names)))
    label_name = ", ".join(f"{c}, '{name}'" for c, name in names.items())
    per_class = F.expr(
        f"transform(_scores, s -> named_struct('row', map({label_name})[s.class],"
        " 'precision', s.precision, 'recall', s.recall, 'f1', s.f1, 'support', s.support))")
    means = {name: _averages(name) for name in ("precision", "recall", "f1")}
    none = F.lit(None).cast("double")

    def row(name: str, i: int) -> Column:
        return F.struct(
            F.lit(name).alias("row"), *(means[m][i].alias(m) for m in means), F.col("n").alias("support"))

    accuracy = F.struct(
        F.lit("accuracy").alias("row"), none.alias("precision"), none.alias("recall"),
        F.col("accuracy").alias("f1"), F.col("n").alias("support"))
    rows = F.concat(per_class, F.array(accuracy, row("macro avg", 0), row("weighted avg", 1)))
    return counts.select(*by, F.inline(rows))


def class_auroc(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", probabilities: str = "probabilities",
) -> DataFrame:
    """One-vs-rest area under the ROC curve for each place in the probabilities.

    Counts, for every positive row, the negative rows with a lower probability
    and half of those with the same one. Null where a class has no positive or
    no negative row.
    """
    long = df.select(*by, F.col(label).alias("_label"), F.posexplode(probabilities).alias("class", "_p"))
    positive = F.col("_label") == F.col("class")
    histogram = long.groupBy(*by, "class", "_p").agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    totals = running_totals(histogram, [*by, "class"], "_p", ["pos", "neg"])
    above = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    pairs = F.max("pos_total").cast("double") * F.max("neg_total")
    return totals.groupBy(*by, "class").agg(
        F.when(pairs > 0, above / pairs).alias("auroc"), F.max("pos_total").alias("support"))


def auroc(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", probabilities: str = "probabilities",
    undefined: float | None = 0.0,
) -> DataFrame:
    """Mean one-vs-rest area under the ROC curve.

    Null with one label only; `undefined` where some class has no row.
    """
    per_class = class_auroc(df, by, label, probabilities)
    present = F.count_if(F.col("support") > 0)
    value = (
        F.when(present <= 1, F.lit(None).cast("double"))
        .when(present < F.count(F.lit(1)), F.lit(undefined).cast("double"))
        .otherwise(F.avg("auroc"))
    )
    return per_class.groupBy(*by).agg(value.alias("auroc"))


def _correlation(x: str, y: str) -> Column:
    """Pearson correlation, 0 where either side is constant."""
    # Written out, since `corr` itself fails on a constant side.
    return F.coalesce(
        F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def _numbers(df, by, target, predicted):
    return df.select(
        *by, F.col(target).cast("double").alias("_x"), F.col(predicted).cast("double").alias("_y")
    ).filter(F.col("_x").isNotNull() & F.col("_y").isNotNull())


def _errors() -> list[Column]:
    error = F.col("_x") - F.col("_y")
    return [
        _correlation("_x", "_y").alias("pearson"), F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse")]


def regression_errors(
    df: DataFrame, by: Sequence[str] = (), target: str = "target", predicted: str = "predicted"
) -> DataFrame:
    """Pearson correlation, mean absolute and mean squared error."""
    return _numbers(df, by, target, predicted).groupBy(*by).agg(*_errors())


def _ranked(df: DataFrame, by: Sequence[str], target: str, predicted: str) -> DataFrame:
    """Both numbers of each row with their average ranks in the group."""
    rows = _numbers(df, by, target, predicted)
    ranked = rows
    for value in ("_x", "_y"):
        ranks = average_ranks(rows, by, value, f"{value}_rank")
        ranked = lookup_join(ranked, ranks, [*by, value], "n")
    return ranked


def spearman(
    df: DataFrame, by: Sequence[str] = (), target: str = "target", predicted: str = "predicted"
) -> DataFrame:
    """Correlation of average ranks, 0 where either side is constant."""
    return _ranked(df, by, target, predicted).groupBy(*by).agg(
        _correlation("_x_rank", "_y_rank").alias("spearman"))


def regression_metrics(
    df: DataFrame, by: Sequence[str] = (), target: str = "target", predicted: str = "predicted"
) -> DataFrame:
    """Pearson, Spearman, mean absolute and mean squared error, in one pass over the ranked rows."""
    return _ranked(df, by, target, predicted).groupBy(*by).agg(
        *_errors(), _correlation("_x_rank", "_y_rank").alias("spearman"))


def _beside(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Put two reports with one row per group next to each other."""
    if by:
        return left.join(right, list(by), "left")
    row = right.select(F.struct(*right.columns)).scalar()
    return left.withColumn("_right", row).select(*left.columns, "_right.*")


def method_table(
    df: DataFrame, method: str = "method", label: str = "label", prediction: str = "prediction",
    probabilities: str = "probabilities", target: str | None = None, predicted: str | None = None,
    classes: Sequence[int] = CLASSES,
) -> DataFrame:
    """One row of metrics per method, all methods in one pass each."""
    by = [method]
    table = overall_metrics(df, by, label, prediction, classes)
    table = _beside(table, auroc(df, by, label, probabilities, undefined=None), by)
    if target and predicted:
        table = _beside(table, spearman(df, by, target, predicted), by)
    return table


def percentile_classes(
    df: DataFrame, score: str = "score", low: float = 0.33, high: float = 0.67
) -> DataFrame:
    """Add the two cut points of the scores and the class they give each row."""
    cuts = exact_percentiles(df, score, [low, high]).select("percentiles").scalar()
    value = F.col(score)
    return (
        df.withColumn("_cuts", cuts)
        .withColumns({"cut_low": F.get("_cuts", 0), "cut_high": F.get("_cuts", 1)}).drop("_cuts")
        .withColumn(
            "prediction",
            F.when(value < F.col("cut_low"), 0).when(value > F.col("cut_high"), 2).otherwise(1))
    )


def mean_losses(
    df: DataFrame, by: Sequence[str] = (), logits: str = "logits", label: str = "label",
    predicted: str | None = None, target: str | None = None, smoothing: float = 0.0,
    gamma: float = 2.0, weight: float = 0.1,
) -> DataFrame:
    """Mean cross-entropy and focal loss; with numbers also Smooth-L1 and the combined loss."""
    ce, focal = cross_entropy(logits, label, smoothing), focal_loss(logits, label, gamma, smoothing)
    means = [F.avg(ce).alias("cross_entropy"), F.avg(focal).alias("focal")]
    if predicted and target:
        l1 = smooth_l1(predicted, target)
        means += [F.avg(l1).alias("smooth_l1"), (F.avg(ce) + F.avg(l1) * weight).alias("combined")]
    return df.groupBy(*by).agg(*means)


def join_annotators(left: DataFrame, right: DataFrame, on: str = "gene") -> DataFrame:
    """Keys that both annotators have."""
    return left.join(right, on, "inner")


def concordance(
    joined: DataFrame, first: str, second: str, labels: Sequence, by: Sequence[str] = ()
) -> DataFrame:
    """Agreement of two annotators, overall and where the second gives each label.

    A label that the second annotator never gives has a null concordance.
    Without any common key only the error text is set besides zeros.
    """
    same = F.col(first) == F.col(second)
    total, agree = F.count(F.lit(1)), F.count_if(same)
    return joined.groupBy(*by).agg(
        total.alias("total"),
        F.when(total > 0, agree / total).otherwise(F.lit(0.0)).alias("agreement_rate"),
        agree.alias("agree_count"),
        (total - agree).alias("disagree_count"),
        *(
            F.try_divide(F.count_if(same & (F.col(second) == x)), F.count_if(F.col(second) == x))
            .alias(f"{x}_concordance")
            for x in labels
        ),
        F.when(total == 0, F.lit(NO_OVERLAP)).alias("error"),
    )


def disagreements(joined: DataFrame, first: str, second: str, keep: Sequence[str]) -> DataFrame:
    """Rows on which the two annotators differ."""
    return joined.filter(F.col(first) != F.col(second)).select(*keep, first, second)
