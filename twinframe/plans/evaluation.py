"""Whole evaluation reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .. import CLASSES
from ..operators.metrics import (
    _beside,
    auroc,
    concordance,
    disagreements,
    join_annotators,
    overall_metrics,
    regression_metrics,
)


def evaluate(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction",
    probabilities: str | None = "probabilities", target: str | None = None, predicted: str | None = None,
    classes: Sequence[int] = CLASSES,
) -> DataFrame:
    """One row of metrics per group: F1 means, accuracy, AUROC, correlations, errors."""
    by = list(by)
    report = overall_metrics(df, by, label, prediction, classes)
    if probabilities:
        report = _beside(report, auroc(df, by, label, probabilities), by)
    if target and predicted:
        report = _beside(report, regression_metrics(df, by, target, predicted), by)
    return report


def compare_annotators(
    predictions: DataFrame, annotations: DataFrame, labels: Sequence[str], key: str = "gene"
) -> tuple[DataFrame, DataFrame]:
    """Concordance of predictions with annotations, and the rows where they differ."""
    joined = join_annotators(
        predictions.select(key, predictions["prediction"].alias("predicted_label")),
        annotations.withColumnRenamed("label", "annotated_label"), key)
    report = concordance(joined, "predicted_label", "annotated_label", labels)
    kept = [key, "effect"] if "effect" in annotations.columns else [key]
    return report, disagreements(joined, "predicted_label", "annotated_label", kept)
