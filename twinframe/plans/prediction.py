"""From references and variants to explained predictions.

The model is a table of logits that the caller supplies, one row per gene.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import CLASS_NAMES
from ..functions.explain import annotate_edits, position_scores, summary, top_edits
from ..functions.sequence import find_edits_sql
from ..functions.vector import argmax, confidence, softmax
from ..operators.assemble import apply_variants, locate_variants
from ..operators.features import pair_features
from ..session import materialize


def variant_records(variants: DataFrame, references: DataFrame, annotations: DataFrame | None = None,
                    strict: bool = True) -> DataFrame:
    """Gene records out of variants: located, joined to references, applied, translated.

    Located variants are read twice, so with annotations they are stored.
    Without, genes are chromosomes.
    """
    located = locate_variants(variants, annotations)
    located = located.drop("chrom") if annotations is None else materialize(located, "located")
    return apply_variants(located, references, strict=strict)


def with_features(records: DataFrame, max_length: int | None = None) -> DataFrame:
    """Add the engineered features of each record."""
    return pair_features(records, "ref_protein", "var_protein", max_length)


def predict(
    records: DataFrame, logits: DataFrame, names: Mapping[int, str] = CLASS_NAMES, key: str = "gene"
) -> DataFrame:
    """Add `prediction`, `confidence` and `probabilities` from `logits` (key, logits).

    Both tables have one row per key, so both are shuffled: neither grows slower
    than the other, and Spark may take one for small that is not.
    """
    joined = records.join(logits.select(key, "logits").hint("merge"), key)
    label = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return (
        joined.withColumn("probabilities", softmax("logits")).drop("logits")
        .withColumns({
            "confidence": confidence("probabilities"),
            "prediction": label[argmax("probabilities")],
        })
    )


def explain(predictions: DataFrame, given: str | None = None, ref: str = "ref_protein",
            var: str = "var_protein") -> DataFrame:
    """Add `summary`, `top_positions` and `position_scores`."""
    annotated = predictions.withColumn("_edits", annotate_edits(find_edits_sql(ref, var)))
    return annotated.withColumns({
        "summary": summary("gene", "prediction", "confidence", ref, var, "_edits"),
        "top_positions": top_edits("_edits"),
        "position_scores": position_scores(ref, var, "_edits", given),
    }).drop("_edits")
