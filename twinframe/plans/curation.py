"""From score files to labelled, balanced and split pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import CLASSES
from ..functions.rules import first_known_token, has_score, is_changed_pair, not_empty
from ..functions.sequence import build_variant
from ..operators.curate import (
    assay_table,
    balance_classes,
    first_per_key,
    stratified_split,
    with_labels,
)
from ..operators.spread import lookup_join, with_once
from ..session import materialize

PAIR = ["ref_seq", "var_seq"]
# Fixed value: rows of each class in a balanced set.
PER_CLASS = 100_000


def label_pairs(
    scores: DataFrame,
    references: DataFrame,
    low: float = 1.0,
    high: float = 1.0,
    group_names: Mapping[str, str] | None = None,
    source: str = "",
    assays: DataFrame | None = None,
) -> DataFrame:
    """Labelled pairs out of scores: `assay`, `score`, `mutant`, `mutated_sequence`, `row_no`.

    Statistics cover every scored row of an assay; pairs that do not change the
    reference are dropped after that, then all but the first copy of each pair.
    `assays` stands for `assay_table(scores, references)` where the caller has a
    cheaper way to it, such as scores without texts.
    """
    # The group follows from the assay, so it is looked up once for each.
    if assays is None:
        assays = assay_table(scores, references)
    assays = assays.withColumn("species", first_known_token("assay", group_names or {}))
    known = lookup_join(scores.filter(has_score("score")), assays, ["assay"], "n").filter("ref_seq IS NOT NULL")
    scored = known.withColumn("zscore", (F.col("score") - F.col("mean")) / F.col("sd"))
    labelled = with_labels(scored, "zscore", low, high)
    built = with_once(labelled, var_seq=build_variant("ref_seq", "mutant", "mutated_sequence"))
    pairs = built.select(
        F.col("assay").alias("gene"), "species", "ref_seq", "var_seq",
        "label", "score", "zscore", F.lit(source).alias("source"), "row_no",
    ).filter(is_changed_pair("ref_seq", "var_seq"))
    return first_per_key(pairs, PAIR, ["row_no"])


def balance_and_split(
    pairs: DataFrame,
    per_class: int = PER_CLASS,
    hold_out: Sequence[str] = (),
    test_size: float = 0.1,
    val_size: float = 0.1,
    seed: int = 42,
    classes: Sequence[int] = CLASSES,
    key: Sequence[str] = tuple(PAIR),
    order: Sequence[str] = ("row_no",),
    store: bool = True,
    unique: bool = False,
) -> DataFrame:
    """Drop empty and repeated pairs, balance the classes and add `split`.

    With `unique` the pairs are known to be neither, as those of `label_pairs`
    are; `order` is not looked at then, so its columns may be missing. Sampling and splitting read their input several times. With `store` the
    deduplicated and the balanced pairs are therefore written once each to the
    shared folder.
    """
    kept = pairs if unique else first_per_key(pairs.filter(not_empty(*PAIR)), PAIR, list(order))
    if store:
        kept = materialize(kept, "unique-pairs")
    balanced = balance_classes(kept, list(key), per_class, classes=classes, seed=seed)
    if store:
        balanced = materialize(balanced, "balanced-pairs")
    return stratified_split(
        balanced, list(key), test_size=test_size, val_size=val_size, seed=seed,
        group="species", hold_out=hold_out, classes=classes,
    )
