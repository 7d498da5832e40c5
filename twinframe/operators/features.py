"""The engineered features of a pair of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import (
    MISSENSE,
    NONSENSE,
    clip,
    find_edits,
    premature_stop_sql,
    region_sql,
    sequence_identity_sql,
    truncation_fraction_sql,
)

# The order of the features in a vector.
FEATURES = (
    "length_changed", "premature_stop", "start_lost", "missense_share", "nonsense_count",
    "dissimilarity", "truncation", "edit_density", "n_terminal_share", "c_terminal_share",
    "log_edits", "length_ratio",
)
START = "M"


def with_edits(df: DataFrame, ref: str = "ref_seq", var: str = "var_seq", edits: str = "edits") -> DataFrame:
    """Add the edit events of each pair."""
    return df.withColumn(edits, find_edits(ref, var))


def explode_edits(df: DataFrame, edits: str = "edits") -> DataFrame:
    """One row per edit event, with the columns of the event."""
    kept = [c for c in df.columns if c != edits]
    return df.select(*kept, F.inline(edits))


def feature_columns(ref: str, var: str, edits: str) -> dict[str, Column]:
    """The features by name, from the texts and their edit events."""
    r, v = f"coalesce({ref}, '')", f"coalesce({var}, '')"
    length, total = f"greatest(length({r}), 1)", f"size({edits})"

    def of_kind(kind: str) -> str:
        return f"size(filter({edits}, e -> e.type = '{kind}'))"

    def share_in(part: str) -> str:
        inside = f"size(filter({edits}, edit__ -> {region_sql('edit__.position', length)} = '{part}'))"
        return f"if({total} > 0, {inside} / {total}, 0D)"

    values = (
        f"CAST(length({v}) <> length({r}) AS double)",
        f"CAST({premature_stop_sql(r, v)} AS double)",
        f"CAST(startswith({r}, '{START}') AND NOT startswith({v}, '{START}') AS double)",
        f"{of_kind(MISSENSE)} / {length}",
        f"CAST({of_kind(NONSENSE)} AS double)",
        f"1 - {sequence_identity_sql(ref, var, edits)}",
        truncation_fraction_sql(r, v),
        f"{total} / {length} * 100",
        share_in("N-terminal"),
        share_in("C-terminal"),
        f"log1p({total})",
        f"length({v}) / {length}",
    )
    return {name: F.expr(value) for name, value in zip(FEATURES, values)}


def pair_features(
    df: DataFrame,
    ref: str = "ref_seq",
    var: str = "var_seq",
    max_length: int | None = None,
    keep_edits: bool = False,
) -> DataFrame:
    """Add the twelve features of each pair as named columns.

    With `max_length` both texts are cut first, as for training tables; without
    it whole texts are compared, as for reports.
    """
    work = df
    left, right = ref, var
    if max_length is not None:
        left, right = "_ref", "_var"
        work = work.withColumns({left: clip(ref, max_length), right: clip(var, max_length)})
    work = with_edits(work, left, right, "_edits")
    work = work.withColumns(feature_columns(left, right, "_edits"))
    if keep_edits:
        work = work.withColumn("edits", F.col("_edits"))
    return work.drop("_edits", "_ref", "_var")


def feature_vector(prefix: str = "") -> Column:
    """The features as one array, for the edge to vector code."""
    return F.array(*(prefix + name for name in FEATURES))
