"""Curation of scored records: references, scores, labels, dedup, sampling, splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import CLASSES
from ..functions.rules import contains_any, has_score, held_out, keyword_match, threshold_label
from ..session import materialize
from .spread import hash_order, lookup_join, prefix_histogram, rank_cuts, running_totals, with_once

# Shortest usable reference is longer than this, and the band of
# scores in which the first row stands for the unchanged text.
MIN_REFERENCE = 10
NEUTRAL_BAND = (-0.1, 0.1)
TRAIN, VAL, TEST = "train", "val", "test"
# Classes with fewer rows than this cannot be divided over three splits.
MIN_PER_CLASS = 3


def filter_catalog(
    catalog: DataFrame,
    keywords: Sequence[str],
    id_columns: Sequence[str] = ("DMS_id", "UniProt_ID"),
    id_patterns: Sequence[str] = (),
) -> DataFrame:
    """Rows of a catalog that any keyword matches."""
    return catalog.filter(keyword_match(catalog.columns, keywords, id_columns, id_patterns))


def filter_by_catalog(
    df: DataFrame, stem: str, catalog: DataFrame, catalog_id: str, keywords: Sequence[str] = ()
) -> DataFrame:
    """Rows whose stem contains some catalog id, or some keyword in lower case.

    Distinct stems are cut into pieces as long as powers of two. An id has
    pieces too, as long as the largest power of two that it is long, and is filed
    under the one that the fewest stems have; ids with a piece that no stem has
    are in no stem. "Contains" is checked only where a stem has the piece an id
    is filed under, so what many ids share, such as a prefix, brings no checks.
    """
    ids = (
        catalog.select(F.col(catalog_id).alias("_id")).filter(F.length("_id") > 0).distinct()
        .withColumn("_size", F.expr("shiftleft(1, CAST(floor(log2(length(_id))) AS int))")))
    sizes = ids.select(F.array_sort(F.collect_set("_size"))).scalar()
    stems = df.select(F.col(stem).alias("_stem")).filter(F.col("_stem").isNotNull()).distinct()
    parts = materialize(_pieces(
        stems.withColumn("_size", F.explode(sizes)).filter(F.col("_size") <= F.length("_stem")), "_stem").distinct(), "pieces")
    frequent = parts.groupBy("_size", "_part").agg(F.count(F.lit(1)).alias("_n"))
    filed = (
        _pieces(ids, "_id").distinct().join(frequent, ["_size", "_part"], "left")
        .groupBy("_id", "_size").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_part")).alias("_rarest"))
        .filter(F.col("_rarest._n") > 0).select("_id", "_size", F.col("_rarest._part").alias("_part")))
    agree = (filed["_part"] == parts["_part"]) & (filed["_size"] == parts["_size"])
    known = parts.join(filed, agree & F.contains(parts["_stem"], filed["_id"]), "left_semi").select("_stem").distinct()
    wanted = known.union(stems.filter(contains_any("_stem", keywords))).distinct()
    return df.join(wanted, df[stem] == wanted["_stem"], "left_semi")


def _pieces(texts: DataFrame, text: str) -> DataFrame:
    """`(text, _size, _part)`: every piece of `_size` characters of each text."""
    return texts.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length(text) - F.col("_size") + 1))).select(
        text, "_size", F.substring(F.col(text), F.col("_at"), F.col("_size")).alias("_part"))


def catalog_references(
    catalog: DataFrame, assay: str = "DMS_id", sequence: str = "target_seq", order: str = "row_no"
) -> DataFrame:
    """Reference text per assay: long enough, the last one in `order` where an id repeats."""
    usable = catalog.filter((F.length(assay) > 0) & (F.length(sequence) > MIN_REFERENCE))
    return usable.groupBy(F.col(assay).alias("assay")).agg(F.max_by(sequence, order).alias("ref_seq"))


def inferred_references(
    scores: DataFrame, assay: str = "assay", score: str = "score",
    sequence: str = "mutated_sequence", order: str = "row_no",
) -> DataFrame:
    """Text of each assay's first row whose score lies in the neutral band."""
    near = scores.filter(F.col(score).between(*NEUTRAL_BAND))
    return (
        near.groupBy(F.col(assay).alias("assay")).agg(F.min_by(sequence, order).alias("inferred_seq"))
        .filter(F.length("inferred_seq") > 0)
    )


def with_references(
    scores: DataFrame, references: DataFrame, inferred: DataFrame | None = None, assay: str = "assay"
) -> DataFrame:
    """Add `ref_seq` from the catalog, else the inferred one; without either the row goes."""
    table = references.select("assay", "ref_seq")
    if inferred is not None:
        table = table.join(inferred, "assay", "full").select(
            "assay", F.coalesce("ref_seq", "inferred_seq").alias("ref_seq")
        )
    renamed = table.withColumnRenamed("assay", assay) if assay != "assay" else table
    return lookup_join(scores, renamed, [assay], how="inner")


def assay_table(scores: DataFrame, references: DataFrame, infer: bool = True) -> DataFrame:
    """Per assay the reference, the mean and deviation of its scores, and its rows.

    `ref_seq` is null for an assay without a reference. Statistics are numbers,
    which Spark adds up by hashing; the texts of `inferred_references`, for which
    it sorts, are looked for apart, among the few rows of the neutral band.
    Without `infer` they are not, and the scores need `assay` and `score` only.
    """
    scored = F.when(has_score("score"), F.col("score"))
    sd = F.stddev_samp(scored)
    found = (
        scores.groupBy("assay").agg(
            F.avg(scored).alias("mean"),
            F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias("sd"),
            F.count(F.lit(1)).alias("n"),
        )
        .join(references.select("assay", "ref_seq"), "assay", "left")
    )
    if not infer:
        return found
    return found.join(inferred_references(scores), "assay", "left").select(
        "assay", "mean", "sd", "n", F.coalesce("ref_seq", "inferred_seq").alias("ref_seq"))


def score_statistics(df: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """Mean, sample deviation (1.0 where it is zero) and row count per group."""
    sd = F.stddev_samp(score)
    return df.filter(has_score(score)).groupBy(*by).agg(
        F.avg(score).alias("mean"),
        F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias("sd"),
        F.count(F.lit(1)).alias("n"),
    )


def standardize_scores(df: DataFrame, by: Sequence[str], score: str, z: str = "zscore") -> DataFrame:
    """Drop rows without a score and add the z-score within the group.

    A group of one row has no sample deviation, so its z-score is null.
    """
    stats = score_statistics(df, by, score)
    joined = lookup_join(df.filter(has_score(score)), stats, list(by), "n")
    return joined.withColumn(z, (F.col(score) - F.col("mean")) / F.col("sd")).drop("mean", "sd")


def with_labels(
    df: DataFrame, z: str = "zscore", low: float = 1.0, high: float = 1.0, label: str = "label"
) -> DataFrame:
    """Add the three-way label of a z-score."""
    return df.withColumn(label, threshold_label(z, low, high))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order.

    Spark keeps one candidate per key in every task before it shuffles, so many
    copies of one key do not meet in one task.
    """
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(first)).filter("_row = 1").drop("_row")


def with_default_columns(
    df: DataFrame, texts: Sequence[str], scores: Sequence[str], label: str | None = "label"
) -> DataFrame:
    """Add missing text columns as `''` and missing scores as null; make the label an int."""
    missing = {c: F.lit("") for c in texts if c not in df.columns}
    missing |= {c: F.lit(None).cast("double") for c in scores if c not in df.columns}
    if label is not None:
        found = F.col(label).cast("int") if label in df.columns else F.lit(None).cast("int")
        missing[label] = found
    return df.withColumns(missing) if missing else df


def label_counts(
    df: DataFrame, label: str = "label", by: Sequence[str] = (), classes: Sequence[int] = CLASSES
) -> DataFrame:
    """Rows per class, 0 for a class without rows; one row per group and class."""
    counts = df.groupBy(*by).agg(
        F.array(*(
            F.expr(f"named_struct('label', {c}, 'n', count_if({label} = {c}))")
            for c in classes)).alias("_counts")
    )
    return counts.select(*by, F.inline("_counts"))


def _position(order: str, key: Sequence[str]) -> Column:
    return F.struct(F.col(order), *(F.col(c) for c in key))


def balance_classes(
    df: DataFrame,
    key: Sequence[str],
    per_class: int | Column,
    label: str = "label",
    classes: Sequence[int] = CLASSES,
    seed: int = 42,
) -> DataFrame:
    """At most `per_class` rows of each class, picked in a fixed hash order.

    `per_class` may be a scalar subquery, such as a share of another table's rows.

    `key` must be unique. Every class gives exactly the smaller of its size and
    `per_class`. The rows themselves are not shuffled.
    """
    work = df.withColumn("_order", hash_order(key, seed))

    def ranks(table: DataFrame) -> DataFrame:
        return table.withColumn("keep", F.least(F.col("n"), per_class if isinstance(per_class, Column) else F.lit(per_class)))

    cuts = rank_cuts(work, label, classes, "_order", key, ranks, ["keep"])
    return (
        work.join(F.broadcast(cuts), label)
        .filter(_position("_order", key) <= F.col("keep"))
        .select(*df.columns)
    )


def shuffle_rows(df: DataFrame, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Put rows in a fixed hash order; only for output where order is looked at."""
    return df.orderBy(hash_order(key, seed), *key)


def places_in_hash_order(df: DataFrame, key: Sequence[str], seed: int = 42) -> DataFrame:
    """`df` with `place`, each row's number in the order of `shuffle_rows`, from 1.

    `key` must be unique. Rows are numbered range by range, not in one task.
    """
    marked = df.withColumn("_position", F.struct(hash_order(key, seed).alias("h"), *key)).withColumn("_one", F.lit(1))
    return running_totals(marked, [], "_position", ["_one"]).select(
        *df.columns, (F.col("_one_before") + 1).alias("place"))


def _share_out(table: DataFrame, size: str, draws: Column, name: str) -> DataFrame:
    """Share `draws` out in proportion to `size`, by largest remainder, as whole numbers.

    `table` has one row per class.
    """
    everyone = Window.partitionBy()
    quota = F.col(size) / F.sum(size).over(everyone) * draws
    by_rest = Window.partitionBy().orderBy(F.desc(F.col("_quota") - F.col("_floor")), "_stratum")
    return (
        table.withColumn("_quota", quota)
        .withColumn("_floor", F.floor("_quota"))
        .withColumn("_open", draws - F.sum("_floor").over(everyone))
        .withColumn(
            name,
            F.col("_floor") + (F.row_number().over(by_rest) <= F.col("_open")).cast("long"),
        )
        .drop("_quota", "_floor", "_open")
    )


def split_sizes(counts: DataFrame, test_size: float, val_size: float) -> DataFrame:
    """Rows of each stratum that go to test, and to test or validation.

    `counts` has `_stratum` and `n`. Sizes over all strata are rounded up, as
    whole numbers, and shared out by largest remainder.
    """
    everyone = Window.partitionBy()
    all_rows = F.sum("n").over(everyone)
    test_rows = F.ceil(all_rows * F.lit(float(test_size)))
    with_test = _share_out(
        counts.withColumn("_rest", all_rows - test_rows), "n", F.col("_rest"), "_train_val"
    )
    val_rows = F.ceil(F.col("_rest") * F.lit(val_size / (1 - test_size)))
    with_val = _share_out(
        with_test.withColumn("_fit", F.col("_rest") - val_rows), "_train_val", F.col("_fit"), "_train"
    )
    return with_val.select(
        "_stratum", "n",
        (F.col("n") - F.col("_train_val")).alias("to_test"),
        (F.col("n") - F.col("_train")).alias("to_val"),
    )


def stratified_split(
    df: DataFrame,
    key: Sequence[str],
    label: str = "label",
    test_size: float = 0.1,
    val_size: float = 0.1,
    seed: int = 42,
    group: str | None = None,
    hold_out: Sequence[str] = (),
    classes: Sequence[int] = CLASSES,
) -> DataFrame:
    """Add `split` with `train`, `val` or `test`, in proportion to the classes.

    Groups named in `hold_out` go to test as a whole, unless that would take
    every row. With fewer than three rows in some class, or with splits too
    small to hold every class, the classes are not looked at. `key` must be
    unique; `classes` must list every label, and -1 is not allowed as one. A null
    label, or one that isn't listed, is an error.

    One pass gives a stored histogram of labels and hash prefixes, from which
    everything is decided; a second finds the rows at the cuts, a third adds
    the split.
    """
    held = held_out(group, hold_out) if group and hold_out else F.lit(False)
    listed = F.when(F.col(label).isin(*classes), F.col(label)).otherwise(
        F.raise_error(F.concat(F.lit("no class lists the label "), F.coalesce(F.col(label).cast("string"), F.lit("null"))))
        .cast(df.schema[label].dataType))
    work = with_once(df, _order=hash_order(key, seed), _out=F.coalesce(held, F.lit(False)), _label=listed)
    stored = materialize(prefix_histogram(work, ["_label", "_out"], "_order"), "prefixes")
    # Where every row is held out, none is.
    some_left = not stored.filter(~F.col("_out")).isEmpty()
    if not some_left:
        work, stored = work.withColumn("_out", F.lit(False)), stored.withColumn("_out", F.lit(False))
    free = stored.filter(~F.col("_out"))

    counts = free.groupBy(F.col("_label").alias("_stratum")).agg(F.sum("_n").alias("n"))
    sizes = split_sizes(counts, test_size, val_size)
    k = F.count(F.lit(1))
    test, val, train = F.sum("to_test"), F.sum(F.col("to_val") - F.col("to_test")), F.sum(F.col("n") - F.col("to_val"))
    divisible = sizes.agg(
        F.coalesce(
            (F.min("n") >= MIN_PER_CLASS) & (test >= k) & (val >= k) & (train >= k)
            & (F.min(F.col("n") - F.col("to_test")) >= 2),
            F.lit(False),
        )
    ).first()[0]
    stratum = F.col("_label") if divisible else F.lit(-1)
    work = work.withColumn("_stratum", stratum)
    histogram = free.groupBy(stratum.alias("_stratum"), "_prefix").agg(F.sum("_n").alias("_n"))

    def ranks(table: DataFrame) -> DataFrame:
        return split_sizes(table, test_size, val_size)

    cuts = rank_cuts(
        work.filter(~F.col("_out")), "_stratum", [*classes, -1], "_order", key, ranks,
        ["to_test", "to_val"], histogram,
    )
    place = _position("_order", key)
    split = (
        F.when(F.col("_out"), TEST)
        .when(place <= F.col("to_test"), TEST)
        .when(place <= F.col("to_val"), VAL)
        .otherwise(TRAIN)
    )
    return work.join(F.broadcast(cuts), "_stratum", "left").select(*df.columns, split.alias("split"))


def highest_impact(
    df: DataFrame, key: str = "gene", impact: str = "impact", order: Sequence[str] = ("row_no",),
    levels: Mapping[str, int] | None = None,
) -> DataFrame:
    """The annotation of highest impact for each key, the first one where several tie."""
    levels = IMPACT_LEVELS if levels is None else levels
    score = F.lit(0)
    for name, level in levels.items():
        score = F.when(F.col(impact) == name, F.lit(level)).otherwise(score)
    return first_per_key(df, [key], [F.desc(score), *order])


# Order of annotation impacts; anything else counts as 0.
IMPACT_LEVELS = {"HIGH": 3, "MODERATE": 2, "LOW": 1, "MODIFIER": 0}
