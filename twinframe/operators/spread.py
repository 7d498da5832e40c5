"""Building blocks that keep grouped work spread over the cluster.

A group, key or value may hold a large part of all rows. The helpers below give
the exact result without ever sending such a group to one task:

* `lookup_join` joins a table with one row per key to many rows per key;
* `running_totals` gives prefix sums over an ordered histogram;
* `rank_cuts` finds, for each class, the rows that close a given number of rows
  in hash order, so that samples and splits become plain filters.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, store, stored_bytes

# A lookup table of at most so many stored bytes is broadcast.
BROADCAST_BYTES = 8 << 20
# A key with more than one row in so many is split; there can be no more such keys.
SPLIT = 1024
HASH_DIGITS = 4


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once per row, whatever uses them later.

    Spark moves a filter below the projection it follows and repeats the column's
    whole expression in it. It does not do so for the output of a generator.
    """
    row = F.struct(*(column.alias(name) for name, column in columns.items()))
    return df.select("*", F.inline(F.array(row)))


def row_salt(df: DataFrame) -> Column:
    """A hash of the row's own content.

    It stays the same when a task runs again, which a random number would not.
    """
    usable = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(*(F.col(f"`{c}`") for c in usable))


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    weight: str | None = None,
    how: str = "left",
    stored: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    split: int = SPLIT,
) -> DataFrame:
    """Join `table`, unique on `on`, to every row of `df`.

    `weight` names a column of `table`, dropped from the result, that holds
    about how many rows of `df` have the key; every frequent key must then be in
    the table. Without it keys are counted, those that the table lacks too.

    The table is written once to the shared folder, and broadcast if it has at
    most `broadcast_bytes` there. Else both sides are shuffled. A key with more
    than 1/`split` of the rows is dealt out by a salt then: its row of the table
    is repeated once per salt, which adds at most 2 * `split` rows. Only hashes
    of such keys are broadcast. Rows with a null key are spread too.

    `stored` says that the table, with its weights, is stored already.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"Join type {how!r} is not offered; take 'left' or 'inner'")
    spark, on = df.sparkSession, list(on)
    values = [c for c in table.columns if c not in (*on, weight)]
    packed = table.select(
        *on, F.struct(*values).alias("_value"), *([F.col(weight).alias("_weight")] if weight else []))
    if weight is None:
        counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_weight"))
        packed = counts.join(packed, on, "left")
    found = [F.col("_value")[c].alias(c) for c in values]
    if not (stored and weight):
        path = store(packed, "lookup")
        packed = spark.read.schema(packed.schema).parquet(path)
        if stored_bytes(spark, path) <= broadcast_bytes:
            small = packed.filter(F.col("_value").isNotNull()).select(*on, "_value")
            return df.join(F.broadcast(small), on, how).select(*df.columns, *found)
    total = packed.agg(F.sum("_weight")).first()[0] or 0
    mark = F.xxhash64(*on)
    heavy = F.broadcast(
        packed.filter(F.col("_weight") * split > total)
        .groupBy(mark.alias("_mark")).agg(F.ceil(F.max("_weight") * split / F.lit(total)).cast("int").alias("_salts")))
    unmatched = F.lit(False)
    for c in on:
        unmatched = unmatched | F.col(c).isNull()
    spread = F.when(unmatched, F.lit(1 << 20)).otherwise(F.coalesce("_salts", F.lit(1)))
    left = (
        df.withColumn("_mark", mark).join(heavy, "_mark", "left")
        .withColumn("_salt", F.pmod(row_salt(df), spread).cast("int")))
    right = (
        packed.filter(F.col("_value").isNotNull()).withColumn("_mark", mark).join(heavy, "_mark", "left")
        .select(*on, "_value", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)).alias("_salt")))
    return left.join(right, [*on, "_salt"], how).select(*df.columns, *found)


def running_totals(
    histogram: DataFrame, by: Sequence[str], value: str, counts: Sequence[str],
) -> DataFrame:
    """Totals before each value, and over the whole group, in the order of `value`.

    `histogram` has one row per group and value. Adds `<count>_before` and
    `<count>_total` for every name in `counts`. The histogram is dealt out in
    ranges of group and value, as many as there are shuffle partitions, and
    stored with the number of its range. Ranges are added up first, so no task
    orders more than one range of a group, and the totals have one row per
    group and range.
    """
    by, counts = list(by), list(counts)
    ranged = materialize(
        histogram.repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()), "histogram")
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    renamed = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    offsets = (
        ranged.groupBy(*by, "_range").agg(*(F.sum(c).alias(f"_{c}") for c in counts))
        .select(
            *renamed, F.col("_range").alias("_at"),
            *(F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}_offset") for c in counts),
            *(F.sum(f"_{c}").over(whole).alias(f"{c}_total") for c in counts),
        )
    )
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_range") == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return (
        ranged.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_{c}_inside") for c in counts))
        .join(offsets, same)
        .select(
            *histogram.columns,
            *((F.col(f"_{c}_offset") + F.col(f"_{c}_inside")).alias(f"{c}_before") for c in counts),
            *(f"{c}_total" for c in counts),
        )
    )


def average_ranks(df: DataFrame, by: Sequence[str], value: str, rank: str = "rank") -> DataFrame:
    """Average rank of each distinct value in its group, with its row count `n`.

    Ties share the mean of their ranks. One row per group and value.
    """
    histogram = (
        df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    )
    return running_totals(histogram, by, value, ["n"]).select(
        *by, value, "n", (F.col("n_before") + (F.col("n") + 1) / 2).alias(rank)
    )


def exact_percentiles(
    df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact percentiles with linear interpolation, one array per group.

    The built-in exact percentile keeps all distinct values of a group in one
    task; this one finds the two neighbours of each share by prefix sums.
    """
    by = list(by)
    histogram = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = running_totals(histogram, by, "_v", ["n"])
    end = F.col("n_before") + F.col("n")
    found = []
    for i, share in enumerate(shares):
        at = (F.col("n_total") - 1) * F.lit(float(share))
        found += [
            F.min(F.when(end > F.floor(at), F.col("_v"))).alias(f"_low{i}"),
            F.min(F.when(end > F.ceil(at), F.col("_v"))).alias(f"_high{i}"),
            F.max(at - F.floor(at)).alias(f"_part{i}"),
        ]
    between = [
        F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_part{i}")
        for i in range(len(shares))
    ]
    return totals.groupBy(*by).agg(*found).select(*by, F.array(*between).alias("percentiles"))


def hash_order(key: Sequence[str], seed: int = 42) -> Column:
    """A fixed pseudo-random order of rows: MD5 of the key columns and the seed."""
    return F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in key), F.lit(str(seed))))


def prefix_histogram(df: DataFrame, by: Sequence[str | Column], order: str) -> DataFrame:
    """Rows per group and hash prefix: `_prefix` and `_n`, 65,536 rows per group at most."""
    prefix = F.substring(order, 1, HASH_DIGITS)
    return df.groupBy(*by, prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"))


def rank_cuts(
    df: DataFrame,
    stratum: str,
    strata: Sequence,
    order: str,
    key: Sequence[str],
    ranks: Callable[[DataFrame], DataFrame],
    names: Sequence[str],
    histogram: DataFrame | None = None,
) -> DataFrame:
    """For each stratum, the row that closes each requested number of rows.

    `order` names a column of MD5 digits and `key` columns that are unique.
    `ranks` gets a table of strata with their row count `n` and returns it with
    one column of wanted numbers per name. The result has one row per stratum
    and, per name, the cut as a struct to compare `struct(order, *key)` with;
    it is null where no row is wanted. `strata` lists every value, which bounds
    every table that is broadcast here.

    A histogram over hash prefixes shows in which prefix a cut falls, and only
    the rows of that prefix are put in order. `histogram` is one that
    `prefix_histogram` gave for these strata, and is best a stored one.
    """
    known = df.filter(F.col(stratum).isin(*strata))
    prefix = F.substring(order, 1, HASH_DIGITS)
    if histogram is None:
        histogram = materialize(prefix_histogram(known, [stratum], order), "prefixes")
    wanted = ranks(histogram.groupBy(stratum).agg(F.sum("_n").alias("n"))).select(stratum, *names)
    upto = Window.partitionBy(stratum).orderBy("_prefix")
    places = (
        histogram.withColumn("_end", F.sum("_n").over(upto))
        .join(F.broadcast(wanted), stratum)
        .select(
            stratum, "_prefix", (F.col("_end") - F.col("_n")).alias("_before"), "_end",
            F.explode(F.array(*(
                F.struct(F.lit(name).alias("name"), F.col(name).cast("long").alias("rank"))
                for name in names))).alias("_w"),
        )
        .filter((F.col("_before") < F.col("_w.rank")) & (F.col("_w.rank") <= F.col("_end")))
        .select(
            stratum, "_prefix", F.col("_w.name").alias("_name"),
            (F.col("_w.rank") - F.col("_before")).alias("_place"),
        )
    )
    position = F.struct(F.col(order), *(F.col(c) for c in key))
    inside = Window.partitionBy(stratum, "_name").orderBy("_position")
    closing = (
        known.select(stratum, prefix.alias("_prefix"), position.alias("_position"))
        .join(F.broadcast(places), [stratum, "_prefix"])
        .withColumn("_row", F.row_number().over(inside))
        .filter(F.col("_row") == F.col("_place"))
    )
    return closing.groupBy(stratum).agg(
        *(F.max(F.when(F.col("_name") == name, F.col("_position"))).alias(name) for name in names)
    )
