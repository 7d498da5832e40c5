"""Encode each distinct text once, keep the vectors, and join them back to pairs.

The encoder is supplied by the caller: a function from a pandas Series of texts
to a pandas DataFrame with the columns `mean` and `max`, each a list of floats
per text. It runs inside `mapInPandas`, which is the only step in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import clip_sql, content_key, drop_stops_sql
from ..session import materialize
from .features import FEATURES, feature_vector, pair_features
from .spread import lookup_join, running_totals

Encoder = Callable[[pd.Series], pd.DataFrame]
VECTORS = "seq_key string, mean array<float>, max array<float>"
# All digits of the content hash: short keys would collide among very many texts.
KEY_DIGITS = 64
HASH_DIMS = 8


def hashing_encoder(dims: int = HASH_DIMS) -> Encoder:
    """A deterministic encoder for trials and tests, without any model.

    Component d of a character with code point c is `(c * (2d + 1)) mod 97 / 97`;
    a text gives the mean and the maximum over its characters, zeros if empty.
    """
    def encode(texts: pd.Series) -> pd.DataFrame:
        # All characters of the batch in one row; each text is a range of it.
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype("int64")
        sizes = texts.str.len().to_numpy(dtype="int64")
        some = sizes > 0
        starts = (np.cumsum(sizes) - sizes)[some]
        means, tops = np.zeros((len(sizes), dims), "float32"), np.zeros((len(sizes), dims), "float32")
        if len(starts):
            for d in range(dims):
                values = codes * (2 * d + 1) % 97
                means[some, d] = np.add.reduceat(values, starts) / 97.0 / sizes[some]
                tops[some, d] = np.maximum.reduceat(values, starts) / 97.0
        return pd.DataFrame({"mean": list(means), "max": list(tops)})

    return encode


def encode_text_sql(text: str, max_length: int | None = 1024) -> str:
    """A text as it goes to the encoder: cut, then without stop markers."""
    return drop_stops_sql(f"coalesce({text}, '')" if max_length is None else clip_sql(text, max_length))


def with_pair_keys(
    pairs: DataFrame, ref: str = "ref_seq", var: str = "var_seq", max_length: int | None = 1024
) -> DataFrame:
    """Add `ref_key` and `var_key`, the content keys of both texts as encoded."""
    return pairs.withColumns({
        "ref_key": content_key(encode_text_sql(ref, max_length), KEY_DIGITS),
        "var_key": content_key(encode_text_sql(var, max_length), KEY_DIGITS),
    })


def _long_form(pairs: DataFrame, ref: str, var: str, max_length: int | None, by: Sequence[str]) -> DataFrame:
    return pairs.select(
        *by, F.expr(
            f"explode(array({encode_text_sql(ref, max_length)}, {encode_text_sql(var, max_length)}))"
        ).alias("text")
    )


def distinct_texts(
    *tables: DataFrame, ref: str = "ref_seq", var: str = "var_seq", max_length: int | None = 1024
) -> DataFrame:
    """Each distinct text of both sides of all tables: `seq_key`, `text`, `uses`."""
    sides = None
    for pairs in tables:
        part = _long_form(pairs, ref, var, max_length, [])
        sides = part if sides is None else sides.unionByName(part)
    # With the text among the keys this is a hash aggregation; carried along as
    # a first value it would need a sort.
    return (
        sides.groupBy(content_key("text", KEY_DIGITS).alias("seq_key"), "text")
        .agg(F.count(F.lit(1)).alias("uses"))
    )


def dedup_report(
    pairs: DataFrame, by: Sequence[str] = (), ref: str = "ref_seq", var: str = "var_seq",
    max_length: int | None = 1024,
) -> DataFrame:
    """Rows, texts, distinct texts and the saving in percent, per group."""
    texts = _long_form(pairs, ref, var, max_length, by)
    keyed = texts.groupBy(*by, content_key("text", KEY_DIGITS).alias("seq_key")).agg(
        F.count(F.lit(1)).alias("_uses")
    )
    total, distinct = F.coalesce(F.sum("_uses"), F.lit(0)), F.count(F.lit(1))
    return keyed.groupBy(*by).agg(
        (total / 2).cast("bigint").alias("n_rows"),
        total.alias("n_texts"),
        distinct.alias("n_distinct"),
        ((1 - distinct / F.greatest(total, F.lit(1))) * 100).alias("reduction_pct"),
    )


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The vectors kept so far; none where the folder does not exist yet."""
    try:
        return spark.read.schema(VECTORS).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VECTORS)


def missing_texts(texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Texts whose key has no vector yet."""
    return texts.join(vectors.select("seq_key"), "seq_key", "left_anti")


def coverage(texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """How many texts are needed, how many have no vector, and whether none lacks one."""
    known = vectors.select("seq_key", F.lit(1).alias("_known"))
    return texts.select("seq_key").join(known, "seq_key", "left").agg(
        F.count(F.lit(1)).alias("n_needed"),
        F.count_if(F.col("_known").isNull()).alias("n_missing"),
        (F.count_if(F.col("_known").isNull()) == 0).alias("complete"),
    )


def by_length(texts: DataFrame, partitions: int | None = None) -> DataFrame:
    """Bring texts of near-equal length together, for batches with little padding.

    Ranges run over length and key, so many texts of one length still spread.
    """
    sized = texts.withColumn("_size", F.length("text"))
    keys = ["_size", "seq_key"]
    ranged = sized.repartitionByRange(partitions, *keys) if partitions else sized.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys).drop("_size")


def length_batches(
    texts: DataFrame, cost: int, step: int = 16, key: str = "seq_key", text: str = "text",
) -> DataFrame:
    """The batches an encoder gets: `(key, size, batch, place)`, numbered by length.

    A batch costs its rows times its longest text, as shorter ones are padded,
    and no batch costs more than `cost` unless it is one longer text. Texts of
    lengths that round up to the same multiple of `step` fill batches of as many
    rows as that length allows, in the order of their keys; only the last batch of
    a length class may have fewer. Places within a class and the number of its
    first batch are running totals, so no task numbers more than a range of rows.
    """
    size = F.length(F.coalesce(text, F.lit("")))
    wide = F.greatest(F.ceil(size / step), F.lit(1)) * step
    sized = texts.select(F.col(key), size.alias("size"), wide.alias("_wide"), F.lit(1).cast("long").alias("_one"))
    placed = running_totals(sized, ["_wide"], key, ["_one"])
    rows = F.greatest(F.lit(1), F.floor(F.lit(cost) / F.col("_wide")))
    # As many classes as the longest text has steps.
    classes = sized.groupBy("_wide").agg(F.count(F.lit(1)).alias("_n")).withColumn("_batches", F.ceil(F.col("_n") / rows))
    first = running_totals(classes, [], "_wide", ["_batches"]).select("_wide", "_n", F.col("_batches_before").alias("_first"))
    return lookup_join(placed, first, ["_wide"], "_n").select(
        key, "size", (F.col("_first") + F.floor(F.col("_one_before") / rows)).alias("batch"),
        (F.col("_one_before") % rows).alias("place"))


def _by_characters(batch: pd.DataFrame, most: int) -> Iterator[pd.DataFrame]:
    """Parts of a batch with about so many characters each, or one longer text."""
    part = batch["text"].str.len().cumsum() // most
    for _, rows in batch.groupby(part, sort=False):
        yield rows


def encode_texts(
    texts: DataFrame, encoder: Encoder | None = None, batch_characters: int = 1 << 20
) -> DataFrame:
    """Run the encoder over the texts, one partition at a time.

    It gets batches of about `batch_characters`, so long texts need no more
    memory than many short ones.
    """
    encoder = encoder or hashing_encoder()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in batches for part in _by_characters(whole, batch_characters)):
            vectors = encoder(batch["text"])
            yield pd.DataFrame({
                "seq_key": batch["seq_key"].to_numpy(),
                "mean": list(vectors["mean"]),
                "max": list(vectors["max"]),
            })

    return texts.select("seq_key", "text").mapInPandas(run, VECTORS)


def encode_once(
    spark: SparkSession,
    tables: Sequence[DataFrame],
    path: str,
    encoder: Encoder | None = None,
    ref: str = "ref_seq",
    var: str = "var_seq",
    max_length: int | None = 1024,
    partitions: int | None = None,
) -> DataFrame:
    """Add the vectors that `path` lacks for the texts of all tables, and read it back.

    Only missing texts are encoded, so a run that broke off goes on where its
    last finished write left off. One writer at a time.
    """
    texts = distinct_texts(*tables, ref=ref, var=var, max_length=max_length)
    # The ranges are found by a sample, which would work the missing texts out twice.
    missing = materialize(missing_texts(texts, read_vectors(spark, path)), "missing-texts")
    encode_texts(by_length(missing, partitions), encoder).write.mode("append").parquet(path)
    return read_vectors(spark, path)


def scatter_vectors(
    pairs: DataFrame, vectors: DataFrame, texts: DataFrame | None = None,
    ref: str = "ref_seq", var: str = "var_seq", max_length: int | None = 1024,
) -> DataFrame:
    """Add `ref_mean`, `ref_max`, `var_mean` and `var_max` to each pair.

    `texts` (from `distinct_texts`) tells how often each key is used, for keys
    that very many pairs share; without it the uses are counted.
    """
    # The vectors are stored already and are not written again.
    weight = None
    if texts is not None:
        vectors = vectors.join(texts.select("seq_key", "uses"), "seq_key")
        weight = "uses"
    keyed = with_pair_keys(pairs, ref, var, max_length)
    for side in ("ref", "var"):
        named = vectors.withColumnsRenamed({
            "seq_key": f"{side}_key", "mean": f"{side}_mean", "max": f"{side}_max",
        })
        keyed = lookup_join(keyed, named, [f"{side}_key"], weight, stored=True)
    return keyed.drop("ref_key", "var_key")


def pair_table(
    pairs: DataFrame, vectors: DataFrame, texts: DataFrame | None = None,
    ref: str = "ref_seq", var: str = "var_seq", max_length: int | None = 1024,
) -> DataFrame:
    """What a trainer reads: each labelled pair with its vectors and features, as one row.

    Adds the four vectors and `features`, an array of the twelve engineered
    numbers, to the columns of `pairs` (such as `label`, `score` and `split`) in
    place of the texts. `write_splits` keeps it with one folder per split.
    """
    featured = pair_features(pairs, ref, var, max_length).withColumn("features", feature_vector()).drop(*FEATURES)
    return scatter_vectors(featured, vectors, texts, ref, var, max_length).drop(ref, var)


def pool_tokens(
    tokens: DataFrame, by: Sequence[str], vector: str = "vector", mask: str | None = None
) -> DataFrame:
    """Mean and maximum of the token vectors of each key, over unmasked tokens.

    A key whose tokens are all masked gets zeros.
    """
    shown = mask or "true"
    values = f"CAST({vector} AS array<double>)"
    # One summary serves both: the first half adds up, the second half, with
    # minus infinity for what is masked, gives the maximum.
    doubled = F.expr(
        f"CASE WHEN {shown} THEN concat({values}, {values}) ELSE concat("
        f"array_repeat(0D, size({vector})), array_repeat(double('-infinity'), size({vector}))) END")
    summary = Summarizer.metrics("sum", "max").summary(array_to_vector(doubled))
    pooled = tokens.groupBy(*by).agg(
        summary.alias("_s"), F.expr(f"count_if({shown})").alias("_n"), F.first(F.size(vector)).alias("_d")
    ).select(
        *by, "_n", "_d",
        vector_to_array("_s.sum").alias("_sum"), vector_to_array("_s.max").alias("_max"),
    )
    return pooled.select(
        *by,
        F.expr("transform(slice(_sum, 1, _d), x -> x / greatest(_n, 1))").alias("mean"),
        F.expr("if(_n = 0, array_repeat(0D, _d), slice(_max, _d + 1, _d))").alias("max"),
    )
