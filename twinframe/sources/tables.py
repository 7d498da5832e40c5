"""Tables of pairs, catalogs, predictions and cached vectors."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequence import STOP, drop_stops
from ..operators.features import pair_features
from .files import file_order

# Columns a table of pairs must have, the schema of curated rows,
# and the size below which a catalog file is taken to be empty.
REQUIRED_COLUMNS = ("ref_protein", "var_protein", "label")
CURATED = (
    "gene string, species string, ref_protein string, var_protein string, ref_dna string, "
    "var_dna string, label int, dms_score double, dms_zscore double, source string"
)
MIN_CATALOG_BYTES = 100
ROW_NO = "row_no struct<file:string,block:bigint,line:bigint>"
# Any text of at least six letters without a stop does.
BASE_TEXT = "MACDEFGHIKLNPQ"


def require_columns(df: DataFrame, required: Iterable[str] = REQUIRED_COLUMNS) -> DataFrame:
    """Fail at once, without a job, where columns are missing."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"The table has no column {', '.join(missing)}")
    return df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a Parquet or CSV table by the suffix of its name."""
    suffix = os.path.splitext(str(path).rstrip("/"))[1]
    if suffix == ".parquet":
        return spark.read.parquet(str(path))
    if suffix == ".csv":
        return spark.read.option("header", True).option("escape", '"').csv(str(path))
    raise ValueError(f"Cannot read files ending in {suffix!r}, only .parquet and .csv")


def read_pairs(spark: SparkSession, path: str, score: str = "dms_zscore") -> DataFrame:
    """Read a table of labelled pairs; label as int, score as double."""
    df = require_columns(read_table(spark, path))
    typed = {"label": F.col("label").cast("int")}
    if score in df.columns:
        typed[score] = F.col(score).cast("double")
    return df.withColumns(typed)


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Read a Parquet table, or give an empty one where the path does not exist."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_catalog(spark: SparkSession, path: str, schema: str = "DMS_id string") -> DataFrame:
    """Read a catalog CSV, all columns as text, with `row_no` for the order of its lines.

    Empty where the file is missing or almost empty.
    """
    try:
        found = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("n")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, {ROW_NO}")
    if (found["n"] or 0) < MIN_CATALOG_BYTES:
        return spark.createDataFrame([], f"{schema}, {ROW_NO}")
    return spark.read.option("header", True).option("escape", '"').csv(path).select(
        "*", file_order().alias("row_no"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Read predictions from JSON, a single array or one object per line.

    One task parses one file; prefer one object per line and `read_report` for
    large files.
    """
    return spark.read.option("multiLine", True).json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Read predictions that `write_json_report` wrote, one object per line."""
    return spark.read.json(path)


def read_cached_pairs(spark: SparkSession, path: str, score: str = "dms_scores") -> DataFrame:
    """Read pairs with their vectors; a missing path is an error, a missing score 0.0."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"No vectors are stored at {path}; encode the pairs before") from None
    return df if score in df.columns else df.withColumn(score, F.lit(0.0))


def synthetic_pairs(spark: SparkSession, n: int = 20, base: str = BASE_TEXT) -> DataFrame:
    """Labelled pairs made from one text, a third of each class, with features.

    Class 0 has a stop at index 5, class 2 an `R` at index 1, class 1 no change.
    Features see the stop; the text given out no longer has it.
    """
    third = n // 3
    label = F.when(F.col("id") < third, 0).when(F.col("id") < 2 * third, 1).otherwise(2)
    rows = spark.range(n).select(
        F.concat(F.lit("test_gene_"), F.col("id").cast("string")).alias("gene"),
        F.lit("test_species").alias("species"),
        F.lit(base).alias("ref_seq"),
        F.when(label == 0, F.overlay(F.lit(base), F.lit(STOP), F.lit(6), F.lit(1)))
        .when(label == 2, F.overlay(F.lit(base), F.lit("R"), F.lit(2), F.lit(1)))
        .otherwise(F.lit(base)).alias("var_seq"),
        label.cast("int").alias("label"),
        F.lit(0.0).alias("score"),
    )
    return pair_features(rows).withColumn("var_seq", drop_stops("var_seq"))
