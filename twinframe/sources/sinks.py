"""Writing splits, reports and vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import CLASS_NAMES


MARKER = "_SPLITS"


def finished_splits(spark: SparkSession, path: str) -> list[str] | None:
    """The splits of a finished write under `path`, None if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path, MARKER)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return sorted(r.split for r in spark.read.schema("split string").json(str(place.toString())).collect())


def write_splits(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write one Parquet folder per split; the root is the merged set.

    Each split's folder is put in place whole, in one commit, and a marker with
    the names of the splits follows it. So a run that broke off is repeated in
    place by the same call: it is an error only to write where a finished set
    lies, unless `mode` is `overwrite`. Splits of an earlier run that the new
    one lacks are not in its marker, and `read_splits` leaves them out.
    """
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path, MARKER)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if mode not in ("error", "overwrite"):
        raise ValueError(f"Mode {mode!r} is not offered; take 'error' or 'overwrite'")
    if mode == "error" and system.exists(place):
        raise FileExistsError(f"{path} holds a finished set of splits")
    system.delete(place, True)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").parquet(path)
    # A handful of names; an empty split has no folder.
    names = df.select(F.col("split").cast("string").alias("split")).distinct()
    names.coalesce(1).write.json(place.toString())


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """The merged set of the last finished write; an error if none has finished."""
    names = finished_splits(spark, path)
    if names is None:
        raise FileNotFoundError(f"{path} holds no finished set of splits")
    return spark.read.parquet(path).filter(F.col("split").isin(names))


def report_columns(
    df: DataFrame, probabilities: str = "probabilities", names: Sequence[str] = tuple(CLASS_NAMES.values())
) -> list[Column]:
    """The columns of the tabular report, numbers with four decimals."""
    def four(value: Column) -> Column:
        return F.format_string("%.4f", F.bround(F.coalesce(value.cast("double"), F.lit(0.0)), 4))

    text = F.coalesce("summary", F.lit("")) if "summary" in df.columns else F.lit("")
    return [
        F.col("gene"), F.col("prediction"), four(F.col("confidence")).alias("confidence"),
        *(four(F.get(probabilities, i)).alias(f"{name}_prob") for i, name in enumerate(names)),
        text.alias("summary"),
    ]


def write_tsv_report(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write the tabular report, tab-separated with a header in every part."""
    (
        df.select(*report_columns(df)).write.mode(mode)
        .option("sep", "\t").option("header", True).option("quote", "\u0000")
        .option("emptyValue", "").csv(path)
    )


def write_json_report(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write rows as JSON, one object per line."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_vectors(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write vectors as Parquet with arrays of floats."""
    df.write.mode(mode).parquet(path)


def show_report(df: DataFrame, n: int = 50) -> None:
    """Print the number of rows, and the first `n` of them; the writers above give all."""
    total = df.count()
    print(f"{total} rows" + (f", of which {n} are shown" if total > n else ""))
    df.show(n, truncate=False)
