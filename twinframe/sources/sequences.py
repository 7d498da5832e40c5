"""FASTA files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import strip_blanks, translate
from ..operators.assemble import last_per_id
from .files import file_order


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of FASTA files: `id`, upper-cased `seq` and `record_no`.

    Files are split at the start of a record, so a large file is read by many
    tasks. The id is the first word of the header.
    """
    return fasta_records(
        spark.read.option("lineSep", "\n>").text(path).select("value", file_order().alias("record_no")))


def fasta_records(texts: DataFrame) -> DataFrame:
    """Records out of texts `value`, each one record without the mark that parts it from the last.

    Texts without an id and a sequence are left out.
    """
    # Only the first record of a file still has its mark.
    record = F.regexp_replace("value", "^>", "")
    header = F.substring_index(record, "\n", 1)
    return (
        texts.select(record.alias("record"), header.alias("header"), "record_no")
        .select(
            F.regexp_extract(strip_blanks("header"), r"^\S*", 0).alias("id"),
            F.upper(F.regexp_replace(
                F.substring(F.col("record"), F.length("header") + 1, F.length("record")), r"\s", "",
            )).alias("seq"),
            "record_no",
        )
        .filter((F.length("id") > 0) | (F.length("seq") > 0))
    )


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """Nucleotide texts by id, the last one where an id repeats."""
    return last_per_id(read_fasta(spark, path))


def read_translated(spark: SparkSession, path: str) -> DataFrame:
    """Texts by id, translated up to the first stop."""
    return read_references(spark, path).withColumn("seq", translate("seq", to_stop=True))
