"""VCF files, plain and annotated."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import code_label
from ..functions.sequence import strip_blanks
from .files import file_order

# How many fields a line needs, and the parts of an annotation.
VARIANT_FIELDS, ANNOTATED_FIELDS, ANNOTATION_PARTS = 5, 8, 11
ANNOTATION_MARK = "ANN="


def _read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", file_order().alias("row_no"))


def _fields(lines: DataFrame, fields: int) -> DataFrame:
    """The tab-separated fields of lines `value` that are no comment and have enough of them."""
    return (
        lines.filter(~F.startswith("value", F.lit("#")))
        .select(F.split(strip_blanks("value"), "\t").alias("f"), "row_no")
        .filter(F.size("f") >= fields)
    )


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """Variants of a VCF file: `chrom`, 0-based `pos`, `ref`, `alt`, `row_no`."""
    return variant_columns(_read_lines(spark, path))


def variant_columns(lines: DataFrame) -> DataFrame:
    """Variants out of lines `value` of a VCF file, with their `row_no`."""
    f = F.col("f")
    return _fields(lines, VARIANT_FIELDS).select(
        f[0].alias("chrom"), (f[1].cast("bigint") - 1).alias("pos"),
        f[3].alias("ref"), f[4].alias("alt"), "row_no",
    )


def annotation_entries_sql(info: str) -> str:
    """Annotations in an INFO text as structs of effect, impact, gene and place.

    Only the first `ANN=` field counts; entries with fewer than 11 parts do not.
    """
    first = f"get(filter(split({info}, ';'), f -> startswith(f, '{ANNOTATION_MARK}')), 0)"
    entries = f"split(substr({first}, {len(ANNOTATION_MARK) + 1}), ',')"
    parts = f"transform({entries}, (e, i) -> named_struct('p', split(e, '[|]'), 'place', i))"
    return (
        f"transform(filter({parts}, e -> size(e.p) >= {ANNOTATION_PARTS}), e -> named_struct("
        f"'effect', e.p[1], 'impact', e.p[2], 'gene', e.p[3], 'place', e.place))"
    )


def explode_annotations(
    df: DataFrame, labels: Mapping[str, str], default: str, info: str = "info", order: str = "row_no"
) -> DataFrame:
    """One row per annotation with its label; `row_no` follows line and place."""
    return (
        df.select(F.col(order).alias("_order"), F.expr(f"inline({annotation_entries_sql(info)})"))
        .select(
            "gene", "effect", "impact", code_label("effect", labels, default).alias("label"),
            F.struct(F.col("_order").alias("line"), "place").alias("row_no"),
        )
    )


def read_annotations(spark: SparkSession, path: str, labels: Mapping[str, str], default: str) -> DataFrame:
    """Annotations of an annotated VCF file, one row per entry."""
    lines = _fields(_read_lines(spark, path), ANNOTATED_FIELDS).select(F.col("f")[7].alias("info"), "row_no")
    return explode_annotations(lines, labels, default)
