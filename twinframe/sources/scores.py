"""Folders of score files: one CSV per assay, with differing headers.

Files are read as lines, once. A file's header and whether any of its lines is
malformed come from one aggregation over the lines and go back to them by a join,
so neither the plan nor the driver grows with the files or their headers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spread import lookup_join
from .files import file_order

# Names of the score and the mutation column, first found wins.
SCORE_COLUMNS = ("DMS_score", "score", "fitness", "DMS_score_bin")
MUTATION_COLUMNS = ("mutant", "mutation", "mutated_sequence")
TEXT_COLUMN = "mutated_sequence"
READ, MALFORMED, NO_COLUMN = "read", "malformed", "no score or mutation column"


def csv_fields(line: str) -> Column:
    """The fields of a line of comma-separated values, as an array; quotes around a field are taken off.

    Inside quotes two of them stand for one. An empty field is null.
    """
    raw = rf"""regexp_extract_all(concat(',', {line}), ',("(?:[^"]++|"")*+"|[^,]*+)', 1)"""
    plain = """if(startswith(f, '"') AND length(f) > 1, replace(substr(f, 2, length(f) - 2), '""', '"'), f)"""
    return F.expr(f"transform({raw}, f -> nullif({plain}, ''))")


def file_verdicts(
    lines: DataFrame, score_columns: Sequence[str] = SCORE_COLUMNS, mutation_columns: Sequence[str] = MUTATION_COLUMNS,
) -> DataFrame:
    """One row per file of `lines(file, line, value)`: `file`, `verdict`, `n_lines`, and where its columns stand.

    The first line that is not empty is the header. A file is malformed, as a
    whole, if a line has more fields than the header, an open quote, or bytes
    that are no UTF-8. Shorter lines lack their last fields. Where columns
    stand counts from 1, 0 for a column that there isn't.
    """
    quotes = F.expr("length(value) - length(replace(value, '\"', ''))")
    files = lines.filter(F.length("value") > 0).groupBy("file").agg(
        F.min_by("value", "line").alias("_header"), F.max(F.size(csv_fields("value"))).alias("_most"),
        F.max((quotes % 2 == 1) | ~F.call_function("is_valid_utf8", F.col("value"))).alias("_broken"),
        F.min("line").alias("first_line"), F.count(F.lit(1)).alias("n_lines")).withColumn(
        "_names", F.transform(csv_fields("_header"), lambda f: F.coalesce(f, F.lit(""))))

    def place(names: Sequence[str]) -> Column:
        found = [F.array_position("_names", name) for name in names]
        return F.coalesce(*(F.when(at > 0, at) for at in found), F.lit(0)).cast("int")

    bad = F.col("_broken") | (F.col("_most") > F.size("_names"))
    placed = files.withColumns({
        "score_at": place(score_columns), "mutant_at": place(mutation_columns), "text_at": place([TEXT_COLUMN])})
    known = (F.col("score_at") > 0) & (F.col("mutant_at") > 0)
    return placed.select(
        "file", F.when(bad, MALFORMED).when(~known, NO_COLUMN).otherwise(READ).alias("verdict"),
        "n_lines", "first_line", "score_at", "mutant_at", "text_at")


def scores_of_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """`(file, score, mutant, mutated_sequence, row_no)` of the files whose verdict is `READ`; others are left out whole."""
    good = files.filter(F.col("verdict") == READ).drop("verdict")
    rows = lookup_join(lines.filter(F.length("value") > 0), good, ["file"], "n_lines", "inner").filter(
        F.col("line") > F.col("first_line")).withColumn("_fields", csv_fields("value"))

    def field(at: str) -> Column:
        return F.when(F.col(at) > 0, F.get("_fields", F.col(at) - 1))

    return rows.select(
        "file", field("score_at").try_cast("double").alias("score"), field("mutant_at").alias("mutant"),
        field("text_at").alias("mutated_sequence"), F.col("line").alias("row_no"))


def read_score_files(
    spark: SparkSession,
    folder: str,
    keep=None,
    score_columns: Sequence[str] = SCORE_COLUMNS,
    mutation_columns: Sequence[str] = MUTATION_COLUMNS,
) -> DataFrame:
    """All score files below a folder as one table: assay, score, mutant, mutated_sequence, row_no.

    `keep`, a function on a table with the column `assay`, can drop files by
    name. Files without a score or a mutation column, and files with a
    malformed line, are left out (see `file_verdicts`).
    """
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(folder)
        .select("value", file_order().alias("line")).select("value", "line", F.col("line.file").alias("file"))
    )
    files = file_verdicts(lines, score_columns, mutation_columns)
    name = F.regexp_extract("file", r"([^/]*)\.csv$", 1)
    if keep is not None:
        files = keep(files.withColumn("assay", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))))).drop("assay")
    found = scores_of_lines(lines, files)
    return found.select(
        F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("assay"), "score", "mutant", "mutated_sequence", "row_no")
