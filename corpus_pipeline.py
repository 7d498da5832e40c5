"""A training corpus from `documents`: five stages, each written and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.catalogue.views import table
from twinframe.llm import bpe, decontaminate, langid, near_copies, secret_scan
from twinframe.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised by a clear margin; null, empty and letterless texts go.

    Labels of the rows themselves are learned from (see `langid.fit`); without any the language is never recognised.
    """
    docs = docs.select(*COLUMNS)
    judged = langid.classify(docs, langid.fit(docs))
    return judged.filter(~F.col("rejected")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies one row: that of the smallest id, rows without an id last, then by content.

    Groups are those of `near_copies.first_of_groups`. Rows are told apart by a hash of all columns, so an id may be
    null or repeated; equal rows are one. Null texts read as empty, and texts without words are one group.
    """
    content = F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"})
    docs = docs.select(*COLUMNS, F.unhex(F.sha2(content.cast("binary"), 256)).alias("row"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    first = near_copies.first_of_groups(docs.select(order.alias("place"), "text"), "place")
    # Equal rows lie together after the join.
    return docs.join(first.select("first.row"), "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; null and empty texts contain none and stay.

    Texts are told apart by a hash, so an id may be null or repeated. Items without an id are searched too, each text
    as an item of its own.
    """
    item = F.coalesce(F.col("item_id").cast("long"), F.xxhash64("text")).alias("item_id")
    items = table(spark, sf_dir, "benchmark").select(item, "text")
    docs = docs.select(*COLUMNS, F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("content"))
    leaking = decontaminate.leaks(docs, items, key="content", kind="binary")
    leaking = materialize(leaking.select(F.col("doc_id").alias("content")).distinct(), "leaking")
    return docs.join(leaking, "content", "left_anti").select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark; n_chars follows the text. A null text stays null."""
    docs = docs.select(*COLUMNS)
    found = secret_scan.paths_with_spans(docs, secret_scan.scan_unseen(docs))
    clean = secret_scan.redacted(F.col("text"), F.col("spans"))
    return found.withColumn("text", clean).withColumn(
        "n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its very text; null and empty texts have no ids."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    known = F.struct("doc_id", "lang", "source", F.sha2(text, 256).alias("sha256"))
    made = bpe.encode(docs.select(known.alias("doc"), "text"), key="doc", decoded=True)
    return made.select(
        "doc_id.doc_id", "doc_id.lang", "doc_id.source",
        F.size("ids").cast("long").alias("n_tokens"), "ids",
        (F.sha2("decoded", 256) == F.col("doc_id.sha256")).alias("round_trip"))


STAGES = [
    ("language ID", known_language),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("byte-level BPE", encoded),
]

# Compression, XXH64 and merges are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over `documents`, each written to the shared folder but the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
