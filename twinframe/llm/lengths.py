"""Token counts for every context limit, from an exact histogram of encoded lengths.

Documents are summed to one row per encoded length, on the map side first. All
answers then come from running sums over the histogram: documents and tokens up
to a length, and what a limit of that many tokens keeps.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .bpe import RANKS, load_ranks
from .common import map_batches

# Lengths that are summed together before the running sums.
WIDTH = 1024


def lengths(
    docs: DataFrame, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN, text: str = "text",
) -> DataFrame:
    """`(n_tokens)` of every whole text, one row per row; null and empty texts have none."""
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches):
        encode = tiktoken.Encoding(
            "own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={}).encode_ordinary
        for batch in batches:
            counts = [len(encode(x)) if x else 0 for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["n_tokens"])

    return map_batches(docs.select(F.col(text).cast("string")), run, "n_tokens long")


def histogram(counts: DataFrame) -> DataFrame:
    """`(n_tokens, n_docs)`: documents of each encoded length."""
    return counts.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def limits(counts: DataFrame) -> DataFrame:
    """One row per encoded length that occurs, read as a context limit.

    n_tokens, n_docs: the length and its documents; docs_within, tokens_within:
    documents up to this length and their tokens; docs_beyond: longer ones;
    tokens_beyond: what the limit cuts off; tokens_truncated: tokens left of all
    documents when each is cut to this limit; share_within: share of documents
    that fit, which is also the quantile at this length; tokens_total: of all.
    For a limit between two lengths the lower row's sums hold, with
    docs_beyond * (limit - n_tokens) more tokens left. No documents give no row.
    """
    table = materialize(histogram(counts), "lengths").withColumn("part", F.floor(F.col("n_tokens") / WIDTH))
    sums = [F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t")]
    # As many rows as the longest text has thousands of tokens.
    parts = table.groupBy("part").agg(*sums)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "part", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"),
        F.sum("d").over(Window.partitionBy()).alias("docs_total"),
        F.sum("t").over(Window.partitionBy()).alias("tokens_total"))
    upto = Window.partitionBy("part").orderBy("n_tokens")
    placed = table.join(parts, "part").select(
        "n_tokens", "n_docs", "docs_total", "tokens_total",
        (F.col("d0") + F.sum("n_docs").over(upto)).alias("docs_within"),
        (F.col("t0") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(upto)).alias("tokens_within"))
    beyond = F.col("docs_total") - F.col("docs_within")
    left = F.col("tokens_within") + beyond * F.col("n_tokens")
    return placed.select(
        "n_tokens", "n_docs", "docs_within", "tokens_within", beyond.alias("docs_beyond"),
        (F.col("tokens_total") - left).alias("tokens_beyond"), left.alias("tokens_truncated"),
        (F.col("docs_within") / F.col("docs_total")).alias("share_within"), "tokens_total")


def at_limits(table: DataFrame, contexts: list[int]) -> DataFrame:
    """`(context, docs_within, docs_beyond, tokens_truncated)` for stated context limits.

    One pass over the histogram with conditional sums, so any limit is answered,
    also one that is no document's length.
    """
    n, d = F.col("n_tokens"), F.col("n_docs")
    sums = [
        F.struct(
            F.lit(c).cast("long").alias("context"),
            F.coalesce(F.sum(F.when(n <= c, d)), F.lit(0)).alias("docs_within"),
            F.coalesce(F.sum(F.when(n > c, d)), F.lit(0)).alias("docs_beyond"),
            F.coalesce(F.sum(F.least(n, F.lit(c)) * d), F.lit(0)).alias("tokens_truncated"))
        for c in contexts]
    return table.agg(F.array(*sums).alias("a")).select(F.explode("a").alias("a")).select("a.*")


def quantile(table: DataFrame, share: float) -> DataFrame:
    """`(n_tokens)`: the smallest length up to which at least this share of documents lies."""
    return table.filter(F.col("share_within") >= share).agg(F.min("n_tokens").alias("n_tokens"))
