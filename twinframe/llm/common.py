"""What several operators share: task-side maps over columns, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

Batches = Iterator[pa.RecordBatch]


def map_batches(df: DataFrame, fn: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """`mapInArrow`, named once so that every operator maps batches alike."""
    return df.mapInArrow(fn, schema)


def raw(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes; null reads as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def open_folder(folder: str):
    """File system and path of a folder that all executors reach."""
    return pa.fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)


def components(edges: DataFrame) -> DataFrame:
    """`(node, component)` for every node of undirected `edges(u, v)`, by its smallest member.

    Large and small stars in turn point every node at the smallest node it knows
    of, so a chain of n nodes takes about log n rounds. Neighbours are never
    gathered: a round is a minimum per node and a join on the node, which AQE
    can split where one node has a great part of the edges. Every round is
    written to the shared folder, so lost executors cost one round at most.
    Loops and repeated edges change nothing, edges with a null are ignored.
    """
    apart = F.col("u") != F.col("v")
    now = materialize(
        edges.filter(apart)
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _mark(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        # A node may be its neighbours' smallest itself.
        large = (
            both.filter(F.col("v") > F.col("u")).join(least, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter(apart).distinct())
        large = materialize(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(
                F.struct(F.col("u"), F.col("m").alias("v")),
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*").filter(apart).distinct())
        now = materialize(small, "small-star")
        mark = _mark(now)
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = mark


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest of an edge table: two numbers reach the driver."""
    return tuple(edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
