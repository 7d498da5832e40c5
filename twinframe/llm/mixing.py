"""Mixing sources to target weights: copies of documents by pivotal dependent rounding.

Every document of a source should be taken target / size times on average. The
whole part is certain. The fractions are paired: words move at random from one
document of a pair to the other until one of them is taken or left, so that the
expected copies of both and the words of the pair stay what they were. What is
left of each leaf, one document at most, goes to the next level of a tree, up to
one document per source, which a last draw settles. Larger documents are paired
first, so that the last one is small where a source has small documents.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spread import lookup_join, running_totals
from ..session import materialize
from .common import map_batches

WORD = r"[^\x20\x09-\x0D]+"
# Documents that a leaf of the tree holds on average, and leaves that a node joins.
LEAF = 4096
FAN = 256
# Equal rows are put out in chunks of this many.
CHUNK = 1 << 16


def targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """`sizes(place, size, rows)` of sources with their `target` words.

    Sources in the order of `place` have `weights` in turn. Targets add up to
    `share` of all words. None is over `most` times its source's size; the
    excess goes to the others by weight until none is above.
    """
    ranked = running_totals(sizes.withColumn("one", F.lit(1)), [], "place", ["one"])
    cap = F.col("size") * most
    ranked = materialize(ranked.select(
        *sizes.columns, cap.alias("cap"),
        F.get(F.array(*map(F.lit, weights)), (F.col("one_before") % len(weights)).cast("int")).alias("weight")),
        "weights")
    # Sources reach their limit in the order of limit / weight.
    levels = ranked.groupBy((F.col("cap") / F.col("weight")).alias("level")).agg(
        F.sum("cap").alias("cap"), F.sum("weight").alias("weight"))
    wanted = F.col("cap_total") / most * share
    full_cap, open_weight = F.col("cap_before") + F.col("cap"), F.col("weight_total") - F.col("weight_before") - F.col("weight")
    totals = running_totals(levels, [], "level", ["cap", "weight"]).select(
        "level", wanted.alias("wanted"), full_cap.alias("full"), open_weight.alias("open"),
        (full_cap + F.col("level") * open_weight <= wanted).alias("reached"),
        F.col("weight_total").alias("all"))
    found = totals.agg(
        F.max("wanted").alias("wanted"), F.max("all").alias("all"),
        F.max(F.when(F.col("reached"), F.struct("level", "full", "open"))).alias("last")).first()
    if found["wanted"] is None:
        level = 0.0
    elif found["last"] is None:
        level = found["wanted"] / found["all"]
    else:
        last = found["last"]
        level = (found["wanted"] - last["full"]) / last["open"] if last["open"] else float("inf")
    fair = F.col("weight") * F.lit(level)
    return ranked.select(
        *sizes.columns, F.when(F.col("cap") <= fair, F.col("cap")).otherwise(fair).cast("double").alias("target"))


def pair(p: float, a: float, q: float, b: float, u: float) -> tuple[float, float]:
    """New fractions of documents of a and b words, one of them 0 or 1; u decides which way words move."""
    room, stock = (1 - p) * a, q * b
    back_room, back_stock = (1 - q) * b, p * a
    up, down = min(room, stock), min(back_room, back_stock)
    if u * (up + down) < down:
        return (1.0 if room <= stock else p + up / a), (0.0 if stock <= room else q - up / b)
    return (0.0 if back_stock <= back_room else p - down / a), (1.0 if back_room <= back_stock else q + down / b)


def settle(nodes: list, sizes: list[int], fractions: list[float], draws: list[float], carry: tuple | None):
    """Round the fractions of consecutive rows of a node, in place.

    Gives the row that is still open at the end as (node, number, size); rows
    are numbered as given, the carried one of an earlier call is -1, and its
    fraction is the last of `carry`. Also gives the carried row's fraction.
    """
    held = -1 if carry else None
    node, a, p = carry if carry else (None, 0, 0.0)
    first = p
    for j, other in enumerate(nodes):
        if held is not None and other != node:
            held = None
        if held is None:
            held, node, a, p = j, other, sizes[j], fractions[j]
            continue
        p, q = pair(p, a, fractions[j], sizes[j], draws[j])
        fractions[j] = q
        if held == -1:
            first = p
        else:
            fractions[held] = p
        if not 0.0 < p < 1.0:
            held = None
            if 0.0 < q < 1.0:
                held, a, p = j, sizes[j], q
    return held, node, a, p, first


def _level(units: DataFrame, draw: Column) -> DataFrame:
    """`units` after one level of the tree: in each node at most one fraction is still open."""
    kept = units.columns
    at = {name: kept.index(name) for name in ("place", "node", "size", "p")}

    def run(batches):
        # Rows go out when they are settled; one row is held back at a time.
        waiting, carry = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_pylist() for c in (batch.column(at["place"]), batch.column(at["node"]))]
            p = batch.column(at["p"]).to_pylist()
            held, node, a, left, first = settle(
                list(zip(*columns)), batch.column(at["size"]).to_pylist(), p, batch.column(len(kept)).to_pylist(), carry)
            if waiting is not None and held != -1:
                yield _with(waiting, at["p"], [first])
                waiting = None
            rows = pa.RecordBatch.from_arrays(batch.columns[:-1], kept)
            if held is None:
                carry = None
                yield _with(rows, at["p"], p)
                continue
            carry = (node, a, left)
            if held == -1:
                yield _with(rows, at["p"], p)
                continue
            if held:
                yield _with(rows.slice(0, held), at["p"], p[:held])
            if held + 1 < len(p):
                yield _with(rows.slice(held + 1), at["p"], p[held + 1:])
            waiting = rows.slice(held, 1)
        if waiting is not None:
            yield _with(waiting, at["p"], [carry[2]])

    ordered = units.withColumn("u", draw).repartition("place", "node").sortWithinPartitions(
        "place", "node", F.desc("size"), "mark", "key")
    return map_batches(ordered, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.schema.fields))


def _with(rows: pa.RecordBatch, i: int, p: list[float]) -> pa.RecordBatch:
    return rows.set_column(i, "p", pa.array(p, pa.float64()))


def copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7,
    leaf: int = LEAF, fan: int = FAN,
) -> DataFrame:
    """`(key, source, size, source_size, target, copies, taken)`, one row per row of `docs`.

    size: words of the text, null and empty texts have none; target: words
    that the source should give (see `targets`, null sources are one source and
    the last); copies: how often the document is taken, the source's rate
    rounded down or up; taken: copies * size. The taken words of a source differ
    from its target by less than the size of one document. Reruns agree, however
    rows are partitioned. Rows equal in key, source and size share their copies
    evenly; keys may be null or repeated. An empty table gives no row.
    """
    place = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("~"))
    counted = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    units = materialize(
        docs.select(F.col(key).alias("key"), F.col(source).alias("source"), place.alias("place"), counted.alias("size"))
        .groupBy("key", "source", "place", "size").agg(F.count(F.lit(1)).alias("m")), "sizes")
    sizes = units.groupBy("place").agg(
        F.sum(F.col("size") * F.col("m")).alias("size"), F.count(F.lit(1)).alias("rows"))
    wanted = targets(materialize(sizes, "sources"), weights, share, most).select(
        "place", "rows", F.col("size").alias("source_size"), "target", F.col("rows").alias("weight"))
    units = lookup_join(units, wanted, ["place"], weight="weight")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    fraction = (F.col("rate") - F.floor("rate")) * F.col("m")
    leaves = F.ceil(F.col("rows") / leaf)
    units = units.withColumn("rate", rate).withColumn(
        "mark", F.xxhash64("key", "size", F.lit(seed))).withColumn(
        "copies", (F.floor("rate") * F.col("m") + F.floor(fraction)).cast("long")).withColumn(
        "p", fraction - F.floor(fraction)).withColumn(
        "node", F.pmod("mark", leaves)).drop("rate", "rows")

    def draw(level: int) -> Column:
        return F.shiftrightunsigned(F.xxhash64("mark", F.lit(seed), F.lit(level)), 11) * F.lit(2.0 ** -53)

    is_open = (F.col("p") > 0) & (F.col("p") < 1)
    mixed = is_open & (F.col("size") > 0)
    # Documents without a word can't be paired by words, and weigh nothing.
    done = units.filter(~mixed).withColumn("p", F.when(F.col("p") > draw(0), 1.0).otherwise(0.0))
    now, level = units.filter(mixed), 0
    last = wanted.agg(F.max(F.ceil(F.col("rows") / leaf)) - 1).first()[0] or 0
    while True:
        level += 1
        now = materialize(_level(now, draw(level)), f"level-{level}")
        done = done.unionByName(now.filter(~is_open))
        now = now.filter(is_open).withColumn("node", F.floor(F.col("node") / fan))
        if last == 0:
            break
        last //= fan
    done = done.unionByName(now.withColumn("p", F.when(F.col("p") > draw(0), 1.0).otherwise(0.0)))
    chunks = done.withColumn("copies", F.col("copies") + F.col("p").cast("long")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / CHUNK))))
    width = F.least(F.lit(CHUNK), F.col("m") - F.col("chunk") * CHUNK) - 1
    each = chunks.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), width))).withColumn(
        "i", F.col("i") + F.col("chunk") * CHUNK)
    own = F.expr("copies div m") + (F.col("i") < F.col("copies") % F.col("m")).cast("long")
    return each.select(
        "key", "source", "size", "source_size", "target", own.alias("copies"), (own * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: every document as often as it is taken. Options are those of `copies`.

    Rows are told apart by a hash of all columns, so ids may be null or repeated.
    """
    content = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), {"ignoreNullFields": "false"})
    marked = docs.withColumn("_row", F.unhex(F.sha2(content.cast("binary"), 256)))
    taken = copies(marked, "_row", text, source, **options).groupBy("key").agg(F.sum("copies").alias("_copies"))
    taken = taken.filter(F.col("_copies") > 0).withColumnRenamed("key", "_row")
    # Equal rows stand for each other, and lie together after the join.
    return marked.join(taken, "_row").dropDuplicates(["_row"]).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / CHUNK)))).withColumn(
        "_i", F.explode(F.sequence(F.lit(1).cast("long"), F.least(
            F.lit(CHUNK), F.col("_copies") - F.col("_chunk") * CHUNK)))).select(
        *(F.col(f"`{c}`") for c in docs.columns))
