"""Random forests whose trees are grown side by side, each by one task over all binned rows.

Rows are binned once, a byte a component, and stored; the task of a tree reads them
and grows it level by level. Trees are stored too, and rows are called by reading
them in blocks. Rules are those of MLlib: rows are drawn with replacement by Poisson
counts, every node looks at the square root of the components, splits are the best by
Gini impurity among at most 32 bins, and the votes of a tree are the shares of its leaf.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..session import TASKS_PER_CORE, store

BINS = 32
# Cells of the counts by node, bin and class that are held together, and rows that are called together.
CELLS, CALLED_ROWS = 100_000, 50_000
ROWS_SCHEMA = "labels binary, bins binary"
TREES_SCHEMA = "tree long, feature binary, cut binary, left binary, votes binary"


def cut_points(rows: DataFrame, vector: str, width: int) -> list[np.ndarray]:
    """Per component the values after which it is cut: all but the last, or where there are many, quantiles."""
    values = rows.select(F.posexplode(vector).alias("d", "x")).filter(~F.isnan("x"))
    shares = [i / BINS for i in range(1, BINS)]
    found = {r.d: r for r in values.groupBy("d").agg(
        F.percentile_approx("x", shares, 10_000).alias("cuts"), F.approx_count_distinct("x").alias("n"),
        F.max("x").alias("last")).collect()}
    few = [d for d, r in found.items() if r.n <= 2 * BINS]
    sets = {r.d: r.every for r in values.filter(F.col("d").isin(few)).groupBy("d").agg(
        F.collect_set("x").alias("every")).collect()} if few else {}
    out = []
    for d in range(width):
        cuts = sets[d] if len(sets.get(d, ())) in range(1, BINS + 1) else found[d].cuts if d in found else []
        out.append(np.array(sorted({x for x in cuts if x < found[d].last})))
    return out


def class_count(rows: DataFrame, label: str) -> int:
    """One more than the greatest label; labels are whole numbers from 0."""
    x = F.col(label).cast("double")
    last, odd = rows.agg(F.max(x), F.count_if(x.isNull() | (x < 0) | (x != F.floor(x)) | F.isnan(x))).first()
    if odd:
        raise ValueError(f"{odd} labels are no whole numbers from 0")
    return int(last) + 1


def _binned(column: pa.Array, cuts: list[np.ndarray]) -> np.ndarray:
    """A byte per row and component: how many of its cut points lie below."""
    values = column.flatten().to_numpy().reshape(len(column), len(cuts))
    out = np.empty(values.shape, np.uint8)
    for d, points in enumerate(cuts):
        out[:, d] = np.searchsorted(points, values[:, d])
    return out


def _batches(folder: str, rows: int) -> Iterator[pa.RecordBatch]:
    system, base = pa.fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
    for entry in sorted(system.get_file_info(pa.fs.FileSelector(base)), key=lambda f: f.path):
        if entry.path.endswith(".parquet"):
            with system.open_input_file(entry.path) as file:
                yield from pq.ParquetFile(file).iter_batches(rows)


def grow(
    bins: np.ndarray, labels: np.ndarray, classes: int, rng: np.random.Generator, min_leaf: int, max_depth: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree as arrays by node: component, last bin that goes left, left child (right is next; -1: leaf), votes."""
    drawn = rng.poisson(1.0, len(bins))
    rows = np.flatnonzero(drawn)
    weight, label = drawn[rows].astype(float), labels[rows]
    node, n, made = np.zeros(len(rows), np.int64), 1, 1
    looked = math.ceil(math.sqrt(bins.shape[1]))
    out = []
    for depth in range(max_depth + 1):
        counts = np.bincount(label * n + node, weight, classes * n).reshape(classes, n)
        total = counts.sum(axis=0)
        feature, cut, left = np.zeros(n, np.int32), np.zeros(n, np.uint8), np.full(n, -1, np.int32)
        out.append((feature, cut, left, (counts / np.maximum(total, 1)).T.astype(np.float32)))
        open_ = np.flatnonzero((total >= 2 * min_leaf) & (counts.max(axis=0) < total))
        if depth == max_depth or not len(open_):
            break
        rows, weight, label, node = _of_nodes(open_, n, rows, weight, label, node)
        counts, total = counts[:, open_], total[open_]
        asked = np.argpartition(rng.random((len(open_), bins.shape[1])), looked - 1, axis=1)[:, :looked]
        best, at, point = _best_splits(bins, rows, weight, label, node, counts, total, asked, min_leaf)
        # A split has to lower the impurity.
        split = np.flatnonzero(best > (counts * counts).sum(axis=0) / total * (1 + 1e-12))
        if not len(split):
            break
        parents = open_[split]
        feature[parents], cut[parents] = asked[split, at[split]], point[split]
        left[parents] = made + 2 * np.arange(len(split))
        rows, weight, label, node = _of_nodes(split, len(open_), rows, weight, label, node)
        node = 2 * node + (bins[rows, feature[parents][node]] > cut[parents][node])
        order = np.argsort(node, kind="stable")
        rows, weight, label, node = rows[order], weight[order], label[order], node[order]
        n = 2 * len(split)
        made += n
    return tuple(np.concatenate(x) for x in zip(*out))


def _of_nodes(nodes, n, rows, weight, label, node):
    """The rows of these of n nodes, which are numbered anew."""
    number = np.full(n, -1)
    number[nodes] = np.arange(len(nodes))
    node = number[node]
    kept = node >= 0
    return rows[kept], weight[kept], label[kept], node[kept]


def _best_splits(bins, rows, weight, label, node, counts, total, asked, min_leaf):
    """Per node the sum over both sides of squared class counts by their size, and which component and bin give it."""
    classes, n = counts.shape
    best, at, point = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
    step = max(1, CELLS // (classes * BINS))
    for first in range(0, n, step):
        size = min(step, n - first)
        some = slice(*np.searchsorted(node, [first, first + size]))
        own = node[some] - first
        place, mine, w = (label[some] * size + own) * BINS, slice(first, first + size), weight[some]
        whole, every = counts[:, mine, None], np.arange(size)
        for j in range(asked.shape[1]):
            value = bins[rows[some], asked[node[some], j]]
            lower = np.bincount(place + value, w, classes * size * BINS).reshape(classes, size, BINS).cumsum(axis=2)[:, :, :-1]
            upper = whole - lower
            below, above = lower.sum(axis=0), upper.sum(axis=0)
            lower *= lower
            upper *= upper
            score = lower.sum(axis=0) / np.maximum(below, 1) + upper.sum(axis=0) / np.maximum(above, 1)
            score[(below < min_leaf) | (above < min_leaf)] = -np.inf
            cut = score.argmax(axis=1)
            score = score[every, cut]
            better = score > best[mine]
            best[mine] = np.where(better, score, best[mine])
            at[mine], point[mine] = np.where(better, j, at[mine]), np.where(better, cut, point[mine])
    return best, at, point


def train(
    rows: DataFrame, vector: str, label: str, cuts: list[np.ndarray], classes: int,
    trees: int, min_leaf: int, max_depth: int, seed: int,
) -> str:
    """The folder of the stored trees."""
    def binned(batches):
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column(1).to_numpy().astype("<i4").tobytes()], pa.binary()),
                    pa.array([_binned(batch.column(0), cuts).tobytes()], pa.binary())], ["labels", "bins"])

    folder = store(rows.select(vector, F.col(label).cast("double")).mapInArrow(binned, ROWS_SCHEMA), "forest-rows")

    def run(batches):
        found = [(r["labels"], r["bins"]) for b in _batches(folder, 1) for r in b.to_pylist()]
        labels = np.concatenate([np.frombuffer(x, "<i4") for x, _ in found]).astype(np.int64)
        bins = np.concatenate([np.frombuffer(x, np.uint8) for _, x in found]).reshape(len(labels), len(cuts))
        # In an order of their own, so that the trees do not depend on how rows were dealt out.
        order = np.argsort(labels, kind="stable")
        order = order[np.argsort(bins[order].view(f"S{len(cuts)}").ravel(), kind="stable")]
        labels, bins = labels[order], bins[order]
        del found, order
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                arrays = grow(bins, labels, classes, np.random.default_rng([seed, tree]), min_leaf, max_depth)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree]), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)],
                    [x.split()[0] for x in TREES_SCHEMA.split(", ")])

    spark = rows.sparkSession
    tasks = min(trees, TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return store(spark.range(0, trees, 1, tasks).mapInArrow(run, TREES_SCHEMA), "forest")


def votes(rows: DataFrame, vector: str, folder: str, cuts: list[np.ndarray], classes: int, out: str) -> DataFrame:
    """`rows` with the summed votes of all stored trees, per class, in place of the vector."""
    def called(held: list[pa.RecordBatch]):
        bins = np.concatenate([_binned(b.column(b.schema.names.index(vector)), cuts) for b in held])
        sums = np.zeros((len(bins), classes))
        for batch in _batches(folder, 20):
            for r in batch.to_pylist():
                sums += _tree_votes(bins, r, classes)
        at = 0
        for b in held:
            own = sums[at:at + len(b)]
            at += len(b)
            lists = pa.ListArray.from_arrays(np.arange(0, own.size + 1, classes, dtype=np.int32), own.ravel())
            yield b.drop_columns([vector]).append_column(out, lists)

    def run(batches):
        held = []
        for batch in batches:
            if len(batch):
                held.append(batch)
            if sum(map(len, held)) >= CALLED_ROWS:
                yield from called(held)
                held = []
        if held:
            yield from called(held)

    schema = rows.drop(vector).schema.add(out, ArrayType(DoubleType()))
    return rows.select(*(c for c in rows.columns if c != vector), vector).mapInArrow(run, schema)


def _tree_votes(bins: np.ndarray, tree: dict, classes: int) -> np.ndarray:
    feature, cut = np.frombuffer(tree["feature"], "<i4"), np.frombuffer(tree["cut"], np.uint8)
    left = np.frombuffer(tree["left"], "<i4").astype(np.int64)
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(rows):
        now = node[rows]
        inner = left[now] >= 0
        rows, now = rows[inner], now[inner]
        node[rows] = left[now] + (bins[rows, feature[now]] > cut[now])
    return np.frombuffer(tree["votes"], "<f4").reshape(-1, classes)[node]
