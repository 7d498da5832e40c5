"""Near-duplicates by SimHash fingerprints, joined by walking a binary trie against itself.

1. `fingerprints`: words of a whole text, four-word shingles, XXH64, majority bits.
2. `trie_links`: distinct fingerprints meet in buckets that agree in two of six
   bit blocks. At most four differing bits leave at least two of six blocks
   equal, so no link is lost. Within a bucket a binary trie is walked against
   itself: pairs of nodes go down together, differing bits add up, and a pair
   ends where the budget is exceeded or where all leaves are already linked.
3. `near_duplicates`: connected components over the links.

A trie node is a range of the sorted fingerprints, so that one pass of numpy
moves all node pairs of many buckets down one bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import components, map_batches, raw

SEED = 42
SHINGLE_WORDS = 4
BUDGET = 4
# First bit and width of each block, from the lowest bit.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
# Node pairs that are moved down together; more wait on a stack.
FRONTIER = 1 << 19


def fingerprint(text: bytes) -> int:
    """SimHash of one UTF-8 text; a text without words has fingerprint zero."""
    words = text.lower().split()  # on bytes: A-Z only, and exactly \x20 and \x09-\x0D
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n - SHINGLE_WORDS + 1].tolist(), ends[SHINGLE_WORDS - 1:].tolist())
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in spans), np.uint64, n - SHINGLE_WORDS + 1)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", kind: str = "long",
) -> DataFrame:
    """`(doc_id, fp)` of every row; `fp` holds the 64 bits as a signed long. Null text reads as empty.

    `kind` is the type that the key is carried as.
    """
    def run(batches):
        for batch in batches:
            values = np.fromiter(map(fingerprint, raw(batch.column(1))), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return map_batches(
        docs.select(F.col(key).cast(kind), F.col(text).cast("string")), run,
        f"doc_id {kind}, fp long")


def buckets(reps: DataFrame) -> DataFrame:
    """`(key, fp, rep)`: every fingerprint under each pair of its blocks."""
    def block(i: int):
        start, width = BLOCKS[i]
        return F.shiftrightunsigned(F.col("fp"), start).bitwiseAND((1 << width) - 1)

    pairs = [
        (F.lit(n << 22) + F.shiftleft(block(i), 11) + block(j))
        for n, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))
    ]
    return reps.select(F.explode(F.array(*pairs)).alias("key"), "fp", "rep")


def _labels(n: int, u: np.ndarray, v: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Labels after joining the rows of the pairs (u, v): the smallest label of each class."""
    while True:
        a, b = labels[u], labels[v]
        low = np.minimum(a, b)
        if (a == b).all():
            return labels
        jump = np.arange(n)
        np.minimum.at(jump, a, low)
        np.minimum.at(jump, b, low)
        while True:
            further = jump[jump]
            if (further == jump).all():
                break
            jump = further
        labels = jump[labels]


def trie_edges(keys: np.ndarray, prints: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by (key, fingerprint): pairs of rows (u, v) that differ in at most `budget` bits.

    They join the rows of a key into the classes of `trie_classes`. A row is in
    few of them, as pairs of rows that are in one class already are not visited.
    """
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    trie_classes(keys, prints, budget, edges)
    if not edges:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    u, v = (np.concatenate(side).astype(np.int64) for side in zip(*edges))
    return u, v


def trie_classes(
    keys: np.ndarray, prints: np.ndarray, budget: int = BUDGET, edges: list | None = None,
) -> np.ndarray:
    """For rows sorted by (key, fingerprint): the first row of each row's class.

    Rows of one key are in one class if a chain of links of at most `budget`
    differing bits joins them. `edges` takes the links that were followed, of
    those found together one per row and side.
    """
    def note(u: np.ndarray, v: np.ndarray) -> None:
        if edges is not None and len(u):
            kept = np.union1d(np.unique(u, return_index=True)[1], np.unique(v, return_index=True)[1])
            edges.append((u[kept], v[kept]))

    n = len(prints)
    same_key = keys[1:] == keys[:-1]
    # Neighbours in sorted order are linked first; that joins most of a dense group.
    near = np.flatnonzero(same_key & (np.bitwise_count(prints[1:] ^ prints[:-1]) <= budget))
    labels = _labels(n, near, near + 1, np.arange(n))
    note(near, near + 1)
    bounds = np.concatenate(([0], np.flatnonzero(~same_key) + 1, [n]))
    lo, hi = bounds[:-1], bounds[1:]
    wide = hi - lo > 1
    lo, hi = lo[wide], hi[wide]
    stack = [(63, np.stack([lo, hi, lo, hi, np.zeros_like(lo)]))]
    while stack:
        bit, front = stack.pop()
        if front.shape[1] > FRONTIER:
            half = front.shape[1] // 2
            stack += [(bit, front[:, half:]), (bit, front[:, :half])]
            continue
        changes = np.concatenate(([0], np.cumsum(labels[1:] != labels[:-1])))
        alo, ahi, blo, bhi, err = front
        done = (
            (changes[ahi - 1] == changes[alo]) & (changes[bhi - 1] == changes[blo])
            & (labels[alo] == labels[blo]))
        front = front[:, ~done]
        alo, ahi, blo, bhi, err = front
        leaves = (ahi - alo == 1) & (bhi - blo == 1)
        if leaves.any():
            u, v = alo[leaves], blo[leaves]
            linked = np.bitwise_count(prints[u] ^ prints[v]) <= budget
            note(u[linked], v[linked])
            labels = _labels(n, u[linked], v[linked], labels)
            front = front[:, ~leaves]
        if bit < 0 or not front.shape[1]:
            # Equal fingerprints of one key: no bit is left to part them.
            if front.shape[1]:
                note(front[0], front[2])
                labels = _labels(n, front[0], front[2], labels)
            continue
        ones = np.concatenate(([0], np.cumsum(((prints >> np.uint64(bit)) & np.uint64(1)).astype(np.int64))))
        alo, ahi, blo, bhi, err = front
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        own = (alo == blo) & (ahi == bhi)
        below = np.concatenate([
            np.stack([alo, amid, blo, bmid, err]),
            np.stack([amid, ahi, bmid, bhi, err]),
            np.stack([alo, amid, bmid, bhi, err + 1]),
            np.stack([amid, ahi, blo, bmid, err + 1])[:, ~own],
        ], axis=1)
        below = below[:, (below[0] < below[1]) & (below[2] < below[3]) & (below[4] <= budget)]
        if below.shape[1]:
            stack.append((bit - 1, below))
    return labels


def _whole_keys(batches: Iterator[pa.RecordBatch]):
    """Arrays (key, fp, rep) that never part the rows of one key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if held and (cut > 0 or held[-1].column(0)[-1].as_py() != keys[0]):
            yield _columns([*held, batch.slice(0, cut)])
            held = []
        elif cut > 0:
            yield _columns([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield _columns(held)


def _columns(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    table = pa.Table.from_batches(parts)
    return tuple(table.column(i).to_numpy() for i in range(3))


def trie_links(reps: DataFrame) -> DataFrame:
    """Links `(u, v)` that join `reps(fp, rep)`, fingerprints distinct, into their classes.

    A bucket gives at most one link per row, to the first row of its class, so a
    dense group of copies gives no pairs. One task holds one bucket's
    fingerprints, 24 bytes each, of one of 15 x 2^21 buckets; texts never meet.
    """
    def run(batches):
        for keys, prints, reps_ in _whole_keys(batches):
            first = trie_classes(keys, prints.view(np.uint64))
            rows = np.flatnonzero(first != np.arange(len(first)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(reps_[rows]), pa.array(reps_[first[rows]])], ["u", "v"])

    dealt = buckets(reps).repartition("key")
    # Unsigned order within a key, as the trie reads the bits from the highest one.
    in_order = dealt.sortWithinPartitions(
        "key", F.shiftrightunsigned(F.col("fp"), 1), F.col("fp").bitwiseAND(1))
    return map_batches(in_order, run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`(doc_id, fp, component_id)`: one row per row of `docs`.

    `component_id` is the smallest doc_id that chains of links reach. Texts
    without words, null ones included, share fingerprint zero and are linked.
    Repeated rows stay repeated. A row without an id takes part in no group and
    has a null component_id unless another row with an id has its fingerprint.
    An empty table gives an empty result; other columns are not read.
    """
    prints = materialize(fingerprints(docs, key, text), "fingerprints")
    reps = materialize(
        prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).filter("rep IS NOT NULL"), "reps")
    found = components(trie_links(reps))
    classes = reps.join(found, F.col("rep") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(classes, "fp", "left").select("doc_id", "fp", "component_id")
