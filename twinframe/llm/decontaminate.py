"""Benchmark decontamination: test items found inside long documents.

Containment search by MinHash, one-sided, as for genome screening: an item is
sketched by some of its shingle hashes, a document is tested with all of its
shingles, so that its length does not dilute the sketch. Items are partitioned
by size, and every size class is searched with a sketch and a demand of its own.
An item of n shingles may miss floor((1 - t) n) of them and still be contained
to the share t. Its sketch has more hashes than that, so a document that contains
the item hits at least the rest: the search demands that many hits of an item
before it is verified, and loses nothing. Sketches take shingles that few items
share first, so a common phrase makes no candidates. Candidates are verified by
the exact shingles, word by word, in the task that holds the document.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
# Text of the items that one pass over the documents carries to every task.
BLOCK_BYTES = 16 << 20
# Hits that are demanded of an item beyond as many as it may miss.
SPARE = 4
# Words whose hashes a task remembers.
KNOWN_WORDS = 500_000
_WORDS = re.compile(r"\w+").findall
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # fixed odd multipliers


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return _WORDS(text.lower()) if text else []


class WordHashes(dict):
    """64-bit hash of a word, alike in every process."""

    def __missing__(self, word: str) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        found = self[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest())
        return found


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for every run of `width` words, from the words' hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = (total + hashes[i:i + n]) * np.uint64(_MIX[0])
        total ^= total >> np.uint64(29)
    return total * np.uint64(_MIX[1])


@dataclass
class SizeClass:
    """Items of one shingle width and size class: each by its distinct shingles' hashes and words, with its sketch."""

    width: int
    ids: list[list[int]]  # ids of equal items
    heads: np.ndarray  # item i has the shingles heads[i] to heads[i + 1]
    hashes: np.ndarray  # of shingles, sorted in each item
    starts: np.ndarray  # where a shingle's words stand in the block's words
    demand: np.ndarray  # hits of its sketch that an item needs
    sketch: np.ndarray  # sorted distinct hashes
    owner_heads: np.ndarray  # hash j of the sketch belongs to owners[owner_heads[j]:owner_heads[j + 1]]
    owners: np.ndarray


@dataclass
class Items:
    """A block of items; words are numbers of the block's vocabulary, in one array."""

    vocabulary: dict[str, int]
    words: np.ndarray
    classes: list[SizeClass]
    sketches: dict[int, np.ndarray]  # by width, of all classes


def allowed_misses(n: int, containment: float) -> int:
    """Shingles that an item of n may miss."""
    return math.floor((1 - containment) * n + 1e-9)


def sketch_size(n: int, containment: float) -> int:
    """Hashes for an item of n shingles: SPARE more than twice what the largest item of its class may miss."""
    largest = (1 << n.bit_length()) - 1
    return min(n, 2 * allowed_misses(largest, containment) + SPARE)


def prepare(rows: list[tuple[int, str | None]], containment: float) -> Items:
    """Sketch items; items with equal ids are taken together as one set of shingles, equal sets as one item."""
    vocabulary: dict[str, int] = {}
    words: list[int] = []
    # Where the distinct shingles of an item start, by shingle.
    shingles: dict[int, dict[int, dict[tuple, int]]] = {}
    for item, text in rows:
        own = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
        if not own or item is None:
            continue
        width = min(SHINGLE_WORDS, len(own))
        starts = shingles.setdefault(width, {}).setdefault(item, {})
        for i in range(len(own) - width + 1):
            starts.setdefault(tuple(own[i:i + width]), len(words) + i)
        words += own
    flat = np.array(words, np.int32)
    known = WordHashes()
    hashed = np.array([known[w] for w in vocabulary], np.uint64)[flat]
    classes: list[SizeClass] = []
    for width, items in shingles.items():
        at = shingle_hashes(hashed, width)
        equal: dict[frozenset, list[int]] = {}
        starts_of: dict[frozenset, np.ndarray] = {}
        for item, starts in items.items():
            key = frozenset(starts)
            equal.setdefault(key, []).append(item)
            starts_of.setdefault(key, np.fromiter(starts.values(), np.int64, len(starts)))
        sizes: dict[int, list[frozenset]] = {}
        for key in equal:
            sizes.setdefault(len(key).bit_length(), []).append(key)
        for group in sizes.values():
            classes.append(_size_class(width, [equal[k] for k in group], [starts_of[k] for k in group], at, containment))
    sketches = {
        width: np.unique(np.concatenate([c.sketch for c in classes if c.width == width])) for width in shingles}
    return Items(vocabulary, flat, classes, sketches)


def _size_class(width: int, ids: list, starts: list[np.ndarray], at: np.ndarray, containment: float) -> SizeClass:
    counts = np.array([len(s) for s in starts])
    heads = np.concatenate(([0], np.cumsum(counts)))
    starts = np.concatenate(starts)
    owner = np.repeat(np.arange(len(ids)), counts)
    order = np.lexsort((at[starts], owner))
    starts = starts[order]
    hashes = at[starts]
    _, kind, shared = np.unique(hashes, return_inverse=True, return_counts=True)
    # Of each item the shingles of fewest items come first; by powers of two, then in the order of the hashes.
    rarity = np.ceil(np.log2(shared))[kind]
    first = np.lexsort((hashes, rarity, owner))
    sizes = np.array([sketch_size(n, containment) for n in counts.tolist()])
    taken = first[np.arange(len(first)) - np.repeat(heads[:-1], counts) < np.repeat(sizes, counts)]
    # Shingles of one item with equal hashes are hit together, so they count once.
    pairs = np.unique(np.stack((hashes[taken], owner[taken].astype(np.uint64))), axis=1)
    sketch, owner_heads = np.unique(pairs[0], return_index=True)
    distinct = np.bincount(pairs[1].astype(np.int64), minlength=len(ids))
    demand = distinct - np.array([allowed_misses(n, containment) for n in counts.tolist()])
    return SizeClass(
        width, ids, heads, hashes, starts, np.maximum(demand, 1), sketch,
        np.append(owner_heads, pairs.shape[1]), pairs[1].astype(np.int64))


def contained(words: list[str], hashes: np.ndarray, items: Items, containment: float) -> Iterator[tuple]:
    """(item, its shingles, those in the document) for every item that the words contain."""
    numbers = None
    for width, every in items.sketches.items():
        own = shingle_hashes(hashes, width)
        if not len(own):
            continue
        at = np.searchsorted(every, own)
        at[at == len(every)] = 0
        hits = np.unique(own[every[at] == own])
        if not len(hits):
            continue
        order = None
        for c in items.classes:
            if c.width != width:
                continue
            places = np.searchsorted(c.sketch, hits)
            places[places == len(c.sketch)] = 0
            places = places[c.sketch[places] == hits]
            if not len(places):
                continue
            found = np.concatenate([c.owners[c.owner_heads[p]:c.owner_heads[p + 1]] for p in places.tolist()])
            candidates, number = np.unique(found, return_counts=True)
            candidates = candidates[number >= c.demand[candidates]]
            if not len(candidates):
                continue
            if order is None:
                order = np.argsort(own, kind="stable")
                own_sorted = own[order]
            if numbers is None:
                numbers = np.fromiter((items.vocabulary.get(w, -1) for w in words), np.int32, len(words))
            for i in candidates.tolist():
                a, b = c.heads[i], c.heads[i + 1]
                shared = _present(
                    c.hashes[a:b], items.words[c.starts[a:b, None] + np.arange(width)], own_sorted, order, numbers)
                if shared >= containment * (b - a) - 1e-9:
                    for item in c.ids[i]:
                        yield item, int(b - a), shared


def _present(hashes, shingles, own_sorted, order, numbers) -> int:
    """How many of the shingles, rows of word numbers, stand in a document."""
    low, high = (np.searchsorted(own_sorted, hashes, side) for side in ("left", "right"))
    there = np.flatnonzero(low < high)
    same = (numbers[order[low[there], None] + np.arange(shingles.shape[1])] == shingles[there]).all(1)
    # Another place of the same hash may have the words.
    other = sum(
        any((numbers[p:p + shingles.shape[1]] == shingles[k]).all() for p in order[low[k] + 1:high[k]].tolist())
        for k in there[~same].tolist())
    return int(same.sum()) + other


def leaks(
    docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT,
    key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    kind: str = "long",
) -> DataFrame:
    """`(doc_id, item_id, n_shingles, n_shared, containment)`: each row of `docs` and item it contains.

    An item is contained if at least the share `containment` of its distinct
    five-word shingles stands in the document; an item of fewer words is one
    shingle of all its words. Items without words match nothing, rows without
    an item id are not items, null and empty documents contain nothing.
    Repeated documents give repeated rows. Items of one id count as one item.
    Other columns are not read. Keys of documents are carried as `kind`, long or
    binary. Items are measured first and carried to the
    tasks in blocks of at most about 16 MB of text, with one pass over the
    documents for each block; the documents are never shuffled.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.col(item_key).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    kept = docs.select(F.col(key).cast(kind).alias("doc_id"), F.col(text).cast("string").alias("t"))
    found = None
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).collect()
        sent = spark.sparkContext.broadcast(prepare([(r.i, r.t) for r in rows], containment))

        def run(batches, sent=sent):
            block_items, known = sent.value, WordHashes()
            for batch in batches:
                out: list[tuple] = []
                for doc, value in zip(batch.column(0), batch.column(1)):
                    words = words_of(value.as_py())
                    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                    out += [
                        (doc.as_py(), item, n, shared, shared / n)
                        for item, n, shared in contained(words, hashes, block_items, containment)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(
                        zip(*out) if out else [()] * 5, [batch.column(0).type] + [pa.int64()] * 3 + [pa.float64()])],
                    ["doc_id", "item_id", "n_shingles", "n_shared", "containment"])

        part = map_batches(
            kept, run, f"doc_id {kind}, item_id long, n_shingles long, n_shared long, containment double")
        found = part if found is None else found.union(part)
    return found
