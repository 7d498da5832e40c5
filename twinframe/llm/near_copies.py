"""One document of every group of near copies: SimHash candidates, verified by their shingles.

The links of `simhash` (four differing bits) hold as they are. They leave out
many pairs of documents that share four fifths of their five-word shingles, as
such pairs differ in about nine bits. For these a wider fingerprint of 256 bits
is made from the distinct pairs of words, which edits touch less. Fingerprints
meet where they agree in one of TABLES fixed choices of KEY_BITS bits, and a
bucket's binary trie is walked against itself under a wider budget. What it
links is a candidate, and becomes a link if the shingles agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import components, map_batches, raw
from .simhash import _whole_keys, fingerprint, majority, trie_edges, trie_links

SHINGLE_WORDS = 5
SIMILARITY = 0.8
# At that similarity about a tenth of the wide fingerprint's bits differ; a pair then meets in some table with
# probability 1 - (1 - 0.9 ** 24) ** 33, over 0.9, and differs in at most 12 of 64 bits with over 0.99.
TABLES, KEY_BITS, BUDGET = 33, 24, 12
_CHOSEN = np.array([np.random.default_rng(t).choice(256, KEY_BITS, replace=False) for t in range(TABLES)])
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xD6E8FEB86659FD93)  # fixed odd multipliers
KNOWN_WORDS = 500_000


class _Words(dict):
    """Hash of a word; remembers a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def _hashes(text: bytes, known: _Words) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _runs(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of the runs of `width` words, or of the one run of fewer words."""
    width = min(width, len(words))
    if not width:
        return words
    value = words[:len(words) - width + 1].copy()
    for i in range(1, width):
        value = value * np.uint64(_ODD[0]) + words[i:len(words) - width + 1 + i]
        value ^= value >> np.uint64(29)
    return np.unique(value * np.uint64(_ODD[2]))


def wide_print(words: np.ndarray) -> bytes:
    """256 bits: in each the majority over the hashes of the distinct pairs of words; zeros without words."""
    pairs = _runs(words, 2)
    if not len(pairs):
        return bytes(32)
    parts = []
    for odd in _ODD:
        mixed = (pairs ^ np.uint64(odd >> 7)) * np.uint64(odd)
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(_ODD[1])
        parts.append(majority(mixed ^ mixed >> np.uint64(29)).to_bytes(8, "little"))
    return b"".join(parts)


def _prints(docs: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches):
        known = _Words()
        for batch in batches:
            texts = raw(batch.column(1))
            narrow = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
            wide = [wide_print(_hashes(t, known)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(narrow), pa.array(wide, pa.binary())], ["place", "fp", "wide"])

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(
        docs.select(F.col(key), F.col(text).cast("string")), run, f"place {kind}, fp long, wide binary")


def candidates(reps: DataFrame) -> DataFrame:
    """Pairs `(u, v)` of `reps(wide, rep)` that some bucket's trie links; no group gives all its pairs."""
    powers = 1 << np.arange(KEY_BITS, dtype=np.int64)

    def keys(batches):
        for batch in batches:
            wide = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, 32)
            bits = np.unpackbits(wide, axis=1)
            for t in range(TABLES):
                own = np.ascontiguousarray(wide[:, 8 * (t % 4):8 * (t % 4) + 8]).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([
                    pa.array(bits[:, _CHOSEN[t]] @ powers + (t << KEY_BITS)), pa.array(own), batch.column(1)],
                    ["key", "fp", "rep"])

    def run(batches):
        for found, prints, reps_ in _whole_keys(batches):
            u, v = trie_edges(found, prints.view(np.uint64), BUDGET)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.minimum(reps_[u], reps_[v])), pa.array(np.maximum(reps_[u], reps_[v]))], ["u", "v"])

    dealt = map_batches(reps.select("wide", "rep"), keys, "key long, fp long, rep long").repartition("key")
    in_order = dealt.sortWithinPartitions(
        "key", F.shiftrightunsigned(F.col("fp"), 1), F.col("fp").bitwiseAND(1))
    return map_batches(in_order, run, "u long, v long").filter("u <> v").distinct()


def verified(links: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of `links(u, v)` whose `texts(rep, text)` share SIMILARITY of their distinct shingles, as hashes of 32 bits."""
    def shingles(batches):
        known = _Words()
        for batch in batches:
            sets = [(_runs(_hashes(t, known), SHINGLE_WORDS) >> np.uint64(32)).astype("<u4") for t in raw(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([np.unique(s).tobytes() for s in sets], pa.binary())], ["rep", "shingles"])

    def run(batches):
        for batch in batches:
            kept = []
            for i, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                a, b = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
                shared = len(np.intersect1d(a, b, assume_unique=True))
                if shared and shared >= SIMILARITY * (len(a) + len(b) - shared) - 1e-9:
                    kept.append(i)
            kept = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], ["u", "v"])

    sets = materialize(map_batches(texts, shingles, "rep long, shingles binary"), "shingles")
    both = links.join(sets.toDF("u", "_a"), "u").join(sets.toDF("v", "_b"), "v").select("u", "v", "_a", "_b")
    return map_batches(both, run, "u long, v long")


def first_of_groups(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`(first)`: of every group of near copies the smallest key, whatever its type; keys may be repeated.

    Documents are linked if their SimHash fingerprints differ in at most four
    bits, or if they are candidates and share four fifths of their shingles.
    Documents whose two fingerprints are equal are taken as one. Null texts read
    as empty; texts without words are one group. An empty table gives no row.
    """
    prints = _prints(docs, key, text)
    least = materialize(prints.groupBy("fp", "wide").agg(F.min("place").alias("first")).withColumn(
        "rep", F.xxhash64("fp", "wide")), "least")
    links = materialize(candidates(least), "candidates")
    asked = links.select(F.explode(F.array("u", "v")).alias("rep")).distinct()
    chosen = least.join(asked, "rep", "left_semi").select(F.col("first").alias(key), "rep")
    texts = docs.select(key, F.col(text).cast("string").alias("_text")).join(chosen, key).select("rep", "_text")
    by_print = materialize(least.groupBy("fp").agg(F.min("rep").alias("rep")), "by-print")
    same = least.join(by_print.withColumnRenamed("rep", "v"), "fp").select(F.col("rep").alias("u"), "v")
    edges = verified(links, texts.dropDuplicates(["rep"])).union(trie_links(by_print)).union(same)
    classes = least.join(components(edges), F.col("rep") == F.col("node"), "left")
    return classes.groupBy(F.coalesce("component", "rep")).agg(F.min("first").alias("first")).select("first")
