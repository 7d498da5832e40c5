"""Collocations: exact counts of all frequent phrases, found by mergeable Misra-Gries summaries.

Words and phrases of every block of text are hashed and counted, and go as one
summary per hash partition to the task that merges the partition. There a
Misra-Gries summary has more counters than the partition's mass divided by the
threshold: what it takes off all counters together stays below the threshold, so
each frequent phrase has a counter left. A second pass over the texts counts the
survivors by their words, not by their hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.spread import lookup_join
from ..session import materialize
from .common import map_batches, raw

# Bytes of text that are counted together; longer texts are cut between words.
BLOCK_BYTES = 4 << 20
# Rows whose texts are taken out of a batch together.
ROWS = 256
# Words and phrases, repeats included, of one hash partition.
PARTITION_MASS = 2 << 20
# The survivors' bitmap has 32 bits each, but no more than 2 ** 29 bits (64 MB).
MOST_BITS = 29

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_END = re.compile(rb"[.,;:!?\x0A-\x0D]")
_GAP = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD))


class MisraGries:
    """Counters of hashes of a known mass, too low by `taken` at most, which stays under the threshold `least`.

    Every unit that is taken off all counters takes one from over `capacity` of
    them, so off the mass as many times more; hence `taken` < mass / capacity.
    """

    def __init__(self, least: int, mass: int):
        self.least, self.capacity, self.taken = least, mass // least + 1, 0
        self.hashes, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        """Merge counters of distinct hashes."""
        self.waiting.append((hashes, counts))
        self.n_waiting += len(hashes)
        if self.n_waiting > self.capacity:
            self.settle()

    def settle(self) -> None:
        hashes = np.concatenate([self.hashes, *(h for h, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c.astype(np.int64) for _, c in self.waiting)])
        self.waiting, self.n_waiting = [], 0
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))[:len(hashes)])
        self.hashes = hashes[first]
        self.counts = np.add.reduceat(counts, first) if len(first) else counts
        if len(self.hashes) > self.capacity:
            off = int(np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1])
            self.taken += off
            left = self.counts > off
            self.hashes, self.counts = self.hashes[left], self.counts[left] - off

    def survivors(self) -> np.ndarray:
        """Hashes that may have the threshold's count."""
        self.settle()
        return self.hashes[self.counts + self.taken >= self.least]


def _cut(text: bytes, size: int, carry: int) -> Iterator[tuple[int, bytes]]:
    """A text in parts of about `size` bytes, each led by up to `carry` words of the piece it goes on with."""
    at = 0
    while True:
        found = _GAP.search(text, at + size) if at + size < len(text) else None
        stop = found.start() if found else len(text)
        lead: list[bytes] = []
        width = 256
        while at:
            pieces = _END.split(text[max(0, at - width):at])
            lead = pieces[-1].split()
            if len(lead) > carry or len(pieces) > 1 or width >= at:
                lead = lead[-carry:] if carry else []
                break
            width *= 4
        yield len(lead), b" ".join([*lead, text[at:stop]])
        at = stop
        if at >= len(text):
            return


class Block:
    """Words of several texts as numbers of a vocabulary, with what may be counted."""

    def __init__(self, groups: list[str], parts: list[bytes], carried: list[int]):
        joined = _LOWER[np.frombuffer(b"\n".join(parts), np.uint8)]
        kinds = _KIND[joined]
        inside = np.concatenate(([0], kinds == 0, [0])).astype(np.int8)
        edges = np.flatnonzero(np.diff(inside))
        starts = edges[::2]
        self.piece = np.cumsum(kinds == 2, dtype=np.int32)[starts]
        bounds = pa.array(np.append(edges, len(joined)), pa.int64()).buffers()[1]
        spans = pa.Array.from_buffers(pa.large_binary(), len(edges), [None, bounds, pa.py_buffer(joined)])
        words = spans.take(pa.array(np.arange(0, len(edges), 2))).dictionary_encode()
        self.codes = words.indices.to_numpy().astype(np.int64)
        self.vocabulary = words.dictionary.cast(pa.binary())
        heads = np.cumsum([0, *(len(p) + 1 for p in parts)])
        per_part = np.diff(np.searchsorted(starts, heads))
        self.groups = list(dict.fromkeys(groups))
        number = {g: i for i, g in enumerate(self.groups)}
        self.group = np.repeat(np.array([number[g] for g in groups], np.int64), per_part)
        self.fresh = np.arange(len(starts)) >= np.repeat(np.searchsorted(starts, heads[:-1]) + carried, per_part)

    def hashes(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For 1 to `longest` words: a hash per place, whether a phrase stands there, whether it counts here."""
        known = np.array([xxhash.xxh64_intdigest(w) for w in self.vocabulary.to_pylist()], np.uint64)
        salts = np.array([xxhash.xxh64_intdigest(g, 1) for g in self.groups], np.uint64)
        word = (known[self.codes] ^ salts[self.group]) * _MIX[1]
        word ^= word >> np.uint64(29)
        same = self.piece[1:] == self.piece[:-1]
        value, stands = word, np.ones(len(word), bool)
        for n in range(1, longest + 1):
            if n > 1:
                value = (value[:-1] * _MIX[0] + word[n - 1:]) * _MIX[1]
                value ^= value >> np.uint64(31)
                stands = stands[:-1] & same[n - 2:]
            yield value, stands, stands & self.fresh[n - 1:]


def _blocks(batches, longest: int, size: int) -> Iterator[Block]:
    groups, parts, carried, held = [], [], [], 0
    for batch in (whole.slice(a, ROWS) for whole in batches for a in range(0, len(whole), ROWS)):
        for group, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
            for lead, part in _cut(text, size, longest - 1):
                groups.append(group)
                parts.append(part)
                carried.append(lead)
                held += len(part) + 1
                if held >= size:
                    yield Block(groups, parts, carried)
                    groups, parts, carried, held = [], [], [], 0
    if parts:
        yield Block(groups, parts, carried)


def _summaries(texts: DataFrame, longest: int, bits: int, size: int) -> DataFrame:
    """`(part, mass, hashes, counts)`: every block's distinct words and phrases, one row per hash partition."""
    def run(batches):
        for block in _blocks(batches, longest, size):
            found = [value[counts] for value, _, counts in block.hashes(longest)]
            hashes, counts = np.unique(np.concatenate(found), return_counts=True)
            if not len(hashes):
                continue
            part = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
            heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            ends = [*heads[1:].tolist(), len(hashes)]
            mass = np.add.reduceat(counts, heads)
            counts = counts.astype("<u4")
            yield pa.RecordBatch.from_arrays([
                pa.array(part[heads]), pa.array(mass, pa.int64()),
                pa.array([hashes[a:b].tobytes() for a, b in zip(heads, ends)], pa.binary()),
                pa.array([counts[a:b].tobytes() for a, b in zip(heads, ends)], pa.binary())],
                ["part", "mass", "hashes", "counts"])

    return map_batches(texts, run, "part long, mass long, hashes binary, counts binary")


def _merged(summaries: DataFrame, least: int) -> DataFrame:
    """`(part, hashes, n)`: survivors of each hash partition's merged summary."""
    def row(part: int, summary: MisraGries) -> pa.RecordBatch:
        left = summary.survivors()
        return pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.array([left.tobytes()], pa.binary()), pa.array([len(left)], pa.int64())],
            ["part", "hashes", "n"])

    def run(batches):
        part, summary = None, None
        for batch in batches:
            for now, mass, hashes, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if now != part:
                    if summary is not None:
                        yield row(part, summary)
                    part, summary = now, MisraGries(least, mass)
                summary.add(np.frombuffer(hashes, "<u8"), np.frombuffer(counts, "<u4"))
        if summary is not None:
            yield row(part, summary)

    # The sum over a partition keeps its rows in order, and spills them where they are many.
    ordered = summaries.repartition("part").sortWithinPartitions("part").withColumn(
        "mass", F.sum("mass").over(Window.partitionBy("part")))
    return map_batches(ordered, run, "part long, hashes binary, n long")


def _bitmap(survivors: DataFrame, most_bits: int) -> tuple[int, bytes]:
    """Bits of hash that a place has, and the map: 64 MB in the driver at most, whatever the input."""
    n = survivors.agg(F.sum("n")).first()[0] or 0
    bits = min(max((32 * n).bit_length(), 16), most_bits)
    slices = 6

    def run(batches):
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                places = (np.frombuffer(blob, "<u8") >> np.uint64(64 - bits)).astype(np.int64)
                which = places >> (bits - slices)
                for s in np.unique(which).tolist():
                    own = maps.setdefault(s, np.zeros(1 << (bits - slices), bool))
                    own[places[which == s] - (s << (bits - slices))] = True
        if maps:
            yield pa.RecordBatch.from_arrays([
                pa.array(list(maps), pa.int64()),
                pa.array([np.packbits(m, bitorder="little").tobytes() for m in maps.values()], pa.binary())],
                ["slice", "map"])

    # Neighbouring partitions fill the same slice, so ranges of them leave few maps to be joined.
    spread = survivors.repartitionByRange(1 << slices, "part").select("hashes")
    whole = np.zeros(1 << (bits - 3), np.uint8)
    width = 1 << (bits - slices - 3)
    for s, found in map_batches(spread, run, "slice long, map binary").collect():
        whole[s * width:(s + 1) * width] |= np.frombuffer(found, np.uint8)
    return bits, whole.tobytes()


def _counted(texts: DataFrame, longest: int, bits: int, bitmap, size: int) -> DataFrame:
    """`(grp, phrase, words, a)`: each block's exact counts of surviving phrases; words 0: all words."""
    def run(batches):
        kept = np.frombuffer(bitmap.value, np.uint8)
        for block in _blocks(batches, longest, size):
            v = max(len(block.vocabulary), 1)
            totals = np.bincount(block.group[block.fresh], minlength=len(block.groups))
            yield _rows(block.groups, [""] * len(totals), 0, totals)
            earlier = ids = None
            for n, (value, stands, counts) in enumerate(block.hashes(longest), 1):
                place = (value >> np.uint64(64 - bits)).astype(np.int64)
                alive = stands & ((kept[place >> 3] >> (place & 7).astype(np.uint8) & 1) > 0)
                if n > 1:  # a frequent phrase begins and ends with frequent ones
                    alive &= earlier[:-1] & earlier[1:]
                at = np.flatnonzero(alive)
                if not len(at):
                    break
                keys = (block.group[at] if n == 1 else ids[at]) * v + block.codes[at + n - 1]
                _, first, which = np.unique(keys, return_index=True, return_inverse=True)
                number = np.bincount(which[counts[at]], minlength=len(first))
                ids = np.full(len(value), -1, np.int64)
                ids[at] = which
                earlier = alive
                here = np.flatnonzero(number)
                head = at[first[here]]
                words = [block.vocabulary.take(pa.array(block.codes[head + i])) for i in range(n)]
                phrase = pc.binary_join_element_wise(*words, pa.scalar(b" ")) if n > 1 else words[0]
                names = [block.groups[g] for g in block.group[head].tolist()]
                yield _rows(names, phrase.cast(pa.string()), n, number[here])

    return map_batches(texts, run, "grp string, phrase string, words int, a long")


def _rows(groups, phrases, words: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(groups, pa.string()),
        phrases if isinstance(phrases, pa.Array) else pa.array(phrases, pa.string()),
        pa.array(np.full(len(counts), words, np.int32)), pa.array(counts.astype(np.int64))],
        ["grp", "phrase", "words", "a"])


def frequent_phrases(
    docs: DataFrame, text: str = "text", group: str = "lang", longest: int = 3, least: int = 10,
    size: int = BLOCK_BYTES, mass: int = PARTITION_MASS, most_bits: int = MOST_BITS,
) -> DataFrame:
    """`(grp, phrase, words, a)`: all words and phrases of up to `longest` words with a >= `least`, counted exactly.

    A-Z are lower-cased; pieces end at `.,;:!?` and line ends, words at spaces
    and tabs. A null group is `und`; null and empty texts have no words. A row
    with an empty phrase and words 0 holds the number of words of each group.
    The result is stored; other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("grp"), F.col(text).cast("string").alias("text"))
    # A word and its gap have two bytes at least.
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (total * longest // (2 * mass)).bit_length())
    survivors = materialize(_merged(_summaries(texts, longest, bits, size), least), "survivors")
    place_bits, places = _bitmap(survivors, most_bits)
    counted = _counted(texts, longest, place_bits, spark.sparkContext.broadcast(places), size)
    summed = counted.groupBy("grp", "phrase", "words").agg(F.sum("a").alias("a"))
    return materialize(summed.filter((F.col("a") >= least) | (F.col("words") == 0)), "phrases")


def _part(first: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, length), " ")


def collocations(
    docs: DataFrame, text: str = "text", group: str = "lang", longest: int = 3, least: int = 10,
    top: int = 2000, share: int = 50, **tuning: int,
) -> DataFrame:
    """`(grp, rank, phrase, a, l, r, n, score)`: the first `top` phrases of every group.

    A candidate is a phrase of 2 to `longest` words with a >= `least`. Cut after
    its first k words into parts of l and r occurrences, it scores
    floor(1000000 * a * a / (l * r)); the lowest cut counts, of equal ones the
    first. Candidates inside a longer one with at least `share` percent of their
    occurrences are dropped. Order: score and a falling, then phrase by bytes.
    n is the number of the group's words. Groups without a candidate, and empty
    tables, give no row. `a` must be below 10 ** 15.
    """
    known = frequent_phrases(docs, text, group, longest, least, **tuning)
    phrases, words = known.filter(F.col("words") >= 1), F.col("words")
    candidates = known.filter(words >= 2)
    parts = phrases.select("grp", F.col("phrase").alias("part"), F.col("a").alias("times"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), words - 1)).alias("k"))
    for name, piece in (("l", _part(F.lit(1), F.col("k"))), ("r", _part(F.col("k") + 1, words - F.col("k")))):
        cuts = lookup_join(
            cuts.withColumn("part", piece), parts, ["grp", "part"]).withColumnRenamed("times", name).drop("part")
    a, product = F.col("a").cast("decimal(15,0)"), F.col("l").cast("decimal(15,0)") * F.col("r").cast("decimal(15,0)")
    cuts = cuts.withColumn("top", a * a * F.lit(1000000).cast("decimal(7,0)")).withColumn("bottom", product)
    cuts = cuts.withColumn("score", F.expr("top div bottom"))
    best = cuts.groupBy("grp", "phrase", "words", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = candidates.filter(words > 2).select(
        "grp", "a", "words", "phrase", F.explode(F.sequence(F.lit(2), words - 1)).alias("len"))
    inner = inner.select(
        "grp", "a", "phrase", "len", F.explode(F.sequence(F.lit(1), words - F.col("len") + 1)).alias("at")).select(
        "grp", "a", _part(F.col("at"), F.col("len")).alias("phrase"))
    longer = inner.groupBy("grp", "phrase").agg(F.max("a").alias("inside"))
    kept = lookup_join(best, longer, ["grp", "phrase"]).filter(
        F.coalesce(100 * F.col("inside") < share * F.col("a"), F.lit(True)))
    order = Window.partitionBy("grp").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    first = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    totals = known.filter(words == 0).select("grp", F.col("a").alias("n"))
    return lookup_join(first, totals, ["grp"]).select(
        "grp", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
