"""Byte-level BPE by replaying merges over the distinct words of a slice of the corpus.

A task takes its texts in slices. Of a slice, every distinct word that is not
known yet is laid out byte by byte in one array. An inverted index leads from
each mergeable pair, named by the token that it makes, to the positions where
the pair stands. Merges are applied in the order of their ranks to all words of
the slice at once; each touches its two neighbours only and enters the pairs
that they now form. Words are independent of each other, so slices give the ids
that one replay over the whole corpus would give, without a shuffle of words.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

RANKS = "byte_bpe_50k.tiktoken"
# Bytes of text whose distinct words are replayed together.
SLICE_BYTES = 4 << 20
# Words that a task remembers before it goes back to those of its last slice.
KNOWN_WORDS = 300_000
# Places of a pair from which they are merged together.
MANY = 80


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token bytes, from a file of base64 tokens and ranks."""
    return {
        base64.b64decode(token): int(rank)
        for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())
    }


@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens in one array, and the start and width of each by rank."""
    ranks = load_ranks(path)
    widths = np.zeros(max(ranks.values()) + 1, np.int32)
    ordered = sorted(ranks.items(), key=lambda x: x[1])
    widths[[rank for _, rank in ordered]] = [len(token) for token, _ in ordered]
    content = np.frombuffer(b"".join(token for token, _ in ordered), np.uint8)
    return content, np.cumsum(widths) - widths, widths


class MergeReplay:
    """Ids of words, many at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.bytes_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.made: dict[int, int] = {}
        self.byte_pairs = np.array(
            [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int32)
        # Tokens after which an earlier merge may become possible, as a longer token that starts
        # or ends with them has a lower rank. All other tokens' merges can be done in one go.
        self.turning = {
            ranks[part] for token, rank in ranks.items() for i in range(1, len(token))
            for part in (token[:i], token[i:]) if ranks.get(part, -1) > rank}

    def _make(self, a: int, b: int) -> int:
        """The token that a and b make together, or -1."""
        key = a << 32 | b
        found = self.made.get(key)
        if found is None:
            if len(self.made) > 400_000:
                self.made.clear()
            found = self.made[key] = self.ranks.get(self.token[a] + self.token[b], -1)
        return found

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, packed as 32-bit integers."""
        whole = list(map(self.ranks.get, words))
        split = [word for word, rank in zip(words, whole) if rank is None]
        parts = iter(self._replay(split) if split else ())
        return [next(parts) if rank is None else rank.to_bytes(4, "little") for rank in whole]

    def _replay(self, words: list[bytes]) -> list[bytes]:
        # One place per byte, and one before each word and at the end that holds no token.
        widths = np.fromiter(map(len, words), np.int64, len(words))
        n = int(widths.sum()) + len(words) + 1
        heads = np.concatenate(([0], np.cumsum(widths + 1)))
        raw = np.zeros(n, np.uint8)
        inside = np.ones(n, bool)
        inside[heads] = False
        raw[inside] = np.frombuffer(b"".join(words), np.uint8)
        # Arrays that plain Python and numpy share: the one reads single places, the other many.
        tok, after, before = (array("i", bytes(4 * n)) for _ in range(3))
        tok_, after_, before_ = (np.frombuffer(x, np.int32) for x in (tok, after, before))
        tok_[:] = np.where(inside, self.bytes_ids[raw], -2)
        after_[:], before_[:] = np.arange(1, n + 1), np.arange(-1, n - 1)
        made = np.where(
            inside[:-1] & inside[1:], self.byte_pairs[raw[:-1].astype(np.int32) * 256 + raw[1:]], -1)
        where: dict[int, list[int]] = {}
        self._enter(where, made, np.arange(n - 1))
        order = list(where)
        heapify(order)
        make = self._make
        while order:
            rank = heappop(order)
            at = where.pop(rank, None)
            if at is None:
                continue
            turning = rank in self.turning
            if len(at) >= MANY and not turning and self._at_once(
                    rank, np.array(at, np.int32), tok_, after_, before_, where, order):
                continue
            at.sort()  # leftmost first
            for k, p in enumerate(at):
                a, q = tok[p], after[p]
                if a < 0 or (b := tok[q]) < 0 or make(a, b) != rank:
                    continue  # a neighbour's merge has taken it
                tok[p], tok[q] = rank, -1
                right = after[p] = after[q]
                before[right] = p
                left = before[p]
                turn_back = False
                if (a := tok[left]) >= 0 and (m := make(a, rank)) >= 0:
                    if m in where:
                        where[m].append(left)
                    else:
                        where[m] = [left]
                        heappush(order, m)
                    turn_back = m < rank
                if (b := tok[right]) >= 0 and (m := make(rank, b)) >= 0:
                    if m in where:
                        where[m].append(p)
                    else:
                        where[m] = [p]
                        heappush(order, m)
                    turn_back |= m < rank
                if turn_back:  # an earlier merge has become possible: it goes first
                    where.setdefault(rank, []).extend(at[k + 1:])
                    heappush(order, rank)
                    break
        alive = tok_ >= 0
        ends = (4 * np.cumsum(alive)[heads]).tolist()
        ids = tok_[alive].astype("<i4").tobytes()
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]

    @staticmethod
    def _enter(where: dict[int, list[int]], made: np.ndarray, places: np.ndarray) -> list[int]:
        """Put places into the index under the tokens that their pairs make; gives new tokens."""
        good = made >= 0
        made, places = made[good], places[good]
        by = np.argsort(made, kind="stable")
        made, places = made[by], places[by]
        cuts = np.flatnonzero(made[1:] != made[:-1]) + 1
        starts = np.concatenate(([0], cuts)) if len(made) else ()
        fresh = []
        for m, part in zip(made[starts].tolist() if len(made) else (), np.split(places, cuts)):
            if m in where:
                where[m].extend(part.tolist())
            else:
                where[m] = part.tolist()
                fresh.append(m)
        return fresh

    def _at_once(self, rank, at, tok, after, before, where, order) -> bool:
        """Merge one pair at many places together; False if its places could overlap."""
        at = np.unique(at)
        a, b = tok[at], tok[after[at]]
        live = (a >= 0) & (b >= 0)
        at, a, b = at[live], a[live], b[live]
        if not len(at):
            return True
        pairs = np.unique(a.astype(np.int64) << 32 | b)
        pairs = [x for x in pairs.tolist() if self._make(x >> 32, x & 0xFFFFFFFF) == rank]
        if len(pairs) != 1:
            return not pairs
        first, second = pairs[0] >> 32, pairs[0] & 0xFFFFFFFF
        if first == second:
            return False
        at = at[(a == first) & (b == second)]
        gone = after[at]
        tok[at], tok[gone] = rank, -1
        after[at] = after[gone]
        before[after[at]] = at
        left, right = before[at], after[at]
        for places, x, y in ((left, tok[left], None), (at, None, tok[right])):
            side = y if x is None else x
            kinds, which = np.unique(side, return_inverse=True)
            made = np.array([
                -1 if k < 0 else (self._make(rank, k) if x is None else self._make(k, rank))
                for k in kinds.tolist()], np.int32)
            for m in self._enter(where, made[which], places):
                heappush(order, m)
        return True


class Encoder:
    """Ids of whole texts; remembers words from slice to slice."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, known: int = KNOWN_WORDS):
        self.replay, self.limit = MergeReplay(ranks), known
        self.words = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as 32-bit integers."""
        split = [self.words(text) for text in texts]
        seen = set().union(*split)
        if missing := list(seen.difference(self.known)):
            self.known.update(zip(missing, self.replay.encode([w.encode() for w in missing])))
        out = [b"".join(map(self.known.__getitem__, words)) for words in split]
        if len(self.known) > self.limit:  # words of this slice are the ones to be met again
            self.known = {word: self.known[word] for word in seen}
        return out


def _slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[list[str]]:
    """Texts of a column, null as empty, in parts of about `size` bytes or one longer text."""
    widths = pc.fill_null(pc.binary_length(column), 0).to_numpy()
    part = np.cumsum(widths, dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(column)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield [x or "" for x in column.slice(a, b - a).to_pylist()]


def decoded_bytes(ids: np.ndarray, ends: np.ndarray, path: str) -> pa.Array:
    """The bytes that rows of ids stand for; row i has the ids from ends[i] to ends[i + 1]."""
    content, starts, widths = token_bytes(path)
    wide = widths[ids]
    stops = np.concatenate(([0], np.cumsum(wide, dtype=np.int64)))
    # Byte i of the result is byte i + shift of the token table.
    out = np.empty(stops[-1], np.uint8)
    for a in range(0, len(ids), 1 << 18):
        own = slice(a, a + (1 << 18))
        first, last = stops[a], stops[min(a + (1 << 18), len(ids))]
        shift = starts[ids[own]] - stops[:-1][own]
        out[first:last] = content[np.repeat(shift, wide[own]) + np.arange(first, last)]
    return pa.Array.from_buffers(
        pa.large_binary(), len(ends) - 1,
        [None, pa.py_buffer(stops[ends].astype("<i8")), pa.py_buffer(out)]).cast(pa.binary())


def encode(
    docs: DataFrame, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN,
    key: str = "doc_id", text: str = "text", decoded: bool = False,
) -> DataFrame:
    """`(doc_id, ids)`: the ids of every whole text, one row per row.

    With `decoded` also the bytes that the ids decode to, in the same pass.
    `ranks` is the path of a rank file that all executors can read. Null and
    empty texts give an empty list. Keys are carried as they are, null and
    repeated ones too; other columns are not read.
    """
    path = ranks or public_tokenizers.path(RANKS)
    names = ["doc_id", "ids"] + ["decoded"] * decoded

    def run(batches):
        encoder = Encoder(load_ranks(path), pattern)
        for batch in batches:
            at = 0
            for part in _slices(batch.column(1)):
                packed = encoder.encode(part)
                ends = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
                ids = np.frombuffer(b"".join(packed), "<i4")
                columns = [
                    batch.column(0).slice(at, len(part)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
                if decoded:
                    columns.append(decoded_bytes(ids, ends, path))
                yield pa.RecordBatch.from_arrays(columns, names)
                at += len(part)

    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, ids array<int>"
    return map_batches(
        docs.select(key, F.col(text).cast("string")), run, schema + ", decoded binary" * decoded)


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """`encoded` with the bytes that its `ids` stand for, as `decoded`; null ids give null."""
    path = ranks or public_tokenizers.path(RANKS)

    @F.arrow_udf("binary")
    def bytes_of(ids: pa.Array) -> pa.Array:
        flat = pa.array(ids.flatten().to_numpy(zero_copy_only=False), pa.int32()).to_numpy()
        ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())))
        found = decoded_bytes(flat, ends.astype(np.int64), path)
        return pc.if_else(ids.is_valid(), found, pa.scalar(None, pa.binary()))

    return encoded.withColumn("decoded", bytes_of("ids"))
