"""A store of vectors by content key that grows by commits, for texts that are encoded once.

Vectors lie in segments, Parquet tables bucketed and sorted by key, so a join with
them moves the other side only. A segment counts once the manifest names it: a
manifest entry is one small file, written last, and entries are only added. So
writers need not know of each other, one that breaks off leaves nothing that is
read, and a compaction replaces segments in one step.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import materialize
from .encode import VECTORS, Encoder, by_length, distinct_texts, encode_texts

KEY = "seq_key"


@dataclass(frozen=True)
class VectorStore:
    """Vectors below `path` in a folder that all executors reach; the number of buckets is fixed by the first commit."""

    spark: SparkSession
    path: str
    buckets: int | None = None

    def _system(self, *parts: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _entries(self) -> list[dict]:
        """What the manifest's entries say; one small file per commit, which a compaction does not add to for long."""
        place, system = self._system("manifest")
        if not system.exists(place):
            return []
        rows = self.spark.read.option("pathGlobFilter", "*.json").text(place.toString(), wholetext=True).collect()
        return [json.loads(r.value) for r in rows]

    def _commit(self, entry: dict) -> None:
        # Written under another name first: a file appears whole or not at all.
        name = uuid.uuid4().hex
        draft, system = self._system("manifest", f"{name}.draft")
        stream = system.create(draft, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        if not system.rename(draft, self._system("manifest", f"{name}.json")[0]):
            raise OSError(f"The manifest entry {name} could not be put in place")

    def segments(self) -> list[tuple[str, int]]:
        """Names and bucket numbers of the segments that count, the oldest first."""
        entries = self._entries()
        dropped = {name for e in entries for name in e["drop"]}
        return sorted((e["add"], e["buckets"]) for e in entries if e["add"] and e["add"] not in dropped)

    def _table(self, name: str, buckets: int) -> DataFrame:
        """A segment as a bucketed table of the session's catalog, which is what tells Spark of the buckets."""
        table = f"vectors_{name.replace('-', '_')}"
        place, _ = self._system("segments", name)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({VECTORS}) USING parquet"
            f" CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{place}'")
        return self.spark.table(table)

    def tables(self) -> list[DataFrame]:
        return [self._table(*segment) for segment in self.segments()]

    def append(self, vectors: DataFrame, drop: Sequence[str] = ()) -> str:
        """Write `vectors(seq_key, mean, max)` as a segment and commit it, in place of the segments `drop`."""
        known = self.segments()
        buckets = known[0][1] if known else self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # Names sort by the number of segments there were; ties, of writers at the same time, by chance.
        name = f"{len(self._entries()):08d}-{uuid.uuid4().hex[:12]}"
        table = self._table(name, buckets)
        # One sorted file per bucket; its Bloom filter answers searches for single keys.
        vectors.select(table.columns).repartition(buckets, KEY).sortWithinPartitions(KEY).write.option(
            f"parquet.bloom.filter.enabled#{KEY}", "true").insertInto(f"vectors_{name.replace('-', '_')}")
        self._commit({"add": name, "buckets": buckets, "drop": list(drop)})
        return name

    def missing(self, texts: DataFrame) -> DataFrame:
        """Rows of `texts` whose key no segment holds; only `texts` is moved."""
        for table in self.tables():
            texts = texts.join(table.select(KEY), KEY, "left_anti")
        return texts

    def vectors(self) -> DataFrame:
        """One row per key. Of a key that two writers added at the same time the oldest segment's counts."""
        found, earlier = None, []
        for table in self.tables():
            own = table
            for other in earlier:
                own = own.join(other.select(KEY), KEY, "left_anti")
            found = own if found is None else found.unionByName(own)
            earlier.append(table)
        return self.spark.createDataFrame([], VECTORS) if found is None else found

    def compact(self) -> None:
        """Replace the segments that count now by one. Segments that others add meanwhile stay as they are."""
        old = [name for name, _ in self.segments()]
        if len(old) > 1:
            self.append(self.vectors(), old)


def encode_into(
    store: VectorStore, tables: Sequence[DataFrame], encoder: Encoder | None = None,
    ref: str = "ref_seq", var: str = "var_seq", max_length: int | None = 1024,
) -> DataFrame:
    """Encode what `store` lacks for the texts of all tables, commit it, and give the whole store's vectors.

    Several writers may run at once. They may then encode the same text, whose
    vector counts once.
    """
    texts = distinct_texts(*tables, ref=ref, var=var, max_length=max_length)
    missing = materialize(store.missing(texts), "missing-texts")
    store.append(encode_texts(by_length(missing), encoder))
    return store.vectors()
