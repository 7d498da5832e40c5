"""WARC archives of pages, and a two-level index of their captures.

Writing: the first of equal payloads becomes a response, the others revisits.
Each task writes its rows to an archive of its own, one gzip member per record,
and gives back where each record lies.

Index: captures are ordered by reversed-host URL key and page id. Each range of
the order becomes a shard: a file of compressed blocks of lines, and a sparse
directory that holds the first key of each block. A lookup finds the shard among
the shards' first keys (one per task that wrote the index), the block by binary
search in that shard's directory, and the line by binary search in the block,
which is read by its byte range, as the record is then from its archive.

Files are written under names of their task attempt, and only files of finished
tasks are in the index, so tasks that are run again leave nothing that counts.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import materialize, shared_folder
from .common import map_batches, open_folder

BLOCK_LINES = 1000
# Bytes of archives that a task reads, and searches of the index that it makes.
TASK_BYTES = 2 << 20
TASK_SEARCHES = 20_000
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE_SCHEMA = "surt string, page_id long, file string, offset long, length long"
RECORD_SCHEMA = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary")


def surt(url: str | None) -> str:
    """Reversed-host key of a URL: `com,example,www)/path?query`; null gives ''."""
    if not url:
        return ""
    clean = quote(url.strip(), safe="".join(map(chr, range(33, 127))))
    try:
        parts = urlsplit(clean)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return clean
    if not host:
        return clean
    port_text = f":{port}" if port and port not in (80, 443) else ""
    query = f"?{parts.query}" if parts.query else ""
    return ",".join(reversed(host.split("."))) + port_text + ")" + (parts.path or "/") + query


@F.arrow_udf(StringType())
def surt_of(urls: pa.Array) -> pa.Array:
    return pa.array(map(surt, urls.to_pylist()), pa.string())


def _member(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _unpack(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def page_of(identifier: str | None) -> int | None:
    tail = identifier[len("<urn:page:"):-1] if identifier else "none"
    return None if tail == "none" else int(tail)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit that keeps the HTTP head only."""
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n").encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload))]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127))))))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record as read; the digest of a response is taken from its payload anew."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).split(": ")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"], "refers_to": page_of(fields.get("WARC-Refers-To")),
        "payload_bytes": size, "payload_digest": digest, "payload": None if revisit else payload}


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write every page to archives under `folder`; gives the captures, already stored.

    A null html is an empty payload. Of equal payloads the smallest page id is
    the response, so repeated rows of that id are responses too; others are
    revisits. Rows without an id are never referred to unless nothing else has
    their payload, and then each is a response. Empty tables write no file.
    Only payloads that occur under several ids are joined back, by digest, which
    AQE can split where one payload has a great part of the rows.
    """
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    repeated = materialize(
        rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 AND first IS NOT NULL").select("digest", "first"), "repeated-payloads")
    rows = rows.join(repeated, "digest", "left").select(
        "page_id", "url", "payload",
        F.expr("CASE WHEN first IS NOT NULL AND NOT (first <=> page_id) THEN first END").alias("refers_to"))

    def run(batches):
        system, base = open_folder(folder)
        task = TaskContext.get()
        name = f"pages-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        stream, at = None, 0
        for batch in batches:
            out = []
            for page_id, address, payload, first in zip(*(c.to_pylist() for c in batch.columns)):
                if stream is None:
                    stream = system.open_output_stream(f"{base}/{name}", compression=None)
                data = _member(record(page_id, address, payload, first))
                stream.write(data)
                out.append((surt(address), page_id, name, at, len(data)))
                at += len(data)
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, _CAPTURE_TYPES)], _CAPTURE_NAMES)
        if stream is not None:
            stream.close()

    _make_folder(pages, folder)
    return materialize(map_batches(rows, run, CAPTURE_SCHEMA), "captures")


_CAPTURE_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
_CAPTURE_NAMES = ["surt", "page_id", "file", "offset", "length"]


def _make_folder(df: DataFrame, folder: str) -> None:
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).mkdirs(path)


def _sort_key(surt_key: str, page_id: int | None) -> tuple[str, int]:
    return surt_key, -(1 << 63) if page_id is None else page_id


@dataclass
class CaptureIndex:
    """Folder of archives and index, and the first key and name of every shard, in order."""

    folder: str
    shards: list[tuple[tuple[str, int], str]]


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """Sort captures into compressed blocks and write each shard's sparse directory.

    The order is by key and page id, so captures of one URL may fill many
    shards. Only one row per shard, that is per task, reaches the driver.
    """
    order = ["surt", F.col("page_id").asc_nulls_first(), "file", "offset"]
    ranged = captures.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        system, base = open_folder(folder)
        task = TaskContext.get()
        name = f"index-{task.partitionId():05d}-{task.taskAttemptId()}"
        stream, directory, lines, at = None, [], [], 0

        def block():
            nonlocal lines, at
            data = _member("".join(text for _, text in lines).encode())
            stream.write(data)
            directory.append([*lines[0][0], at, len(data)])
            at += len(data)
            lines = []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if stream is None:
                    stream = system.open_output_stream(f"{base}/{name}.cdx.gz", compression=None)
                lines.append((_sort_key(*row[:2]), json.dumps(row) + "\n"))
                if len(lines) == block_lines:
                    block()
        if stream is not None:
            if lines:
                block()
            stream.close()
            with system.open_output_stream(f"{base}/{name}.directory.gz", compression=None) as out:
                out.write(_member(json.dumps(directory).encode()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (directory[0][0], directory[0][1], name)], ["surt", "page_id", "name"])

    _make_folder(captures, folder)
    shards = materialize(map_batches(ranged, run, "surt string, page_id long, name string"), "shards")
    return CaptureIndex(folder, sorted(((r.surt, r.page_id), r.name) for r in shards.collect()))


class _Reader:
    """A task's view of the index: the directory and block that it read last, and open files."""

    def __init__(self, index: CaptureIndex):
        self.system, self.base = open_folder(index.folder)
        self.firsts, self.names = [s[0] for s in index.shards], [s[1] for s in index.shards]
        self.files: OrderedDict = OrderedDict()
        self.shard = self.block = None

    def bytes_at(self, name: str, offset: int, length: int) -> bytes:
        file = self.files.get(name)
        if file is None:
            file = self.files[name] = self.system.open_input_file(f"{self.base}/{name}")
            if len(self.files) > 64:
                self.files.popitem(last=False)[1].close()
        return file.read_at(length, offset)

    def _load(self, shard: int) -> None:
        if self.shard != shard:
            with self.system.open_input_stream(f"{self.base}/{self.names[shard]}.directory.gz", compression=None) as f:
                self.directory = json.loads(_unpack(f.read()))
            self.keys = [(s, p) for s, p, *_ in self.directory]
            self.shard = shard

    def _lines(self, shard: int, block: int) -> None:
        self._load(shard)
        if self.block != (shard, block):
            data = _unpack(self.bytes_at(self.names[shard] + ".cdx.gz", *self.directory[block][2:]))
            self.lines = [json.loads(line) for line in data.decode().splitlines()]
            self.line_keys = [_sort_key(*line[:2]) for line in self.lines]
            self.block = shard, block

    def find(self, low: tuple[str, int], high: tuple[str, int]):
        """The lines with keys from low to high, both included."""
        if not self.names:
            return
        # The last shard and block that start below the key, as its first line may end them.
        shard = max(0, bisect_left(self.firsts, low) - 1)
        self._load(shard)
        block = max(0, bisect_left(self.keys, low) - 1)
        while True:
            self._lines(shard, block)
            start, stop = bisect_left(self.line_keys, low), bisect_right(self.line_keys, high)
            yield from self.lines[start:stop]
            if stop < len(self.lines):
                return
            if block + 1 < len(self.directory):
                block += 1
            elif shard + 1 < len(self.names):
                shard, block = shard + 1, 0
            else:
                return


def lookup(index: CaptureIndex, queries: DataFrame) -> DataFrame:
    """`(file, offset, length)` of all captures that `queries(url)` or `queries(url, page_id)` ask for.

    With a page id the capture of that id is meant, a null id being one too,
    else all captures of the URL. Queries are ordered like the index first, so
    a task goes through its blocks once. Repeated queries give their captures
    once, unknown URLs and empty tables nothing.
    """
    exact = "page_id" in queries.columns
    wanted = queries.select(
        surt_of(F.col("url")).alias("surt"),
        (F.col("page_id").cast("long") if exact else F.lit(None).cast("long")).alias("page_id")).distinct()
    order = ["surt", F.col("page_id").asc_nulls_first()]
    wanted = materialize(wanted, "wanted")
    # A row stands for a search, not for its few bytes, so tasks are counted by rows.
    ranged = wanted.repartitionByRange(wanted.count() // TASK_SEARCHES + 1, *order).sortWithinPartitions(*order)

    def run(batches):
        reader = _Reader(index)
        for batch in batches:
            out = []
            for key, page_id in zip(*(c.to_pylist() for c in batch.columns)):
                low = _sort_key(key, page_id)
                high = low if exact else (key, 1 << 63)
                out += [tuple(line[2:]) for line in reader.find(low, high)]
            columns = zip(*out) if out else [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, _CAPTURE_TYPES[2:])], _CAPTURE_NAMES[2:])

    return map_batches(ranged, run, "file string, offset long, length long")


def read_records(index: CaptureIndex, places: DataFrame) -> DataFrame:
    """The records at `places(file, offset, length)`, each read by its byte range, in archive order.

    A task gets a range of places that stand for about 2 MB of archives.
    """
    places = materialize(places, "places")
    tasks = (places.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES + 1
    ordered = places.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]

    def run(batches):
        reader = _Reader(index)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                found = [
                    parse(_unpack(reader.bytes_at(*place)))
                    for place in zip(*(c.to_pylist() for c in part.columns))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[n] for r in found], k) for n, k in zip(names, kinds)], names)

    return map_batches(ordered, run, RECORD_SCHEMA)


def new_folder(spark) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
