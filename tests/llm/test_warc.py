import gzip
import glob

from pyspark.sql import functions as F

from twinframe.llm import warc


def archive(spark, rows, block_lines=3, extra=""):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = warc.new_folder(spark)
    index = warc.build_index(warc.write_archives(pages.repartition(3), folder), folder, block_lines)
    return pages, index


def test_keys():
    assert warc.surt("http://www.Example.com:80/a/b?c=d#e") == "com,example,www)/a/b?c=d"
    assert warc.surt("https://example.com:8080") == "com,example:8080)/"
    assert warc.surt("x y") == "x%20y" and warc.surt(None) == "" and warc.surt("http://[bad/") != ""
    assert warc.surt("http://h/é\n") == "h)/%C3%A9"


def test_round_trip_and_duplicates(spark):
    rows = [(i, f"http://h{i % 7}.example.com/p{i}", f"<p>é {i % 40}</p>") for i in range(200)]
    rows += [(300, None, None), (301, "http://x/", ""), (302, "http://x/", None), (None, "http://n/", "only"), (None, None, "<p>é 1</p>")]
    pages, index = archive(spark, rows)
    assert len(index.shards) >= 1
    got = warc.read_records(index, warc.lookup(index, pages.select("url", "page_id"))).collect()
    assert len(got) == len(rows)
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    by = {(r.page_id, r.payload_bytes): r for r in got}
    for page, url, html in rows:
        data = (html or "").encode()
        r = by[page, len(data)]
        assert r.payload_digest == warc.base32_sha1(data) and r.url == url
        origin = first.get(html or "")
        if origin is None or origin == page:
            assert r.record_type == "response" and r.refers_to is None and bytes(r.payload) == data
        else:
            assert r.record_type == "revisit" and r.refers_to == origin and r.payload is None


def test_lookup_by_url_over_blocks_and_shards(spark):
    rows = [(i, "http://same.example.com/", f"body {i}") for i in range(50)] + [(100 + i, f"http://o{i}.example.com/", "b") for i in range(20)]
    _, index = archive(spark, rows)
    asked = spark.createDataFrame([("http://same.example.com/",), ("http://o7.example.com/",), ("http://none.example.com/",), (None,)], "url string")
    got = warc.read_records(index, warc.lookup(index, asked.union(asked))).collect()
    assert sorted(r.page_id for r in got) == [*range(50), 107]


def test_files_are_warc(spark):
    _, index = archive(spark, [(1, "http://a/", "x"), (2, "http://b/", "x")])
    data = b"".join(gzip.open(f).read() for f in glob.glob(f"{index.folder}/*.warc.gz"))
    assert data.count(b"WARC/1.1\r\n") == 2 and data.count(b"WARC-Type: revisit") == 1
    assert b"WARC-Refers-To: <urn:page:1>" in data and data.endswith(b"\r\n\r\n")


def test_odd_tables(spark):
    pages = spark.createDataFrame(
        [(1, "http://a/", "x", "f", "s"), (1, "http://a/", "x", "f", "s")], "page_id long, url string, html string, file string, surt string")
    folder = warc.new_folder(spark)
    index = warc.build_index(warc.write_archives(pages, folder), folder)
    got = warc.read_records(index, warc.lookup(index, pages)).collect()
    # A repeated row is a capture of its own, and a response like the first.
    assert [(r.page_id, r.record_type) for r in got] == [(1, "response")] * 2
    folder = warc.new_folder(spark)
    index = warc.build_index(warc.write_archives(pages.limit(0), folder), folder)
    assert index.shards == [] and warc.lookup(index, pages.select("url")).count() == 0
    long = spark.createDataFrame([(1, "http://a/" + "q" * 9000, "é" * 2_000_000)], "page_id long, url string, html string")
    folder = warc.new_folder(spark)
    index = warc.build_index(warc.write_archives(long, folder), folder)
    assert warc.read_records(index, warc.lookup(index, long.select("url", "page_id"))).select(F.length("payload")).first()[0] == 4_000_000
