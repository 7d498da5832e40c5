import hashlib
import re

from pyspark.sql import functions as F

from twinframe.llm import secret_scan

ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def plain_base(text):
    text = text or ""
    found = [("assign", m) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = {"assign": 0, "access": 1, "hex": 2}
    return [f"{k}:{m.start()}:{m.end()}" for k, m in sorted(found, key=lambda x: (x[1].start(), order[x[0]]))]


TEXTS = [
    "password: token: abcdefgh", "token: token=abcdef", "PassWord = 'hunter2x' x", "api_key:\"abcdef123\"",
    "é😀 secret=abc secret=abcdefg", "AKIA" + "B" * 15 + " AKIA" + "C" * 16, "AKIAAKIA" + "Z" * 12,
    "f" * 23 + "g" + "0" * 24, "token=" + "a" * 30, "passwd:abcde\npasswd: abcdef", "apikey=====AAAA",
    "-----BEGIN RSA PRIVATE KEY----- ghp_" + "Z" * 36, "secret : 'x' secret:\t1234567", "", None,
    "token='" + "AKIA" + "1" * 20 + "'", "p" * 3000 + " secret=" + "q" * 3000, "password password=longenough",
]


def spans_of(df):
    return {r.doc_id: [f"{s.kind}:{s.start}:{s.stop}" for s in r.spans or []] for r in df.collect()}


def test_spans_as_stated(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = spans_of(secret_scan.paths_with_spans(docs, secret_scan.scan_unseen(docs)))
    base = tuple(r.kind for r in secret_scan.BASE_RULES)
    for i, text in enumerate(TEXTS):
        assert [s for s in got[i] if s.startswith(base)] == plain_base(text), text
    assert {s.split(":")[0] for s in got[11]} == {"private_key", "forge"}


def test_whole_table(spark):
    from twinframe.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op6_secret_scan"](spark, folder).collect()
    assert len(got) == len(docs)
    for r in got:
        base = plain_base(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(
            sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))


def test_only_unseen_pairs_are_scanned(spark):
    first = spark.createDataFrame([(1, "token=abcdef"), (2, "token=abcdef"), (3, "clean")], "doc_id long, text string")
    later = spark.createDataFrame([(4, "token=abcdef"), (5, "secret=zzzzzz")], "doc_id long, text string")
    one = secret_scan.scan_unseen(first)
    assert one.seen.count() == 2 and one.findings.count() == 1
    two = secret_scan.scan_unseen(later, one)
    assert two.seen.count() == 3 and two.findings.count() == 2
    again = secret_scan.scan_unseen(first.union(later), two)
    assert again.seen.count() == 3 and again.findings.count() == 2
    got = spans_of(secret_scan.paths_with_spans(first.union(later), again))
    assert got == {1: ["assign:0:12"], 2: ["assign:0:12"], 3: [], 4: ["assign:0:12"], 5: ["assign:0:13"]}
    # Other rules are another version: everything is unseen under them.
    fewer = secret_scan.BASE_RULES[1:]
    assert secret_scan.scan_unseen(first, two, fewer).seen.count() == 5
    empty = secret_scan.empty_ledger(spark)
    assert secret_scan.scan_unseen(first, empty).findings.count() == 1


def test_stored_ledger(spark, tmp_path, monkeypatch):
    """Commits add up, can be repeated, and one that broke off between its two writes leaves nothing behind."""
    path = str(tmp_path / "ledger")
    first = spark.createDataFrame([(1, "token=abcdef"), (2, "token=abcdef"), (3, "clean")], "doc_id long, text string")
    later = spark.createDataFrame([(4, "token=abcdef"), (5, "secret=zzzzzz"), (6, None)], "doc_id long, text string")
    assert secret_scan.read_ledger(spark, path).seen.count() == 0
    one = secret_scan.commit(first, path, "a")
    assert (one.seen.count(), one.findings.count()) == (2, 1)
    (tmp_path / "ledger" / "findings" / "commit=b").mkdir()
    (tmp_path / "ledger" / "seen" / "commit=b").mkdir()
    assert secret_scan.read_ledger(spark, path).seen.count() == 2
    scanned = []
    whole = secret_scan.scan
    monkeypatch.setattr(secret_scan, "scan", lambda blobs, rules: whole(blobs.transform(
        lambda df: scanned.append(df.count()) or df), rules))
    for _ in range(2):
        two = secret_scan.commit(first.union(later), path, "b")
        assert (two.seen.count(), two.findings.count()) == (4, 2)
    assert scanned == [2]
    fewer = secret_scan.commit(first.union(later), path, "c", secret_scan.BASE_RULES)
    assert fewer.seen.count() == 8 and scanned == [2, 4]
    got = spans_of(secret_scan.paths_with_spans(first.union(later), secret_scan.read_ledger(spark, path)))
    assert got == {1: ["assign:0:12"], 2: ["assign:0:12"], 3: [], 4: ["assign:0:12"], 5: ["assign:0:13"], 6: []}


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "token=abcdef", 7, 8)], "doc_id long, text string, _blob int, spans int")
    got = secret_scan.paths_with_spans(docs, secret_scan.scan_unseen(docs))
    assert got.columns == ["doc_id", "text", "_blob", "spans"] and got.first()._blob == 7


def test_redaction(spark):
    docs = spark.createDataFrame(
        [(1, "é token='AKIA" + "1" * 20 + "' end"), (2, "clean"), (3, None), (4, "a " + "0" * 24 + " b secret=abcdefg")],
        "doc_id long, text string")
    found = secret_scan.paths_with_spans(docs, secret_scan.scan_unseen(docs))
    got = {r.doc_id: r.t for r in found.select(
        "doc_id", secret_scan.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {1: "é [SECRET]' end", 2: "clean", 3: None, 4: "a [SECRET] b [SECRET]"}


def test_odd_rows(spark, odd_docs):
    got = secret_scan.paths_with_spans(odd_docs, secret_scan.scan_unseen(odd_docs))
    assert got.count() == odd_docs.count()
    assert {r.doc_id for r in got.filter("spans IS NOT NULL").collect()} == {11}  # forty thousand hex digits
    none = odd_docs.limit(0)
    assert secret_scan.paths_with_spans(none, secret_scan.scan_unseen(none)).count() == 0
