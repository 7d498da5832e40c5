import pytest

from twinframe.operators import encode as e
from twinframe.operators.store import VectorStore, encode_into


def texts(spark, *words):
    return e.distinct_texts(spark.createDataFrame([(w, w) for w in words], "ref_seq string, var_seq string"))


def test_commits_writers_and_compaction(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "store"), 8)
    assert store.vectors().isEmpty() and store.missing(texts(spark, "A", "B")).count() == 2
    pairs = [spark.createDataFrame(rows, "ref_seq string, var_seq string") for rows in (
        [("A", "B"), ("C", "")], [("B", "D"), ("A", "E")], [("A", "B")])]
    log = []

    def encoder(batch):
        return e.hashing_encoder()(batch)

    for rows, n in zip(pairs, (4, 6, 6)):
        assert encode_into(store, [rows], encoder).count() == n
        log.append(store.missing(e.distinct_texts(*pairs)).count())
    assert log == [2, 0, 0] and len(store.segments()) == 3
    # A writer that saw an older state adds keys again; they count once.
    again = texts(spark, "A", "F")
    store.append(e.encode_texts(again))
    assert store.vectors().count() == 7 and sum(t.count() for t in store.tables()) == 8
    # One that broke off before its commit adds nothing.
    store._table("00000009-broken", 8)
    with pytest.raises(Exception, match="broken"):
        VectorStore(spark, store.path).append(e.encode_texts(again).selectExpr(
            "seq_key", "mean", "if(seq_key > '', raise_error('broken'), max) as max"))
    assert store.vectors().count() == 7
    before = {r.seq_key: (r.mean, r.max) for r in store.vectors().collect()}
    # A commit between the reading and the writing of a compaction stays.
    old = [name for name, _ in store.segments()]
    merged = store.vectors()
    store.append(e.encode_texts(texts(spark, "G")))
    store.append(merged, old)
    assert len(store.segments()) == 2 and store.vectors().count() == 8
    store.compact()
    other = VectorStore(spark, store.path)
    assert len(other.segments()) == 1 and other.buckets is None
    after = {r.seq_key: (r.mean, r.max) for r in other.vectors().collect()}
    assert {k: after[k] for k in before} == before and len(after) == 8


def test_stored_vectors_are_not_moved(spark, tmp_path):
    """Tests for missing keys and joins shuffle the other side only."""
    store = VectorStore(spark, str(tmp_path / "store"), 8)
    store.append(e.encode_texts(texts(spark, *"ABCDEFGH")))
    store.append(e.encode_texts(texts(spark, *"GHIJ")))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.createDataFrame([("x",)], "seq_key string")
        for df, moved in ((store.missing(asked), 1), (store.vectors(), 0), (asked.join(store.tables()[0], "seq_key"), 1)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == moved, plan
            assert plan.count("Bucketed: true") >= 1
        assert store.vectors().count() == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
