"""The helpers that keep hot groups apart, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinframe.catalogue.views import pair_view
from twinframe.operators import spread as sp
from twinframe.session import PARTITIONS_SETTING, dealt_out, spread_scan


def test_lookup_join_with_hot_null_and_missing_keys(spark):
    rng = random.Random(1)
    keys = [0] * 400 + [rng.randint(1, 300) for _ in range(500)] + [None] * 60 + [999] * 300
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, k int")
    table = spark.createDataFrame([(k, f"v{k}", 1 if k else 400) for k in range(0, 250)], "k int, v string, n int")
    wanted = {i: (f"v{k}" if k is not None and k < 250 else None) for i, k in enumerate(keys)}
    for limit, stored in ((1 << 20, False), (0, False), (0, True)):
        for weight in ("n", None):
            used = table if weight else table.drop("n")
            got = sp.lookup_join(rows, used, ["k"], weight, "left", stored, limit, split=50)
            assert got.columns == ["id", "k", "v"]
            assert {r.id: r.v for r in got.collect()} == wanted
            inner = sp.lookup_join(rows, used, ["k"], weight, "inner", stored, limit, split=50)
            assert {r.id: r.v for r in inner.collect()} == {i: v for i, v in wanted.items() if v}
    with pytest.raises(ValueError):
        sp.lookup_join(rows, table, ["k"], "n", "full")


def test_large_lookup_texts_are_not_broadcast(spark):
    texts = spark.range(40).select(F.col("id").alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 40_000).alias("t"))
    rows = spark.range(400).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 40).otherwise(0).alias("k"))
    got = sp.lookup_join(rows, texts.drop("n"), ["k"], broadcast_bytes=1000).select("id", F.length("t").alias("n"))
    assert got.count() == 400 and got.filter("n <> 1280000").isEmpty()
    plan = sp.lookup_join(rows, texts, ["k"], broadcast_bytes=1000)._jdf.queryExecution().optimizedPlan().toString()
    # Only hashes of heavy keys may be broadcast.
    for line in plan.splitlines():
        if "rightHint=(strategy=broadcast)" in line:
            assert "_mark" in line


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_totals(spark, by):
    rng = random.Random(2)
    cells = {(rng.choice(["a", "a", "a", "b", None]), round(rng.gauss(0, 1), 2)): rng.randint(0, 9) for _ in range(900)}
    if not by:
        cells = {("a", v): n for (_, v), n in cells.items()}
    df = spark.createDataFrame([(g, v, n) for (g, v), n in cells.items()], "g string, v double, n long")
    got = sp.running_totals(df, by, "v", ["n"]).collect()
    assert len(got) == len(cells)
    for r in got:
        group = [(v, n) for (g, v), n in cells.items() if g == r.g]
        assert r.n_before == sum(n for v, n in group if v < r.v)
        assert r.n_total == sum(n for _, n in group)


def test_average_ranks(spark):
    df = spark.createDataFrame([("a", x) for x in (3.0, 1.0, 3.0, 3.0, 2.0, None)] + [("b", 5.0)], "g string, v double")
    got = {(r.g, r.v): (r.n, r["rank"]) for r in sp.average_ranks(df, ["g"], "v").collect()}
    assert got == {("a", 1.0): (1, 1.0), ("a", 2.0): (1, 2.0), ("a", 3.0): (3, 4.0), ("b", 5.0): (1, 1.0)}


def test_exact_percentiles(spark):
    rng = random.Random(3)
    values = [rng.choice([1.5, rng.gauss(0, 9)]) for _ in range(501)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = sp.exact_percentiles(df, "v", [0.0, 0.33, 0.5, 0.67, 1.0]).first()[0]
    assert got == pytest.approx(list(np.percentile(values, [0, 33, 50, 67, 100])))


def test_rank_cuts_close_exact_counts(spark):
    rows = spark.range(3000).withColumn("s", (F.col("id") % 7 == 0).cast("int")).withColumn("o", sp.hash_order(["id"]))
    cuts = sp.rank_cuts(rows, "s", [0, 1], "o", ["id"], lambda t: t.selectExpr("*", "n div 3 AS a", "0 AS b"), ["a", "b"])
    joined = rows.join(cuts, "s")
    kept = {r.s: r["count"] for r in joined.filter(F.struct("o", "id") <= F.col("a")).groupBy("s").count().collect()}
    sizes = {r.s: r["count"] for r in rows.groupBy("s").count().collect()}
    assert kept == {s: n // 3 for s, n in sizes.items()}
    assert joined.filter(F.col("b").isNotNull()).isEmpty()


def test_rows_are_dealt_out_only_where_the_session_says_so(spark):
    df = spark.range(1000).coalesce(1)
    assert dealt_out(df) is df
    spark.conf.set(PARTITIONS_SETTING, "5")
    try:
        many = dealt_out(df)
        assert sorted(r.id for r in many.collect()) == list(range(1000))
        parts = many.groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) == 5
    finally:
        spark.conf.unset(PARTITIONS_SETTING)


def test_a_scan_of_few_tasks_is_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    small = pair_view(spark, "/root/testdata/sf0.001")
    assert small.rdd.getNumPartitions() > 1
    assert len(small.groupBy(F.spark_partition_id()).count().collect()) > 1
    wide = spark.range(0, 100, 1, cores)
    assert spread_scan(wide) is wide
