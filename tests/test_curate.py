import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from twinframe.functions import rules
from twinframe.operators import curate as c
from twinframe.plans.curation import balance_and_split, label_pairs


def test_ids_that_begin_alike_bring_no_checks(spark):
    """Ids and stems with one prefix: candidates grow with the stems, not with stems times ids."""
    spent = []
    for n in (2000, 2000, 32_000):
        start = time.perf_counter()
        stems = spark.range(n).selectExpr("concat('common_prefix_', lpad(cast(id as string), 6, '0'), '_x') as stem")
        ids = spark.range(2 * n).selectExpr("concat('common_prefix_', lpad(cast(id * 2 as string), 6, '0')) as id")
        got = c.filter_by_catalog(stems, "stem", ids, "id")
        assert got.count() == n // 2 and got.filter("cast(substr(stem, 15, 6) as int) % 2 = 1").isEmpty()
        spent.append(time.perf_counter() - start)
    # 256 times the pairs; the first run starts workers.
    assert spent[2] < 16 * spent[1] + 5


def test_keyword_filter(spark):
    df = spark.createDataFrame(
        [("A_ECO", "x", None), ("b", "y", "Coli X"), (None, "z", "q"), ("b", None, None)],
        "DMS_id string, UniProt_ID string, my_Organism string")
    ids = lambda kws, **k: [tuple(r) for r in c.filter_catalog(df, kws, **k).collect()]
    assert len(ids(["e.o"])) == 1 and len(ids(["COLI"])) == 1
    assert len(ids(["nan"])) == 2
    assert ids([]) == [] and len(ids([], id_patterns=["^B$"])) == 2


def test_catalog_names_inside_stems(spark):
    df = spark.createDataFrame([("TEM1_X",), ("abc_kw_d",), ("tem1",), (None,), ("KW",)], "stem string")
    ids = spark.createDataFrame([("TEM1",), ("",), (None,), ("a_very_long_identifier",)], "id string")
    got = {r.stem for r in c.filter_by_catalog(df, "stem", ids, "id", ["kw", "."]).collect()}
    assert got == {"TEM1_X", "abc_kw_d", "KW"}
    # Ids of all sizes, that begin alike and are found at the edges of stems.
    names = [(s,) for s in ("abcde", "xabcdf", "abc", "b", "ab\\cd", "aXbcd", "zab", "bcdx", "")]
    few = spark.createDataFrame([("abcdf",), ("abcdg",), ("bcdx",), ("zab",), ("X",)], "id string")
    got = {r.stem for r in c.filter_by_catalog(spark.createDataFrame(names, "stem string"), "stem", few, "id").collect()}
    assert got == {n for n, in names if any(i in n for i in ("abcdf", "abcdg", "bcdx", "zab", "X"))}
    none = c.filter_by_catalog(df, "stem", ids.limit(0), "id", ["kw"])
    assert {r.stem for r in none.collect()} == {"abc_kw_d", "KW"}


def test_labels_at_the_cuts(spark):
    df = spark.createDataFrame([(-1.0,), (-1.01,), (1.0,), (1.01,), (None,), (float("nan"),)], "z double")
    assert [r[0] for r in df.select(rules.threshold_label("z")).collect()] == [1, 0, 1, 2, 1, 1]


def test_small_rules(spark):
    df = spark.createDataFrame([("x_ecoli_n1", "Ps. A"), (None, None), ("none", "")], "stem string, grp string")
    names = df.select(rules.first_known_token("stem", {"ECOLI": "E", "N1": "N"})).collect()
    assert [r[0] for r in names] == ["E", "", ""]
    assert [r[0] for r in df.select(rules.held_out("grp", ["ps. a"])).collect()] == [True, False, False]
    assert [r[0] for r in df.select(rules.code_label("grp", {"Ps. A": "low"}, "mid")).collect()] == ["low", "mid", "mid"]
    scores = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "s double")
    assert [r[0] for r in scores.select(rules.score_or_zero(["s"], "s")).collect()] == [1.0, 0.0, 0.0]
    assert scores.select(rules.score_or_zero(["s"], "other")).first()[0] == 0.0


def test_zscores_of_odd_groups(spark):
    df = spark.createDataFrame(
        [("one", 5.0), ("flat", 2.0), ("flat", 2.0), ("two", 1.0), ("two", 3.0), ("two", None)], "g string, s double")
    got = {(r.g, r.s): r.zscore for r in c.standardize_scores(df, ["g"], "s").collect()}
    assert got[("one", 5.0)] is None and got[("flat", 2.0)] == 0.0
    assert got[("two", 1.0)] == pytest.approx(-(2 ** -0.5)) and len(got) == 4


def test_references_last_wins_and_inference(spark):
    catalog = spark.createDataFrame(
        [("a", "short", 1), ("a", "M" * 11, 2), ("a", "K" * 12, 3), ("b", "tiny", 4), ("c", None, 5)],
        "DMS_id string, target_seq string, o int")
    scores = spark.createDataFrame(
        [("b", 0.2, "no", 1), ("b", 0.1, "first", 2), ("b", 0.0, "second", 3), ("c", 5.0, "far", 4), ("a", 0.0, "x", 5),
         ("d", 0.0, None, 6), ("d", 0.0, "later", 7)],
        "assay string, score double, mutated_sequence string, row_no int")
    table = {r.assay: r.ref_seq for r in c.assay_table(scores, c.catalog_references(catalog, order="o")).collect()}
    assert table == {"a": "K" * 12, "b": "first", "c": None, "d": None}
    known = c.with_references(scores, c.catalog_references(catalog, order="o"), c.inferred_references(scores))
    assert {(r.assay, r.ref_seq) for r in known.collect()} == {("a", "K" * 12), ("b", "first")}


def test_first_per_key_keeps_partial_limit(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), "id")
    first = c.first_per_key(df, ["k"], ["id"])
    assert {(r.k, r.id) for r in first.collect()} == {(0, 0), (1, 1), (2, 2)}
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()


def test_default_columns_and_counts(spark):
    df = spark.createDataFrame([("1",), ("2",), ("2",)], "label string")
    full = c.with_default_columns(df, ["gene"], ["score"])
    assert full.columns == ["label", "gene", "score"] and full.first().gene == "" and full.first().score is None
    assert {(r.label, r.n) for r in c.label_counts(full).collect()} == {(0, 0), (1, 1), (2, 2)}


def rows(spark, sizes):
    parts = [(f"k{label}-{i}", label, f"Group {i % 4}") for label, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(parts, "key string, label int, species string")


def test_balance_is_exact_and_repeatable(spark):
    df = rows(spark, {0: 100, 1: 40, 2: 5})
    got = c.balance_classes(df, ["key"], 30)
    assert {r.label: r["count"] for r in got.groupBy("label").count().collect()} == {0: 30, 1: 30, 2: 5}
    again = c.balance_classes(df.repartition(5), ["key"], 30)
    assert sorted(got.collect()) == sorted(again.collect())
    other = c.balance_classes(df, ["key"], 30, seed=1)
    assert sorted(got.collect()) != sorted(other.collect())


def counted(split):
    return {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}


def test_split_is_a_partition_in_proportion(spark):
    df = rows(spark, {0: 300, 1: 200, 2: 100})
    split = c.stratified_split(df, ["key"])
    assert split.count() == 600 and split.select("key").distinct().count() == 600
    # A ninth of 540 rows comes out a little above 60 and is rounded up to 61.
    assert counted(split) == {
        (0, "test"): 30, (1, "test"): 20, (2, "test"): 10, (0, "val"): 31, (1, "val"): 20, (2, "val"): 10,
        (0, "train"): 239, (1, "train"): 160, (2, "train"): 80}


def test_split_rounds_over_all_classes(spark):
    sizes = counted(c.stratified_split(rows(spark, {0: 33, 1: 34, 2: 38}), ["key"]))
    by_split = {s: sum(n for (_, t), n in sizes.items() if t == s) for s in ("train", "val", "test")}
    # ceil(105 * 0.1) = 11, then ceil(94 / 9) = 11.
    assert by_split == {"test": 11, "val": 11, "train": 83}


def test_small_classes_are_not_stratified(spark):
    split = counted(c.stratified_split(rows(spark, {0: 40, 1: 2}), ["key"]))
    assert sum(n for (_, s), n in split.items() if s == "test") == 5
    assert sum(split.values()) == 42


def test_hold_out(spark):
    df = rows(spark, {0: 80, 1: 80, 2: 80})
    split = c.stratified_split(df, ["key"], group="species", hold_out=["group 1"])
    out = split.filter("species = 'Group 1'")
    assert out.count() == 60 and out.filter("split <> 'test'").isEmpty()
    assert split.filter("split = 'test'").count() == 60 + 18
    everything = c.stratified_split(df, ["key"], group="species", hold_out=["GROUP"])
    assert everything.filter("split = 'test'").count() == 24


def test_shuffle_is_a_fixed_order(spark):
    df = spark.range(50)
    order = [r.id for r in c.shuffle_rows(df, ["id"]).collect()]
    assert order == [r.id for r in c.shuffle_rows(df.repartition(7), ["id"]).collect()]
    assert order != sorted(order) and sorted(order) == list(range(50))


def test_highest_impact(spark):
    df = spark.createDataFrame(
        [("g", "LOW", 1), ("g", "HIGH", 2), ("g", "HIGH", 3), ("h", "odd", 5), ("h", "MODIFIER", 4)],
        "gene string, impact string, row_no int")
    assert {(r.gene, r.row_no) for r in c.highest_impact(df).collect()} == {("g", 2), ("h", 4)}


def test_scores_to_splits(spark):
    refs = spark.createDataFrame([("A_X", "MKTLVVVVVVV"), ("B_X", "MKTLVVVVVVV")], "assay string, ref_seq string")
    codes = [f"{old}{i + 1}{new}" for i, old in enumerate("MKTLVVVVVVV") for new in "ACD"]
    scores = [("A_X", float(i), code, None, i) for i, code in enumerate(codes)]
    scores += [("A_X", 3.0, "Z1A", None, 900), ("B_X", 99.0, codes[0], None, 901), ("B_X", 1.0, "", "MK", 902)]
    df = spark.createDataFrame(scores, "assay string, score double, mutant string, mutated_sequence string, row_no int")
    pairs = label_pairs(df, refs, group_names={"X": "Ex"}).cache()
    # The unchanged pair is dropped and the copy from the later assay loses.
    assert pairs.count() == len(codes) + 1
    assert pairs.filter("var_seq = 'AKTLVVVVVVV'").first().gene == "A_X"
    assert {r.species for r in pairs.select("species").distinct().collect()} == {"Ex"}
    split = balance_and_split(pairs, per_class=5)
    assert split.groupBy("label").count().filter("count > 5").isEmpty()
    assert balance_and_split(split.drop("split"), per_class=5).count() == split.count()


def test_unlisted_and_null_labels_are_errors(spark):
    for bad in (None, 7):
        df = spark.createDataFrame([(i, i % 3) for i in range(30)] + [(99, bad)], "key int, label int")
        with pytest.raises(PySparkException, match="no class lists"):
            c.stratified_split(df, ["key"]).collect()


def test_places_in_hash_order(spark):
    df = spark.range(500).withColumnRenamed("id", "key")
    places = {r.key: r.place for r in c.places_in_hash_order(df, ["key"]).collect()}
    assert [places[r.key] for r in c.shuffle_rows(df, ["key"]).collect()] == list(range(1, 501))


def test_statistics_of_assays_are_added_up_without_sorting(spark):
    refs = spark.createDataFrame([("a", "MKTL")], "assay string, ref_seq string")
    df = spark.createDataFrame(
        [("a", 1.0, "x", 1), ("a", 3.0, "y", 2), ("b", 0.0, "first", 3), ("b", 0.05, "second", 4), ("b", None, "z", 5)],
        "assay string, score double, mutated_sequence string, row_no int")
    table = c.assay_table(df.select("assay", "score"), refs, infer=False)
    assert "SortAggregate" not in table._jdf.queryExecution().executedPlan().toString()
    assert {(r.assay, r.mean, r.n, r.ref_seq) for r in table.collect()} == {("a", 2.0, 2, "MKTL"), ("b", 0.025, 3, None)}
    whole = c.assay_table(df, refs)
    assert {(r.assay, r.mean, r.n, r.ref_seq) for r in whole.collect()} == {("a", 2.0, 2, "MKTL"), ("b", 0.025, 3, "first")}
    # The neutral band is filtered before anything is sorted.
    sorted_in = whole._jdf.queryExecution().optimizedPlan().toString().split("min_by")[1]
    assert "Filter" in sorted_in


def test_pairs_known_to_be_unique_are_not_compared_again(spark):
    rows = [("Ex" if i % 5 else "Out", "MKTL", f"MKT{i}", i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "species string, ref_seq string, var_seq string, label int")
    known = balance_and_split(df, per_class=20, hold_out=["Out"], unique=True)
    compared = balance_and_split(df.withColumn("row_no", F.lit(1)), per_class=20, hold_out=["Out"])
    key = ("ref_seq", "var_seq", "label", "split")
    assert sorted(known.select(*key).collect()) == sorted(compared.select(*key).collect())
