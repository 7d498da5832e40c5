import math
import random

import numpy as np
import pytest

from twinframe.functions import vector as v
from twinframe.functions.loss import cross_entropy, focal_loss, smooth_l1
from twinframe.operators import learn
from twinframe.operators import metrics as m
from twinframe.operators.encode import pool_tokens
from twinframe.plans.evaluation import evaluate


def labelled(spark, pairs, group="g"):
    return spark.createDataFrame([(group, t, p) for t, p in pairs], "g string, label int, prediction int")


def test_confusion_and_class_scores(spark):
    df = labelled(spark, [(0, 0), (0, 0), (0, 1), (1, 1), (1, 2), (1, 1)])
    cells = {(r.label, r.prediction): r.n for r in m.confusion_matrix(df).collect()}
    assert len(cells) == 9 and cells[(0, 0)] == 2 and cells[(1, 2)] == 1 and cells[(2, 2)] == 0
    rows = {r["class"]: r for r in m.class_metrics(df).collect()}
    assert (rows[0].precision, rows[0].recall, rows[0].f1) == (1.0, pytest.approx(2 / 3), pytest.approx(0.8))
    assert (rows[2].precision, rows[2].recall, rows[2].f1, rows[2].support) == (0.0, 0.0, 0.0, 0)
    row = m.overall_metrics(df).first()
    assert row.accuracy == pytest.approx(4 / 6)
    assert row.macro_f1 == pytest.approx((0.8 + 2 / 3 + 0) / 3)
    assert row.weighted_f1 == pytest.approx((0.8 * 3 + 2 / 3 * 3) / 6)


def test_macro_f1_leaves_out_absent_classes(spark):
    df = labelled(spark, [(0, 0), (1, 1)])
    assert m.overall_metrics(df).first().macro_f1 == 1.0
    assert m.class_metrics(df).filter("class = 2").first().f1 == 0.0
    report = {r.row: r for r in m.classification_report(df).collect()}
    assert list(report) == ["low", "mid", "high", "accuracy", "macro avg", "weighted avg"]
    assert report["macro avg"].f1 == 1.0 and report["accuracy"].f1 == 1.0 and report["accuracy"].precision is None
    empty = m.overall_metrics(df.limit(0)).first()
    assert tuple(empty) == (0.0, 0.0, 0.0)


def test_auroc_with_ties(spark):
    rng = random.Random(1)
    rows = [("a", rng.randint(0, 2), [round(rng.random(), 1) for _ in range(3)]) for _ in range(200)]
    rows += [("one", 1, [0.2, 0.5, 0.3]), ("two", 0, [0.2, 0.5, 0.3]), ("two", 1, [0.1, 0.6, 0.3])]
    df = spark.createDataFrame(rows, "g string, label int, probabilities array<double>")
    wanted = []
    for k in range(3):
        pos = [p[k] for g, t, p in rows if g == "a" and t == k]
        neg = [p[k] for g, t, p in rows if g == "a" and t != k]
        wanted.append(sum((x > y) + (x == y) / 2 for x in pos for y in neg) / len(pos) / len(neg))
    got = {r.g: r.auroc for r in m.auroc(df, ["g"]).collect()}
    assert got == {"a": pytest.approx(np.mean(wanted)), "one": None, "two": 0.0}
    assert {r.g: r.auroc for r in m.auroc(df, ["g"], undefined=None).collect()}["two"] is None


def plain_ranks(x):
    return [sum(b < a for b in x) + (sum(b == a for b in x) + 1) / 2 for a in x]


def test_regression(spark):
    rng = random.Random(2)
    x = [round(rng.gauss(0, 1), 1) for _ in range(150)]
    y = [round(a + rng.gauss(0, 1), 1) for a in x]
    rows = [("v", a, b) for a, b in zip(x, y)] + [("flat", 1.0, 2.0), ("flat", 1.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, target double, predicted double")
    got = {r.g: r for r in m.regression_metrics(df, ["g"]).collect()}
    assert got["v"].pearson == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert got["v"].spearman == pytest.approx(np.corrcoef(plain_ranks(x), plain_ranks(y))[0, 1])
    assert got["v"].mae == pytest.approx(np.mean(np.abs(np.subtract(x, y))))
    assert (got["flat"].pearson, got["flat"].spearman, got["flat"].mse) == (0.0, 0.0, 2.5)
    whole = evaluate(df.selectExpr("*", "0 AS label", "0 AS prediction"), probabilities=None, target="target", predicted="predicted")
    assert whole.columns == ["accuracy", "macro_f1", "weighted_f1", "pearson", "mae", "mse", "spearman"]


def test_percentile_classes_and_shares(spark):
    values = [float(i * i) for i in range(40)]
    df = spark.createDataFrame([(x,) for x in values], "score double")
    low, high = np.percentile(values, [33, 67])
    for r in m.percentile_classes(df).select("*", v.pseudo_probabilities("score", "cut_low", "cut_high").alias("p")).collect():
        assert (r.cut_low, r.cut_high) == (pytest.approx(low), pytest.approx(high))
        assert r.prediction == (0 if r.score < low else 2 if r.score > high else 1)
        assert sum(r.p) == pytest.approx(1)


def test_concordance(spark):
    df = spark.createDataFrame([("low", "low"), ("low", "mid"), ("mid", "mid")], "a string, b string")
    row = m.concordance(df, "a", "b", ["low", "mid", "high"]).first()
    assert (row.total, row.agree_count, row.disagree_count) == (3, 2, 1)
    assert (row.low_concordance, row.mid_concordance, row.high_concordance, row.error) == (1.0, 0.5, None, None)
    empty = m.concordance(df.limit(0), "a", "b", ["low"]).first()
    assert (empty.total, empty.agreement_rate, empty.error) == (0, 0.0, m.NO_OVERLAP)


def test_losses(spark):
    logits, label = [2.0, -1.0, 0.5], 2
    logp = [x - math.log(sum(map(math.exp, logits))) for x in logits]
    df = spark.createDataFrame([(logits, label, 0.5, 2.5)], "logits array<double>, c int, p double, t double")
    row = df.select(
        cross_entropy("logits", "c"), cross_entropy("logits", "c", 0.1), cross_entropy("logits", "c", 0.1, [1, 2, 3]),
        focal_loss("logits", "c"), smooth_l1("p", "t"), smooth_l1("p", "0.1D")).first()
    smooth = -0.9 * logp[2] - 0.1 / 3 * sum(logp)
    weighted = -0.9 * 3 * logp[2] - 0.1 / 3 * sum(w * x for w, x in zip((1, 2, 3), logp))
    focal = (1 - math.exp(logp[2])) ** 2 * -logp[2]
    assert list(row) == pytest.approx([-logp[2], smooth, weighted, focal, 1.5, 0.08])


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 0.0, 1.0])], "r array<double>, v array<double>")
    row = df.select(v.pair_vector("r", "v"), v.flat_features("r", "v", mode="mean_only"), v.softmax("r"),
                    v.argmax("v"), v.layer_norm("r"), v.flat_features("r", "v", "array(9)")).first()
    assert row[0] == [-3, 2, 2, 4, 0, 3, 1, 2, 3, 4, 0, 1] and row[1] == [1, 2, 3, 4, 0, 1] and row[3] == 0
    assert row[2] == pytest.approx(list(np.exp([1, 2, 3]) / np.exp([1, 2, 3]).sum()))
    assert row[4] == pytest.approx([-1.224735, 0, 1.224735], abs=1e-5) and row[5][-1] == 9.0
    with pytest.raises(ValueError, match="Unknown mode"):
        v.flat_features("r", "v", mode="odd")
    tie = spark.createDataFrame([([1.0, 1.0],)], "r array<double>").select(v.argmax("r"), v.clamp("99D"), v.clamp("-99D"))
    assert tuple(tie.first()) == (0, 10.0, -10.0)
    pairs = spark.createDataFrame([("MKTL", "MK"), ("MK", "MKT"), ("MK", "MK"), ("MK", "MA")], "r string, v string")
    assert [r[0] for r in pairs.select(v.length_change_score("r", "v", "7")).collect()] == [-2.5, 0.0, 0.0, 7.0]


def test_pooling_with_mask(spark):
    rows = [("a", [1.0, -2.0], True), ("a", [3.0, -4.0], True), ("a", [9.0, 9.0], False), ("b", [5.0, 5.0], False)]
    df = spark.createDataFrame(rows, "k string, vector array<double>, shown boolean")
    got = {r.k: (r.mean, r.max) for r in pool_tokens(df, ["k"], mask="shown").collect()}
    assert got == {"a": ([2.0, -3.0], [3.0, -2.0]), "b": ([0.0, 0.0], [0.0, 0.0])}


def test_scaling_and_learning(spark):
    rng = random.Random(4)
    rows = [(i, i % 3, [rng.gauss(i % 3 * 4, 1), rng.gauss(0, 1), 7.0]) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, label int, features array<double>")
    stats = learn.column_statistics(df)
    matrix = np.array([r[2] for r in rows])
    assert stats.first().sd == pytest.approx(list(matrix.std(axis=0)), abs=1e-9)
    scaled = learn.standardize(df, stats).filter("id = 0").first().scaled
    assert scaled == pytest.approx([*((matrix[0] - matrix.mean(0)) / [*matrix.std(0)[:2], 1])])
    train, test = df.filter("id < 100"), df.filter("id >= 100")
    for called in (
        learn.logistic_regression(train, test, max_iter=50), learn.random_forest(train, test, trees=10, max_depth=5),
        learn.perceptron(train, test, inputs=3, hidden=(8,), max_iter=60),
    ):
        got = called.collect()
        assert len(got) == 50 and np.mean([r.label == r.prediction for r in got]) > 0.8
        assert all(sum(r.probabilities) == pytest.approx(1) for r in got)


def test_a_large_forest_is_trained_in_parts(spark):
    assert learn._forest_sizes(500, 8_000, learn.ROW_TREES) == [500]
    assert learn._forest_sizes(500, 41_000, learn.ROW_TREES) == [84, 84, 83, 83, 83, 83]
    assert learn._forest_sizes(3, 10**9, learn.ROW_TREES) == [1, 1, 1] and learn._forest_sizes(2, 0, 1) == [1, 1]
    rng = random.Random(5)
    rows = [(i, i % 3, [rng.gauss(i % 3 * 4, 1), rng.gauss(0, 1), 7.0]) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, label int, features array<double>")
    train, test = df.filter("id < 100"), df.filter("id >= 100")
    got = learn.random_forest(train, test, trees=7, max_depth=4, row_trees=300).collect()
    assert len(got) == 50 and np.mean([r.label == r.prediction for r in got]) > 0.8
    for r in got:
        assert sum(r.probabilities) == pytest.approx(1) and r.prediction == int(np.argmax(r.probabilities))
