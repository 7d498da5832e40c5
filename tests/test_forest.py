import random

import numpy as np
import pytest

from twinframe.operators import forest, learn


def gini_gain(labels, weight, left, classes):
    def part(rows):
        counts = np.bincount(labels[rows], weight[rows], classes)
        return (counts ** 2).sum() / counts.sum()
    return part(left) + part(~left) - part(np.ones(len(labels), bool))


def test_a_tree_takes_the_best_splits_of_all_rows():
    rng = np.random.default_rng(3)
    bins = rng.integers(0, forest.BINS, (600, 1), dtype=np.uint8)
    labels = ((bins[:, 0] > 11) + (rng.random(600) < 0.2)) % 3
    drawn = np.random.default_rng(8).poisson(1.0, 600).astype(float)
    feature, cut, left, votes = forest.grow(bins, labels, 3, np.random.default_rng(8), 5, 6)
    held, leaves = {0: drawn > 0}, 0
    for node in range(len(left)):
        rows = held[node]
        own = np.bincount(labels[rows], drawn[rows], 3)
        assert votes[node] == pytest.approx(own / own.sum())
        gains = {c: gini_gain(labels[rows], drawn[rows], bins[rows, 0] <= c, 3) for c in range(forest.BINS)
                 if min(drawn[rows & (bins[:, 0] <= c)].sum(), drawn[rows & (bins[:, 0] > c)].sum()) >= 5}
        if left[node] < 0:
            leaves += 1
            continue
        assert gains[cut[node]] == pytest.approx(max(gains.values())) and gains[cut[node]] > 0
        held[left[node]] = rows & (bins[:, 0] <= cut[node])
        held[left[node] + 1] = rows & (bins[:, 0] > cut[node])
    assert len(held) == len(left) and leaves > 3
    # Nodes in parts of few cells, and called rows, agree with that.
    cells, forest.CELLS = forest.CELLS, 1
    again = forest.grow(bins, labels, 3, np.random.default_rng(8), 5, 6)
    forest.CELLS = cells
    assert all((a == b).all() for a, b in zip(again, (feature, cut, left, votes)))
    tree = dict(zip(("feature", "cut", "left", "votes"), (x.tobytes() for x in again)))
    called = forest._tree_votes(bins, tree, 3)
    assert all((called[rows] == votes[node]).all() for node, rows in held.items() if left[node] < 0)


def test_components_are_cut_by_quantiles_or_by_all_their_values(spark):
    rows = [([i / 1000, 5.0, float(i > 0), float(i % 7)],) for i in range(1000)]
    cuts = forest.cut_points(spark.createDataFrame(rows, "x array<double>"), "x", 4)
    assert [len(c) for c in cuts] == [31, 0, 1, 6] and list(cuts[2]) == [0.0]
    assert np.diff([0.0, *cuts[0], 1.0]) == pytest.approx([1 / 32] * 32, abs=2e-3)


def test_a_large_forest_needs_no_job_per_level_or_part(spark):
    rng = random.Random(5)
    rows = [(i, i % 3, [rng.gauss(i % 3, 1), rng.gauss(0, 1), 7.0, float(i % 2)]) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, label int, features array<double>")
    train, test = df.filter("id < 300"), df.filter("id >= 300")

    def jobs(trees, name, depth):
        spark.sparkContext.setJobGroup(name, name)
        called = learn.random_forest(train, test, trees=trees, max_depth=depth, row_trees=600).collect()
        spark.sparkContext.setJobGroup("after", "after")
        return called, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    few, n = jobs(6, "few", 2)
    many, m = jobs(60, "many", 20)
    assert m == n
    assert len(few) == len(many) == 100 and {r.id for r in many} == set(range(300, 400))
    assert np.mean([r.label == r.prediction for r in many]) > 0.5
    assert all(sum(r.probabilities) == pytest.approx(1) and r.prediction == int(np.argmax(r.probabilities)) for r in many)
    again, _ = jobs(60, "again", 20)
    assert sorted(map(str, again)) == sorted(map(str, many))
    # More rows than the task of a tree holds are trained by MLlib, as small forests are.
    odd = train.selectExpr("id", "label + 0.5 as label", "features")
    with pytest.raises(ValueError, match="300 labels"):
        learn.random_forest(odd, test, trees=60, row_trees=600)


def test_rows_of_more_than_a_task_holds_are_trained_in_parts(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, i % 3, [rng.gauss(i % 3 * 4, 1), rng.gauss(0, 1)]) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, label int, features array<double>")
    monkeypatch.setattr(learn, "TREE_BYTES", 10)
    monkeypatch.setattr(forest, "train", None)
    got = learn.random_forest(df.filter("id < 100"), df.filter("id >= 100"), trees=7, max_depth=4, row_trees=300).collect()
    assert len(got) == 50 and np.mean([r.label == r.prediction for r in got]) > 0.8
