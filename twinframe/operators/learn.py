"""Standardised features and the three baseline classifiers, on MLlib but for forests of many rows and trees.

Training reads its rows many times, so hand over tables that are cheap to read,
such as those written by `materialize`.
"""

from __future__ import annotations

from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import doubles_sql
from ..session import materialize
from . import forest

# MLlib trains at most so many rows times trees at once.
ROW_TREES = 4_000_000
# Rows of at most so many components in all are held by the task of a tree, a byte each.
TREE_BYTES = 100_000_000


def column_statistics(df: DataFrame, vector: str = "features") -> DataFrame:
    """Mean and population deviation of each component, as one row of two arrays."""
    summary = Summarizer.metrics("mean", "variance").summary(array_to_vector(F.expr(doubles_sql(vector))))
    row = df.agg(summary.alias("_s"), F.count(F.lit(1)).alias("_n")).select(
        "_n", vector_to_array("_s.mean").alias("mean"), vector_to_array("_s.variance").alias("_v"))
    # The summary gives the sample variance.
    population = F.transform("_v", lambda v: F.sqrt(v * (F.col("_n") - 1) / F.col("_n")))
    return row.select("mean", population.alias("sd"))


def standardize(
    df: DataFrame, statistics: DataFrame, vector: str = "features", out: str = "scaled",
    epsilon: float | None = None,
) -> DataFrame:
    """Scale each component with given statistics, those of the training rows for all splits.

    A constant component is only centred; with `epsilon` that is added to every
    deviation instead.
    """
    row = statistics.select(F.struct("mean", "sd").alias("s")).scalar()

    divisor = "if(sd = 0, 1D, sd)" if epsilon is None else f"(sd + {epsilon!r}D)"
    centred = f"zip_with({doubles_sql(vector)}, _stats.mean, (x, m) -> x - m)"
    scaled = F.expr(f"zip_with({centred}, _stats.sd, (x, sd) -> x / {divisor})")
    return df.withColumn("_stats", row).withColumn(out, scaled).drop("_stats")


def _prepared(df: DataFrame, label: str) -> DataFrame:
    return df.withColumns({
        "_features": array_to_vector("scaled"), "_label": F.col(label).cast("double")})


def _fit(estimator, train: DataFrame, vector, label, epsilon):
    """The fitted model, and the training rows' statistics."""
    statistics = materialize(column_statistics(train, vector), "column-statistics")
    return estimator.setFeaturesCol("_features").setLabelCol("_label").fit(
        _prepared(standardize(train, statistics, vector, epsilon=epsilon), label)), statistics


def _fit_and_predict(estimator, train: DataFrame, test: DataFrame, vector, label, epsilon) -> DataFrame:
    fitted, statistics = _fit(estimator, train, vector, label, epsilon)
    scored = fitted.transform(_prepared(standardize(test, statistics, vector, epsilon=epsilon), label))
    return scored.select(
        *test.columns, F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability").alias("probabilities"))


def _logistic(n: int, c: float, max_iter: int) -> LogisticRegression:
    return LogisticRegression(
        family="multinomial", maxIter=max_iter, regParam=1.0 / (c * max(n, 1)), standardization=False)


def logistic_regression(
    train: DataFrame, test: DataFrame, vector: str = "features", label: str = "label",
    c: float = 1.0, max_iter: int = 3000,
) -> DataFrame:
    """Multinomial logistic regression; adds `prediction` and `probabilities` to `test`.

    `c` weighs the summed loss against the penalty; MLlib takes the penalty per row.
    """
    return _fit_and_predict(_logistic(train.count(), c, max_iter), train, test, vector, label, None)


def logistic_certificate(
    train: DataFrame, vector: str = "features", label: str = "label", c: float = 1.0, max_iter: int = 3000,
) -> DataFrame:
    """`(class, component, coefficient, gradient)` of the fitted regression; component 0 is the intercept.

    gradient is that of the mean log loss plus the penalty at the coefficients,
    summed over the training rows apart from the fit. The loss is strictly convex
    but for a constant added to all intercepts, so gradients of zero prove that no
    other coefficients do better.
    """
    n = train.count()
    fitted, statistics = _fit(_logistic(n, c, max_iter), train, vector, label, None)
    scored = fitted.transform(_prepared(standardize(train, statistics, vector), label))
    weights, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    classes, inputs = weights.shape
    # Probability less the true class, times each input and one, for all classes in one vector.
    rests = F.transform(vector_to_array("probability"), lambda p, k: p - (k == F.col("_label")).cast("double"))
    inputs_and_one = F.concat(F.array(F.lit(1.0)), F.col("scaled"))
    products = F.flatten(F.transform(rests, lambda r: F.transform(inputs_and_one, lambda x: r * x)))
    mean = Summarizer.metrics("mean").summary(array_to_vector(products))
    sums = scored.agg(vector_to_array(mean["mean"]).alias("_g")).select(F.posexplode("_g").alias("_at", "_mean"))
    known = train.sparkSession.createDataFrame(
        [(k * (inputs + 1) + j, k, j, float(intercepts[k] if j == 0 else weights[k, j - 1]))
         for k in range(classes) for j in range(inputs + 1)], "_at int, class int, component int, coefficient double")
    penalty = F.when(F.col("component") > 0, F.col("coefficient") / (c * max(n, 1))).otherwise(0.0)
    return sums.join(known, "_at").select(
        "class", "component", "coefficient", (F.col("_mean") + penalty).alias("gradient"))


def _forest_sizes(trees: int, rows: int, row_trees: int) -> list[int]:
    """`trees` in as few parts of about the same size as keep rows times trees of a part within `row_trees`."""
    parts = -(-trees // max(1, min(trees, row_trees // max(rows, 1))))
    return [trees // parts + (i < trees % parts) for i in range(parts)]


def _forest_in_parts(
    train, test, statistics, n: int, vector, label, trees, min_leaf, max_depth, seed, row_trees,
) -> DataFrame:
    """The test rows with `_votes` of MLlib's trees, trained in parts."""
    rows = materialize(_prepared(standardize(train, statistics, vector), label).select("_features", "_label"), "forest-rows")
    scored = _prepared(standardize(test, statistics, vector), label).select(*test.columns, "_features")
    for i, size in enumerate(_forest_sizes(trees, n, row_trees)):
        # Kept node ids spare walking down every deep tree again on each level. The subset is the usual
        # one, which MLlib would not take for a part of one tree.
        fitted = RandomForestClassifier(
            numTrees=size, minInstancesPerNode=min_leaf, maxDepth=max_depth, seed=seed + i, cacheNodeIds=True,
            featureSubsetStrategy="sqrt", featuresCol="_features", labelCol="_label").fit(rows)
        own = vector_to_array("rawPrediction")
        votes = own if i == 0 else F.zip_with("_votes", own, lambda a, b: a + b)
        scored = materialize(fitted.transform(scored).select(*test.columns, "_features", votes.alias("_votes")), "votes")
    return scored


def random_forest(
    train: DataFrame, test: DataFrame, vector: str = "features", label: str = "label",
    trees: int = 500, min_leaf: int = 5, max_depth: int = 30, seed: int = 42, row_trees: int = ROW_TREES,
) -> DataFrame:
    """Random forest. MLlib limits the depth of a tree to 30.

    MLlib holds a number per row and tree while it trains, and passes over all rows
    once for every few ten thousand nodes of all trees; both grow with rows times trees.
    So where these exceed `row_trees`, trees are grown side by side, each by one task
    (`forest`), by the same rules but other random numbers. Rows of more than
    TREE_BYTES components are too many for a task: there MLlib trains the forest in parts
    of at most `row_trees`, of which only one is held at a time, and the votes of
    its trees are added to those stored with the test rows. Part i has the seed
    `seed + i`.
    """
    statistics = materialize(column_statistics(train, vector), "column-statistics")
    n, width = train.count(), len(statistics.first().mean or [])
    if n * trees <= row_trees or not 0 < n * width <= TREE_BYTES:
        scored = _forest_in_parts(train, test, statistics, n, vector, label, trees, min_leaf, max_depth, seed, row_trees)
    else:
        rows = materialize(standardize(train, statistics, vector).select("scaled", label), "forest-input")
        cuts, classes = forest.cut_points(rows, "scaled", width), forest.class_count(rows, label)
        folder = forest.train(rows, "scaled", label, cuts, classes, trees, min_leaf, max_depth, seed)
        asked = standardize(test, statistics, vector).select(*test.columns, F.col("scaled").alias("_scaled"))
        scored = materialize(forest.votes(asked, "_scaled", folder, cuts, classes, "_votes"), "votes")
    total = F.aggregate("_votes", F.lit(0.0), lambda a, b: a + b)
    return scored.select(
        *test.columns, (F.array_position("_votes", F.array_max("_votes")) - 1).cast("int").alias("prediction"),
        F.transform("_votes", lambda x: x / total).alias("probabilities"))


def perceptron(
    train: DataFrame, test: DataFrame, inputs: int, vector: str = "features", label: str = "label",
    hidden: tuple[int, ...] = (512, 128), classes: int = 3, max_iter: int = 50, seed: int = 42,
) -> DataFrame:
    """Feed-forward network with the given hidden layers; `inputs` is the vector size."""
    estimator = MultilayerPerceptronClassifier(
        layers=[inputs, *hidden, classes], maxIter=max_iter, seed=seed)
    return _fit_and_predict(estimator, train, test, vector, label, 1e-8)
