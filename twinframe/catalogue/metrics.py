"""Queries on evaluation: confusion, F1, AUROC, correlations, percentiles, losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.loss import smooth_l1
from ..functions.vector import argmax, pseudo_probabilities, softmax
from ..operators import metrics as m
from ..operators.spread import average_ranks, exact_percentiles
from ..plans.evaluation import evaluate
from .register import query, rounded
from .views import SCORED_VECTORS, scored_vectors, table


def evaluated(spark, sf):
    """Vectors with probabilities and the predicted class."""
    rows = scored_vectors(spark, sf).withColumn("probabilities", softmax("logits"))
    return rows.withColumn("prediction", argmax("probabilities"))


def all_rounded(df, keys):
    return df.select(*(c if c in keys else rounded(c).alias(c) for c in df.columns))


@query("confusion_matrix", f"""
SELECT method, CAST(t.c AS INT) AS label, CAST(p.c AS INT) AS prediction, count(v.vec_id) AS n
FROM (SELECT DISTINCT method FROM {SCORED_VECTORS}) CROSS JOIN (VALUES (0), (1), (2)) t(c)
CROSS JOIN (VALUES (0), (1), (2)) p(c)
LEFT JOIN {SCORED_VECTORS} v USING (method) WHERE v.label = t.c AND v.prediction = p.c GROUP BY ALL
UNION ALL
SELECT g.method, CAST(t.c AS INT), CAST(p.c AS INT), 0 FROM (SELECT DISTINCT method FROM {SCORED_VECTORS}) g
CROSS JOIN (VALUES (0), (1), (2)) t(c) CROSS JOIN (VALUES (0), (1), (2)) p(c)
WHERE NOT EXISTS (SELECT 1 FROM {SCORED_VECTORS} v WHERE v.method = g.method AND v.label = t.c AND v.prediction = p.c)""")
def confusion_matrix(spark, sf):
    return m.confusion_matrix(evaluated(spark, sf), ["method"])


def class_sql(by: str, rows: str = SCORED_VECTORS, classes: str = "(0), (1), (2)") -> str:
    return f"""(
  SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE hits / CAST(predicted AS DOUBLE) END AS precision,
         CASE WHEN support = 0 THEN 0.0 ELSE hits / CAST(support AS DOUBLE) END AS recall,
         CASE WHEN predicted + support = 0 THEN 0.0 ELSE 2 * hits / CAST(predicted + support AS DOUBLE) END AS f1
  FROM (SELECT {by}, k.c AS class, count_if(label = k.c AND prediction = k.c) AS hits,
               count_if(prediction = k.c) AS predicted, count_if(label = k.c) AS support,
               avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n
        FROM {rows} CROSS JOIN (VALUES {classes}) k(c) GROUP BY {by}, k.c))"""


@query("class_metrics", f"""
SELECT method, CAST(class AS INT) AS class, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall,
       round(f1, 6) + 0.0 AS f1, CAST(support AS BIGINT) AS support FROM {class_sql('method')}""")
def class_metrics(spark, sf):
    return all_rounded(m.class_metrics(evaluated(spark, sf), ["method"]), ["method", "class", "support"])


def overall_sql(by: str, rows: str = SCORED_VECTORS, classes: str = "(0), (1), (2)") -> str:
    return f"""
SELECT {by}, round(max(accuracy), 6) + 0.0 AS accuracy, round(avg(f1), 6) + 0.0 AS macro_f1,
       round(sum(f1 * support) / sum(support), 6) + 0.0 AS weighted_f1
FROM {class_sql(by, rows, classes)} WHERE predicted + support > 0 GROUP BY {by}"""


@query("overall_metrics", overall_sql("method"))
def overall_metrics(spark, sf):
    return all_rounded(m.overall_metrics(evaluated(spark, sf), ["method"]), ["method"])


# A large table to evaluate: line numbers against quantity bands, per supplier.
LINES = """(SELECT l_suppkey, CAST(l_linenumber - 1 AS INT) AS label,
    CAST(floor(l_quantity / 8) AS INT) AS prediction FROM lineitem)"""
LINE_CLASSES = "(0), (1), (2), (3), (4), (5), (6)"


@query("supplier_metrics", overall_sql("l_suppkey", LINES, LINE_CLASSES))
def supplier_metrics(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_suppkey", (F.col("l_linenumber") - 1).alias("label"),
        F.floor(F.col("l_quantity") / 8).cast("int").alias("prediction"))
    return all_rounded(m.overall_metrics(lines, ["l_suppkey"], classes=range(7)), ["l_suppkey"])


@query("classification_report", f"""
WITH c AS (SELECT * FROM {class_sql("'all'")} ORDER BY class),
p AS (SELECT * FROM c WHERE predicted + support > 0)
SELECT ['low', 'mid', 'high'][class + 1] AS row, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall,
       round(f1, 6) + 0.0 AS f1, CAST(support AS BIGINT) AS support FROM c
UNION ALL SELECT 'accuracy', NULL, NULL, round(max(accuracy), 6) + 0.0, CAST(max(n) AS BIGINT) FROM c
UNION ALL SELECT 'macro avg', round(avg(precision), 6) + 0.0, round(avg(recall), 6) + 0.0, round(avg(f1), 6) + 0.0,
  CAST(max(n) AS BIGINT) FROM p
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6) + 0.0,
  round(sum(recall * support) / sum(support), 6) + 0.0, round(sum(f1 * support) / sum(support), 6) + 0.0,
  CAST(max(n) AS BIGINT) FROM p""")
def classification_report(spark, sf):
    report = m.classification_report(evaluated(spark, sf))
    return all_rounded(report, ["row", "support"])


def auroc_sql(by: str, rows: str) -> str:
    """Areas from average ranks over all rows of a class."""
    return f"""(
  SELECT {by}, c, (sum(CASE WHEN pos THEN rk END) - count_if(pos) * (count_if(pos) + 1) / 2.0)
         / (CAST(count_if(pos) AS DOUBLE) * count_if(NOT pos)) AS auroc
  FROM (SELECT {by}, c, pos, rank() OVER (PARTITION BY {by}, c ORDER BY p)
               + (count(*) OVER (PARTITION BY {by}, c, p) - 1) / 2.0 AS rk
        FROM (SELECT {by}, k.c, label = k.c AS pos, probabilities[k.c + 1] AS p
              FROM {rows} CROSS JOIN (VALUES (0), (1), (2)) k(c))) GROUP BY {by}, c)"""


@query("auroc", f"""
SELECT method, round(avg(auroc), 6) + 0.0 AS auroc FROM {auroc_sql('method', SCORED_VECTORS)} GROUP BY method
HAVING count(auroc) = 3
UNION ALL SELECT method, CASE WHEN count(DISTINCT label) = 1 THEN NULL ELSE 0.0 END FROM {SCORED_VECTORS}
GROUP BY method HAVING count(DISTINCT label) < 3""")
def auroc(spark, sf):
    return all_rounded(m.auroc(evaluated(spark, sf), ["method"]), ["method"])


# Prices as a score for three line groups.
PRICED = """(SELECT l_returnflag, CAST(l_linenumber % 3 AS INT) AS label,
    [l_extendedprice, l_quantity, l_discount] AS probabilities FROM lineitem)"""


@query("price_auroc", f"""
SELECT l_returnflag, CAST(c AS INT) AS class, round(auroc, 6) + 0.0 AS auroc FROM {auroc_sql('l_returnflag', PRICED)}""")
def price_auroc(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_returnflag", (F.col("l_linenumber") % 3).alias("label"),
        F.array("l_extendedprice", "l_quantity", "l_discount").alias("probabilities"))
    return m.class_auroc(rows, ["l_returnflag"]).select("l_returnflag", "class", rounded("auroc").alias("auroc"))


def ranked_sql(value: str, by: str) -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0)"


@query("price_correlations", f"""
SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) + 0.0 AS pearson,
       round(avg(abs(l_quantity - l_extendedprice)), 4) + 0.0 AS mae,
       round(avg(pow(l_quantity - l_extendedprice, 2)) / 1000000, 4) + 0.0 AS mse,
       round(corr(rx, ry), 6) + 0.0 AS spearman
FROM (SELECT *, {ranked_sql('l_quantity', 'l_returnflag')} AS rx,
             {ranked_sql('l_extendedprice', 'l_returnflag')} AS ry FROM lineitem) GROUP BY l_returnflag""")
def price_correlations(spark, sf):
    report = m.regression_metrics(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return report.select(
        "l_returnflag", rounded("pearson").alias("pearson"), rounded("mae", 4).alias("mae"),
        rounded(F.col("mse") / 1000000, 4).alias("mse"), rounded("spearman").alias("spearman"))


@query("average_ranks", f"""
SELECT DISTINCT l_returnflag, l_extendedprice, count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) AS n,
       {ranked_sql('l_extendedprice', 'l_returnflag')} AS rank FROM lineitem""")
def ranks(spark, sf):
    return average_ranks(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query("global_ranks", """
SELECT DISTINCT value, count(*) OVER (PARTITION BY value) AS n,
       rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rank FROM events""")
def global_ranks(spark, sf):
    return average_ranks(table(spark, sf, "events"), [], "value")


@query("price_percentiles", """
SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.33), 6) + 0.0 AS low,
       round(quantile_cont(l_extendedprice, 0.67), 6) + 0.0 AS high FROM lineitem GROUP BY l_suppkey""")
def price_percentiles(spark, sf):
    cuts = exact_percentiles(table(spark, sf, "lineitem"), "l_extendedprice", [0.33, 0.67], ["l_suppkey"])
    return cuts.select("l_suppkey", rounded(F.get("percentiles", 0)).alias("low"),
                       rounded(F.get("percentiles", 1)).alias("high"))


PRICE_CUTS = """(SELECT *, (SELECT quantile_cont(o_totalprice, 0.33) FROM orders) AS lo,
    (SELECT quantile_cont(o_totalprice, 0.67) FROM orders) AS hi FROM orders)"""


@query("percentile_classes", f"""
SELECT o_orderkey, round(lo, 6) + 0.0 AS cut_low, round(hi, 6) + 0.0 AS cut_high,
       CAST(CASE WHEN o_totalprice < lo THEN 0 WHEN o_totalprice > hi THEN 2 ELSE 1 END AS INT) AS prediction
FROM {PRICE_CUTS}""")
def percentile_classes(spark, sf):
    rows = m.percentile_classes(table(spark, sf, "orders"), "o_totalprice")
    return rows.select("o_orderkey", rounded("cut_low").alias("cut_low"), rounded("cut_high").alias("cut_high"),
                       "prediction")


@query("pseudo_probabilities", """
WITH c AS (SELECT value, event_id, (SELECT quantile_cont(value, 0.33) FROM events) AS lo,
                  (SELECT quantile_cont(value, 0.67) FROM events) AS hi FROM events),
r AS (SELECT event_id, 1 / (1 + exp(value - lo)) AS a, exp(-pow(value - (lo + hi) / 2, 2) / 2) AS b,
             1 / (1 + exp(-(value - hi))) AS d FROM c)
SELECT event_id, round(a / (a + b + d), 6) + 0.0 AS low, round(b / (a + b + d), 6) + 0.0 AS mid,
       round(d / (a + b + d), 6) + 0.0 AS high FROM r""")
def pseudo(spark, sf):
    cut = m.percentile_classes(table(spark, sf, "events"), "value")
    shares = cut.select("event_id", pseudo_probabilities("value", "cut_low", "cut_high").alias("p"))
    return shares.select("event_id", *(
        rounded(F.get("p", i)).alias(name) for i, name in enumerate(("low", "mid", "high"))))


LOGP = """(SELECT *, list_transform(logits, lambda x: x - list_max(logits)
    - ln(list_sum(list_transform(logits, lambda y: exp(y - list_max(logits)))))) AS logp FROM {rows})"""


@query("mean_losses", f"""
SELECT method, round(avg(ce), 6) + 0.0 AS cross_entropy, round(avg(pow(1 - exp(-ce), 2) * ce), 6) + 0.0 AS focal,
       round(avg(l1), 6) + 0.0 AS smooth_l1, round(avg(ce) + 0.1 * avg(l1), 6) + 0.0 AS combined
FROM (SELECT method, -logp[label + 1] * CAST(0.95 AS DOUBLE) - list_sum(logp) * CAST(0.05 AS DOUBLE) / 3 AS ce,
             CASE WHEN abs(predicted - target) < 1 THEN pow(predicted - target, 2) / 2
                  ELSE abs(predicted - target) - 0.5 END AS l1
      FROM {LOGP.format(rows=SCORED_VECTORS)}) GROUP BY method""")
def mean_losses(spark, sf):
    losses = m.mean_losses(scored_vectors(spark, sf), ["method"], predicted="predicted", target="target",
                           smoothing=0.05)
    return all_rounded(losses, ["method"])


@query("smooth_l1", """
SELECT l_suppkey, round(avg(CASE WHEN abs(l_quantity / 10 - l_linenumber) < 1
    THEN pow(l_quantity / 10 - l_linenumber, 2) / 2 ELSE abs(l_quantity / 10 - l_linenumber) - 0.5 END), 6) + 0.0 AS loss
FROM lineitem GROUP BY l_suppkey""")
def smooth_l1_per_supplier(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        rounded(F.avg(smooth_l1("l_quantity / 10", "l_linenumber"))).alias("loss"))


VECTOR_RANKS = f"""(SELECT *, {ranked_sql('target', 'method')} AS rx, {ranked_sql('predicted', 'method')} AS ry
    FROM {SCORED_VECTORS})"""


@query("method_table", f"""
SELECT o.method, accuracy, macro_f1, weighted_f1, a.auroc, spearman FROM ({overall_sql('method')}) o
LEFT JOIN (SELECT method, CASE WHEN count(auroc) = 3 THEN round(avg(auroc), 6) + 0.0 END AS auroc
           FROM {auroc_sql('method', SCORED_VECTORS)} GROUP BY method) a USING (method)
LEFT JOIN (SELECT method, round(corr(rx, ry), 6) + 0.0 AS spearman FROM {VECTOR_RANKS} GROUP BY method) s USING (method)""")
def method_table(spark, sf):
    rows = m.method_table(evaluated(spark, sf), target="target", predicted="predicted")
    return all_rounded(rows, ["method"])


@query("evaluation", f"""
SELECT o.accuracy, o.macro_f1, o.weighted_f1, a.auroc, s.pearson, s.mae, s.mse, s.spearman
FROM ({overall_sql("'all'")}) o,
     (SELECT round(avg(auroc), 6) + 0.0 AS auroc FROM {auroc_sql("'all'", SCORED_VECTORS)}) a,
     (SELECT round(corr(target, predicted), 6) + 0.0 AS pearson, round(avg(abs(target - predicted)), 6) + 0.0 AS mae,
             round(avg(pow(target - predicted, 2)), 6) + 0.0 AS mse, round(corr(rx, ry), 6) + 0.0 AS spearman
      FROM (SELECT *, {ranked_sql('target', "'all'")} AS rx, {ranked_sql('predicted', "'all'")} AS ry
            FROM {SCORED_VECTORS})) s""")
def evaluation(spark, sf):
    return all_rounded(evaluate(evaluated(spark, sf), target="target", predicted="predicted"), [])
