"""Queries on vectors: encode once, pooling, pair vectors, scaling, learning."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as v
from ..functions.sequence import content_key
from ..operators import encode as e
from ..operators import learn
from ..operators.curate import stratified_split
from ..operators.features import FEATURES
from ..operators.store import VectorStore
from ..session import materialize, shared_folder
from ..sources.sinks import write_splits
from .curation import split_sql
from .pairs import features_sql
from .register import query, rounded
from .views import PAIRS, TURNS, pair_view, table, turn_pairs

DIMS = 64
BOTH = f"(SELECT conv_id, turn, unnest([ref_seq, var_seq]) AS text FROM {TURNS})"


@query("distinct_texts", f"""
SELECT sha256(text) AS seq_key, CAST(len(text) AS INT) AS size, count(*) AS uses
FROM (SELECT replace(text, '*', '') AS text FROM {BOTH}) GROUP BY text""")
def distinct_texts(spark, sf):
    texts = e.distinct_texts(turn_pairs(spark, sf), max_length=None)
    return texts.select("seq_key", F.length("text").alias("size"), "uses")


@query("dedup_report", f"""
SELECT role, count(*) // 2 AS n_rows, count(*) AS n_texts, count(DISTINCT text) AS n_distinct,
       round((1 - count(DISTINCT text) / CAST(count(*) AS DOUBLE)) * 100, 6) + 0.0 AS reduction_pct
FROM (SELECT role, replace(unnest([ref_seq, var_seq]), '*', '') AS text FROM {TURNS}) GROUP BY role""")
def dedup_report(spark, sf):
    report = e.dedup_report(turn_pairs(spark, sf), ["role"], max_length=None)
    return report.withColumn("reduction_pct", rounded("reduction_pct"))


@query("missing_texts", f"""
SELECT DISTINCT sha256(text) AS seq_key FROM {BOTH}
WHERE text NOT IN (SELECT text FROM conversations WHERE role = 'user')""")
def missing_texts(spark, sf):
    known = table(spark, sf, "conversations").filter(F.col("role") == "user").select(
        content_key("text", 64).alias("seq_key"))
    texts = e.distinct_texts(turn_pairs(spark, sf), max_length=None)
    return e.missing_texts(texts, known).select("seq_key")


@query("vector_coverage", f"""
SELECT count(*) AS n_needed, CAST(count_if(NOT known) AS BIGINT) AS n_missing, count_if(NOT known) = 0 AS complete
FROM (SELECT DISTINCT text, text IN (SELECT text FROM conversations WHERE role = 'user') AS known FROM {BOTH})""")
def vector_coverage(spark, sf):
    known = table(spark, sf, "conversations").filter(F.col("role") == "user").select(
        content_key("text", 64).alias("seq_key")).distinct()
    return e.coverage(e.distinct_texts(turn_pairs(spark, sf), max_length=None), known)


def encoded_sql(side: str, rows: str = TURNS, keys: str = "conv_id, turn") -> str:
    """Mean and maximum over the characters of one side, as the trial encoder gives them."""
    return f"""(
  SELECT {keys}, d,
         CAST(CAST(sum((c * (2 * d + 1)) % 97) / 97.0 / count(*) AS FLOAT) AS DOUBLE) AS mean,
         CAST(CAST(max((c * (2 * d + 1)) % 97) / 97.0 AS FLOAT) AS DOUBLE) AS max
  FROM (SELECT {keys}, unicode(unnest(string_split(replace({side}, '*', ''), ''))) AS c FROM {rows}), range(0, 8) t(d)
  GROUP BY {keys}, d)"""


@query("encoded_pairs", f"""
SELECT r.conv_id, r.turn, CAST(r.d AS INT) AS d, round(r.mean, 6) + 0.0 AS ref_mean, round(r.max, 6) + 0.0 AS ref_max,
       round(v.mean, 6) + 0.0 AS var_mean, round(v.max, 6) + 0.0 AS var_max
FROM {encoded_sql('ref_seq')} r JOIN {encoded_sql('var_seq')} v USING (conv_id, turn, d)""")
def encoded_pairs(spark, sf):
    pairs = turn_pairs(spark, sf)
    texts = materialize(e.distinct_texts(pairs, max_length=None), "texts")
    vectors = materialize(e.encode_texts(e.by_length(texts)), "vectors")
    done = e.scatter_vectors(pairs, vectors, texts, max_length=None)
    zipped = F.posexplode(F.arrays_zip("ref_mean", "ref_max", "var_mean", "var_max")).alias("d", "z")
    return done.select("conv_id", "turn", zipped).select("conv_id", "turn", "d", *(
        rounded(F.col("z")[n]).alias(n) for n in ("ref_mean", "ref_max", "var_mean", "var_max")))


COST, STEP = 40_000, 64


@query("length_batches", f"""
WITH s AS (
  SELECT doc_id, CAST(length(text) AS INT) AS size, greatest(1, (length(text) + {STEP - 1}) // {STEP}) * {STEP} AS wide
  FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY wide ORDER BY doc_id) - 1 AS n, greatest(1, {COST} // wide) AS rows FROM s),
c AS (
  SELECT wide, coalesce(sum(batches) OVER (ORDER BY wide ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM (SELECT wide, (count(*) + max(rows) - 1) // max(rows) AS batches FROM p GROUP BY wide))
SELECT doc_id, size, CAST(first + n // rows AS BIGINT) AS batch, CAST(n % rows AS BIGINT) AS place FROM p JOIN c USING (wide)""")
def length_batches(spark, sf):
    return e.length_batches(table(spark, sf, "documents"), COST, STEP, "doc_id")


@query("encode_runs", f"""
WITH n AS (SELECT count(DISTINCT text) AS n FROM {BOTH}), u AS (
  SELECT count(DISTINCT text) AS n FROM {BOTH} WHERE conv_id % 2 = 0)
SELECT 1 AS run, u.n AS n_needed, u.n AS n_encoded, u.n AS n_stored FROM u
UNION ALL SELECT 2, n.n, n.n - u.n, n.n FROM n, u
UNION ALL SELECT 3, n.n, 0, n.n FROM n""")
def encode_runs(spark, sf):
    """Half of the conversations, then all, then all again: nothing is encoded twice."""
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    pairs, done = turn_pairs(spark, sf), None
    for run, rows in enumerate((pairs.filter("conv_id % 2 = 0"), pairs, pairs), 1):
        texts = materialize(e.distinct_texts(rows, max_length=None), "texts")
        lacking = e.coverage(texts, e.read_vectors(spark, path)).select(
            "n_needed", F.col("n_missing").alias("n_encoded"))
        counted = materialize(lacking, "lacking")
        e.encode_once(spark, [rows], path, max_length=None)
        part = counted.select(F.lit(run).alias("run"), "*").crossJoin(
            e.read_vectors(spark, path).agg(F.count_distinct("seq_key").alias("n_stored")))
        part = materialize(part, "run")
        done = part if done is None else done.unionByName(part)
    return done


@query("vector_store", f"""
WITH n AS (SELECT count(DISTINCT text) AS n FROM {BOTH}), u AS (
  SELECT count(DISTINCT text) AS n FROM {BOTH} WHERE conv_id % 2 = 0)
SELECT 'two writers' AS step, 2 AS n_segments, n.n + u.n AS n_rows, n.n AS n_keys, 0 AS n_missing FROM n, u
UNION ALL SELECT 'compaction', 1, n.n, n.n, 0 FROM n""")
def vector_store(spark, sf):
    """Two writers at once, one with half of the conversations and one with all; then a compaction."""
    store = VectorStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    pairs = turn_pairs(spark, sf)
    texts = materialize(e.distinct_texts(pairs, max_length=None), "texts")
    half = e.distinct_texts(pairs.filter("conv_id % 2 = 0"), max_length=None)
    # Neither writer sees what the other one adds.
    lacking = [materialize(store.missing(some), "lacking") for some in (half, texts)]
    for rows in lacking:
        store.append(e.encode_texts(e.by_length(rows)))
    steps = None
    for step in ("two writers", "compaction"):
        if steps is not None:
            store.compact()
        tables = store.tables()
        keys = store.vectors().agg(F.count(F.lit(1)).alias("n_keys"))
        missing = store.missing(texts).agg(F.count(F.lit(1)).alias("n_missing"))
        rows = reduce(DataFrame.unionByName, tables).agg(F.count(F.lit(1)).alias("n_rows"))
        part = rows.select(
            F.lit(step).alias("step"), F.lit(len(tables)).alias("n_segments"), "n_rows",
            keys.scalar().alias("n_keys"), missing.scalar().alias("n_missing"))
        part = materialize(part, "step")
        steps = part if steps is None else steps.unionByName(part)
    return steps


PART_PAIRS = f"""(SELECT *, CAST(pair_id % 3 AS INT) AS label,
    CASE WHEN pair_id % 10 = 0 THEN 'test' WHEN pair_id % 10 = 1 THEN 'val' ELSE 'train' END AS split FROM {PAIRS})"""


@query("pair_table", f"""
SELECT p.pair_id, p.label, p.split, p.score, r.d, f.* EXCLUDE (pair_id), round(r.mean, 6) + 0.0 AS ref_mean,
       round(r.max, 6) + 0.0 AS ref_max, round(v.mean, 6) + 0.0 AS var_mean, round(v.max, 6) + 0.0 AS var_max
FROM {PART_PAIRS} p JOIN ({features_sql(PAIRS, 'pair_id')}) f USING (pair_id)
JOIN {encoded_sql('ref_seq', PAIRS, 'pair_id')} r USING (pair_id)
JOIN {encoded_sql('var_seq', PAIRS, 'pair_id')} v ON v.pair_id = p.pair_id AND v.d = r.d""")
def pair_table(spark, sf):
    part = F.col("pair_id") % 10
    pairs = pair_view(spark, sf).select(
        "pair_id", "score", "ref_seq", "var_seq", (F.col("pair_id") % 3).cast("int").alias("label"),
        F.when(part == 0, "test").when(part == 1, "val").otherwise("train").alias("split"))
    texts = materialize(e.distinct_texts(pairs, max_length=None), "texts")
    vectors = materialize(e.encode_texts(e.by_length(texts)), "vectors")
    path = f"{shared_folder(spark)}/pair-table-{uuid.uuid4().hex}"
    write_splits(e.pair_table(pairs, vectors, texts, max_length=None), path)
    kept = spark.read.parquet(path)
    sides = ("ref_mean", "ref_max", "var_mean", "var_max")
    return kept.select("*", F.posexplode(F.arrays_zip(*sides)).alias("d", "z")).select(
        "pair_id", "label", "split", "score", F.col("d").cast("long").alias("d"),
        *(rounded(F.get("features", i)).alias(name) for i, name in enumerate(FEATURES)),
        *(rounded(F.col("z")[n]).alias(n) for n in sides))


@query("pooled_vectors", """
SELECT label, CAST(d AS INT) AS d, round(coalesce(avg(CASE WHEN shown THEN x END), 0), 6) + 0.0 AS mean,
       round(coalesce(max(CASE WHEN shown THEN x END), 0), 6) + 0.0 AS max
FROM (SELECT label, vec_id % 5 <> 0 AND label <> 3 AS shown, CAST(unnest(embedding) AS DOUBLE) AS x,
             generate_subscripts(embedding, 1) - 1 AS d FROM embeddings) GROUP BY label, d""")
def pooled_vectors(spark, sf):
    tokens = table(spark, sf, "embeddings").withColumn(
        "shown", (F.col("vec_id") % 5 != 0) & (F.col("label") != 3))
    pooled = e.pool_tokens(tokens, ["label"], "embedding", "shown")
    zipped = F.posexplode(F.arrays_zip("mean", "max")).alias("d", "z")
    return pooled.select("label", zipped).select(
        "label", "d", rounded(F.col("z.mean")).alias("mean"), rounded(F.col("z.max")).alias("max"))


# Each vector with the one that follows it.
PAIRED = """(SELECT a.vec_id, a.label, a.embedding AS r, b.embedding AS v FROM embeddings a
  JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def vector_pairs(spark, sf):
    rows = table(spark, sf, "embeddings")
    later = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("v"))
    return rows.select("vec_id", "label", F.col("embedding").alias("r")).join(later, "vec_id")


def long_form(df, key, vector):
    return df.select(key, F.posexplode(vector).alias("d", "x")).select(key, "d", rounded("x").alias("x"))


def long_sql(rows: str, vector: str) -> str:
    return f"""SELECT vec_id, CAST(generate_subscripts(vec, 1) - 1 AS INT) AS d, round(unnest(vec), 6) + 0.0 AS x
FROM (SELECT vec_id, {vector} AS vec FROM {rows})"""


DOUBLES = "CAST({} AS DOUBLE[])"
R, V = DOUBLES.format("r"), DOUBLES.format("v")
DIFF = "list_transform(range(1, 65), lambda i: CAST(r[i] AS DOUBLE) - CAST(v[i] AS DOUBLE))"
PROD = "list_transform(range(1, 65), lambda i: CAST(r[i] AS DOUBLE) * CAST(v[i] AS DOUBLE))"


@query("pair_vectors", long_sql(PAIRED, f"list_concat(list_concat({DIFF}, {PROD}), list_concat({R}, {V}))"))
def pair_vectors(spark, sf):
    return long_form(vector_pairs(spark, sf), "vec_id", v.pair_vector("r", "v"))


@query("flat_features", f"""
SELECT *, 'diff_only' AS mode FROM ({long_sql(PAIRED, DIFF)})
UNION ALL SELECT *, 'mean_only' FROM ({long_sql(PAIRED, f'list_concat({R}, {V})')})
UNION ALL SELECT *, 'full' FROM ({long_sql(
    PAIRED, f'list_concat(list_concat(list_concat({DIFF}, {PROD}), list_concat({R}, {V})), [CAST(label AS DOUBLE)])')})""")
def flat_features(spark, sf):
    pairs = vector_pairs(spark, sf)
    parts = [
        long_form(pairs, "vec_id", v.flat_features("r", "v", "array(label)", mode)).withColumn("mode", F.lit(mode))
        for mode in ("diff_only", "mean_only", "full")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


EMB = DOUBLES.format("embedding")


@query("layer_norms", long_sql(
    f"(SELECT vec_id, {EMB} AS e, list_avg({EMB}) AS m, list_var_pop({EMB}) AS s FROM embeddings)",
    "list_transform(e, lambda x: (x - m) / sqrt(s + 0.00001))"))
def layer_norms(spark, sf):
    return long_form(table(spark, sf, "embeddings"), "vec_id", v.layer_norm("embedding"))


@query("softmax_calls", f"""
SELECT vec_id, CAST(list_position({EMB}, list_max({EMB})) - 1 AS INT) AS called,
       round(1 / list_sum(list_transform({EMB}, lambda x: exp(x - list_max({EMB})))), 6) + 0.0 AS confidence
FROM embeddings""")
def softmax_calls(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("p", v.softmax("embedding"))
    return rows.select("vec_id", v.argmax("p").alias("called"), rounded(v.confidence("p")).alias("confidence"))


STATS = """(SELECT d, avg(x) AS m, stddev_pop(x) AS sd FROM (
    SELECT CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings
    WHERE label < 4) GROUP BY d)"""


@query("scaled_vectors", f"""
SELECT vec_id, CAST(d AS INT) AS d, round((x - m) / sd, 6) + 0.0 AS x
FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings)
JOIN {STATS} USING (d)""")
def scaled_vectors(spark, sf):
    rows = table(spark, sf, "embeddings")
    stats = learn.column_statistics(rows.filter(F.col("label") < 4), "embedding")
    return long_form(learn.standardize(rows, stats, "embedding"), "vec_id", "scaled")


def _learning_sets(spark, sf):
    """Training and test rows by a fixed hash split, classes 0 to 2."""
    pairs = vector_pairs(spark, sf).select(
        "vec_id", (F.col("label") % 3).alias("label"), v.flat_features("r", "v", mode="diff_only").alias("features"))
    split = materialize(stratified_split(pairs, ["vec_id"], test_size=0.2), "learning-rows")
    return split.filter(F.col("split") != "test"), split.filter(F.col("split") == "test")


@query("learning_rows", split_sql(PAIRED, "false", ["vec_id"], "label % 3", 0.2))
def learning_rows(spark, sf):
    """The rows that the three baselines are trained and tested on."""
    train, test = _learning_sets(spark, sf)
    return train.unionByName(test).select("vec_id", F.col("label").cast("int").alias("label"), "split")


def _called(df):
    return df.select("vec_id", "label", "prediction", rounded(v.confidence("probabilities"), 4).alias("confidence"))


@query("logistic_regression")
def logistic_regression(spark, sf):
    return _called(learn.logistic_regression(*_learning_sets(spark, sf)))


@query("logistic_certificate", f"""
SELECT CAST(class AS INT) AS class, CAST(component AS INT) AS component, 0.0 AS gradient
FROM (SELECT DISTINCT label % 3 AS class FROM embeddings),
     (SELECT unnest(range(0, max(len(embedding)) + 1)) AS component FROM embeddings)""")
def logistic_certificate(spark, sf):
    """At the fitted coefficients the loss over all training rows has no slope in any direction."""
    train, _ = _learning_sets(spark, sf)
    return learn.logistic_certificate(train).select("class", "component", rounded("gradient", 4).alias("gradient"))


@query("random_forest")
def random_forest(spark, sf):
    return _called(learn.random_forest(*_learning_sets(spark, sf)))


@query("perceptron")
def perceptron(spark, sf):
    return _called(learn.perceptron(*_learning_sets(spark, sf), inputs=DIMS))
