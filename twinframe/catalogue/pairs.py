"""Queries on pairs of texts: edits, measures, features, codes, explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import CLASS_NAMES
from ..functions import explain as x
from ..functions import sequence as s
from ..functions.vector import clamp, length_change_score
from ..operators.features import FEATURES, explode_edits, pair_features, with_edits
from ..operators.spread import with_once
from .register import edits_text, query, rounded
from .views import (
    EDITED,
    HEX,
    PAIRS,
    SCORED,
    TURNS,
    dna_of,
    dna_sql,
    pair_view,
    scored_view,
    table,
    translate_sql,
    turn_pairs,
)


def edits_sql(source: str, keys: str) -> str:
    """One row per edit event of the pairs in a source."""
    return f"""
    SELECT {keys}, i AS position, substr(ref_seq, i, 1) AS ref, substr(var_seq, i, 1) AS var,
           CASE WHEN substr(var_seq, i, 1) = '*' THEN 'nonsense'
                WHEN substr(ref_seq, i, 1) = '*' THEN 'readthrough' ELSE 'missense' END AS type
    FROM (SELECT {keys}, ref_seq, var_seq,
                 CAST(unnest(range(1, least(len(ref_seq), len(var_seq)) + 1)) AS INT) AS i FROM {source})
    WHERE substr(ref_seq, i, 1) <> substr(var_seq, i, 1)
    UNION ALL
    SELECT {keys}, CAST(len(var_seq) + 1 AS INT), substr(ref_seq, len(var_seq) + 1, 1), '-', 'truncation'
    FROM {source} WHERE len(var_seq) < len(ref_seq)
    UNION ALL
    SELECT {keys}, CAST(len(ref_seq) + 1 AS INT), '-', substr(var_seq, len(ref_seq) + 1, 1), 'extension'
    FROM {source} WHERE len(var_seq) > len(ref_seq)"""


def edit_lists_sql(source: str, keys: str) -> str:
    """One row per pair with its events as a list of structs, empty without any."""
    return f"""
    SELECT p.*, coalesce(e.edits, []) AS edits FROM {source} p LEFT JOIN (
      SELECT {keys}, list({{'position': position, 'ref': ref, 'var': var, 'type': type}}
                          ORDER BY position) AS edits
      FROM ({edits_sql(source, keys)}) GROUP BY {keys}) e USING ({keys})"""


EDIT_LISTS = edit_lists_sql(PAIRS, "pair_id")


@query("edit_events", edits_sql(PAIRS, "pair_id"))
def edit_events(spark, sf):
    edited = with_edits(pair_view(spark, sf)).select("pair_id", "edits")
    return explode_edits(edited)


@query("edit_lists", f"""
SELECT pair_id, CAST(len(edits) AS INT) AS n_edits, array_to_string(list_transform(edits, lambda e:
    e.position || ':' || e.ref || ':' || e.var || ':' || e.type), ';') AS edits FROM ({EDIT_LISTS})""")
def edit_lists(spark, sf):
    edited = with_edits(pair_view(spark, sf))
    return edited.select("pair_id", F.size("edits").alias("n_edits"), edits_text("edits").alias("edits"))


@query("turn_edits", f"""
WITH chars AS (
  SELECT conv_id, turn, ref_seq, var_seq, string_split(ref_seq, '') AS r, string_split(var_seq, '') AS v
  FROM {TURNS}),
hits AS (
  SELECT *, list_filter(range(1, least(len(r), len(v)) + 1), lambda i: r[i] <> v[i]) AS hit FROM chars)
SELECT conv_id, turn,
       CAST(len(hit) + CASE WHEN len(r) <> len(v) THEN 1 ELSE 0 END AS INT) AS n_edits,
       CAST(len(list_filter(hit, lambda i: v[i] <> '*' AND r[i] <> '*')) AS INT) AS n_missense,
       CAST(coalesce(list_sum(hit), 0) + CASE WHEN len(r) <> len(v) THEN least(len(r), len(v)) + 1 ELSE 0 END
            AS BIGINT) AS position_sum
FROM hits""")
def turn_edits(spark, sf):
    edited = with_edits(turn_pairs(spark, sf))
    return edited.select(
        "conv_id", "turn", F.size("edits").alias("n_edits"),
        F.size(F.filter("edits", lambda e: e["type"] == s.MISSENSE)).alias("n_missense"),
        F.aggregate("edits", F.lit(0).cast("bigint"), lambda acc, e: acc + e["position"]).alias("position_sum"))


MEASURES = """
  instr(var_seq, '*') > 0 AND (instr(ref_seq, '*') = 0 OR instr(var_seq, '*') < instr(ref_seq, '*'))"""
REF_LEN = "CASE WHEN instr(ref_seq, '*') > 0 THEN instr(ref_seq, '*') - 1 ELSE len(ref_seq) END"
VAR_LEN = "CASE WHEN instr(var_seq, '*') > 0 THEN instr(var_seq, '*') - 1 ELSE len(var_seq) END"
TRUNCATED = f"CASE WHEN {VAR_LEN} < {REF_LEN} THEN ({REF_LEN} - {VAR_LEN}) / CAST({REF_LEN} AS DOUBLE) ELSE 0.0 END"


@query("pair_measures", f"""
SELECT pair_id, {MEASURES} AS premature_stop, round({TRUNCATED}, 6) + 0.0 AS truncation,
       round(len(list_filter(range(1, least(len(ref_seq), len(var_seq)) + 1),
             lambda i: substr(ref_seq, i, 1) = substr(var_seq, i, 1)))
             / CAST(greatest(len(ref_seq), len(var_seq)) AS DOUBLE), 6) + 0.0 AS identity,
       CASE WHEN len(var_seq) / CAST(len(ref_seq) AS DOUBLE) <= 0.2 THEN 'N-terminal'
            WHEN len(var_seq) / CAST(len(ref_seq) AS DOUBLE) >= 0.8 THEN 'C-terminal' ELSE 'middle' END AS end_region
FROM {PAIRS}""")
def pair_measures(spark, sf):
    return pair_view(spark, sf).select(
        "pair_id", s.has_premature_stop("ref_seq", "var_seq").alias("premature_stop"),
        rounded(s.truncation_fraction("ref_seq", "var_seq")).alias("truncation"),
        rounded(s.sequence_identity("ref_seq", "var_seq")).alias("identity"),
        s.region("length(var_seq)", "length(ref_seq)").alias("end_region"))


def features_sql(source: str, keys: str) -> str:
    lists = edit_lists_sql(source, keys)
    length = "CAST(greatest(len(ref_seq), 1) AS DOUBLE)"
    total = "len(edits)"

    def kind(name: str) -> str:
        return f"len(list_filter(edits, lambda e: e.type = '{name}'))"

    def share(test: str) -> str:
        return (f"CASE WHEN {total} > 0 THEN len(list_filter(edits, lambda e: e.position / {length} {test}))"
                f" / CAST({total} AS DOUBLE) ELSE 0.0 END")

    longer = "greatest(len(ref_seq), len(var_seq))"
    differing = "len(list_filter(edits, lambda e: e.type NOT IN ('truncation', 'extension')))"
    identity = (f"CASE WHEN {longer} = 0 THEN 1.0 ELSE (least(len(ref_seq), len(var_seq)) - {differing})"
                f" / CAST({longer} AS DOUBLE) END")
    values = (
        "CASE WHEN len(var_seq) <> len(ref_seq) THEN 1.0 ELSE 0.0 END",
        f"CASE WHEN {MEASURES} THEN 1.0 ELSE 0.0 END",
        "CASE WHEN starts_with(ref_seq, 'M') AND NOT starts_with(var_seq, 'M') THEN 1.0 ELSE 0.0 END",
        f"{kind('missense')} / {length}", f"CAST({kind('nonsense')} AS DOUBLE)", f"1.0 - {identity}",
        TRUNCATED, f"{total} / {length} * 100", share("<= 0.2"), share(">= 0.8"),
        f"ln(1.0 + {total})", f"len(var_seq) / {length}",
    )
    columns = ", ".join(f"round(CAST({v} AS DOUBLE), 6) + 0.0 AS {n}" for n, v in zip(FEATURES, values))
    return f"SELECT {keys}, {columns} FROM ({lists})"


CLIPPED = f"(SELECT pair_id, substr(ref_seq, 1, 20) AS ref_seq, substr(var_seq, 1, 20) AS var_seq FROM {PAIRS})"


@query("pair_features", features_sql(PAIRS, "pair_id"))
def features(spark, sf):
    return pair_features(pair_view(spark, sf)).select("pair_id", *(rounded(f).alias(f) for f in FEATURES))


@query("pair_features_clipped", features_sql(CLIPPED, "pair_id"))
def features_clipped(spark, sf):
    return pair_features(pair_view(spark, sf), max_length=20).select(
        "pair_id", *(rounded(f).alias(f) for f in FEATURES))


@query("scored_pair_features", f"""
SELECT ref_seq, count(*) AS n, round(avg(edit_density), 6) + 0.0 AS edit_density,
       round(avg(dissimilarity), 6) + 0.0 AS dissimilarity, CAST(sum(nonsense_count) AS BIGINT) AS stops
FROM (SELECT split_part(k, '|', 1) AS ref_seq, * EXCLUDE (k) FROM ({features_sql(
    f"(SELECT ref_seq || '|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey "
    f"|| '|' || l_extendedprice AS k, "
    f"ref_seq, {EDITED} AS var_seq FROM {SCORED})", "k")})) GROUP BY ref_seq""")
def scored_pair_features(spark, sf):
    pairs = with_once(
        scored_view(spark, sf), var_seq=s.build_variant("ref_seq", "mutant", "mutated_sequence"))
    return pair_features(pairs).groupBy("ref_seq").agg(
        F.count(F.lit(1)).alias("n"),
        # Rounded per row first, as the check does.
        rounded(F.avg(F.round("edit_density", 6))).alias("edit_density"),
        rounded(F.avg(F.round("dissimilarity", 6))).alias("dissimilarity"),
        F.sum("nonsense_count").cast("bigint").alias("stops"))


@query("edit_codes", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {EDITED} AS var_seq FROM {SCORED}""")
def edit_codes(spark, sf):
    return scored_view(spark, sf).select(
        "row_no.*", s.build_variant("ref_seq", "mutant", "mutated_sequence").alias("var_seq"))


ORDER_DNA = dna_sql("o_orderkey", "ab")


@query("translations", f"""
SELECT o_orderkey, {translate_sql('d')} AS protein, split_part({translate_sql('d')}, '*', 1) AS to_stop
FROM (SELECT o_orderkey, {ORDER_DNA} AS d FROM orders)""")
def translations(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", dna_of(F.col("o_orderkey"), "ab").alias("d"))
    return rows.select("o_orderkey", s.translate("d").alias("protein"), s.translate("d", True).alias("to_stop"))


@query("point_edits", f"""
SELECT o_orderkey, substr(d, 1, p) || 'N' || substr(d, p + 2) AS substituted,
       substr(d, 1, p) || 'ACG' || substr(d, p + 1) AS inserted,
       substr(d, 1, p) || substr(d, p + 6) AS deleted
FROM (SELECT o_orderkey, CAST(o_custkey % 64 AS INT) AS p, {ORDER_DNA} AS d FROM orders)""")
def point_edits(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", dna_of(F.col("o_orderkey"), "ab").alias("d"), (F.col("o_custkey") % 64).alias("p"))
    return rows.select(
        "o_orderkey", s.substitute_char("d", "p", "'n'").alias("substituted"),
        s.insert_text("d", "p", "'acg'").alias("inserted"),
        s.delete_span("d", "p", "5").alias("deleted"))


@query("content_keys", """
SELECT doc_id, substr(sha256(text), 1, 16) AS key, CAST(len(replace(text, '*', '')) AS INT) AS size,
       substr(text, 1, 100) AS head FROM documents""")
def content_keys(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", s.content_key("text").alias("key"), F.length(s.drop_stops("text")).alias("size"),
        s.clip("text", 100).alias("head"))


@query("nucleotide_flags", f"""
SELECT o_orderkey, t AS text, regexp_full_match(substr(t, 1, 100), '[ATGCN]*') AS is_dna,
       regexp_full_match(substr(t, 1, 50), '[ATGCN]*') AS starts_as_dna
FROM (SELECT o_orderkey, {ORDER_DNA} || o_orderstatus AS t FROM orders)""")
def nucleotide_flags(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.concat(dna_of(F.col("o_orderkey"), "ab"), "o_orderstatus").alias("text"))
    return rows.select(
        "o_orderkey", "text", s.is_nucleotide("text", 100).alias("is_dna"),
        s.is_nucleotide("text", 50).alias("starts_as_dna"))


IMPACT = """CASE WHEN e.type IN ('nonsense', 'truncation') THEN 'high'
     WHEN e.type IN ('missense', 'readthrough') THEN 'moderate'
     WHEN e.type = 'extension' THEN 'low' ELSE 'unknown' END"""
# Pairs of neighbouring brands, which differ in many places.
WIDE_PAIRS = f"""(
  SELECT a.pair_id, a.ref_seq, b.var_seq FROM {PAIRS} a JOIN {PAIRS} b ON b.pair_id = a.pair_id + 1)"""
WIDE_LISTS = edit_lists_sql(WIDE_PAIRS, "pair_id")


def wide_pairs(spark, sf):
    pairs = pair_view(spark, sf)
    later = pairs.select((F.col("pair_id") - 1).alias("pair_id"), "var_seq")
    return pairs.select("pair_id", "ref_seq").join(later, "pair_id")


def annotated_pairs(spark, sf):
    edited = with_edits(wide_pairs(spark, sf))
    return edited.withColumn("edits", x.annotate_edits("edits"))


@query("top_edits", f"""
SELECT pair_id, array_to_string(list_transform(list_sort(list_transform(edits, lambda e:
         (CASE {IMPACT} WHEN 'high' THEN '0' WHEN 'moderate' THEN '1' WHEN 'low' THEN '2' ELSE '3' END)
         || lpad(CAST(e.position AS VARCHAR), 6, '0') || e.type))[1:10], lambda t: t[2:]), ';') AS top
FROM ({WIDE_LISTS})""")
def top_edits(spark, sf):
    top = F.transform(x.top_edits("edits"), lambda e: F.concat(
        F.lpad(e["position"].cast("string"), 6, "0"), e["type"]))
    return annotated_pairs(spark, sf).select("pair_id", F.array_join(top, ";").alias("top"))


@query("impact_counts", f"""
SELECT grp, impact, count(*) AS n FROM (
  SELECT grp, unnest(list_transform(edits, lambda e: {IMPACT})) AS impact FROM ({EDIT_LISTS})) GROUP BY grp, impact""")
def impact_counts(spark, sf):
    edited = with_edits(pair_view(spark, sf)).select("grp", x.annotate_edits("edits").alias("edits"))
    return explode_edits(edited).groupBy("grp", "impact").agg(F.count(F.lit(1)).alias("n"))


SCORE_AT = f"""coalesce(list_filter(list_transform(edits, lambda e: {{'p': e.position,
    's': CASE WHEN {IMPACT} = 'high' THEN '1.0' ELSE '0.5' END}}), lambda e: e.p = i)[1].s, '0.0')"""


@query("position_scores", f"""
SELECT pair_id, array_to_string(list_transform(
    range(1, greatest(len(ref_seq), len(var_seq), 1) + 1), lambda i: {SCORE_AT}), ',') AS scores
FROM ({WIDE_LISTS})""")
def position_scores(spark, sf):
    scores = x.position_scores("ref_seq", "var_seq", "edits")
    return annotated_pairs(spark, sf).select("pair_id", F.array_join(scores.cast("array<string>"), ",").alias("scores"))


@query("summaries", f"""
SELECT pair_id, array_to_string(list_concat(
  [grp || ': ' || call || printf(' (confidence=%.2f%%)', conf * 100)],
  CASE WHEN len(edits) = 0 THEN ['No mutations detected — wildtype sequence.'] ELSE list_concat(
       list_transform(list_filter(edits, lambda e: e.type IN ('nonsense', 'truncation'))[1:3], lambda e:
         CASE WHEN e.type = 'nonsense' THEN 'Premature stop at position ' || e.position || ' (' || e.ref || '→*)'
              ELSE 'Truncation: ' || printf('%.0f%%', (1 - len(var_seq) / CAST(len(ref_seq) AS DOUBLE)) * 100)
                   || ' of protein lost' END),
       CASE WHEN moderate > 0 THEN [moderate || ' missense mutation(s)'] ELSE [] END) END), ' | ') AS summary
FROM (SELECT *, CASE pair_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END AS call,
        (pair_id % 1000) / CAST(1024 AS DOUBLE) AS conf,
        len(list_filter(edits, lambda e: e.type IN ('missense', 'readthrough'))) AS moderate FROM ({EDIT_LISTS}))
""")
def summaries(spark, sf):
    edited = with_edits(pair_view(spark, sf)).withColumns({
        "edits": x.annotate_edits("edits"),
        "conf": (F.col("pair_id") % 1000) / 1024,
        "call": F.element_at(F.array(*(F.lit(n) for n in CLASS_NAMES.values())), (F.col("pair_id") % 3).cast("int") + 1),
    })
    return edited.select(
        "pair_id", x.summary("grp", "call", "conf", "ref_seq", "var_seq", "edits").alias("summary"))


@query("length_scores", f"""
SELECT pair_id, round(greatest(least(CASE
         WHEN len(var_seq) < len(ref_seq) THEN -5.0 * (len(ref_seq) - len(var_seq)) / len(ref_seq)
         WHEN len(var_seq) > len(ref_seq) OR ref_seq = var_seq THEN 0.0 ELSE score / 100 END, 10.0), -10.0), 6)
       + 0.0 AS score FROM {PAIRS}""")
def length_scores(spark, sf):
    raw = length_change_score("ref_seq", "var_seq", "score / 100")
    return pair_view(spark, sf).withColumn("raw", raw).select(
        "pair_id", rounded(clamp("raw")).alias("score"))
