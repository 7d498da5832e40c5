"""Queries on assembly: intervals, variants, records, annotations, predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assemble as a
from ..operators.curate import highest_impact
from ..operators.metrics import concordance, disagreements, join_annotators
from ..operators.spread import lookup_join
from ..plans.evaluation import compare_annotators
from ..plans.prediction import explain, predict, variant_records
from ..session import spread_scan
from ..sources.sequences import fasta_records as parse_fasta
from ..sources.sinks import report_columns
from ..sources.variants import explode_annotations, variant_columns
from .pairs import edit_lists_sql
from .register import query
from .views import (
    GENES,
    LINE_KEY,
    ROW_ORDER,
    VARIANTS,
    dna_of,
    dna_sql,
    gene_view,
    table,
    translate_sql,
    variant_view,
)

# An interval per order, after the orders' keys and totals, in the space of one of
# the event types; positions of events are their seconds since the type's first.
SPANS = """(
  SELECT event_type AS chrom, CAST((o_orderkey * 977) % 2600000 AS BIGINT) AS start,
         CAST((o_orderkey * 977) % 2600000 + floor(o_totalprice / 40) + 1 AS BIGINT) AS end_,
         CAST((o_orderkey * 31) % 1000003 * 10000000 + o_orderkey AS BIGINT) AS ord, 'order' || o_orderkey AS gene
  FROM orders JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS place, count(*) OVER () AS places FROM types)
    ON o_custkey % places = place)"""
SECONDS = "CAST(floor(epoch(ts) - epoch(first_ts)) AS BIGINT)"


@query("located_events", f"""
WITH types AS (SELECT event_type, min(ts) AS first_ts FROM events GROUP BY event_type),
v AS (SELECT event_id, event_type AS chrom, {SECONDS} AS pos FROM events JOIN types USING (event_type)),
s AS {SPANS},
m AS (SELECT event_id, min_by(gene, ord) AS gene, min_by(start, ord) AS start
      FROM v JOIN s ON v.chrom = s.chrom AND s.start <= v.pos AND v.pos < s.end_ GROUP BY event_id)
SELECT v.event_id, coalesce(m.gene, v.chrom) AS gene, v.pos - coalesce(m.start, 0) AS local_pos
FROM v LEFT JOIN m USING (event_id)""")
def located_events(spark, sf):
    events = table(spark, sf, "events")
    types = events.groupBy("event_type").agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n"))
    # A row per event type, of which one may have most of the events.
    positions = lookup_join(events, types, ["event_type"], "n").select(
        "event_id", F.col("event_type").alias("chrom"),
        F.expr("(unix_micros(CAST(ts AS timestamp)) - unix_micros(CAST(first_ts AS timestamp))) div 1000000").alias("pos"))
    names = types.agg(F.array_sort(F.collect_set("event_type"))).scalar()
    orders = spread_scan(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))
    spans = orders.withColumn("_names", names).select(
        F.get("_names", (F.col("o_custkey") % F.size("_names")).cast("int")).alias("chrom"),
        F.expr("o_orderkey * 977 % 2600000").alias("start"),
        F.expr("o_orderkey * 977 % 2600000 + CAST(floor(o_totalprice / 40) AS BIGINT) + 1").alias("end"),
        F.expr("o_orderkey * 31 % 1000003 * 10000000 + o_orderkey").alias("ord"),
        F.concat(F.lit("order"), F.col("o_orderkey").cast("string")).alias("gene"))
    return a.locate_variants(positions, spans).select("event_id", "gene", "local_pos")


# The variants of a gene, one string each, from right to left.
EDITS = f"""list(CAST(pos AS VARCHAR) || '|' || CAST(len(ref) AS VARCHAR) || '|' || alt
    ORDER BY pos DESC, {ROW_ORDER})"""


def _field(i: int) -> str:
    return f"split_part(e, '|', {i})"


POS, REF_SIZE, ALT = f"CAST({_field(1)} AS INT)", f"CAST({_field(2)} AS INT)", _field(3)
APPLIED = f"""list_reduce(list_concat([seq], edits), lambda t, e:
  CASE WHEN {REF_SIZE} = 1 AND len({ALT}) = 1
         THEN substr(t, 1, {POS}) || {ALT} || substr(t, {POS} + 2)
       WHEN {REF_SIZE} < len({ALT})
         THEN substr(t, 1, {POS} + {REF_SIZE}) || substr({ALT}, {REF_SIZE} + 1) || substr(t, {POS} + {REF_SIZE} + 1)
       WHEN {REF_SIZE} > len({ALT}) THEN substr(t, 1, {POS} + len({ALT})) || substr(t, {POS} + {REF_SIZE} + 1)
       ELSE t END)"""
EDITED_GENES = f"""(
  SELECT chrom AS gene, n_variants, seq AS ref_dna, {APPLIED} AS var_dna FROM (
    SELECT chrom, count(*) AS n_variants, {EDITS} AS edits FROM {VARIANTS}
    WHERE NOT contains(alt, ',') GROUP BY chrom) JOIN {GENES} g ON g.id = chrom)"""
RECORDS = f"""(
  SELECT gene, n_variants, ref_dna, var_dna, split_part({translate_sql('ref_dna')}, '*', 1) AS ref_protein,
         split_part({translate_sql('var_dna')}, '*', 1) AS var_protein FROM {EDITED_GENES})"""


@query("gene_records", f"SELECT * FROM {RECORDS}")
def gene_records(spark, sf):
    return variant_records(variant_view(spark, sf), gene_view(spark, sf)).drop("chrom")


@query("variant_details", f"""
SELECT chrom AS gene, pos AS local_pos, ref, alt, chrom, pos AS original_pos, {ROW_ORDER} FROM {VARIANTS}
WHERE NOT contains(alt, ',') AND chrom IN (SELECT id FROM {GENES})""")
def variant_details(spark, sf):
    details = a.variant_details(a.locate_variants(variant_view(spark, sf)), gene_view(spark, sf))
    return details.select("gene", "local_pos", "ref", "alt", "chrom", "original_pos", "row_no.*")


@query("gene_edit_order", f"""
SELECT chrom AS gene, count(*) AS n_variants, sum(pos * place) AS weighted FROM (
  SELECT chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos DESC, l_orderkey, l_linenumber,
         l_partkey, l_suppkey, l_extendedprice) AS place FROM {VARIANTS}
  WHERE NOT contains(alt, ',') AND len(ref) <> len(alt)) GROUP BY chrom""".replace(
    "sum(pos * place)", "CAST(sum(pos * place) AS BIGINT)"))
def gene_edit_order(spark, sf):
    sizes = a.applicable_variants(variant_view(spark, sf)).filter(F.length("ref") != F.length("alt"))
    edits = a.gene_edits(a.locate_variants(sizes).drop("chrom"))
    weighted = F.expr("aggregate(transform(edits, (e, i) -> e.pos * (i + 1)), 0L, (acc, x) -> acc + x)")
    return edits.select("gene", "n_variants", weighted.alias("weighted"))


FASTA_TEXTS = """(
  SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN '>' ELSE '' END || CASE WHEN o_orderkey % 7 = 0 THEN '  ' ELSE '' END
         || CASE WHEN o_orderkey % 50 = 3 THEN chr(10) ELSE 'id' || o_custkey || ' ' || o_orderpriority || chr(10)
              || lower(md5(CAST(o_orderkey AS VARCHAR))) || chr(13) || chr(10) || ' ' || chr(9) || 'ac' || chr(10) END AS value
  FROM orders)"""


@query("fasta_records", f"""
SELECT * FROM (
  SELECT o_orderkey, regexp_extract(trim(split_part(ltrim(value, '>'), chr(10), 1), ' '), '^[^ ]*') AS id,
         upper(regexp_replace(substr(ltrim(value, '>'), strpos(ltrim(value, '>'), chr(10))), '\\s', '', 'g')) AS seq
  FROM {FASTA_TEXTS}) WHERE len(id) > 0 OR len(seq) > 0""")
def fasta_records(spark, sf):
    key = F.col("o_orderkey")
    texts = table(spark, sf, "orders").select(key.alias("record_no"), F.concat(
        F.when(key % 10 == 0, ">").otherwise(""), F.when(key % 7 == 0, "  ").otherwise(""),
        F.when(key % 50 == 3, "\n").otherwise(F.concat(
            F.lit("id"), F.col("o_custkey").cast("string"), F.lit(" "), "o_orderpriority", F.lit("\n"),
            F.md5(key.cast("string")), F.lit("\r\n \tac\n")))).alias("value"))
    return parse_fasta(texts).select(F.col("record_no").alias("o_orderkey"), "id", "seq")


@query("variant_lines", f"""
SELECT CAST(l_partkey AS VARCHAR) AS chrom, l_orderkey - 1 AS pos, l_returnflag AS ref, l_linestatus AS alt, {ROW_ORDER}
FROM lineitem WHERE l_linenumber NOT IN (3, 4)""")
def variant_lines(spark, sf):
    number = F.col("l_linenumber")
    start = F.concat_ws("\t", F.when(number == 3, F.concat(F.lit("#"), F.col("l_partkey").cast("string"))).otherwise(
        F.col("l_partkey").cast("string")), F.col("l_orderkey").cast("string"), F.lit("."))
    rest = F.when(number == 5, F.lit("q\t.\tDP=1")).otherwise("q ")
    lines = table(spark, sf, "lineitem").select(
        F.struct(*LINE_KEY).alias("row_no"),
        F.when(number == 4, start).otherwise(
            F.concat_ws("\t", start, "l_returnflag", "l_linestatus", rest)).alias("value"))
    return variant_columns(lines).select("chrom", "pos", "ref", "alt", "row_no.*")


@query("rejected_variants", f"""
SELECT reason, count(*) AS n FROM (
  SELECT CASE WHEN contains(alt, ',') THEN 'several alleles'
              WHEN len(ref) = len(alt) AND len(ref) > 1 THEN 'same length' END AS reason FROM {VARIANTS})
WHERE reason IS NOT NULL GROUP BY reason""")
def rejected_variants(spark, sf):
    return a.rejected_variants(variant_view(spark, sf)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# Order texts paired with part texts; some hold a letter outside the bases.
SECOND = dna_sql("o_orderkey", "d")
ORDER_TEXTS = f"""(SELECT CAST(o_custkey AS VARCHAR) AS id, o_orderkey,
    {SECOND} || CASE WHEN o_orderstatus = 'P' THEN 'P*' ELSE '' END AS seq FROM orders)"""
PART_TEXTS = f"""(SELECT CAST(p_partkey AS VARCHAR) AS id,
    {dna_sql('p_partkey')} || CASE WHEN p_size < 10 THEN '' ELSE 'QQ*' END AS seq FROM part)"""


def order_texts(spark, sf):
    tail = F.when(F.col("o_orderstatus") == "P", "P*").otherwise("")
    columns = "o_orderkey o_custkey o_orderstatus"
    return spread_scan(table(spark, sf, "orders").select(*columns.split())).select(
        F.col("o_custkey").cast("string").alias("id"), "o_orderkey",
        F.concat(dna_of(F.col("o_orderkey"), "d"), tail).alias("seq"))


def part_texts(spark, sf):
    tail = F.when(F.col("p_size") < 10, "").otherwise("QQ*")
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.concat(dna_of(F.col("p_partkey")), tail).alias("seq"))


def protein_sql(text: str) -> str:
    """Translation up to the first stop, empty where a letter is no base."""
    return (f"CASE WHEN regexp_full_match({text}[:len({text}) - len({text}) % 3], '[ACGT]*')"
            f" THEN split_part({translate_sql(text)}, '*', 1) ELSE '' END")


@query("paired_records", f"""
SELECT v.id AS gene, CASE WHEN dna THEN {protein_sql('r.seq')} ELSE replace(r.seq, '*', '') END AS ref_protein,
       CASE WHEN dna THEN {protein_sql('v.seq')} ELSE replace(v.seq, '*', '') END AS var_protein,
       CASE WHEN dna THEN r.seq ELSE '' END AS ref_dna, CASE WHEN dna THEN v.seq ELSE '' END AS var_dna
FROM {ORDER_TEXTS} v JOIN (SELECT *, regexp_full_match(seq[:100], '[ATGCN]*') AS dna FROM {PART_TEXTS}) r
  ON v.id = r.id""")
def paired_records(spark, sf):
    return a.pair_records(part_texts(spark, sf), order_texts(spark, sf))


@query("loaded_pairs", f"""
SELECT v.id AS gene, {protein_sql('r.seq')} AS ref_protein,
       CASE WHEN regexp_full_match(v.seq[:50], '[ATGCN]*') THEN {protein_sql('v.seq')}
            ELSE replace(v.seq, '*', '') END AS var_protein, r.seq AS ref_dna,
       CASE WHEN regexp_full_match(v.seq[:50], '[ATGCN]*') THEN v.seq ELSE '' END AS var_dna
FROM (SELECT id, max_by(seq, o_orderkey) AS seq FROM {ORDER_TEXTS} GROUP BY id) v JOIN {GENES} r ON v.id = r.id""")
def loaded_pairs(spark, sf):
    last = a.last_per_id(order_texts(spark, sf), "o_orderkey")
    return a.pair_with_loaded(gene_view(spark, sf), last)


@query("unmatched_records", """
SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey NOT IN (SELECT p_partkey FROM part)""")
def unmatched_records(spark, sf):
    # Orders by their own key: those beyond the parts' keys have no reference.
    orders = order_texts(spark, sf).withColumn("id", F.col("o_orderkey").cast("string"))
    return a.unmatched_records(part_texts(spark, sf), orders)


# Annotation texts out of lineitem: two entries per row, one of them too short for some.
EFFECTS = {"A": "stop_gained", "N": "synonymous_variant", "R": "stop_lost"}
LABELS = {"stop_gained": "low", "stop_lost": "high", "synonymous_variant": "mid"}
LEVELS = ("HIGH", "MODERATE", "LOW", "MODIFIER")


def annotated_lines(spark, sf):
    effect = F.col("l_returnflag")
    for flag, name in EFFECTS.items():
        effect = F.when(F.col("l_returnflag") == flag, name).otherwise(effect)
    level = F.element_at(F.array(*(F.lit(x) for x in LEVELS)), (F.col("l_linenumber") % 4).cast("int") + 1)
    gene = F.concat(F.lit("g"), (F.col("l_partkey") % 1000).cast("string"))
    first = F.concat_ws("|", F.lit("A"), effect, level, gene, F.lit("t|t|t|t|t|t|t"))
    second = F.when(F.col("l_linestatus") == "F", F.lit("A|other|HIGH|g0")).otherwise(
        F.concat_ws("|", F.lit("C"), F.lit("unknown_effect"), F.lit("LOW"), gene, F.lit("t|t|t|t|t|t|t|t")))
    columns = " ".join(LINE_KEY) + " l_returnflag l_linestatus"
    return spread_scan(table(spark, sf, "lineitem").select(*columns.split())).select(
        F.concat(F.lit("DP=9;ANN="), first, F.lit(","), second, F.lit(";ANN=x|y")).alias("info"),
        F.struct(*LINE_KEY).alias("row_no"))


ANNOTATIONS = f"""(
  SELECT 'g' || (l_partkey % 1000) AS gene,
         CASE l_returnflag WHEN 'A' THEN 'stop_gained' WHEN 'N' THEN 'synonymous_variant' WHEN 'R' THEN 'stop_lost' END AS effect,
         CASE l_linenumber % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MODERATE' WHEN 2 THEN 'LOW' ELSE 'MODIFIER' END AS impact,
         CASE l_returnflag WHEN 'A' THEN 'low' WHEN 'R' THEN 'high' ELSE 'mid' END AS label, 0 AS place, {ROW_ORDER}
  FROM lineitem
  UNION ALL
  SELECT 'g' || (l_partkey % 1000), 'unknown_effect', 'LOW', 'mid', 1, {ROW_ORDER} FROM lineitem WHERE l_linestatus <> 'F')"""
BEST = f"""(SELECT gene, effect, impact, label FROM {ANNOTATIONS}
  QUALIFY row_number() OVER (PARTITION BY gene ORDER BY
    CASE impact WHEN 'HIGH' THEN 3 WHEN 'MODERATE' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END DESC, {ROW_ORDER}, place) = 1)"""


def annotations(spark, sf):
    return explode_annotations(annotated_lines(spark, sf), LABELS, "mid")


@query("annotation_entries", f"""
SELECT gene, effect, impact, label, count(*) AS n FROM {ANNOTATIONS} GROUP BY ALL""")
def annotation_entries(spark, sf):
    return annotations(spark, sf).groupBy("gene", "effect", "impact", "label").agg(F.count(F.lit(1)).alias("n"))


@query("highest_impact", f"SELECT * FROM {BEST}")
def best_annotation(spark, sf):
    return highest_impact(annotations(spark, sf)).drop("row_no")


CALLS = """(SELECT 'g' || p_partkey AS gene,
    CASE WHEN p_size < 15 THEN 'low' WHEN p_size < 35 THEN 'mid' ELSE 'high' END AS prediction FROM part)"""


def calls(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("gene"),
        F.when(size < 15, "low").when(size < 35, "mid").otherwise("high").alias("prediction"))


@query("annotator_concordance", f"""
SELECT count(*) AS total, round(count_if(prediction = label) / count(*), 6) + 0.0 AS agreement_rate,
       CAST(count_if(prediction = label) AS BIGINT) AS agree_count,
       CAST(count_if(prediction <> label) AS BIGINT) AS disagree_count,
       round(count_if(prediction = label AND label = 'low') / nullif(count_if(label = 'low'), 0), 6) AS low_concordance,
       round(count_if(prediction = label AND label = 'mid') / nullif(count_if(label = 'mid'), 0), 6) AS mid_concordance,
       round(count_if(prediction = label AND label = 'high') / nullif(count_if(label = 'high'), 0), 6) AS high_concordance,
       CAST(NULL AS VARCHAR) AS error
FROM {CALLS} JOIN {BEST} USING (gene)""")
def annotator_concordance(spark, sf):
    report, _ = compare_annotators(calls(spark, sf), highest_impact(annotations(spark, sf)), ["low", "mid", "high"])
    return _rounded_report(report)


def _rounded_report(report):
    return report.select(*(
        F.round(c, 6).alias(c) if c.endswith(("_concordance", "_rate")) else F.col(c) for c in report.columns))


@query("annotator_disagreements", f"""
SELECT gene, effect, prediction AS predicted_label, label AS annotated_label
FROM {CALLS} JOIN {BEST} USING (gene) WHERE prediction <> label""")
def annotator_disagreements(spark, sf):
    _, rows = compare_annotators(calls(spark, sf), highest_impact(annotations(spark, sf)), ["low", "mid", "high"])
    return rows


@query("label_concordance", """
SELECT lang, count(*) AS total, round(count_if(quality = toxic) / count(*), 6) + 0.0 AS agreement_rate,
       CAST(count_if(quality = toxic) AS BIGINT) AS agree_count,
       CAST(count_if(quality <> toxic) AS BIGINT) AS disagree_count,
       round(count_if(quality = toxic AND toxic = 0) / nullif(count_if(toxic = 0), 0), 6) AS "0_concordance",
       round(count_if(quality = toxic AND toxic = 1) / nullif(count_if(toxic = 1), 0), 6) AS "1_concordance",
       CAST(NULL AS VARCHAR) AS error
FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def label_concordance(spark, sf):
    labels = table(spark, sf, "labels")
    joined = join_annotators(labels, table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return _rounded_report(concordance(joined, "quality", "toxic", [0, 1], ["lang"]))


@query("label_disagreements", """
SELECT doc_id, quality, toxic FROM labels WHERE quality <> toxic""")
def label_disagreements(spark, sf):
    return disagreements(table(spark, sf, "labels"), "quality", "toxic", ["doc_id"])


# Logits per gene, out of part.
LOGITS = """(SELECT CAST(p_partkey AS VARCHAR) AS gene, [p_size / CAST(16 AS DOUBLE), (p_partkey % 64) / CAST(16 AS DOUBLE),
    (p_partkey % 7) / CAST(2 AS DOUBLE)] AS logits FROM part)"""
CALLED = f"""(
  SELECT *, ['low', 'mid', 'high'][CAST(list_position(p, list_max(p)) AS INT)] AS prediction, list_max(p) AS confidence FROM (
    SELECT gene, ref_protein AS ref_seq, var_protein AS var_seq, list_transform(logits, lambda x: exp(x - list_max(logits))
       / list_sum(list_transform(logits, lambda y: exp(y - list_max(logits))))) AS p
    FROM {RECORDS} JOIN {LOGITS} USING (gene)))"""


@query("prediction_report", f"""
SELECT gene, prediction, printf('%.4f', confidence) AS confidence, printf('%.4f', p[1]) AS low_prob,
       printf('%.4f', p[2]) AS mid_prob, printf('%.4f', p[3]) AS high_prob,
       array_to_string(list_concat(
         [gene || ': ' || prediction || printf(' (confidence=%.2f%%)', confidence * 100)],
         CASE WHEN len(edits) = 0 THEN ['No mutations detected — wildtype sequence.'] ELSE list_concat(
           list_transform(list_filter(edits, lambda e: e.type IN ('nonsense', 'truncation'))[1:3], lambda e:
             'Truncation: ' || printf('%.0f%%', (1 - len(var_seq) / CAST(greatest(len(ref_seq), 1) AS DOUBLE)) * 100)
             || ' of protein lost'),
           CASE WHEN moderate > 0 THEN [moderate || ' missense mutation(s)'] ELSE [] END) END), ' | ') AS summary
FROM (SELECT *, len(list_filter(edits, lambda e: e.type IN ('missense', 'readthrough'))) AS moderate
      FROM ({edit_lists_sql(CALLED, 'gene')}))""")
def prediction_report(spark, sf):
    key = F.col("p_partkey")
    logits = table(spark, sf, "part").select(
        key.cast("string").alias("gene"),
        F.array(F.col("p_size") / 16, (key % 64) / 16, (key % 7) / 2).alias("logits"))
    records = variant_records(variant_view(spark, sf), gene_view(spark, sf))
    report = explain(predict(records, logits))
    return report.select(*report_columns(report))
