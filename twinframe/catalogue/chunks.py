"""Queries on long texts as chunks, here of few characters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assemble as a
from ..operators import chunks as c
from ..operators.features import FEATURES
from ..session import spread_scan
from .assembly import EDITED_GENES
from .pairs import ORDER_DNA, features_sql
from .register import query, rounded
from .views import PAIRS, dna_of, gene_view, pair_view, table, translate_sql, variant_view

SIZE = 15


def chunks_sql(rows: str, key: str, text: str, size: int) -> str:
    return f"""(
  SELECT {key}, chunk, substr({text}, {size} * chunk + 1, {size}) AS text
  FROM (SELECT *, unnest(range(0, greatest(1, (len({text}) + {size - 1}) // {size}))) AS chunk FROM {rows}))"""


@query("gene_chunks", f"SELECT * FROM {chunks_sql(EDITED_GENES, 'gene', 'var_dna', SIZE)}")
def gene_chunks(spark, sf):
    parts = c.cut_texts(gene_view(spark, sf), size=SIZE)
    return c.edit_chunks(a.locate_variants(variant_view(spark, sf)), parts, size=SIZE)


# Orders as the lines of one file: every tenth one is a header, the others hold 33 letters and blanks.
FASTA_LINES = """(
  SELECT o_orderkey AS line, o_orderkey % 10 = 0 OR o_orderkey = (SELECT min(o_orderkey) FROM orders) AS header,
         CASE WHEN o_orderkey % 10 = 0 THEN '> id' || o_custkey || ' ' || o_orderpriority
              ELSE lower(md5(CAST(o_orderkey AS VARCHAR))) || ' ' || chr(9) || 'x' END AS value FROM orders)"""


@query("sequence_chunks", f"""
WITH numbered AS (SELECT *, sum((value[1] = '>')::INT) OVER (ORDER BY line) AS number FROM {FASTA_LINES}),
heads AS (SELECT number, regexp_extract(ltrim(value, '> '), '^[^ ]*') AS id FROM numbered WHERE header),
texts AS (
  SELECT number, coalesce(upper(string_agg(regexp_replace(value, '\\s', '', 'g'), '' ORDER BY line)
         FILTER (NOT header)), '') AS seq FROM numbered GROUP BY number)
SELECT CAST(number AS BIGINT) AS number, id, chunk, text
FROM {chunks_sql('texts', 'number', 'seq', 60)} JOIN heads USING (number) WHERE id <> '' OR text <> ''""")
def sequence_chunks(spark, sf):
    key = F.col("o_orderkey")
    lines = spread_scan(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")).select(
        F.lit("orders").alias("file"), key.alias("line"),
        F.when(key % 10 == 0, F.concat(F.lit("> id"), F.col("o_custkey").cast("string"), F.lit(" "), "o_orderpriority"))
        .otherwise(F.concat(F.md5(key.cast("string")), F.lit(" \tx"))).alias("value"))
    names, parts = c.fasta_chunks(lines, size=60)
    return parts.join(names, "record").select(
        F.col("record.number").cast("long").alias("number"), "id", "chunk", "text")


@query("chunk_translations", f"""
WITH t AS (SELECT o_orderkey, {translate_sql('d')} AS protein FROM (SELECT o_orderkey, {ORDER_DNA} AS d FROM orders)),
s AS (SELECT o_orderkey, split_part(protein, '*', 1) AS protein FROM t)
SELECT false AS to_stop, * FROM {chunks_sql('t', 'o_orderkey', 'protein', SIZE // 3)}
UNION ALL SELECT true, * FROM {chunks_sql('s', 'o_orderkey', 'protein', SIZE // 3)}""")
def chunk_translations(spark, sf):
    orders = spread_scan(table(spark, sf, "orders").select("o_orderkey"))
    parts = c.cut_texts(orders.select("o_orderkey", dna_of(F.col("o_orderkey"), "ab").alias("d")), "o_orderkey", "d", SIZE)
    products = c.chunk_products(parts, "o_orderkey")
    whole, stopped = (c.ended_products(products, "o_orderkey", stop, SIZE) for stop in (False, True))
    return whole.select(F.lit(False).alias("to_stop"), "*").unionByName(stopped.select(F.lit(True).alias("to_stop"), "*"))


@query("chunk_features", features_sql(PAIRS, "pair_id"))
def chunk_features(spark, sf):
    pairs = pair_view(spark, sf)
    refs, variants = (c.cut_texts(pairs, "pair_id", text, 6) for text in ("ref_seq", "var_seq"))
    states = c.merged_states(c.pair_states(refs, variants, "pair_id", 6), "pair_id")
    return c.state_features(states, "pair_id").select("pair_id", *(rounded(f).alias(f) for f in FEATURES))
