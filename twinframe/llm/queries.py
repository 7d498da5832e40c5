"""Registered queries of the operators, over whole tables, each with SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue.views import table
from ..session import shared_folder
from . import bm25, bpe, chat, collocations, decontaminate, html_text, langid, lengths, mixing, secret_scan, simhash, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def fingerprint_text(column: str):
    """16 lower-case hex digits of a signed long's bits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


@query("op1_decontamination", """
WITH item AS (
  SELECT item_id, w, least(5, len(w)) AS width
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM benchmark) WHERE len(w) > 0),
ishingle AS (
  SELECT DISTINCT item_id, width, array_to_string(list_slice(w, i, i + width - 1), ' ') AS s
  FROM (SELECT item_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM item)),
isize AS (SELECT item_id, width, count(*) AS n_shingles FROM ishingle GROUP BY item_id, width),
doc AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents),
dshingle AS (
  SELECT DISTINCT doc_id, width, array_to_string(list_slice(w, i, i + width - 1), ' ') AS s
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i
        FROM doc JOIN (SELECT DISTINCT width FROM item) ON len(w) >= width))
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles AS containment
FROM dshingle JOIN ishingle USING (width, s) JOIN isize USING (item_id, width)
GROUP BY doc_id, item_id, n_shingles
HAVING count(*) >= 0.8 * n_shingles - 1e-9
""")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op2_html_extraction")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.main_text(table(spark, sf, "pages")).withColumn(
        "n_chars", F.length("text").cast("long"))


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_LETTERS = " || ".join(
    f"substr('{_BASE32}', CAST((CAST('0x' || substr(h, {1 + 5 * i}, 5) AS BIGINT) >> {shift}) & 31 AS INT) + 1, 1)"
    for i in range(8) for shift in (15, 10, 5, 0))


@query("op3_warc_archives", f"""
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, payload_bytes, {_LETTERS} AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p JOIN f USING (h)
""")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    folder = warc.new_folder(spark)
    index = warc.build_index(warc.write_archives(pages, folder), folder)
    places = warc.lookup(index, pages.select("url", "page_id"))
    return warc.read_records(index, places).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_byte_bpe")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(table(spark, sf, "documents"), decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


_CONTROL_SQL = r"<\|(?:im_start|im_end|endoftext)\|>|</?s>|<</?SYS>>|\[/?INST\]"


@query("op5_chat_formatting", rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
w AS (
  SELECT *, length(role || text) + length(role || text) - length(replace(role || text, '\', ''))
         + len(regexp_extract_all(role, '{_CONTROL_SQL}')) + len(regexp_extract_all(text, '{_CONTROL_SQL}'))
         + length(role) - length(replace(role, chr(10), '')) + {len(chat.START) + len(chat.STOP) + 2} AS width
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(width) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
""")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    extra = spark.sql("""
      SELECT -7L AS conv_id, array(
        named_struct('role', 'user', 'content', '</s>[INST] ok [/INST]'),
        named_struct('role', 'assistant', 'content', '</s>[INST] ok [/INST]')) AS messages""")
    turns = chat.canonical_turns(table(spark, sf, "conversations")).unionByName(chat.canonical_turns(extra))
    made = chat.formatted(turns).select(
        F.col("key").alias("conv_id"), "formatted", chat.read_back(F.col("formatted")).alias("turns"),
        chat.under_mask(F.col("formatted"), F.col("loss")).alias("learned"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return made.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def _secret_sql() -> str:
    parts = []
    for place, rule in enumerate(secret_scan.RULES):
        pattern = rule.pattern.replace("'", "''").replace(r"\x20", " ")
        parts.append(f"""
  SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, m, t,
         regexp_split_to_array(text, '{pattern}') AS gaps
  FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}', 0) AS m,
               regexp_extract_all(text, '{pattern}', {rule.group}) AS t FROM d)
  WHERE len(m) > 0""")
    least = " ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in secret_scan.RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(parts)}),
each AS (
  SELECT doc_id, place, kind, length(m[i]) AS width, length(t[i]) AS tested,
         list_sum(list_transform(list_slice(gaps, 1, i), lambda x: length(x)))
         + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found)),
good AS (
  SELECT doc_id, place, kind, CAST(start AS BIGINT) AS start, CAST(start + width AS BIGINT) AS stop
  FROM each WHERE tested >= CASE kind {least} END),
summed AS (
  SELECT doc_id,
         count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place)
           FILTER (place < 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans
  FROM good GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN summed USING (doc_id)
"""


@query("op6_secret_scan", _secret_sql())
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    # Two commits, as of a corpus that grows: about half of the contents first, then all documents, of which the
    # second scans what the first has not seen.
    folder = f"{shared_folder(spark)}/secrets-{uuid.uuid4().hex}"
    secret_scan.commit(docs.filter(F.xxhash64("text") < 0), folder, "1")
    ledger = secret_scan.commit(docs, folder, "2")
    kinds = [r.kind for r in secret_scan.BASE_RULES]
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,place:int,kind:string,stop:bigint>>"))

    def listed(x):
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return secret_scan.paths_with_spans(docs, ledger).select(
        "doc_id", *map(count, kinds),
        F.sha2(listed(F.filter(spans, lambda s: s["kind"].isin(kinds))).cast("binary"), 256).alias("base_sha256"),
        listed(spans).alias("spans"))


@query("op8_simhash_near_duplicates")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents")).select(
        "doc_id", fingerprint_text("fp").alias("fingerprint"), "component_id")


@query("op9_language_id")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = langid.fit(docs)
    return langid.classify(docs.select("doc_id", "text"), model).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query("op10_token_counts")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return lengths.limits(lengths.lengths(table(spark, sf, "documents")))


@query("op7_bm25_search", """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents),
n AS (SELECT count(*) AS n_docs, sum(len(w)) / count(*) AS mean FROM d),
p AS (
  SELECT doc_id, dl, t, count(*) AS tf
  FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS t FROM d) GROUP BY doc_id, dl, t),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
s AS (
  SELECT q.doc_id AS query_id, p.doc_id,
         sum(q.tf * ln(1 + (n_docs - df + 0.5) / (df + 0.5))
             * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / mean))) AS score
  FROM p AS q JOIN p USING (t) JOIN f USING (t) CROSS JOIN n
  WHERE q.doc_id % 100 = 0 GROUP BY ALL),
r AS (
  SELECT query_id, doc_id, round(score, 6) + 0.0 AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s)
SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10
""")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    asked = docs.filter(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return bm25.search(bm25.build_index(docs), asked)


@query("op11_source_mixing")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.copies(table(spark, sf, "documents")).withColumnRenamed("key", "doc_id")


@query("op12_collocations", """
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS p FROM t),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w CROSS JOIN (VALUES (1), (2), (3)) AS s(k))),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
cut AS MATERIALIZED (
  SELECT lang, phrase, a, pos, array_to_string(w[1:pos], ' ') AS first, array_to_string(w[pos + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS pos FROM c)),
scored AS (
  SELECT cut.lang, cut.phrase, cut.a, pos, l.a AS l, r.a AS r,
         (cut.a::HUGEINT * cut.a * 1000000 // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM cut JOIN f AS l ON l.lang = cut.lang AND l.phrase = first
  JOIN f AS r ON r.lang = cut.lang AND r.phrase = rest),
best AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, pos) AS place FROM scored) WHERE place = 1),
longer AS (
  SELECT lang, part, max(a) AS a FROM (
    SELECT lang, a, array_to_string(w[1:2], ' ') AS part FROM c WHERE k = 3
    UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE k = 3)
  GROUP BY lang, part),
kept AS (
  SELECT b.* FROM best AS b LEFT JOIN longer AS x ON x.lang = b.lang AND x.part = b.phrase
  WHERE x.a IS NULL OR 100 * x.a < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
JOIN n USING (lang) WHERE rank <= 2000
""")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents")).withColumnRenamed("grp", "lang")


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings")).withColumnRenamed("key", "vec_id")
