"""Views of the driver's tables in the shape that the operators take.

Every view is given twice, as a DataFrame and as SQL text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import CODON_PRODUCTS, build_variant
from ..operators.spread import with_once
from ..session import spread_scan

# Letters that stand for hex digits in made-up texts.
HEX = "0123456789abcdef"
LETTERS = "ACDEFGHIKLMNPQRS"
BASES = "ACGTACGTACGTACGT"
NEW_LETTERS = "ACDEFGHIKLMNPQRSTVWY*"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Together these tell the rows of `lineitem` apart; a line number alone repeats.
LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def letters_of(key: Column) -> Column:
    return F.concat(F.lit("M"), F.translate(F.md5(key), HEX, LETTERS))


def pair_view(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs out of `part`: the same text, a substitution, a stop, a truncation, an extension."""
    ref, pos = F.col("ref_seq"), F.col("pos")

    def replaced(letter: str) -> Column:
        return F.overlay(ref, F.lit(letter), pos, F.lit(1))

    kind = F.col("p_partkey") % 5
    return (
        spread_scan(table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice"))
        .withColumns({
            "pos": (F.col("p_partkey") % 32).cast("int") + 1, "ref_seq": letters_of(F.col("p_brand"))})
        .select(
            F.col("p_partkey").alias("pair_id"), F.col("p_brand").alias("grp"),
            F.col("p_retailprice").alias("score"), "ref_seq",
            F.when(kind == 0, ref).when(kind == 1, replaced("W")).when(kind == 2, replaced("*"))
            .when(kind == 3, F.substring(ref, F.lit(1), pos)).otherwise(F.concat(ref, F.lit("WW")))
            .alias("var_seq"),
        )
    )


PAIRS = f"""(
  SELECT p_partkey AS pair_id, p_brand AS grp, p_retailprice AS score, ref_seq,
         CASE p_partkey % 5 WHEN 0 THEN ref_seq
           WHEN 1 THEN substr(ref_seq, 1, pos - 1) || 'W' || substr(ref_seq, pos + 1)
           WHEN 2 THEN substr(ref_seq, 1, pos - 1) || '*' || substr(ref_seq, pos + 1)
           WHEN 3 THEN substr(ref_seq, 1, pos) ELSE ref_seq || 'WW' END AS var_seq
  FROM (SELECT *, CAST(p_partkey % 32 AS INT) + 1 AS pos,
               'M' || translate(md5(p_brand), '{HEX}', '{LETTERS}') AS ref_seq FROM part))"""


def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn of a conversation next to the turn that follows it."""
    turns = table(spark, sf, "conversations")
    later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("var_seq"))
    return turns.select("conv_id", "turn", "role", F.col("text").alias("ref_seq")).join(
        later, ["conv_id", "turn"])


TURNS = """(
  SELECT a.conv_id, a.turn, a.role, a.text AS ref_seq, b.text AS var_seq
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def assay_view(spark: SparkSession, sf: str) -> DataFrame:
    """The assays of `scored_view`, each with its reference text."""
    suppliers = table(spark, sf, "lineitem").select("l_suppkey").distinct()
    return suppliers.select(_assay().alias("assay")).withColumn("ref_seq", letters_of(F.col("assay")))


def _assay() -> Column:
    return F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), F.lit("_N"), (F.col("l_suppkey") % 25).cast("string"))


def _score() -> Column:
    return F.when(F.col("l_tax") < 0.075, F.col("l_extendedprice"))


def price_view(spark: SparkSession, sf: str) -> DataFrame:
    """Assays and scores of the rows of `scored_view`, without their texts."""
    return table(spark, sf, "lineitem").select(_assay().alias("assay"), _score().alias("score"))


def scored_view(spark: SparkSession, sf: str) -> DataFrame:
    """Scores out of `lineitem`: one assay per supplier, with edit codes."""
    ref, pos = F.col("ref_seq"), F.col("pos")

    def code(at: Column, letter: Column) -> Column:
        return F.concat(F.substring(ref, at, F.lit(1)), at.cast("string"), letter)

    line = F.col("l_linenumber")
    second = (F.col("l_orderkey") % 33).cast("int") + 1
    first_code = F.when(line == 7, F.concat(F.lit("?"), pos.cast("string"), F.col("letter"))).otherwise(
        code(pos, F.col("letter")))
    columns = " ".join(LINE_KEY) + " l_tax"
    lines = spread_scan(table(spark, sf, "lineitem").select(*columns.split())).withColumn("assay", _assay())
    return (
        with_once(lines, ref_seq=letters_of(F.col("assay")))
        .withColumns({
            "pos": (F.col("l_partkey") % 33).cast("int") + 1,
            "letter": F.substring(
                F.lit(NEW_LETTERS), (F.col("l_orderkey") % 21).cast("int") + 1, F.lit(1)),
        })
        .select(
            "assay", "ref_seq",
            _score().alias("score"),
            F.when(line.isin(2, 4), F.concat_ws(":", first_code, code(second, F.lit("Y"))))
            .otherwise(first_code).alias("mutant"),
            F.when(line == 1, F.substring(ref, F.lit(1), pos)).alias("mutated_sequence"),
            F.struct(*LINE_KEY).alias("row_no"),
        )
    )


SCORED = f"""(
  SELECT assay, ref_seq, CASE WHEN l_tax < 0.075 THEN l_extendedprice END AS score,
         CASE WHEN l_linenumber = 7 THEN '?' ELSE substr(ref_seq, pos, 1) END || pos || letter
         || CASE WHEN l_linenumber IN (2, 4)
              THEN ':' || substr(ref_seq, pos2, 1) || pos2 || 'Y' ELSE '' END AS mutant,
         CASE WHEN l_linenumber = 1 THEN substr(ref_seq, 1, pos) END AS mutated_sequence,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM (SELECT *, 'M' || translate(md5(assay), '{HEX}', '{LETTERS}') AS ref_seq,
               CAST(l_partkey % 33 AS INT) + 1 AS pos, CAST(l_orderkey % 33 AS INT) + 1 AS pos2,
               substr('{NEW_LETTERS}', CAST(l_orderkey % 21 AS INT) + 1, 1) AS letter
        FROM (SELECT *, 'S' || l_suppkey || '_N' || (l_suppkey % 25) AS assay FROM lineitem)))"""

# The edited text of a row of SCORED, as SQL.
EDITED = """coalesce(mutated_sequence, list_reduce(
    list_concat([ref_seq], list_filter(string_split_regex(mutant, '[:;]'), lambda m: len(m) >= 3)),
    lambda t, m: CASE WHEN try_cast(substr(m, 2, len(m) - 2) AS INT) BETWEEN 1 AND len(t)
        AND substr(t, try_cast(substr(m, 2, len(m) - 2) AS INT), 1) = m[1]
      THEN substr(t, 1, try_cast(substr(m, 2, len(m) - 2) AS INT) - 1) || m[-1]
           || substr(t, try_cast(substr(m, 2, len(m) - 2) AS INT) + 1) ELSE t END))"""


def labelled_view(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs out of `scored_view` with a label from fixed price bounds."""
    price = F.col("score")
    variant = build_variant("ref_seq", "mutant", "mutated_sequence")
    return with_once(scored_view(spark, sf), var_seq=variant).select(
        F.col("assay").alias("gene"), F.element_at(F.split("assay", "_"), -1).alias("species"),
        "ref_seq", "var_seq",
        F.when(price < 20000, 0).when(price > 60000, 2).otherwise(1).cast("int").alias("label"),
        "row_no",
    )


LABELLED = f"""(
  SELECT assay AS gene, split_part(assay, '_', 2) AS species, ref_seq, {EDITED} AS var_seq,
         CASE WHEN score < 20000 THEN 0 WHEN score > 60000 THEN 2 ELSE 1 END AS label,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM {SCORED})"""
ROW_ORDER = ", ".join(LINE_KEY)


def dna_of(key: Column, parts: str = "abc") -> Column:
    """A text over the four bases, 32 characters for each part."""
    return F.concat(*(
        F.translate(F.md5(F.concat(key.cast("string"), F.lit(p))), HEX, BASES) for p in parts))


def dna_sql(key: str, parts: str = "abc") -> str:
    return " || ".join(f"translate(md5(CAST({key} AS VARCHAR) || '{p}'), '{HEX}', '{BASES}')" for p in parts)


def translate_sql(text: str) -> str:
    """SQL that translates a text over the four bases."""
    def base(i: int) -> str:
        return f"(instr('TCAG', substr({text}, CAST(3 * i + {i} AS INT), 1)) - 1)"

    return (
        f"array_to_string(list_transform(range(0, len({text}) // 3), lambda i: "
        f"substr('{CODON_PRODUCTS}', CAST(16 * {base(1)} + 4 * {base(2)} + {base(3)} + 1 AS INT), 1)), '')")


def gene_view(spark: SparkSession, sf: str) -> DataFrame:
    """Reference texts, one per part."""
    return spread_scan(table(spark, sf, "part").select("p_partkey")).select(
        F.col("p_partkey").cast("string").alias("id"), dna_of(F.col("p_partkey")).alias("seq"))


GENES = f"(SELECT CAST(p_partkey AS VARCHAR) AS id, {dna_sql('p_partkey')} AS seq FROM part)"


def variant_view(spark: SparkSession, sf: str) -> DataFrame:
    """Variants out of `lineitem`: substitutions, insertions, deletions and others."""
    kind = F.col("l_linenumber") % 4
    base = F.substring(F.lit("ACGT"), (F.col("l_suppkey") % 4).cast("int") + 1, F.lit(1))
    several = (F.col("l_returnflag") == "R") & (F.col("l_tax") < 0.005)
    columns = " ".join(LINE_KEY) + " l_returnflag l_tax"
    lines = spread_scan(table(spark, sf, "lineitem").select(*columns.split()))
    return with_once(
        lines,
        chrom=F.col("l_partkey").cast("string"),
        ref=F.when(kind == 2, F.lit("CGT")).when(kind == 3, F.lit("AC")).otherwise(F.lit("C")),
        alt=F.when(several, F.lit("A,T")).when(kind == 1, F.concat(F.lit("C"), base, base))
        .when(kind == 3, F.lit("GG")).otherwise(base),
    ).select("chrom", (F.col("l_orderkey") % 60).alias("pos"), "ref", "alt", F.struct(*LINE_KEY).alias("row_no"))


VARIANTS = """(
  SELECT CAST(l_partkey AS VARCHAR) AS chrom, l_orderkey % 60 AS pos,
         CASE l_linenumber % 4 WHEN 2 THEN 'CGT' WHEN 3 THEN 'AC' ELSE 'C' END AS ref,
         CASE WHEN l_returnflag = 'R' AND l_tax < 0.005 THEN 'A,T'
              WHEN l_linenumber % 4 = 1 THEN 'C' || base || base
              WHEN l_linenumber % 4 = 3 THEN 'GG' ELSE base END AS alt,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM (SELECT *, substr('ACGT', CAST(l_suppkey % 4 AS INT) + 1, 1) AS base FROM lineitem))"""


def scored_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as evaluation rows: class, three logits, a target and a prediction.

    Every component counts, in whole thousandths, so that sums don't depend on
    their order: each logit has every third one, target and prediction have the
    halves.
    """
    def total(kept: str) -> Column:
        return F.expr(
            f"aggregate(filter(_units, (x, i) -> {kept}), 0L, (t, x) -> t + x)").cast("double")

    units = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("bigint"))
    return table(spark, sf, "embeddings").withColumn("_units", units).select(
        "vec_id", (F.col("label") % 3).cast("int").alias("label"),
        F.array(*(total(f"i % 3 = {k}") / 500 for k in range(3))).alias("logits"),
        F.round(total("i < 32") / 1000, 1).alias("target"), F.round(total("i >= 32") / 1000, 1).alias("predicted"),
        F.when(F.col("label") < 2, "a").otherwise("b").alias("method"),
    )


VECTORS = """(
  SELECT vec_id, CAST(label % 3 AS INT) AS label,
         list_transform([0, 1, 2], lambda k: CAST(list_sum(list_transform(range(1, 23),
           lambda j: coalesce(units[3 * (j - 1) + k + 1], 0))) AS DOUBLE) / 500) AS logits,
         round(CAST(list_sum(units[1:32]) AS DOUBLE) / 1000, 1) AS target,
         round(CAST(list_sum(units[33:]) AS DOUBLE) / 1000, 1) AS predicted,
         CASE WHEN label < 2 THEN 'a' ELSE 'b' END AS method
  FROM (SELECT *, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS units
        FROM embeddings))"""

# Rows of VECTORS with probabilities, a predicted class and its confidence.
SCORED_VECTORS = f"""(
  SELECT *, list_position(probabilities, list_max(probabilities)) - 1 AS prediction FROM (
    SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))
        / list_sum(list_transform(logits, lambda y: exp(y - list_max(logits))))) AS probabilities
    FROM {VECTORS}))"""
