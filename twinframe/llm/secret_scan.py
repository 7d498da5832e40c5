"""Secret scans over every version of every text, kept by an incremental ledger of blobs.

A version is addressed by the SHA-256 of its content. The ledger holds the pairs
(blob, rules) that were scanned; only unseen pairs are scanned, once however
many paths hold the blob, and findings are joined back to all paths. All of it
is DataFrame operations.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

LEDGER_SCHEMA = "blob binary, rules string"
FINDINGS_SCHEMA = "blob binary, rules string, kind string, start long, stop long"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regular expression, whose matches fail if a group is too short."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hint: str | None = None  # a literal that every match holds


# The base kinds, in their fixed order.
BASE_RULES = (
    Rule("assign",
         r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)
# Kinds that are found besides.
MORE_RULES = (
    Rule("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
)
RULES = BASE_RULES + MORE_RULES


def rules_version(rules: tuple[Rule, ...]) -> str:
    """Names a set of rules by its content."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def address(versions: DataFrame, text: str = "text") -> Column:
    """The content address of a version; a null text is the empty blob."""
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))


def _matches(rule: Rule, text: str = "t") -> Column:
    """Array of (gap, width, ok) for all leftmost matches: code points before, in, and validity."""
    sql = "'" + rule.pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    found = F.expr(f"regexp_extract_all({text}, {sql}, 0)")
    tested = F.expr(f"regexp_extract_all({text}, {sql}, {rule.group})") if rule.group else found
    gaps = F.expr(f"split({text}, {sql}, -1)")
    made = F.transform(F.arrays_zip(
        F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("found"), tested.alias("tested")),
        lambda m: F.struct(
            F.length(m["gap"]).cast("long").alias("gap"), F.length(m["found"]).cast("long").alias("width"),
            (F.length(m["tested"]) >= rule.least).alias("ok")))
    hit = F.expr(f"{text} LIKE '%{rule.hint}%'") if rule.hint else F.expr(f"{text} RLIKE {sql}")
    return F.when(hit, made)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`(blob, kind, start, stop)` of `blobs(blob, t)`, each blob once.

    Spans are whole matches in code points, the end excluded; matches of a kind
    do not overlap. Positions are running sums over the matches of one blob and
    kind, which hold no text.
    """
    found = blobs.select("blob", F.explode(F.array(*[
        F.struct(F.lit(r.kind).alias("kind"), _matches(r).alias("m")) for r in rules])).alias("k"))
    each = found.select("blob", "k.kind", F.posexplode("k.m").alias("n", "m"))
    before = Window.partitionBy("blob", "kind").orderBy("n")
    stop = F.sum(F.col("m.gap") + F.col("m.width")).over(before)
    return each.withColumn("stop", stop).filter("m.ok").select(
        "blob", "kind", (F.col("stop") - F.col("m.width")).alias("start"), "stop")


@dataclass
class Ledger:
    """What was scanned and found so far; start from `empty_ledger`."""

    seen: DataFrame
    findings: DataFrame


def empty_ledger(spark: SparkSession) -> Ledger:
    return Ledger(spark.createDataFrame([], LEDGER_SCHEMA), spark.createDataFrame([], FINDINGS_SCHEMA))


def scan_unseen(
    versions: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES,
    text: str = "text",
) -> Ledger:
    """The ledger after scanning the contents in `versions` that it has not seen under these rules.

    Without a ledger all contents are unseen. Repeated and null versions cost one
    scan, of the empty text for nulls. New rules have a new version, so every
    blob is then scanned again; old findings stay under the old version.
    """
    version = F.lit(rules_version(rules))
    content = versions.select(
        address(versions, text).alias("blob"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    if ledger is not None:
        content = content.join(
            ledger.seen.filter(F.col("rules") == version), "blob", "left_anti")
    # One copy of each blob, of which the map side drops its repeats before the shuffle.
    found = materialize(
        scan(content.dropDuplicates(["blob"]), rules).withColumn("rules", version), "findings")
    seen = materialize(content.select("blob").distinct().withColumn("rules", version), "ledger")
    found = found.select("blob", "rules", "kind", "start", "stop")
    if ledger is None:
        return Ledger(seen, found)
    return Ledger(ledger.seen.union(seen), ledger.findings.union(found))


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished commits of a ledger, the oldest name first; one short name per commit reaches the driver."""
    place, system = _files(spark, f"{path}/seen")
    if not system.exists(place):
        return []
    return sorted(
        entry.getPath().getName().removeprefix("commit=") for entry in system.listStatus(place)
        if system.exists(spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")))


def read_ledger(spark: SparkSession, path: str) -> Ledger:
    """The ledger stored under `path` in the shared folder, empty if there is none; unfinished commits don't count."""
    names = _commits(spark, path)
    if not names:
        return empty_ledger(spark)
    seen, findings = (
        spark.read.schema(schema).parquet(*(f"{path}/{part}/commit={name}" for name in names))
        for part, schema in (("seen", LEDGER_SCHEMA), ("findings", FINDINGS_SCHEMA)))
    return Ledger(seen, findings)


def commit(
    versions: DataFrame, path: str, name: str, rules: tuple[Rule, ...] = RULES, text: str = "text",
) -> Ledger:
    """Scan what the ledger under `path` has not seen and add it as the commit `name`; gives the whole ledger.

    Findings are written first and the seen pairs last, whose finished folder
    makes the commit. A commit that broke off can be repeated, as it overwrites
    its own folders only; one that is finished is not done again. Commits are
    made one after the other.
    """
    spark = versions.sparkSession
    if name not in _commits(spark, path):
        version = F.lit(rules_version(rules))
        content = versions.select(
            address(versions, text).alias("blob"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
        known = read_ledger(spark, path).seen.filter(F.col("rules") == version)
        unseen = content.join(known, "blob", "left_anti")
        found = scan(unseen.dropDuplicates(["blob"]), rules).withColumn("rules", version)
        found.select("blob", "rules", "kind", "start", "stop").write.mode("overwrite").parquet(
            f"{path}/findings/commit={name}")
        unseen.select("blob").distinct().withColumn("rules", version).write.mode("overwrite").parquet(
            f"{path}/seen/commit={name}")
    return read_ledger(spark, path)


def spans_by_blob(ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`(blob, spans)` of the ledger under these rules: array of (start, place, kind, stop) in order."""
    place = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    return (
        ledger.findings.filter(F.col("rules") == rules_version(rules)).groupBy("blob")
        .agg(F.array_sort(F.collect_list(F.struct(
            "start", place[F.col("kind")].alias("place"), "kind", "stop"))).alias("spans")))


def paths_with_spans(
    versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, text: str = "text",
) -> DataFrame:
    """`versions` with `spans`, null where there is none; one row per row, a column of the name is replaced."""
    blob = "_blob"
    while blob in versions.columns:
        blob += "_"
    return (
        versions.drop("spans").withColumn(blob, address(versions, text))
        .join(spans_by_blob(ledger, rules).withColumnRenamed("blob", blob), blob, "left").drop(blob))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch of overlapping spans replaced by a mark; null stays null."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(s: Column, x: Column) -> Column:
        piece = F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        return F.when(x["start"] >= s["at"], F.struct(
            x["stop"].alias("at"), F.concat(s["parts"], F.array(piece, F.lit(mark))).alias("parts"),
        )).otherwise(F.struct(F.greatest(s["at"], x["stop"]).alias("at"), s["parts"].alias("parts")))

    done = F.aggregate(spans, state, add, lambda s: F.concat(
        F.array_join(s["parts"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    return F.when(spans.isNull() | (F.size(spans) == 0), text).otherwise(done)


__all__ = [
    "BASE_RULES", "RULES", "Ledger", "Rule", "address", "commit", "empty_ledger", "paths_with_spans", "read_ledger",
    "redacted", "rules_version", "scan", "scan_unseen", "spans_by_blob",
]
