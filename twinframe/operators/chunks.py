"""Long texts as chunks: no row, task or message ever holds a whole text.

A chunk table has one row per key and chunk: `chunk` counts from 0, and each but
the last of a key has exactly `size` characters. An empty text has one empty
chunk. `size` is a multiple of three, so that codons never lie across a border.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import (
    EXTENSION,
    MISSENSE,
    NONSENSE,
    STOP,
    TRUNCATION,
    find_edits_sql,
    region_sql,
    strip_blanks,
    translate,
)
from ..session import materialize
from ..sources.files import file_order
from .assemble import applicable_variants, edit_part, reduced_edits
from .features import FEATURES, START
from .spread import lookup_join, running_totals

SIZE = 3 << 14
# Texts of so many chunks may be a large part of a table.
MANY_CHUNKS = 1000


def _checked(size: int) -> int:
    if size < 3 or size % 3:
        raise ValueError(f"Chunks have a multiple of three characters, not {size}")
    return size


def recut(pieces: DataFrame, key: str, order: str, text: str = "text", size: int = SIZE) -> DataFrame:
    """Chunks `(key, chunk, text)` of the texts that the pieces of each key make up in `order`.

    Pieces may have any length, null ones count as empty. Where each begins
    comes from running totals over ranges of pieces; then every piece is cut at
    the chunks' borders, and a chunk gathers at most `size` characters.
    """
    _checked(size)
    parts = F.posexplode(F.regexp_extract_all(
        F.coalesce(text, F.lit("")), F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))
    short = pieces.select(F.col(key), F.col(order).alias("_order"), parts.alias("_at", "_text")).select(
        key, F.struct("_order", "_at").alias("_order"), "_text", F.length("_text").alias("_n"))
    begun = F.col("_n_before")
    placed = running_totals(short, [key], "_order", ["_n"])
    cut = placed.withColumn("chunk", F.explode(F.sequence(
        F.floor(begun / size), F.floor((begun + F.col("_n") - 1) / size))))
    low = F.greatest(F.col("chunk") * size, begun)
    high = F.least((F.col("chunk") + 1) * size, begun + F.col("_n"))
    inside = F.substring(F.col("_text"), (low - begun + 1).cast("int"), (high - low).cast("int"))
    full = cut.select(key, "chunk", F.struct(low.alias("at"), inside.alias("part")).alias("_part")).groupBy(
        key, "chunk").agg(F.array_join(
            F.transform(F.sort_array(F.collect_list("_part")), lambda p: p["part"]), "").alias("text"))
    return full.unionByName(_empty(pieces, key, F.length(F.col(text))))


def _empty(pieces: DataFrame, key: str, length: Column) -> DataFrame:
    """The one chunk of each key whose pieces are all empty."""
    return pieces.groupBy(key).agg(F.max(F.coalesce(length, F.lit(0))).alias("_n")).filter("_n = 0").select(
        key, F.lit(0).cast("long").alias("chunk"), F.lit("").alias("text"))


def cut_texts(texts: DataFrame, key: str = "id", text: str = "seq", size: int = SIZE) -> DataFrame:
    """Chunks `(key, chunk, text)` of texts that are one row each, without a shuffle; null texts have none."""
    _checked(size)
    parts = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    kept = F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(parts)
    return texts.select(key, F.posexplode(kept).alias("chunk", "text")).withColumn("chunk", F.col("chunk").cast("long"))


def whole_texts(chunks: DataFrame, key: str = "id") -> DataFrame:
    """`(key, text)`: the texts again, one row each; for texts that a row can hold."""
    return chunks.groupBy(key).agg(F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("chunk", "text"))), lambda p: p["text"]), "").alias("text"))


def fasta_chunks(lines: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """Records of FASTA files, by their lines `(file, line, value)`: `(record, id)` and `(record, chunk, text)`.

    `line` orders the lines of a file. A record is a struct of the file and the
    number of header marks before it, which running totals give, so a record may
    lie in any number of tasks. The first line of a file is a header with or
    without its mark. Records with neither an id nor a text are left out.
    """
    marked = lines.withColumn("_mark", F.startswith("value", F.lit(">")).cast("int"))
    numbered = materialize(running_totals(marked, ["file"], "line", ["_mark"]).select(
        F.struct("file", (F.col("_mark_before") + F.col("_mark")).alias("number")).alias("record"),
        "line", "_mark", "value"), "lines")
    unmarked = numbered.filter(F.col("record.number") == 0).groupBy("record").agg(F.min("line").alias("_first"))
    numbered = lookup_join(numbered, unmarked, ["record"]).withColumn(
        "header", (F.col("_mark") == 1) | F.coalesce(F.col("line") == F.col("_first"), F.lit(False)))
    headers = numbered.filter("header").select(
        "record", F.regexp_extract(strip_blanks("value"), r"^>?\s*(\S*)", 1).alias("id"))
    body = numbered.select(
        "record", "line", F.when(F.col("header"), "").otherwise(
            F.upper(F.regexp_replace("value", r"\s", ""))).alias("text"))
    chunks = materialize(recut(body, "record", "line", size=size), "chunks")
    filled = chunks.filter(F.length("text") > 0).select("record").distinct()
    named = headers.filter(F.length("id") > 0)
    kept = named.unionByName(headers.filter(F.length("id") == 0).join(filled, "record", "left_semi"))
    return kept, chunks.join(kept.select("record"), "record", "left_semi")


def read_fasta_chunks(spark: SparkSession, path: str, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """`fasta_chunks` of files; a file is split at line ends, wherever its records begin."""
    lines = spark.read.text(path).select("value", file_order().alias("line"))
    return fasta_chunks(lines.select(F.col("line.file").alias("file"), "line", "value"), size)


_OPERATIONS = "at array<long>, remove array<long>, insert array<string>, rest array<boolean>"


def _applied(chunks: DataFrame, strict: bool, inner: bool) -> DataFrame:
    """`chunks(gene, chunk, last, text, at, remove, insert, rest)` after these operations, with those left for the next chunk."""
    names = ["gene", "chunk", "last", "text", "at", "remove", "insert", "rest"]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.bool_())]

    def run(batches):
        for batch in batches:
            texts, left = [], ([], [], [], [])
            lists = [batch.column(i).to_pylist() for i in range(4, 8)]
            for text, last, *operations in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), *lists):
                edited, passed = edit_part(text, zip(*operations), last, strict, inner)
                texts.append(edited)
                for column, values in zip(left, zip(*passed) if passed else [()] * 4):
                    column.append(list(values))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(texts, pa.string()), *map(pa.array, left, kinds)], names)

    return chunks.select(*names).mapInArrow(
        run, f"gene string, chunk long, last boolean, text string, {_OPERATIONS}")


def edit_chunks(
    located: DataFrame, chunks: DataFrame, order: str = "row_no", strict: bool = True, size: int = SIZE,
) -> DataFrame:
    """Apply located variants to the chunks `(id, chunk, text)` of their genes: `(gene, chunk, text)`, cut anew.

    Gives the texts that `apply_variants` gives, for genes that have variants. An
    edit goes to the chunk that its position lies in, so a task holds the edits
    and the text of one chunk. What a chunk's edits do beyond its border is
    passed on to the next chunk, after that chunk's own edits, as edits come
    from right to left; a round of passing on is needed for every further chunk
    that one deletion reaches. Lengths are added up by running totals at the end.
    """
    _checked(size)
    used = applicable_variants(located)
    sizes = chunks.groupBy(F.col("id").alias("gene")).agg(
        F.max("chunk").alias("final"), F.count(F.lit(1)).alias("rows"))
    counted = used.groupBy("gene").agg(F.count(F.lit(1)).alias("edits"))
    sizes = materialize(sizes.join(counted, "gene"), "sizes")
    texts = lookup_join(chunks.withColumnRenamed("id", "gene"), sizes.drop("edits"), ["gene"], "rows", "inner")
    texts = materialize(texts.select("gene", "chunk", (F.col("chunk") == F.col("final")).alias("last"), "text"), "texts")
    placed = lookup_join(reduced_edits(used, order), sizes.drop("rows"), ["gene"], "edits", "inner")
    lists = _edit_lists(placed, order, size)
    on = ["gene", "chunk"]
    rounds = [materialize(_applied(texts.join(lists, on), strict, True), "edited")]
    while True:
        passed = rounds[-1].filter(F.size("at") > 0).select(
            "gene", (F.col("chunk") + 1).alias("chunk"), "at", "remove", "insert", "rest")
        if passed.isEmpty():
            break
        now = texts.withColumnRenamed("text", "_text").join(passed, on).join(_latest(rounds), on, "left")
        now = now.withColumn("text", F.coalesce("text", "_text")).drop("_text")
        rounds.append(materialize(_applied(now, strict, False), "edited"))
    edited = texts.withColumnRenamed("text", "_text").join(_latest(rounds), on, "left").select(
        *on, F.coalesce("text", "_text").alias("text"))
    return recut(edited, "gene", "chunk", size=size)


def _edit_lists(edits: DataFrame, order: str, size: int) -> DataFrame:
    """The operations of every chunk that has some, from right to left, as flat lists."""
    removed, alt = F.col("ref_size"), F.col("alt")
    added = F.length(alt)
    single = (removed == 1) & (added == 1)
    chunk = F.greatest(F.lit(0).cast("long"), F.least(F.floor(F.col("pos") / size), F.col("final")))
    at = F.when(single, F.col("pos")).otherwise(F.col("pos") + F.least(removed, added))
    changing = edits.filter(single | (removed != added)).select(
        "gene", chunk.alias("chunk"), F.struct(
            (-F.col("pos")).alias("back"), F.col(order).alias("order"), (at - chunk * size).alias("at"),
            F.when(single, 1).otherwise(F.greatest(removed - added, F.lit(0))).cast("long").alias("remove"),
            F.upper(F.when(single, alt).otherwise(F.substring(alt, removed + 1, added))).alias("insert"),
        ).alias("_edit"))
    sorted_ = changing.groupBy("gene", "chunk").agg(F.sort_array(F.collect_list("_edit")).alias("_edits"))
    return sorted_.select(
        "gene", "chunk", F.col("_edits.at").alias("at"), F.col("_edits.remove").alias("remove"),
        F.col("_edits.insert").alias("insert"), F.transform("_edits", lambda e: F.lit(False)).alias("rest"))


def _latest(rounds: list[DataFrame]) -> DataFrame:
    """The text of every chunk after its last round."""
    every = None
    for i, done in enumerate(rounds):
        own = done.select("gene", "chunk", F.lit(i).alias("_round"), "text")
        every = own if every is None else every.unionByName(own)
    return every.groupBy("gene", "chunk").agg(F.max_by("text", "_round").alias("text"))


def translate_chunks(chunks: DataFrame, key: str = "id", to_stop: bool = False, size: int = SIZE) -> DataFrame:
    """Chunks `(key, chunk, text)` of the translations, a third as long; see `functions.sequence.translate`.

    A letter outside the alphabet makes the whole translation empty, and with
    `to_stop` it ends before the first stop: both are one value per key, found
    over its chunks first. Chunks behind the end are left out, the first one is not.
    """
    return ended_products(chunk_products(chunks, key), key, to_stop, size)


def chunk_products(chunks: DataFrame, key: str = "id") -> DataFrame:
    """The stored translation of every chunk by itself, for `ended_products` to read as often as it is called."""
    return materialize(
        chunks.select(key, "chunk", F.length("text").alias("_n"), translate("text").alias("text")), "products")


def ended_products(products: DataFrame, key: str = "id", to_stop: bool = False, size: int = SIZE) -> DataFrame:
    """What `translate_chunks` gives, from `chunk_products`.

    Facts are looked up for keys that have something to cut, and for keys of many
    rows, whose number tells `lookup_join` which ones to deal out.
    """
    third = _checked(size) // 3
    stop = F.instr("text", STOP)
    facts = products.groupBy(key).agg(
        F.max((F.col("_n") >= 3) & (F.col("text") == "")).alias("_bad"),
        F.min(F.when((stop > 0) & F.lit(to_stop), F.col("chunk") * third + stop)).alias("_stop"),
        F.count(F.lit(1)).alias("_rows"))
    needed = F.col("_bad") | F.col("_stop").isNotNull() | (F.col("_rows") >= MANY_CHUNKS)
    joined = lookup_join(products, facts.filter(needed), [key], "_rows")
    kept = F.col("text")
    if to_stop:
        left = F.greatest(F.lit(0).cast("long"), F.col("_stop") - 1 - F.col("chunk") * third)
        kept = F.when(F.col("_stop").isNull(), kept).otherwise(F.substring(kept, F.lit(1), left.cast("int")))
    return joined.select(key, "chunk", F.when(F.col("_bad"), "").otherwise(kept).alias("text")).filter(
        (F.length("text") > 0) | (F.col("chunk") == 0))


def pair_states(refs: DataFrame, variants: DataFrame, key: str = "id", size: int = SIZE) -> DataFrame:
    """One row of counts per key and chunk of a pair of chunked texts; `merged_states` adds them up.

    Positions are compared chunk by chunk. Regions depend on the whole length,
    which is summed first. The event of the shorter text's end belongs to the
    chunk in which that end lies.
    """
    _checked(size)
    pairs = refs.select(key, "chunk", F.col("text").alias("ref")).join(
        variants.select(key, "chunk", F.col("text").alias("var")), [key, "chunk"], "full").select(
        key, "chunk", F.coalesce("ref", F.lit("")).alias("ref"), F.coalesce("var", F.lit("")).alias("var"))
    pairs = materialize(pairs, "pairs")
    lengths = pairs.groupBy(key).agg(
        F.sum(F.length("ref").cast("long")).alias("_ref_n"), F.sum(F.length("var").cast("long")).alias("_var_n"),
        F.count(F.lit(1)).alias("_rows"))
    pairs = lookup_join(pairs, lengths, [key], "_rows")
    begun = F.col("chunk") * size
    ends_here = F.floor(F.least("_ref_n", "_var_n") / size) == F.col("chunk")
    edits = F.filter(F.expr(find_edits_sql("ref", "var")), lambda e: ends_here | ~e["type"].isin(TRUNCATION, EXTENSION))
    pairs = pairs.withColumns({"_edits": edits, "_begun": begun})
    length = "greatest(_ref_n, 1L)"

    def count(condition: str) -> Column:
        return F.expr(f"CAST(size(filter(_edits, edit__ -> {condition})) AS bigint)")

    def stop(text: str) -> Column:
        return F.when(F.instr(text, STOP) > 0, begun + F.instr(text, STOP))

    place = "(edit__.position + _begun)"
    return pairs.select(
        key, F.length("ref").cast("long").alias("ref_size"), F.length("var").cast("long").alias("var_size"),
        stop("ref").alias("ref_stop"), stop("var").alias("var_stop"),
        F.when(F.col("chunk") == 0, F.startswith("ref", F.lit(START)) & ~F.startswith("var", F.lit(START))).alias("start_lost"),
        F.size("_edits").cast("long").alias("edits"), count(f"edit__.type = '{MISSENSE}'").alias("missense"),
        count(f"edit__.type = '{NONSENSE}'").alias("nonsense"),
        count(f"edit__.type NOT IN ('{TRUNCATION}', '{EXTENSION}')").alias("differing"),
        count(f"{region_sql(place, length)} = 'N-terminal'").alias("n_terminal"),
        count(f"{region_sql(place, length)} = 'C-terminal'").alias("c_terminal"))


def merged_states(states: DataFrame, key: str = "id") -> DataFrame:
    """States of parts of a pair as one: sizes and counts add up, of stops the first counts; in any order and grouping."""
    summed = "ref_size var_size edits missense nonsense differing n_terminal c_terminal".split()
    return states.groupBy(key).agg(
        *(F.sum(c).alias(c) for c in summed), F.min("ref_stop").alias("ref_stop"),
        F.min("var_stop").alias("var_stop"), F.max("start_lost").alias("start_lost"))


def state_features(states: DataFrame, key: str = "id") -> DataFrame:
    """The twelve features of `features.pair_features`, from merged states."""
    length, total = "greatest(ref_size, 1)", "edits"
    ref_end, var_end = "coalesce(ref_stop - 1, ref_size)", "coalesce(var_stop - 1, var_size)"
    longer = "greatest(ref_size, var_size)"
    values = (
        "CAST(var_size <> ref_size AS double)",
        "CAST(var_stop IS NOT NULL AND (ref_stop IS NULL OR var_stop < ref_stop) AS double)",
        "CAST(coalesce(start_lost, false) AS double)",
        f"missense / {length}",
        "CAST(nonsense AS double)",
        f"1 - if({longer} = 0, 1D, (least(ref_size, var_size) - differing) / {longer})",
        f"if({var_end} < {ref_end}, ({ref_end} - {var_end}) / {ref_end}, 0D)",
        f"{total} / {length} * 100",
        f"if({total} > 0, n_terminal / {total}, 0D)",
        f"if({total} > 0, c_terminal / {total}, 0D)",
        f"log1p({total})",
        f"var_size / {length}",
    )
    return states.select(key, *(F.expr(value).alias(name) for name, value in zip(FEATURES, values)))
