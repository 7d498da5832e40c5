"""Assembly of edited texts from references and variants."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequence import drop_stops, is_nucleotide, translate, translated
from ..session import materialize
from .spread import SPLIT, lookup_join

# Intervals are cut into aligned blocks of 8**level positions, at most 14 of a
# level. Ten levels reach over 2**30 positions, and longer intervals only take
# more top blocks.
RADIX_BITS = 3
LEVELS = 10
# Genes are counted by so many hashes; where more rows have one, its substitutions are reduced ahead.
GENE_BUCKETS, HEAVY_ROWS = 1 << 16, 100_000
# Up to so many characters it is cheaper to copy a text for an edit than to keep it in pieces.
SHORT_TEXT = 4096


def interval_blocks(intervals: DataFrame) -> DataFrame:
    """Every row of `intervals` once for each of the fewest aligned blocks that make up `[start, end)`.

    Adds `level` and `block`. On each level the blocks are those inside the
    interval that no block of the next level covers, so there are at most two
    runs of them. Empty intervals have no blocks.
    """
    def up(level: str) -> str:  # shifts round down, for negative positions too
        return f"-shiftright(-CAST(start AS bigint), {RADIX_BITS} * ({level}))"

    def down(level: str) -> str:
        return f"shiftright(CAST(end AS bigint), {RADIX_BITS} * ({level}))"

    columns = [f"`{c}`" for c in intervals.columns]
    inside = (
        intervals.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
        .selectExpr(*columns, "level", f"{up('level')} AS _low", f"{down('level')} AS _high",
                    f"{up('level + 1')} AS _low_next", f"{down('level + 1')} AS _high_next")
        .filter("_low < _high"))
    covered = f"level < {LEVELS - 1} AND _low_next < _high_next"
    runs = f"""inline(array(
        struct(_low AS _from, if({covered}, shiftleft(_low_next, {RADIX_BITS}), _high) AS _to),
        struct(if({covered}, shiftleft(_high_next, {RADIX_BITS}), _high) AS _from, _high AS _to)))"""
    return (
        inside.selectExpr(*columns, "level", runs).filter("_from < _to")
        .selectExpr(*columns, "level", "explode(sequence(_from, _to - 1)) AS block"))


POINT, START, END, COVER = range(4)


def first_covering(points: DataFrame, intervals: DataFrame, space: str = "chrom") -> DataFrame:
    """For each distinct point the first interval in order that covers it.

    `points` has `space` and `pos`; `intervals` has `space`, `start`, `end`
    (half-open), a number `ord` and value columns. Gives `space`, `pos`, `n` (how
    many rows of `points` share it) and `hit`, a struct of ord, start and the
    values, null for a point that no interval covers or whose fields are null.

    Points and both ends of all intervals are dealt out in ranges, and each
    range is swept once, batch by batch in the order of positions; held are only
    those open intervals of which no earlier one in order ends as late. An
    interval that reaches into a range from the left and ends there is known by
    its end; of those that cover a whole range only the first counts. So an
    interval is in two rows, however long it is. The driver gets one position
    per range, of which there are as many as shuffle partitions.
    """
    values = [c for c in intervals.columns if c not in (space, "start", "end", "ord")]
    hit = F.struct("ord", "start", *values)
    spans = intervals.filter((F.col("start") < F.col("end")) & F.col(space).isNotNull()).select(
        space, F.col("start").cast("long").alias("low"), F.col("end").cast("long").alias("high"), hit.alias("hit"))
    none = F.lit(None).cast("long")
    asked = points.groupBy(space, "pos").agg(F.count(F.lit(1)).alias("n")).select(
        space, F.col("pos").cast("long").alias("pos"), F.lit(POINT).alias("kind"), "n", none.alias("low"),
        none.alias("high"), F.lit(None).cast(spans.schema["hit"].dataType).alias("hit"))
    ends = spans.select("*", F.explode(F.array(
        F.struct(F.col("low").alias("pos"), F.lit(START).alias("kind")),
        F.struct(F.col("high").alias("pos"), F.lit(END).alias("kind")))).alias("_end"))
    rows = asked.unionByName(ends.select(space, "_end.*", none.alias("n"), "low", "high", "hit"))
    ranged = materialize(
        rows.repartitionByRange(space, "pos").withColumn("_range", F.spark_partition_id()), "ranges")
    first = ranged.groupBy("_range").agg(F.min(F.struct(space, "pos")).alias("_key")).collect()
    begins = sorted((_place(r["_key"][space], r["_key"]["pos"]), r["_range"]) for r in first)
    swept = ranged.unionByName(_covers(ranged, begins, space), allowMissingColumns=True)
    kept = [space, "pos", "n", "hit"]
    names = [*kept, "kind", "low", "high", "_range"]
    schema = ", ".join(f"{f} {ranged.schema[f].dataType.simpleString()}" for f in kept)
    begin_of = {number: place for place, number in begins}

    def run(batches):
        return _sweep(batches, begin_of, kept)

    # What reaches into a range comes first; at one position intervals begin before points are looked up.
    ahead = ~F.col("kind").isin(END, COVER)
    ordered = swept.select(*names).repartition("_range").sortWithinPartitions(
        "_range", ahead, space, "pos", F.desc("kind"))
    found = ordered.mapInArrow(run, schema)
    position = points.schema["pos"].dataType
    return found.withColumn("pos", F.col("pos").cast(position))


def _place(space, pos) -> tuple:
    """A key that Python orders as Spark orders (space, pos), nulls first."""
    return space is not None, "" if space is None else space, float("-inf") if pos is None else pos


def _covers(ranged: DataFrame, begins: list[tuple], space: str) -> DataFrame:
    """For each range that some interval covers whole, the first such interval in order."""
    places = [place for place, _ in begins]
    numbers = [number for _, number in begins]

    def run(batches):
        for batch in batches:
            low = [bisect_right(places, _place(s, p)) for s, p in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            high = [bisect_right(places, _place(s, p)) - 1 for s, p in zip(
                batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            kept = pa.array([i for i, (a, b) in enumerate(zip(low, high)) if a < b], pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(low, pa.int64()).take(kept), pa.array(high, pa.int64()).take(kept), batch.column(3).take(kept)],
                ["start", "end", "hit"])

    kind = ranged.schema["hit"].dataType.simpleString()
    wide = ranged.filter(F.col("kind") == START).select(space, "low", "high", "hit").mapInArrow(
        run, f"start long, end long, hit {kind}")
    blocks = interval_blocks(wide).groupBy("level", "block").agg(F.min_by("hit", "hit.ord").alias("hit"))
    width = F.expr(f"shiftleft(1L, {RADIX_BITS} * level)")
    # Ranges are numbered in their order here, and by their tasks in the table.
    number = ranged.sparkSession.createDataFrame(list(enumerate(numbers)), "_at long, _range int")
    each = blocks.select("hit", F.explode(F.sequence(F.col("block") * width, (F.col("block") + 1) * width - 1)).alias("_at"))
    return each.groupBy("_at").agg(F.min_by("hit", "hit.ord").alias("hit")).join(F.broadcast(number), "_at").select(
        "_range", "hit", F.lit(COVER).alias("kind"))


class _Open:
    """Open intervals by their order, without those that an earlier one outlasts, so their ends ascend too."""

    def __init__(self):
        self.orders, self.ends, self.hits = [], [], []

    def add(self, order, end, hit: pa.Scalar) -> None:
        at = bisect_left(self.orders, order)
        if at and self.ends[at - 1] >= end or at < len(self.orders) and self.orders[at] == order and self.ends[at] >= end:
            return
        stop = bisect_right(self.ends, end, lo=at)
        self.orders[at:stop], self.ends[at:stop], self.hits[at:stop] = [order], [end], [hit.as_py()]

    def first(self, pos):
        """The hit of the first interval in order that reaches beyond `pos`; those that do not are closed."""
        if self.ends and self.ends[0] <= pos:
            gone = bisect_right(self.ends, pos)
            del self.orders[:gone], self.ends[:gone], self.hits[:gone]
        return self.hits[0] if self.hits else None


def _sweep(batches, begin_of: dict[int, tuple], kept: list[str]):
    """The points of sorted batches of ranges, each with the first interval that is open there."""
    number = begin = now = opened = None
    for batch in batches:
        hits = batch.column(3)
        columns = [batch.column(i).to_pylist() for i in (0, 1, 4, 5, 6, 7)]
        points, found = [], []
        for i, (space, pos, kind, low, high, order, own) in enumerate(zip(
                *columns[:5], hits.field("ord").to_pylist(), columns[5])):
            if own != number:
                number, begin = own, begin_of[own]
                now, opened = begin[1] if begin[0] else None, _Open()
            if kind == COVER:
                opened.add(order, float("inf"), hits[i])
                continue
            if kind == END:
                if space == now and _place(space, low) < begin:
                    opened.add(order, high, hits[i])
                continue
            if space != now:
                now, opened = space, _Open()
            if kind == START:
                opened.add(order, high, hits[i])
                continue
            points.append(i)
            found.append(opened.first(pos) if space is not None and pos is not None else None)
        chosen = batch.select(kept).take(pa.array(points, pa.int64()))
        yield chosen.set_column(3, "hit", pa.array(found, hits.type))


def locate_variants(variants: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """Add `gene` and `local_pos` to variants with `chrom` and a 0-based `pos`.

    The first annotation in order that covers the position gives the gene, and
    the position counts from its start. Elsewhere, and without annotations, the
    gene is the chromosome and the position stays.
    """
    if annotations is None:
        return variants.withColumns({"gene": F.col("chrom"), "local_pos": F.col("pos")})
    hits = first_covering(variants, annotations.select("chrom", "start", "end", "ord", "gene"))
    joined = lookup_join(variants, hits, ["chrom", "pos"], "n")
    return joined.withColumns({
        "gene": F.coalesce("hit.gene", "chrom"),
        "local_pos": F.col("pos") - F.coalesce("hit.start", F.lit(0)),
    }).drop("hit")


# Why a variant is not applied.
SEVERAL_ALLELES, SYMBOLIC, SAME_LENGTH = "several alleles", "symbolic allele", "same length"
PLAIN = r"R'\A[A-Za-z]+\z'"


def reject_reason(ref: str = "ref", alt: str = "alt") -> Column:
    """Why a variant cannot be applied, null for one that can."""
    return F.expr(
        f"CASE WHEN contains({alt}, ',') THEN '{SEVERAL_ALLELES}'"
        f" WHEN NOT {alt} RLIKE {PLAIN} THEN '{SYMBOLIC}'"
        f" WHEN length({ref}) = length({alt}) AND length({ref}) > 1 THEN '{SAME_LENGTH}' END"
    )


def rejected_variants(variants: DataFrame) -> DataFrame:
    """Variants that are not applied, with the reason."""
    return variants.withColumn("reason", reject_reason()).filter(F.col("reason").isNotNull())


def applicable_variants(variants: DataFrame) -> DataFrame:
    """Variants with one plain allele.

    Substitutions of several characters stay: they change nothing, but their
    gene still gets a record.
    """
    return variants.filter(F.expr(f"coalesce(alt RLIKE {PLAIN}, true)"))


def edit_operation(pos: int, ref_size: int, alt: str) -> tuple[int, int, str, bool] | None:
    """An edit as (place, characters to remove, text to insert, False); None for one that changes nothing."""
    if ref_size == len(alt):
        return (pos, 1, alt.upper(), False) if ref_size == 1 else None
    if ref_size < len(alt):
        return pos + ref_size, 0, alt[ref_size:].upper(), False
    return pos + len(alt), ref_size - len(alt), "", False


def edit_part(text: str, operations, last: bool = True, strict: bool = True, inner: bool = True) -> tuple[str, list]:
    """Apply operations to a text or one part of it; gives the edited part and what is left for the next one.

    `inner` operations come from right to left. The text left of the last place
    is not touched; what lies right of it is a stack of pieces with the leftmost
    on top. An operation moves as many characters as it is long, so the work
    grows with the text and the edits, not their product. Operations that an
    earlier part has left may lie anywhere in the part.

    An operation that starts beyond the part, or removes more than is there, is
    passed on, with its place counted from the end of the part. Beyond the
    `last` part it is an error with `strict`, else left out; there a removal ends
    with the text.
    """
    cut, tail = (len(text), []) if inner else (0, [[text, 0]])  # [piece, characters of it that are gone]
    passed: list[tuple[int, int, str, bool]] = []

    def take(count: int) -> list[str]:
        taken = []
        while count > 0 and tail:
            piece, gone = tail[-1]
            part = piece[gone:gone + count]
            taken.append(part)
            count -= len(part)
            if gone + len(part) == len(piece):
                tail.pop()
            else:
                tail[-1][1] += len(part)
        return taken

    for at, remove, insert, rest in operations:
        if at < 0:
            if strict:
                raise ValueError(f"No position {at} in the text")
            continue
        if at < cut:
            tail.append([text[at:cut], 0])
            cut = at
        before = take(at - cut)
        beyond = at - cut - sum(map(len, before))
        gone = sum(map(len, take(remove))) if not beyond else 0
        if beyond or remove and not gone:
            if not last:
                passed.append((beyond, remove, insert, rest))
            elif strict and not rest:
                raise ValueError(f"No position {at} in the text, it lies {beyond} characters beyond the end")
        else:
            if insert:
                tail.append([insert, 0])
            if gone < remove and not last:
                passed.append((0, remove - gone, "", True))
        tail.extend([piece, 0] for piece in reversed(before))
    return text[:cut] + "".join(piece[gone:] for piece, gone in reversed(tail)), passed


def edited_text(text: str, edits, strict: bool = True) -> str:
    """Apply (pos, ref_size, alt) edits that come from right to left to one text."""
    operations = filter(None, (edit_operation(*edit) for edit in edits))
    for operation in operations:
        at, remove, insert, _ = operation
        size = len(text)
        if size > SHORT_TEXT or at < 0 or at + bool(remove) > size:
            text = edit_part(text, chain([operation], operations) if size > SHORT_TEXT else [operation], strict=strict)[0]
        else:
            text = text[:at] + insert + text[at + remove:]
    return text


def reduced_edits(located: DataFrame, order: str = "row_no", heavy: int = HEAVY_ROWS) -> DataFrame:
    """`(gene, pos, ref_size, alt, chrom, <order>, _n)`: edits that stand for `_n` variants each, together for all.

    Without a column `chrom` in `located` there is none here: genes are chromosomes then.

    Substitutions at one position touch nothing but that position, so only the
    last of them counts. In genes of many rows the first and the last are
    found before the variants of a gene come together; elsewhere all rows stay.
    Genes of many rows are told by a pass that counts the rows per hash of the
    gene, of which at most `SPLIT` with more than `heavy` rows are looked at:
    any other has fewer rows than one in `SPLIT`.
    """
    bucket = F.pmod(F.xxhash64("gene"), F.lit(GENE_BUCKETS))
    chrom = _chrom(located)
    plain = located.select(
        "gene", F.col("local_pos").cast("long").alias("pos"), F.length("ref").alias("ref_size"), "alt", *chrom, order,
        F.lit(1).cast("long").alias("_n"))
    counted = located.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_rows"))
    many = [r["_bucket"] for r in counted.filter(F.col("_rows") > heavy).orderBy(F.desc("_rows")).limit(SPLIT).collect()]
    if not many:
        return plain
    repeated = F.coalesce(bucket.isin(many) & (F.col("ref_size") == 1) & (F.length("alt") == 1), F.lit(False))
    variant = F.struct(order, "ref_size", "alt", *chrom)
    ends = plain.filter(repeated).groupBy("gene", "pos").agg(
        F.min_by(variant, order).alias("_first"), F.max_by(variant, order).alias("_last"), F.count(F.lit(1)).alias("_rows"))
    last = F.struct("_last.*", F.greatest(F.col("_rows") - 1, F.lit(1)).cast("long").alias("_n"))
    first = F.struct("_first.*", F.lit(1).cast("long").alias("_n"))
    reduced = ends.select("gene", "pos", F.inline(F.when(F.col("_rows") > 1, F.array(first, last)).otherwise(F.array(last))))
    return plain.filter(~repeated).unionByName(reduced)


def _chrom(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == "chrom"]


def _in_order_of_edits(edits: DataFrame, order: str, *further: str) -> DataFrame:
    """Rows of one gene in one task and next to each other, its edits from right to left.

    Chromosomes and the order, which only they need later, come last. The fields
    of an `order` of several are one column each, as structs are slow to hand
    over row by row.
    """
    kind = edits.schema[order].dataType
    fields = [F.col(order)[f] for f in kind.fieldNames()] if isinstance(kind, T.StructType) else [F.col(order)]
    places = [f.alias(f"_order{i}") for i, f in enumerate(fields)] if _chrom(edits) else []
    return edits.repartition("gene").sortWithinPartitions("gene", F.desc("pos"), order).select(
        "gene", "pos", "ref_size", "alt", "_n", *further, *_chrom(edits), *places)


def _whole_runs(batches):
    """Batches of rows sorted by their first column, cut where its value changes."""
    held, held_key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0)
        ends = _runs(keys)
        start = int(ends[-2]) if len(ends) > 1 else 0
        if held and keys[0].as_py() != held_key:
            yield pa.concat_batches(held)
            held = []
        if start:
            yield pa.concat_batches([*held, batch.slice(0, start)])
            held = []
        held.append(batch.slice(start))
        held_key = keys[-1].as_py()
    if held:
        yield pa.concat_batches(held)


def _runs(column: pa.Array) -> np.ndarray:
    """Where each run of equal values ends."""
    return pc.run_end_encode(column).run_ends.to_numpy()


def _rank(value) -> tuple:
    """A key that Python orders as Spark orders values and structs, nulls first."""
    if isinstance(value, dict):
        return 1, tuple(map(_rank, value.values()))
    if value is None:
        return (0,)
    return (2,) if value != value else (1, value)


def _listed(column: pa.Array) -> list:
    """`to_pylist`, faster where few values repeat."""
    coded = column.dictionary_encode()
    values = coded.dictionary.to_pylist()
    return column.to_pylist() if coded.null_count else [values[i] for i in coded.indices.to_numpy().tolist()]


class _Runs:
    """The genes of a batch that `_in_order_of_edits` gives; `chrom` is the place of the chromosomes, if there are any."""

    def __init__(self, batch: pa.RecordBatch, chrom: int = 5):
        self.gene, self.pos, self.ref_size, self.alt, n = batch.columns[:5]
        self.chrom, *self.order = batch.columns[chrom:] or [self.gene]
        self.stops = _runs(self.gene)
        self.starts = np.concatenate([[0], self.stops[:-1]]).astype(np.int64)
        self.n = n.to_numpy()
        self.n_variants = np.add.reduceat(self.n, self.starts)

    def changing(self) -> np.ndarray:
        """Which rows change their text: of substitutions at one position the last."""
        removed = self.ref_size.to_numpy(zero_copy_only=False)
        added = pc.utf8_length(self.alt).to_numpy(zero_copy_only=False)
        pos = self.pos.to_numpy(zero_copy_only=False)
        single = (removed == 1) & (added == 1)
        keep = single | (removed != added)
        at = np.flatnonzero(single)
        own = np.repeat(np.arange(len(self.stops)), self.stops - self.starts)[at]
        keep[at[:-1][(own[:-1] == own[1:]) & (pos[at[:-1]] == pos[at[1:]])]] = False
        return keep

    def first_chrom(self, starts: np.ndarray, stops: np.ndarray) -> list:
        """For each slice of rows, none of them empty, the chromosome of the first variant in order."""
        changes = _runs(self.chrom)[:-1]
        mixed = np.searchsorted(changes, starts, "right") < np.searchsorted(changes, stops, "left")
        found = self.chrom.take(pa.array(starts)).to_pylist()
        for i in np.flatnonzero(mixed):
            a, b = int(starts[i]), int(stops[i])
            places = list(zip(*(map(_rank, c.slice(a, b - a).to_pylist()) for c in self.order)))
            found[i] = self.chrom[a + min(range(b - a), key=places.__getitem__)].as_py()
        return found


def gene_edits(located: DataFrame, order: str = "row_no", heavy: int = HEAVY_ROWS) -> DataFrame:
    """Per gene the edits from right to left, the first chromosome and the variant count.

    The edits of a gene make one text, so they meet in one row: what is
    gathered is bounded by the text, whose characters deletions use up, and by
    the insertions, which are part of the result.
    """
    edits = reduced_edits(located, order, heavy)

    def run(batches):
        for batch in _whole_runs(batches):
            runs = _Runs(batch)
            keep = runs.changing()
            kept = pa.array(keep)
            rows = pa.StructArray.from_arrays(
                [runs.pos.filter(kept), runs.ref_size.filter(kept), runs.alt.filter(kept)], ["pos", "ref_size", "alt"])
            bounds = np.concatenate([[0], np.cumsum(keep)[runs.stops - 1]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                runs.gene.take(pa.array(runs.starts)), pa.array(runs.first_chrom(runs.starts, runs.stops), runs.chrom.type),
                pa.array(runs.n_variants), pa.ListArray.from_arrays(pa.array(bounds), rows)],
                ["gene", "chrom", "n_variants", "edits"])

    return _in_order_of_edits(edits, order).mapInArrow(
        run, "gene string, chrom string, n_variants long, edits array<struct<pos:long,ref_size:int,alt:string>>")


def edited_genes(edits: DataFrame, references: DataFrame, order: str = "row_no", strict: bool = True) -> DataFrame:
    """One record per gene out of `reduced_edits` and references `(id, seq)`, see `apply_variants`.

    References go to the tasks of their genes as rows ahead of the edits, so one
    shuffle brings both together, whatever the size of either.
    """
    ahead = references.select(
        F.col("id").alias("gene"), F.lit((1 << 63) - 1).alias("pos"), F.lit(0).alias("ref_size"), F.lit("").alias("alt"),
        *(F.lit(None).cast("string").alias(c) for c in _chrom(edits)), F.lit(None).cast(edits.schema[order].dataType).alias(order),
        F.lit(0).cast("long").alias("_n"), F.col("seq").alias("_seq"))
    rows = edits.withColumn("_seq", F.lit(None).cast("string")).unionByName(ahead).filter(F.col("gene").isNotNull())

    def run(batches):
        for batch in _whole_runs(batches):
            runs = _Runs(batch, chrom=6)
            given = np.add.reduceat((runs.n == 0).astype(np.int64), runs.starts)
            both = np.flatnonzero((given > 0) & (runs.n_variants > 0))
            firsts, stops = (runs.starts + given)[both], runs.stops[both]
            keep = runs.changing()
            kept = pa.array(keep)
            placed = np.concatenate([[0], np.cumsum(keep)])
            pos, ref_size, alt = (_listed(c.filter(kept)) for c in (runs.pos, runs.ref_size, runs.alt))
            texts = batch.column(5)
            at, edited, proteins = [], [], []
            for i, first, stop in zip(both.tolist(), firsts.tolist(), stops.tolist()):
                a, b = placed[first], placed[stop]
                own = list(zip(pos[a:b], ref_size[a:b], alt[a:b]))
                for row in range(first - int(given[i]), first):
                    text = texts[row].as_py()
                    at.append(row)
                    edited.append(None if text is None else edited_text(text, own, strict))
                    proteins.append(translated(text, to_stop=True))
            edited_proteins = [translated(text, to_stop=True) for text in edited]
            each = pa.array(np.repeat(np.arange(len(both)), given[both]))
            chroms = pa.array(runs.first_chrom(firsts, stops), runs.chrom.type)
            yield pa.RecordBatch.from_arrays([
                runs.gene.take(pa.array(at, pa.int64())), chroms.take(each),
                pa.array(runs.n_variants[both]).take(each), texts.take(pa.array(at, pa.int64())),
                *(pa.array(column, pa.string()) for column in (edited, proteins, edited_proteins))],
                ["gene", "chrom", "n_variants", "ref_dna", "var_dna", "ref_protein", "var_protein"])

    return _in_order_of_edits(rows, order, "_seq").mapInArrow(
        run, "gene string, chrom string, n_variants long, ref_dna string, var_dna string, ref_protein string, var_protein string")


def apply_variants(
    located: DataFrame, references: DataFrame, order: str = "row_no", strict: bool = True, heavy: int = HEAVY_ROWS
) -> DataFrame:
    """One record per gene that has variants and a reference.

    `references` has unique `id` and `seq`. Gives the reference and the edited
    text and their translations up to the first stop. Where genes are
    chromosomes, leave `chrom` out of `located`: less goes through the shuffle.
    """
    return edited_genes(reduced_edits(applicable_variants(located), order, heavy), references, order, strict)


def variant_details(located: DataFrame, references: DataFrame) -> DataFrame:
    """The variants behind the records of `apply_variants`, one row each.

    Gives `gene`, `local_pos`, `ref`, `alt`, `chrom` and `original_pos`, and any
    further columns of `located`. They stand beside the records, not in them, so
    a gene may have any number of variants.
    """
    used = applicable_variants(located).withColumnRenamed("pos", "original_pos")
    return used.join(references.select(F.col("id").alias("gene")), "gene", "left_semi").select(
        "gene", "local_pos", "ref", "alt", "chrom", "original_pos",
        *(c for c in used.columns if c not in ("gene", "local_pos", "ref", "alt", "chrom", "original_pos")))


def pair_records(references: DataFrame, variants: DataFrame) -> DataFrame:
    """Pair the records of two text tables by id and translate nucleotide pairs.

    Both have `id` and `seq`; ids of `references` are unique. A pair counts as
    nucleotides by the first 100 characters of its reference.
    """
    table = references.select("id", F.col("seq").alias("_ref"))
    pairs = lookup_join(variants.select("id", F.col("seq").alias("_var")), table, ["id"], how="inner")
    dna = is_nucleotide("_ref", 100)
    return pairs.select(
        F.col("id").alias("gene"),
        F.when(dna, translate("_ref", True)).otherwise(drop_stops("_ref")).alias("ref_protein"),
        F.when(dna, translate("_var", True)).otherwise(drop_stops("_var")).alias("var_protein"),
        F.when(dna, F.col("_ref")).otherwise("").alias("ref_dna"),
        F.when(dna, F.col("_var")).otherwise("").alias("var_dna"),
    )


def pair_with_loaded(references: DataFrame, variants: DataFrame) -> DataFrame:
    """Pair variant texts with loaded nucleotide references.

    Here each variant counts as nucleotides by its own first 50 characters, and
    of repeated variant ids the last one stays (see `last_per_id`).
    """
    table = references.select("id", F.col("seq").alias("ref_dna"))
    pairs = lookup_join(variants.select("id", F.col("seq").alias("_var")), table, ["id"], how="inner")
    dna = is_nucleotide("_var", 50)
    return pairs.select(
        F.col("id").alias("gene"),
        translate("ref_dna", True).alias("ref_protein"),
        F.when(dna, translate("_var", True)).otherwise(drop_stops("_var")).alias("var_protein"),
        "ref_dna",
        F.when(dna, F.col("_var")).otherwise("").alias("var_dna"),
    )


def unmatched_records(references: DataFrame, variants: DataFrame) -> DataFrame:
    """Ids of variants that no reference has."""
    return variants.select("id").join(references.select("id"), "id", "left_anti")


def last_per_id(records: DataFrame, order: str = "record_no") -> DataFrame:
    """The last text of each id."""
    return records.groupBy("id").agg(F.max_by("seq", order).alias("seq"))
