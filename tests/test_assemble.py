import random
import time

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException

from twinframe.operators import assemble as a
from twinframe.plans.prediction import explain, predict, variant_records, with_features


def plain_apply(text, variants):
    """Variants (pos, ref, alt) in input order, applied from right to left."""
    for pos, ref, alt in sorted(variants, key=lambda v: v[0], reverse=True):
        if len(ref) == 1 and len(alt) == 1:
            text = text[:pos] + alt.upper() + text[pos + 1:]
        elif len(ref) < len(alt):
            at = pos + len(ref)
            text = text[:at] + alt[len(ref):].upper() + text[at:]
        elif len(ref) > len(alt):
            at = pos + len(alt)
            text = text[:at] + text[at + len(ref) - len(alt):]
    return text


def variant_frame(spark, variants):
    return spark.createDataFrame(variants, "chrom string, pos long, ref string, alt string, row_no long")


def test_applied_variants_match_brute_force(spark):
    rng = random.Random(5)
    genes = {f"g{i}": "".join(rng.choice("ACGT") for _ in range(60)) for i in range(60)}
    variants = []
    for gene in genes:
        for _ in range(rng.randint(1, 12)):
            ref, alt = rng.choice([("A", "t"), ("A", "ACC"), ("ACG", "A"), ("AC", "GT"), ("AC", "ACG"), ("ACGT", "AC")])
            variants.append((gene, rng.randint(0, 25), ref, alt, len(variants)))
    refs = spark.createDataFrame(list(genes.items()), "id string, seq string")
    got = {r.gene: r for r in variant_records(variant_frame(spark, variants), refs).collect()}
    assert got.keys() == genes.keys()
    for gene, text in genes.items():
        own = [(p, r, v) for g, p, r, v, _ in variants if g == gene]
        assert got[gene].var_dna == plain_apply(text, own), own
        assert got[gene].n_variants == len(own)


def test_many_edits_take_linear_time():
    rng = random.Random(9)
    text = "".join(rng.choice("ACGT") for _ in range(200_000))
    indels = sorted(((rng.randrange(190_000), *rng.choice([("A", "ACC"), ("ACG", "A"), ("A", "t"), ("ACGT", "AC")]))
                     for _ in range(100_000)), key=lambda v: -v[0])
    began = time.time()
    got = a.edited_text(text, [(p, len(r), v) for p, r, v in indels])
    assert time.time() - began < 10 and len(got) > 0
    some = indels[-300:]
    assert a.edited_text(text, [(p, len(r), v) for p, r, v in some]) == plain_apply(text, some)


def test_variant_details(spark):
    refs = spark.createDataFrame([("g", "ACGTACGT")], "id string, seq string")
    variants = variant_frame(spark, [("g", 1, "A", "C", 1), ("g", 1, "A", "C", 2), ("g", 2, "A", "C,T", 3), ("x", 1, "A", "C", 4)])
    got = a.variant_details(a.locate_variants(variants), refs)
    assert got.columns == ["gene", "local_pos", "ref", "alt", "chrom", "original_pos", "row_no"]
    assert sorted(tuple(r) for r in got.collect()) == [("g", 1, "A", "C", "g", 1, 1), ("g", 1, "A", "C", "g", 1, 2)]


def test_positions_out_of_range(spark):
    refs = spark.createDataFrame([("g", "ACGT")], "id string, seq string")
    variants = variant_frame(spark, [("g", 9, "A", "C", 1), ("g", 0, "A", "C", 2), ("other", 1, "A", "C", 3)])
    with pytest.raises(PySparkException, match="No position"):
        variant_records(variants, refs).collect()
    assert [r.var_dna for r in variant_records(variants, refs, strict=False).collect()] == ["CCGT"]


def test_rejected_variants(spark):
    variants = variant_frame(spark, [
        ("g", 0, "A", "C,T", 1), ("g", 0, "A", ".", 2), ("g", 0, "A", "<DEL>", 3), ("g", 0, "AC", "GT", 4), ("g", 0, "A", "T", 5)])
    assert {(r.row_no, r.reason) for r in a.rejected_variants(variants).collect()} == {
        (1, a.SEVERAL_ALLELES), (2, a.SYMBOLIC), (3, a.SYMBOLIC), (4, a.SAME_LENGTH)}
    assert {r.row_no for r in a.applicable_variants(variants).collect()} == {4, 5}


def test_locating_matches_brute_force(spark):
    rng = random.Random(6)
    spans = []
    for i in range(80):
        start = rng.randint(-50, 300_000)
        size = rng.choice([0, 1, 63, 64, 65, 4096, 5000, 100_000])
        spans.append((rng.choice("ab"), start, start + size, rng.randint(0, 10**6), f"gene{i}"))
    points = [(rng.choice("abc"), rng.choice([rng.randint(-60, 310_000), 100, 64, 4096]), "A", "C", i) for i in range(900)]
    annotations = spark.createDataFrame(spans, "chrom string, start long, end long, ord long, gene string")
    got = {r.row_no: (r.gene, r.local_pos) for r in
           a.locate_variants(variant_frame(spark, points), annotations).collect()}
    assert len(got) == len(points)
    for chrom, pos, _, _, i in points:
        hits = sorted((o, g, s) for c, s, e, o, g in spans if c == chrom and s <= pos < e)
        assert got[i] == ((hits[0][1], pos - hits[0][2]) if hits else (chrom, pos))
    assert a.locate_variants(variant_frame(spark, points)).filter("gene <> chrom OR pos <> local_pos").isEmpty()


def test_intervals_over_many_ranges(spark):
    """More ranges than values in places: intervals that cover, begin or end in ranges, ties, nulls, repeated points."""
    rng = random.Random(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        for width in (5, 300, 3000):
            spans = []
            for i in range(150):
                start = rng.randint(0, 3000)
                spans.append((rng.choice(["a", "b", None]), start, start + rng.randint(0, width), i if width > 5 else i // 2, f"g{i}"))
            points = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-5, 3010, 3)])) for _ in range(700)]
            got = a.first_covering(
                spark.createDataFrame(points, "chrom string, pos int"),
                spark.createDataFrame(spans, "chrom string, start int, end int, ord long, gene string"))
            assert got.schema["pos"].dataType.simpleString() == "int"
            rows = got.collect()
            assert sorted(((r.chrom, r.pos, r.n) for r in rows), key=str) == sorted(
                ((*p, points.count(p)) for p in set(points)), key=str)
            for r in rows:
                hits = [x for x in spans if None not in (r.chrom, r.pos) and x[0] == r.chrom and x[1] <= r.pos < x[2]]
                assert (r.hit is None) == (not hits)
                if hits:
                    assert r.hit.ord == min(h[3] for h in hits)
                    assert (r.hit.ord, r.hit.start, r.hit.gene) in {(h[3], h[1], h[4]) for h in hits}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    none = spark.createDataFrame([], "chrom string, start long, end long, ord long, gene string")
    some = spark.createDataFrame([("a", 1)], "chrom string, pos long")
    assert [r.hit for r in a.first_covering(some, none).collect()] == [None]
    assert a.first_covering(some.limit(0), none).count() == 0


def test_an_interval_is_made_of_few_blocks(spark):
    rng = random.Random(8)
    starts = [rng.randint(-200, 5000) for _ in range(200)]
    spans = [(i, start, start + rng.randint(0, 9000)) for i, start in enumerate(starts)]
    spans += [(200, -3, 2**31 + 5), (201, 7, 8), (202, 0, 8**3)]
    cut = a.interval_blocks(spark.createDataFrame(spans, "i int, start long, end long"))
    blocks = {}
    for r in cut.collect():
        blocks.setdefault(r.i, []).append((r.block * 8**r.level, (r.block + 1) * 8**r.level))
    for i, start, end in spans:
        own = sorted(blocks.get(i, []))
        assert [x for x, _ in own] + [end] == [start] + [x for _, x in own]
        assert len(own) <= (5 if i < 200 else 10) * 14 + 16
    assert len(blocks[202]) == len(blocks[201]) == 1


def test_pairs_of_records(spark):
    refs = spark.createDataFrame([("d", "ATGAAATAA"), ("p", "MKT*"), ("u", "ATG")], "id string, seq string")
    variants = spark.createDataFrame([("d", "ATGTAA"), ("p", "MK*T"), ("d", "ATGCCC"), ("x", "M")], "id string, seq string")
    got = {(r.gene, r.ref_protein, r.var_protein, r.ref_dna) for r in a.pair_records(refs, variants).collect()}
    assert got == {("d", "MK", "M", "ATGAAATAA"), ("d", "MK", "MP", "ATGAAATAA"), ("p", "MKT", "MKT", "")}
    assert [r.id for r in a.unmatched_records(refs, variants).collect()] == ["x"]
    loaded = {(r.gene, r.var_protein, r.var_dna) for r in a.pair_with_loaded(refs, variants).collect()}
    assert loaded == {("d", "M", "ATGTAA"), ("d", "MP", "ATGCCC"), ("p", "MKT", "")}


def test_predictions(spark):
    records = spark.createDataFrame(
        [("a", "MKTLVV", "MK*LVV"), ("b", "MKTL", "MKTL")], "gene string, ref_protein string, var_protein string")
    logits = spark.createDataFrame([("a", [3.0, 1.0, 1.0]), ("b", [0.0, 0.0, 0.0]), ("c", [1.0, 2.0, 3.0])],
                                   "gene string, logits array<double>")
    got = {r.gene: r for r in explain(predict(with_features(records), logits)).collect()}
    assert got.keys() == {"a", "b"}
    assert got["a"].prediction == "low" and got["b"].prediction == "low"
    assert sum(got["a"].probabilities) == pytest.approx(1) and got["a"].confidence == max(got["a"].probabilities)
    assert got["a"].top_positions[0].type == "nonsense" and got["a"].premature_stop == 1.0


def test_a_range_is_swept_batch_by_batch():
    """Points of one batch are given before the next one is read, and no more intervals are held than may still count."""
    kind = pa.struct([("ord", pa.int64()), ("start", pa.int64()), ("gene", pa.string())])
    names = ["chrom", "pos", "n", "hit", "kind", "low", "high", "_range"]

    def batch(rows):
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), *(pa.array(columns[i], pa.int64()) for i in (1, 2)), pa.array(columns[3], kind),
             *(pa.array(columns[i], pa.int64()) for i in range(4, 8))], names)

    def begun(low, high, order):
        return ("a", low, None, {"ord": order, "start": low, "gene": f"g{order}"}, a.START, low, high, 0)

    read = []

    def batches():
        for k in range(3):
            read.append(k)
            yield batch([begun(k, 10, k), ("a", k, 1, None, a.POINT, None, None, 0)])

    swept = a._sweep(batches(), {0: (True, "a", 0)}, names[:4])
    assert [h["ord"] for h in next(swept).column(3).to_pylist()] == [0] and read == [0]
    assert [h["ord"] for x in swept for h in x.column(3).to_pylist()] == [0, 0] and read == [0, 1, 2]
    held = a._Open()
    for i in range(1000):
        held.add(1000 - i, 2000 + i, pa.scalar(i))
    assert len(held.hits) == 1 and held.first(2998) == 999 and held.first(2999) is None


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_records_meet_their_references_and_logits_by_shuffles_only(spark):
    refs = spark.createDataFrame([("g", "ACGTACGT")], "id string, seq string")
    records = variant_records(variant_frame(spark, [("g", 0, "A", "T", 1)]), refs)
    assert "Join" not in plan_of(records)
    logits = spark.createDataFrame([("g", [1.0, 0.0, 0.0])], "gene string, logits array<double>")
    called = predict(records, logits)
    assert "BroadcastHashJoin" not in called._jdf.queryExecution().executedPlan().toString()
    assert [r.prediction for r in called.collect()] == ["low"]


@pytest.mark.parametrize("heavy", [3, 100_000])
def test_genes_of_many_variants_give_the_same_records(spark, heavy):
    rng = random.Random(8)
    genes = {f"g{i}": "".join(rng.choice("ACGT") for _ in range(60)) for i in range(8)} | {"none": None}
    rows, kinds = [], [("A", "t"), ("A", "C"), ("A", "ACC"), ("ACG", "A"), ("AC", "GT")]
    for gene in [*genes, "unknown", None]:
        for _ in range(400 if gene == "g0" else 6):
            # Two fields of order; chromosomes mix in a gene.
            order = (rng.randrange(5), len(rows))
            rows.append((gene, f"c{order[0]}", rng.randrange(12 if gene == "g0" else 30), *rng.choice(kinds[:3] if gene == "g0" else kinds), order))
    located = spark.createDataFrame(
        rows, "gene string, chrom string, local_pos int, ref string, alt string, row_no struct<a:int,b:int>").repartition(5)
    refs = spark.createDataFrame(list(genes.items()), "id string, seq string")
    got = {r.gene: r for r in a.apply_variants(located, refs, heavy=heavy).collect()}
    lists = {r.gene: r for r in a.gene_edits(located, heavy=heavy).collect()}
    assert got.keys() == genes.keys() and lists.keys() == {*genes, "unknown", None}
    for gene in lists:
        own = sorted((r for r in rows if r[0] == gene), key=lambda r: r[5])
        assert lists[gene].chrom == own[0][1] and lists[gene].n_variants == len(own)
        if genes.get(gene):
            wanted = plain_apply(genes[gene], [r[2:5] for r in own])
            edits = [(e.pos, e.ref_size, e.alt) for e in lists[gene].edits]
            assert got[gene].var_dna == wanted == a.edited_text(genes[gene], edits)
            assert (got[gene].chrom, got[gene].n_variants) == (own[0][1], len(own))
    assert got["none"].var_dna is None


def test_a_run_of_one_gene_over_many_batches_stays_whole():
    batches = [pa.RecordBatch.from_arrays([pa.array(list(x), pa.string())], ["gene"]) for x in ("ab", "b", "bbc", "", "d", "de")]
    got = ["".join(b.column(0).to_pylist()) for b in a._whole_runs(batches)]
    assert "".join(got) == "abbbbcdde" and all(x[-1] != y[0] for x, y in zip(got, got[1:]))


def test_genes_that_are_chromosomes_need_no_chromosomes(spark):
    rng = random.Random(3)
    rows = [(f"g{rng.randrange(5)}", rng.randrange(30), *rng.choice([("A", "t"), ("A", "ACC"), ("ACG", "A")]), i) for i in range(300)]
    variants = variant_frame(spark, [r for r in rows if r[0] != "g4"])
    refs = spark.createDataFrame([(f"g{i}", "ACGTTGCA" * 9 + "RU" * i) for i in range(6)], "id string, seq string")
    located = a.locate_variants(variants)
    handed = a._in_order_of_edits(a.reduced_edits(located.drop("chrom")), "row_no").columns
    assert {"gene", "pos", "ref_size", "alt", "_n"} <= {*handed} and not any(c == "chrom" or "_order" in c for c in handed)
    for heavy in (3, 100_000):
        got = sorted(a.apply_variants(located.drop("chrom"), refs, heavy=heavy).collect())
        assert [r.gene for r in got] == ["g0", "g1", "g2", "g3"] == [r.chrom for r in got]
        assert got == sorted(a.apply_variants(located, refs, heavy=heavy).collect())
        assert sorted(a.gene_edits(located.drop("chrom"), heavy=heavy).collect()) == sorted(a.gene_edits(located, heavy=heavy).collect())
    assert "transform" not in plan_of(a.apply_variants(located, refs))


def test_short_texts_are_edited_as_long_ones(monkeypatch):
    rng = random.Random(6)
    for _ in range(2000):
        text = "".join(rng.choice("ACGT") for _ in range(rng.randrange(12)))
        edits = [(rng.randrange(-1, 14), *rng.choice([(1, "c"), (1, "ACC"), (4, "A"), (2, "GT"), (2, "acg")])) for _ in range(rng.randrange(5))]
        edits = sorted(edits, key=lambda e: -e[0])
        for strict in (True, False):
            found = []
            for size in (4096, 6, -1):
                monkeypatch.setattr(a, "SHORT_TEXT", size)
                try:
                    found.append(a.edited_text(text, edits, strict))
                except ValueError as error:
                    found.append(str(error))
            assert found[0] == found[1] == found[2], (text, edits, found)
