import random
import subprocess
import sys
import textwrap

import pytest
from pyspark.errors import PySparkException

from twinframe.operators import assemble as a
from twinframe.operators import chunks as c
from twinframe.operators.features import FEATURES, pair_features
from twinframe.sources.sequences import read_fasta

from .test_assemble import variant_frame


def whole(chunks, key="gene"):
    return {r[key]: r.text for r in c.whole_texts(chunks, key).collect()}


def regular(chunks, key, size):
    """Every chunk but the last of a text is full."""
    last = {}
    for r in sorted(chunks.collect(), key=lambda r: (str(r[key]), r.chunk)):
        before = last.get(r[key])
        assert r.chunk == (0 if before is None else before[0] + 1) and (before is None or before[1] == size)
        assert len(r.text) <= size
        last[r[key]] = (r.chunk, len(r.text))


KINDS = [("A", "t"), ("A", "ACC"), ("ACG", "A"), ("AC", "GT"), ("AC", "ACG"), ("ACGT", "AC"), ("ACGTACGTACGT", "A"), ("CGT", "CGTAAAAAAA")]


@pytest.mark.parametrize("size", [3, 21])
def test_edits_across_borders(spark, size):
    """Overlapping deletions and insertions near every border, also deletions over several chunks."""
    rng = random.Random(size)
    genes = {f"g{i}": "".join(rng.choice("ACGT") for _ in range(rng.choice((20, 21, 60, 61)))) for i in range(80)}
    variants = []
    for gene, text in genes.items():
        for _ in range(rng.randint(0, 14)):
            ref, alt = rng.choice(KINDS)
            # Room is left for deletions that come before this one.
            variants.append((gene, rng.randint(0, max(0, len(text) // 4)), ref, alt, len(variants)))
    variants.append(("nowhere", 1, "A", "C", len(variants)))
    located = a.locate_variants(variant_frame(spark, variants))
    refs = spark.createDataFrame(list(genes.items()), "id string, seq string")
    wanted = {r.gene: r.var_dna for r in a.apply_variants(located, refs, strict=False).collect()}
    got = c.edit_chunks(located, c.cut_texts(refs, size=size), strict=False, size=size)
    assert whole(got) == wanted and len(wanted) > 60
    regular(got, "gene", size)


def test_positions_out_of_range(spark):
    refs = c.cut_texts(spark.createDataFrame([("g", "ACGTACG"), ("h", "")], "id string, seq string"), size=3)
    located = a.locate_variants(variant_frame(spark, [
        ("g", 9, "A", "C", 1), ("g", 0, "A", "C", 2), ("g", 5, "ACGTACGT", "A", 3), ("h", 0, "A", "C", 4), ("g", 6, "A", "AT", 5)]))
    with pytest.raises(PySparkException, match="No position"):
        c.edit_chunks(located, refs, size=3).collect()
    assert whole(c.edit_chunks(located, refs, strict=False, size=3)) == {"g": "CCGTAC", "h": ""}
    reach = a.locate_variants(variant_frame(spark, [("g", 0, "ACGTACG", "A", 1), ("g", 1, "A", "C", 2)]))
    assert whole(c.edit_chunks(reach, refs, size=3)) == {"g": "A"}
    with pytest.raises(ValueError, match="three"):
        c.cut_texts(refs, "id", "text", 4)


def test_recut_and_empty_texts(spark):
    rows = [("a", 1, "abc"), ("a", 3, "éfghijklm"), ("a", 2, None), ("b", 1, ""), ("b", 2, None), ("c", 1, "x" * 100)]
    got = c.recut(spark.createDataFrame(rows, "k string, o int, text string"), "k", "o", size=6)
    assert whole(got, "k") == {"a": "abcéfghijklm", "b": "", "c": "x" * 100}
    regular(got, "k", 6)
    texts = spark.createDataFrame([("a", "abcdefg"), ("b", ""), ("c", None)], "id string, seq string")
    assert sorted((r.id, r.chunk, r.text) for r in c.cut_texts(texts, size=3).collect()) == [
        ("a", 0, "abc"), ("a", 1, "def"), ("a", 2, "g"), ("b", 0, "")]


def test_fasta_records_over_many_splits(spark, tmp_path):
    rng = random.Random(3)
    body = ["".join(rng.choice("acgtn") for _ in range(60)) for _ in range(4000)]
    (tmp_path / "one.fa").write_text(">first of all\n" + "\n".join(body) + "\n>second\nac gt\n\n>\nTT\n>none\n>\n")
    (tmp_path / "two.fa").write_text("early\nAC\n>x\n" + "\n".join(body[:900]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        names, parts = c.read_fasta_chunks(spark, str(tmp_path), size=3000)
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        texts = c.whole_texts(parts, "record").join(names, "record").collect()
        wanted = {(r.id, r.seq) for r in read_fasta(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {(r.id, r.text) for r in texts} == wanted
    assert ("first", "".join(body).upper()) in wanted and ("", "TT") in wanted and ("none", "") in wanted
    assert ("early", "AC") in wanted and len(texts) == 6
    regular(parts, "record", 3000)


def test_translations(spark):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice("acgtuRYN" if i % 3 else "ACGT") for _ in range(i))) for i in range(70)]
    texts += [(100, "ATGxAAATG"), (101, "ATGTAA"), (102, "TAAATG"), (103, "ATGAAATG?")]
    df = spark.createDataFrame(texts, "id int, seq string")
    for stop in (False, True):
        from twinframe.functions.sequence import translate

        wanted = {r.id: r.p for r in df.select("id", translate("seq", stop).alias("p")).collect()}
        for size in (3, 9, 60):
            assert whole(c.translate_chunks(c.cut_texts(df, size=size), to_stop=stop, size=size), "id") == wanted


def test_features_from_parts_in_any_grouping(spark):
    rng = random.Random(6)
    pairs = []
    for i in range(120):
        ref = "".join(rng.choice("MKTLV*") for _ in range(rng.choice((0, 5, 6, 12, 40))))
        var = "".join(rng.choice("MKTLV*") if rng.random() < 0.2 else x for x in ref)[:rng.choice((0, 6, 11, 99))]
        pairs.append((i, ref, var + rng.choice(("", "", "WW", "WWWWWWWWW"))))
    df = spark.createDataFrame(pairs, "id int, ref_seq string, var_seq string")
    wanted = {r.id: [r[f] for f in FEATURES] for r in pair_features(df).collect()}
    for size in (3, 6, 30):
        states = c.pair_states(c.cut_texts(df, "id", "ref_seq", size), c.cut_texts(df, "id", "var_seq", size), size=size)
        got = {r.id: [r[f] for f in FEATURES] for r in c.state_features(c.merged_states(states)).collect()}
        assert got == {k: pytest.approx(v) for k, v in wanted.items()}
        # Merging is associative: halves first, then the halves.
        halves = [c.merged_states(states.filter(f"pmod(xxhash64(ref_size, edits, id), 2) = {k}")) for k in (0, 1)]
        names = halves[0].columns
        again = c.state_features(c.merged_states(halves[0].unionByName(halves[1]).select(names)))
        assert {r.id: [r[f] for f in FEATURES] for r in again.collect()} == got


LARGE = """
    import random, sys, tempfile
    sys.path.insert(0, {root!r})
    from pyspark.sql import SparkSession, functions as F
    from twinframe.operators import assemble as a, chunks as c
    spark = (SparkSession.builder.master("local[4]").config("spark.driver.memory", "1g").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "16").config("spark.checkpoint.dir", tempfile.mkdtemp()).getOrCreate())
    n, edits = {n}, {edits}
    # A text of n letters, as pieces of 10,000; edits of all kinds at places that a hash picks.
    pieces = spark.range(n // 10_000).select(F.lit("g").alias("id"), "id", F.expr(
        "translate(repeat(md5(cast(id as string)), 313), '0123456789abcdef', 'ACGTACGTACGTACGT')").alias("t")).toDF("id", "o", "t")
    refs = c.recut(pieces.select("id", "o", F.substring("t", 1, 10_000).alias("text")), "id", "o").cache()
    kind, at = F.col("id") % 4, F.pmod(F.xxhash64("id"), F.lit(n - 1000))
    located = spark.range(edits).select(
        F.lit("g").alias("gene"), F.lit("g").alias("chrom"), at.alias("local_pos"),
        F.when(kind == 2, "ACG").otherwise("A").alias("ref"),
        F.when(kind == 1, "ACC").when(kind == 2, "A").otherwise("T").alias("alt"), F.col("id").alias("row_no"))
    got = c.edit_chunks(located, refs)
    size = got.agg(F.sum(F.length("text"))).first()[0]
    gone = located.agg(F.sum(F.length("alt") - F.length("ref"))).first()[0]
    assert size == n + gone, (size, n, gone)
    if {check}:  # against one pass over the whole text
        text = c.whole_texts(refs).first().text
        own = sorted(((r.local_pos, r.row_no, r.ref, r.alt) for r in located.collect()), key=lambda v: (-v[0], v[1]))
        assert c.whole_texts(got, "gene").first().text == a.edited_text(text, [(p, len(r), v) for p, _, r, v in own])
    print("equal", size)
"""


@pytest.mark.parametrize("n, edits, check", [(10_000_000, 1_000_000, True)])
def test_one_large_gene_in_little_memory(tmp_path, n, edits, check):
    """10^7 characters and 10^6 edits of one gene, with 1 GB for the driver and all tasks."""
    from pathlib import Path

    script = tmp_path / "large.py"
    script.write_text(textwrap.dedent(LARGE.format(root=str(Path(c.__file__).parents[2]), n=n, edits=edits, check=check)))
    done = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, timeout=600)
    assert "equal" in done.stdout, done.stderr[-3000:]


def test_translations_are_looked_up_only_where_something_is_cut(spark, monkeypatch):
    looked_up = []
    real = c.lookup_join
    monkeypatch.setattr(c, "lookup_join", lambda df, table, *rest: looked_up.append(table.count()) or real(df, table, *rest))
    df = spark.createDataFrame([(1, "ATGAAA"), (2, "ATGTAAAAA"), (3, "ATGxAA")], "id int, seq string")
    products = c.chunk_products(c.cut_texts(df, size=3))
    got = [whole(c.ended_products(products, to_stop=stop, size=3), "id") for stop in (False, True)]
    assert got == [{1: "MK", 2: "M*K", 3: ""}, {1: "MK", 2: "M", 3: ""}] and looked_up == [1, 2]


def test_edits_are_not_counted_a_second_time(spark, monkeypatch):
    """Lookups know the rows of their keys, so the edits are worked out once only."""
    weights = []
    real = c.lookup_join
    monkeypatch.setattr(c, "lookup_join", lambda df, table, on, weight=None, how="left": weights.append(weight) or real(
        df, table, on, weight, how))
    located = spark.createDataFrame(
        [("g", "g", 1, "C", "T", 1), ("g", "g", 4, "C", "CA", 2)], "gene string, chrom string, local_pos long, ref string, alt string, row_no int")
    parts = c.cut_texts(spark.createDataFrame([("g", "ACGTCG"), ("h", "AAA")], "id string, seq string"), size=3)
    assert whole(c.edit_chunks(located, parts, size=3), "gene") == {"g": "ATGTCAG"}
    assert weights and None not in weights
