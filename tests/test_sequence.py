"""Exact values of the expressions on texts, and brute force on random pairs."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from twinframe.functions import sequence as s
from twinframe.operators.features import FEATURES, pair_features


def plain_edits(ref, var):
    found = [
        (i + 1, a, b, "nonsense" if b == "*" else "readthrough" if a == "*" else "missense")
        for i, (a, b) in enumerate(zip(ref, var)) if a != b
    ]
    if len(var) < len(ref):
        found.append((len(var) + 1, ref[len(var)], "-", "truncation"))
    elif len(var) > len(ref):
        found.append((len(ref) + 1, "-", var[len(ref)], "extension"))
    return found


PAIRS = [
    ("MKTL", "MKTL"), ("MKTL", "MRTL"), ("MKTL", "MK*L"), ("MK*L", "MKAL"), ("MKTL", "MK"), ("MK", "MKTL"),
    ("", ""), ("", "AB"), ("AB", ""), ("Aé\nx", "Aê\nx"), ("A" * 32, "A" * 33), ("A" * 64, "A" * 63 + "B"),
]


def random_pairs(n=300):
    rng = random.Random(7)
    pairs = list(PAIRS)
    for _ in range(n):
        ref = "".join(rng.choice("AB*é") for _ in range(rng.randint(0, 150)))
        var = list(ref[: rng.randint(0, len(ref))]) if rng.random() < 0.4 else list(ref)
        for _ in range(rng.randint(0, 4)):
            if var:
                var[rng.randrange(len(var))] = rng.choice("AB*é")
        var += rng.choices("AB*", k=rng.randint(0, 40)) if rng.random() < 0.3 else []
        pairs.append((ref, "".join(var)))
    return pairs


def test_edits_match_brute_force(spark):
    pairs = random_pairs()
    rows = spark.createDataFrame(pairs, "r string, v string").select("r", "v", s.find_edits("r", "v").alias("e")).collect()
    for row in rows:
        assert [tuple(e) for e in row.e] == plain_edits(row.r, row.v), (row.r, row.v)
        assert (row.r == row.v) == (row.e == [])


def test_edits_of_null_read_as_empty(spark):
    df = spark.createDataFrame([(None, "A")], "r string, v string")
    assert [tuple(e) for e in df.select(s.find_edits("r", "v")).first()[0]] == [(1, "-", "A", "extension")]


@pytest.mark.parametrize("ref, var, stop, lost", [
    ("MKTLV", "MK*LV", True, 0.6), ("MKTLV", "MRTLV", False, 0.0), ("MK*LV", "MK*LV", False, 0.0),
    ("MK*LV", "M*KLV", True, 0.5), ("MKTLVVVV", "MKTL", False, 0.5), ("MK", "MKTL", False, 0.0),
    ("", "MK", False, 0.0), ("*AB", "", False, 0.0),
])
def test_stop_and_truncation(spark, ref, var, stop, lost):
    df = spark.createDataFrame([(ref, var)], "r string, v string")
    row = df.select(s.has_premature_stop("r", "v"), s.truncation_fraction("r", "v")).first()
    assert row[0] is stop and row[1] == pytest.approx(lost)


@pytest.mark.parametrize("position, length, part", [
    (1, 5, "N-terminal"), (2, 5, "middle"), (4, 5, "C-terminal"), (3, 0, "none"), (1, 10, "N-terminal"), (8, 10, "C-terminal")])
def test_region(spark, position, length, part):
    assert spark.createDataFrame([(position, length)], "p int, n int").select(s.region("p", "n")).first()[0] == part


def plain_features(ref, var):
    ref, var = ref or "", var or ""
    edits, n = plain_edits(ref, var), max(len(ref), 1)
    longer = max(len(ref), len(var))
    same = sum(a == b for a, b in zip(ref, var))
    ends = [e[0] / n for e in edits]
    ref_len = ref.index("*") if "*" in ref else len(ref)
    var_len = var.index("*") if "*" in var else len(var)
    early = "*" in var and ("*" not in ref or var.index("*") < ref.index("*"))
    return [
        float(len(ref) != len(var)), float(early), float(ref[:1] == "M" and var[:1] != "M"),
        sum(e[3] == "missense" for e in edits) / n, float(sum(e[3] == "nonsense" for e in edits)),
        1 - (same / longer if longer else 1.0), (ref_len - var_len) / ref_len if var_len < ref_len else 0.0,
        len(edits) / n * 100, sum(x <= 0.2 for x in ends) / len(ends) if ends else 0.0,
        sum(x >= 0.8 for x in ends) / len(ends) if ends else 0.0, math.log1p(len(edits)), len(var) / n,
    ]


def test_features_match_brute_force(spark):
    pairs = [*random_pairs(120), ("MKTL", "RKTL"), ("MKTL", "MKTLVVVV"), (None, "A"), ("A", None)]
    rows = pair_features(spark.createDataFrame(pairs, "ref_seq string, var_seq string")).collect()
    for row in rows:
        assert [row[f] for f in FEATURES] == pytest.approx(plain_features(row.ref_seq, row.var_seq)), row


def test_features_are_cut_first_on_request(spark):
    df = spark.createDataFrame([("MKTL", "MKTA")], "ref_seq string, var_seq string")
    assert pair_features(df, max_length=3).first()["log_edits"] == 0.0
    assert pair_features(df).first()["log_edits"] > 0.0


@pytest.mark.parametrize("codes, text", [
    ("K2R", "MRTL"), ("K2R:T3A", "MRAL"), ("K2R;R2Q", "MQTL"), ("X2R: T3A ", "MKAL"), ("KxR", "MKTL"),
    ("K22R", "MKTL"), ("K0R", "MKTL"), ("K2", "MKTL"), ("", "MKTL"), ("K02R", "MRTL"), ("K_2R", "MKTL"), ("k2R", "MKTL"),
    ("K99999999999999R", "MKTL"), ("\tK2R\n;\x0cT3f\x0b", "MRfL")])
def test_edit_codes(spark, codes, text):
    df = spark.createDataFrame([("MKTL", codes)], "r string, c string")
    assert df.select(s.apply_edit_codes("r", "c")).first()[0] == text


def test_given_text_wins_over_codes(spark):
    df = spark.createDataFrame([("MK", "K2R", "XX"), ("MK", "K2R", None)], "r string, c string, g string")
    assert [r[0] for r in df.select(s.build_variant("r", "c", "g")).collect()] == ["XX", "MR"]


@pytest.mark.parametrize("dna, protein, to_stop", [
    ("ATGAAATTT", "MKF", "MKF"), ("ATGTAAAAA", "M*K", "M"), ("", "", ""), ("ATGA", "M", "M"), ("AT", "", ""),
    ("augNNNTAR", "MX*", "MX"), ("CTNRAYMTH", "LBJ", "LBJ"), ("SAR", "Z", "Z"), ("AT-AAA", "", ""), ("ATGA-", "M", "M")])
def test_translation(spark, dna, protein, to_stop):
    df = spark.createDataFrame([(dna,)], "d string")
    assert tuple(df.select(s.translate("d"), s.translate("d", True)).first()) == (protein, to_stop)


def test_point_edits(spark):
    df = spark.createDataFrame([("ACGT", 1), ("ACGT", 4), ("ACGT", -1)], "d string, p int").select(
        s.substitute_char("d", "p", "'n'", strict=False), s.insert_text("d", "p", "'nn'", strict=False),
        s.delete_span("d", "p", "9", strict=False))
    assert [tuple(r) for r in df.collect()] == [("ANGT", "ANNCGT", "A"), (None, "ACGTNN", None), (None, None, None)]


@pytest.mark.parametrize("edit, place, more", [
    (s.substitute_char, "4", "'n'"), (s.insert_text, "5", "'n'"), (s.delete_span, "4", "1")])
def test_point_edits_out_of_range(spark, edit, place, more):
    with pytest.raises(PySparkException, match="in a text of 4 characters"):
        spark.createDataFrame([("ACGT",)], "d string").select(edit("d", place, more)).collect()


def test_small_text_functions(spark):
    df = spark.createDataFrame([("A*B*",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(s.drop_stops("t")).collect()] == ["AB", None, ""]
    assert [r[0] for r in df.select(s.clip("t", 2)).collect()] == ["A*", "", ""]
    key = df.select(s.content_key("t"), F.length(s.content_key("t", 64))).first()
    assert len(key[0]) == 16 and key[1] == 64
    flags = spark.createDataFrame([("ACGTN",), ("ACGU",), ("",), ("A" * 100 + "Q",), ("AC\n",)], "t string")
    assert [r[0] for r in flags.select(s.is_nucleotide("t")).collect()] == [True, False, True, True, False]


def test_translation_reads_small_letters_of_any_kind(spark):
    texts = ["augGcuUAa", "acn", "augſſſ", "augß", "zzz", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(s.translate("t")).collect()]
    wanted = [r[0] for r in rows.selectExpr("upper(t) t").select(s.translate("t")).collect()]
    assert got == wanted and got[:2] == ["MA*", "T"] and got[4:] == ["", "", None]


def test_translated_agrees_with_translate(spark):
    rng = random.Random(2)
    texts = [None, "", "A", "AC", "ACGT", "acguRYn", "TAA", "ACGTAAAC", "ACG-", "ACGT-", "ACGN*", "ACGß", "ﬅA", "tſa", "ACGé", "AC G", "ACG\nTT", "ATG\n"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for letters in ("ACGT", "acgtuU", "ACGTRYKMSWBDHVN", "ACGTX") for _ in range(100)]
    df = spark.createDataFrame([(t,) for t in texts], "d string").repartition(2)
    for r in df.select("d", s.translate("d").alias("p"), s.translate("d", True).alias("e")).collect():
        assert (s.translated(r.d), s.translated(r.d, True)) == (r.p, r.e), r
