from twinframe.functions import explain as x
from twinframe.functions.sequence import find_edits


def explained(spark, ref, var, given=None):
    df = spark.createDataFrame([(ref, var, given)], "r string, v string, g array<double>")
    df = df.withColumn("e", find_edits("r", "v")).withColumn("e", x.annotate_edits("e"))
    return df.selectExpr("*", "'g' AS name", "'low' AS call", "0.95D AS conf").select(
        "e", x.top_edits("e").alias("top"), x.position_scores("r", "v", "e").alias("scores"),
        x.position_scores("r", "v", "e", "g").alias("given"),
        x.summary("name", "call", "conf", "r", "v", "e").alias("summary")).first()


def test_impacts_and_order(spark):
    row = explained(spark, "MKTLV", "MR*LV")
    assert [(e.position, e.impact) for e in row.e] == [(2, "moderate"), (3, "high")]
    assert [(e.position, e.type) for e in row.top] == [(3, "nonsense"), (2, "missense")]
    assert row.scores == [0.0, 0.5, 1.0, 0.0, 0.0]
    assert row.given == row.scores
    assert row.summary == "g: low (confidence=95.00%) | Premature stop at position 3 (T→*) | 1 missense mutation(s)"


def test_nothing_changed(spark):
    row = explained(spark, "MKTL", "MKTL")
    assert row.top == [] and row.scores == [0.0] * 4
    assert row.summary.endswith(" | No mutations detected — wildtype sequence.")
    assert explained(spark, "", "").scores == [0.0]


def test_truncation_and_extension(spark):
    row = explained(spark, "MKTLVVVV", "MKTL")
    assert row.scores == [0.0] * 4 + [1.0] + [0.0] * 3
    assert row.summary == "g: low (confidence=95.00%) | Truncation: 50% of protein lost"
    row = explained(spark, "MK", "MKTL")
    assert row.scores == [0.0, 0.0, 0.5, 0.0] and row.top[0].impact == "low"
    assert row.summary == "g: low (confidence=95.00%)"


def test_at_most_ten_positions_and_three_lines(spark):
    row = explained(spark, "A" * 30, "*" * 15 + "A" * 15)
    assert [e.position for e in row.top] == list(range(1, 11))
    assert row.summary.count("Premature stop") == 3


def test_given_scores_are_cut_or_padded(spark):
    assert explained(spark, "MKTL", "MK*L", [0.1, 0.9]).given == [0.1, 0.9, 0.0, 0.0]
    assert explained(spark, "MK", "M*", [0.1, 0.2, 0.3]).given == [0.1, 0.2]
