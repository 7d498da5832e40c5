"""Sources, sinks and the encode-once flow on files of their own."""

import hashlib
import json
from pathlib import Path
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from twinframe.operators import encode as e
from twinframe.operators.curate import catalog_references
from twinframe.operators.features import FEATURES
from twinframe.session import drop_stored, materialize, shared_folder
from twinframe.sources import scores, sequences, sinks, tables, variants


def test_tables(spark, tmp_path):
    path = tmp_path / "pairs.csv"
    pd.DataFrame({"ref_protein": ["MK"], "var_protein": ["M"], "label": [2], "dms_zscore": [1.5]}).to_csv(path, index=False)
    row = tables.read_pairs(spark, str(path)).first()
    assert (row.label, row.dms_zscore) == (2, 1.5)
    with pytest.raises(ValueError, match="ending in '.txt'"):
        tables.read_table(spark, "data.txt")
    with pytest.raises(ValueError, match="no column .*var_protein"):
        tables.require_columns(spark.createDataFrame([("M", 0)], "ref_protein string, label int"))
    assert tables.read_optional(spark, str(tmp_path / "none"), tables.CURATED).columns[0] == "gene"
    with pytest.raises(FileNotFoundError):
        tables.read_cached_pairs(spark, str(tmp_path / "none"))
    spark.createDataFrame([(1,)], "label int").write.parquet(str(tmp_path / "cached.parquet"))
    assert tables.read_cached_pairs(spark, str(tmp_path / "cached.parquet")).first().dms_scores == 0.0


def test_catalog(spark, tmp_path):
    small, large = tmp_path / "small.csv", tmp_path / "large.csv"
    small.write_text("DMS_id,x\na,b\n")
    large.write_text("DMS_id,target_seq\n" + "abc,MKTLVVVVVVVVVVVVVVVV\n" * 9)
    assert tables.read_catalog(spark, str(small)).isEmpty()
    assert tables.read_catalog(spark, str(tmp_path / "none.csv")).isEmpty()
    assert tables.read_catalog(spark, str(large)).count() == 9


@pytest.mark.parametrize("n", [9, 11, 2])
def test_synthetic_pairs(spark, n):
    rows = tables.synthetic_pairs(spark, n).collect()
    sizes = [sum(r.label == k for r in rows) for k in range(3)]
    assert sizes == [n // 3, n // 3, n - 2 * (n // 3)]
    for r in rows:
        assert "*" not in r.var_seq and r.premature_stop == float(r.label == 0)
        assert {f for f in FEATURES} < set(r.asDict())


def test_score_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a_x.csv").write_text("mutant,DMS_score,mutated_sequence\n\nK2R,0.5,MR\nM1A,,AK\nQ1A,bad\n")
    (tmp_path / "deep" / "b_x.csv").write_text('score,mutation,fitness\r\n1.5,"K2T:""Q"", 1",9\r\n')
    (tmp_path / "c_x.csv").write_text("other,mutant\n1,K2R\n")
    (tmp_path / "d_y.csv").write_text("score,mutant\n1,K2R\n")
    (tmp_path / "empty_x.csv").write_text("")
    (tmp_path / "only_x.csv").write_text("score,mutant\n")
    # Files that are left out whole: a line with too many fields, an open quote, bytes that are no text.
    (tmp_path / "ragged_x.csv").write_text("score,mutant\n1,K2R\n2,K3R,x\n")
    (tmp_path / "open_x.csv").write_text('score,mutant\n1,K2R\n2,"K3R\n')
    (tmp_path / "bytes_x.csv").write_bytes(b"score,mutant\n1,K2R\n2,\xff\xfe\n")
    (tmp_path / "sp +%25 _x.csv").write_text("score,mutant\n,K2R\n")
    (tmp_path / "notes.txt").write_text("score,mutant\n1,2\n")
    got = scores.read_score_files(spark, str(tmp_path), lambda files: files.filter("assay LIKE '%_x'"))
    rows = [(r.assay, r.score, r.mutant, r.mutated_sequence) for r in got.orderBy("row_no").collect()]
    assert sorted(rows, key=str) == sorted([
        ("a_x", 0.5, "K2R", "MR"), ("a_x", None, "M1A", "AK"), ("a_x", None, "Q1A", None),
        ("b_x", 1.5, 'K2T:"Q", 1', None), ("sp +%25 _x", None, "K2R", None)], key=str)
    assert [r.mutant for r in got.filter("assay = 'a_x'").orderBy("row_no").collect()] == ["K2R", "M1A", "Q1A"]
    assert scores.read_score_files(spark, str(tmp_path), lambda files: files.limit(0)).isEmpty()


def test_fasta(spark, tmp_path):
    path = tmp_path / "x.fasta"
    path.write_bytes(b">g1 first one\nacgt\nACG\n>g2\r\nMK T\r\n\n>g1\nTTT>A\n>empty\n")
    rows = sequences.read_fasta(spark, str(path)).orderBy("record_no").collect()
    assert [(r.id, r.seq) for r in rows] == [("g1", "ACGTACG"), ("g2", "MKT"), ("g1", "TTT>A"), ("empty", "")]
    assert {r.id: r.seq for r in sequences.read_references(spark, str(path)).collect()}["g1"] == "TTT>A"
    path.write_text(">g\nATGAAATAAATG\n")
    assert sequences.read_translated(spark, str(path)).first().seq == "MK"


def test_fasta_is_split_between_tasks(spark, tmp_path):
    path = tmp_path / "big.fasta"
    path.write_text("".join(f">r{i} x\n{'ACGT' * (i % 9)}\n{'GG' * (i % 4)}\n" for i in range(4000)))
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "4096")
    try:
        df = sequences.read_fasta(spark, str(path))
        assert df.rdd.getNumPartitions() > 5
        rows = df.orderBy("record_no").collect()
    finally:
        spark.conf.set(setting, before)
    assert [(r.id, r.seq) for r in rows] == [(f"r{i}", "ACGT" * (i % 9) + "GG" * (i % 4)) for i in range(4000)]


def test_vcf(spark, tmp_path):
    path = tmp_path / "x.vcf"
    ann = "|".join(["A", "stop_gained", "HIGH", "g1"] + ["t"] * 7)
    short = "A|other|HIGH|g2"
    path.write_text(
        "##head\n#CHROM\tPOS\nc1\t5\t.\tA\tT\n\nc1\t6\tid\tA\n"
        f"c2\t10\t.\tAC\tA\t.\tPASS\tDP=3;ANN={ann},{short},{ann.replace('g1', 'g3')};ANN={ann}\n"
        "c3\t1\t.\tA\tT\t.\t.\tDP=1\n")
    rows = variants.read_variants(spark, str(path)).orderBy("row_no").collect()
    assert [(r.chrom, r.pos, r.ref, r.alt) for r in rows] == [("c1", 4, "A", "T"), ("c2", 9, "AC", "A"), ("c3", 0, "A", "T")]
    notes = variants.read_annotations(spark, str(path), {"stop_gained": "low"}, "mid").orderBy("row_no").collect()
    assert [(r.gene, r.effect, r.impact, r.label) for r in notes] == [
        ("g1", "stop_gained", "HIGH", "low"), ("g3", "stop_gained", "HIGH", "low")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame(
        [("g", "low", 0.75, [0.75, 0.125, 0.125], 'say "x" | y', "train"), ("h", "mid", 0.5, [0.2, 0.5, 0.3], None, "test")],
        "gene string, prediction string, confidence double, probabilities array<double>, summary string, split string")
    sinks.write_splits(df, str(tmp_path / "splits"))
    assert spark.read.parquet(str(tmp_path / "splits")).count() == 2
    assert spark.read.parquet(str(tmp_path / "splits" / "split=train")).first().gene == "g"
    sinks.write_tsv_report(df.coalesce(1), str(tmp_path / "tsv"))
    lines = next((tmp_path / "tsv").glob("*.csv")).read_text().splitlines()
    assert lines[0].split("\t") == ["gene", "prediction", "confidence", "low_prob", "mid_prob", "high_prob", "summary"]
    assert lines[1].split("\t") == ["g", "low", "0.7500", "0.7500", "0.1250", "0.1250", 'say "x" | y']
    assert lines[2].split("\t") == ["h", "mid", "0.5000", "0.2000", "0.5000", "0.3000", ""]
    sinks.write_json_report(df, str(tmp_path / "json"))
    assert {r.gene for r in tables.read_report(spark, str(tmp_path / "json")).collect()} == {"g", "h"}
    array = tmp_path / "array.json"
    array.write_text(json.dumps([{"gene": "g", "prediction": "low"}, {"gene": "h", "prediction": "mid"}], indent=1))
    assert tables.read_predictions(spark, str(array)).count() == 2
    sinks.show_report(df, 1)


def test_fields_of_lines(spark):
    lines = {"": [None], ",": [None, None], ",a": [None, "a"], 'a,"b,c",': ["a", "b,c", None], '"",x': [None, "x"],
             '"a ""b"", c",2': ['a "b", c', "2"], " a ,b": [" a ", "b"]}
    df = spark.createDataFrame([(k,) for k in lines], "line string")
    assert {r.line: r.f for r in df.select("line", scores.csv_fields("line").alias("f")).collect()} == lines


def test_a_broken_write_of_splits_is_repeated(spark, tmp_path):
    path = str(tmp_path / "splits")
    good = spark.createDataFrame([(i, "train" if i % 3 else "test") for i in range(30)], "id int, split string")

    def broken(batches):
        for i, batch in enumerate(batches):
            yield batch
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        sinks.write_splits(good.mapInArrow(broken, good.schema), path)
    assert sinks.finished_splits(spark, path) is None
    with pytest.raises(FileNotFoundError):
        sinks.read_splits(spark, path)
    sinks.write_splits(good, path)
    assert sinks.finished_splits(spark, path) == ["test", "train"]
    with pytest.raises(FileExistsError):
        sinks.write_splits(good, path)
    # A run that breaks off while it replaces a finished set leaves no marker, and is repeated likewise.
    with pytest.raises(Exception, match="lost"):
        sinks.write_splits(good.mapInArrow(broken, good.schema), path, "overwrite")
    assert sinks.finished_splits(spark, path) is None
    sinks.write_splits(good.filter("split = 'train'"), path)
    assert {r.split for r in sinks.read_splits(spark, path).collect()} == {"train"}
    assert sinks.read_splits(spark, path).count() == 20
    sinks.write_splits(good, path, "overwrite")
    assert sinks.read_splits(spark, path).count() == 30


def test_batches_cost_no_more_than_stated(spark):
    texts = [(f"k{i:04d}", "x" * (i * 37 % 211)) for i in range(900)] + [("long", "x" * 5000), ("none", None)]
    df = spark.createDataFrame(texts, "seq_key string, text string").repartition(7)
    rows = e.length_batches(df, 1000).collect()
    assert sorted(r.seq_key for r in rows) == sorted(k for k, _ in texts)
    batches = {}
    for r in rows:
        batches.setdefault(r.batch, []).append(r)
    assert sorted(batches) == list(range(len(batches)))
    for number, own in batches.items():
        assert sorted(r.place for r in own) == list(range(len(own)))
        longest = max(r.size for r in own)
        assert len(own) == 1 or len(own) * longest <= 1000
        assert number == 0 or min(r.size for r in own) + 16 >= max(r.size for r in batches[number - 1])
    # Little is left unused: a class of n rows has the fewest batches that its length allows.
    assert len(batches) <= sum(len(t or "") + 16 for _, t in texts) / 1000 * 1.3 + 211 / 16 + 2
    assert e.length_batches(df.limit(0), 1000).count() == 0


def test_encode_once_only_encodes_what_is_missing(spark, tmp_path):
    path, log = str(tmp_path / "vectors"), tmp_path / "log"
    log.mkdir()

    def encoder(texts):
        for t in texts:
            (log / hashlib.sha256(t.encode()).hexdigest()).touch()
        return e.hashing_encoder()(texts)

    train = spark.createDataFrame([("MK*", "MKT"), ("MK", "MA"), ("MKT", "")], "ref_seq string, var_seq string")
    val = spark.createDataFrame([("MK", "NEW")], "ref_seq string, var_seq string")
    vectors = e.encode_once(spark, [train], path, encoder)
    assert vectors.count() == 4 and len(list(log.iterdir())) == 4
    for f in log.iterdir():
        f.unlink()
    again = e.encode_once(spark, [train, val], path, encoder)
    assert again.count() == 5 and [f.name for f in log.iterdir()] == [hashlib.sha256(b"NEW").hexdigest()]
    texts = e.distinct_texts(train, val)
    assert tuple(e.coverage(texts, again).first()) == (5, 0, True)
    assert tuple(e.coverage(texts, again.limit(0)).first()) == (5, 5, False)
    for used in (None, texts):
        done = e.scatter_vectors(train, again, used)
        assert done.count() == 3 and done.filter("ref_mean IS NULL OR var_max IS NULL").isEmpty()
        empty = done.filter("var_seq = ''").first()
        assert empty.var_mean == [0.0] * e.HASH_DIMS and empty.var_max == [0.0] * e.HASH_DIMS
    sinks.write_vectors(again, str(tmp_path / "copy"))
    assert e.read_vectors(spark, str(tmp_path / "copy")).count() == 5


def test_dedup_report(spark):
    df = spark.createDataFrame([("a", "x", "y"), ("a", "x", "x"), ("b", "x", "x*")], "g string, ref_seq string, var_seq string")
    got = {r.g: (r.n_rows, r.n_texts, r.n_distinct, r.reduction_pct) for r in e.dedup_report(df, ["g"]).collect()}
    assert got == {"a": (2, 4, 2, 50.0), "b": (1, 2, 1, 50.0)}
    assert tuple(e.dedup_report(df.limit(0)).first()) == (0, 0, 0, 100.0)


def test_batches_come_sorted_by_length(spark):
    texts = spark.range(200).select(
        F.repeat(F.lit("A"), (F.col("id") % 7).cast("int")).alias("text"), F.col("id").cast("string").alias("seq_key"))
    parts = e.by_length(texts, 4).select(F.length("text").alias("n")).rdd.glom().collect()
    assert len(parts) == 4 and all([r.n for r in p] == sorted(r.n for r in p) for p in parts)
    assert max(map(len, parts)) < 100


def test_stored_tables(spark):
    df = spark.range(5).withColumn("s", F.struct(F.col("id").alias("x")))
    assert sorted(materialize(df).collect()) == sorted(df.collect())
    assert shared_folder(spark) == shared_folder(spark)


def test_shared_folder_on_a_cluster():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        sparkContext = SimpleNamespace(getCheckpointDir=lambda: None)  # noqa: N815

        def __init__(self, **settings):
            self.conf = Conf({k.replace("_", "."): v for k, v in settings.items()})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session(spark_master="yarn"))
    assert shared_folder(Session(spark_master="yarn", spark_checkpoint_dir="hdfs:///x/")) == "hdfs:///x"


def test_stored_tables_can_be_dropped(spark):
    kept = materialize(spark.range(3))
    path = kept.inputFiles()[0]
    assert drop_stored(spark) >= 1
    assert not Path(path.removeprefix("file://")).exists()


def test_quoted_fields(spark, tmp_path):
    (tmp_path / "scores").mkdir()
    line = 'A1C,"say ""hi"", ok",0.5,CCC\n'
    (tmp_path / "scores" / "one.csv").write_text("mutant,note,DMS_score,mutated_sequence\n" + line)
    row = scores.read_score_files(spark, str(tmp_path / "scores")).first()
    assert (row.mutant, row.score, row.mutated_sequence) == ("A1C", 0.5, "CCC")
    (tmp_path / "t.csv").write_text("mutant,note,x,y\n" + line)
    assert tables.read_table(spark, str(tmp_path / "t.csv")).first().note == 'say "hi", ok'


def test_last_line_of_a_catalog_wins(spark, tmp_path):
    folder = tmp_path / "catalog"
    folder.mkdir()
    for name, text in (("a.csv", "x"), ("b.csv", "y"), ("c.csv", "z")):
        (folder / name).write_text("DMS_id,target_seq\n" + "".join(f'D{i},"{text * 12}{i}"\n' for i in range(5)))
    catalog = tables.read_catalog(spark, str(folder))
    got = {r.assay: r.ref_seq for r in catalog_references(catalog).collect()}
    assert got == {f"D{i}": "z" * 12 + str(i) for i in range(5)}
