import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from twinframe.llm import bpe

from .test_decontaminate import plain_leaks
from .test_secret_scan import plain_base
from .test_near_copies import plain_groups

FOLDER = "/root/testdata/sf0.001"


def test_every_stage_against_plain_versions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    items = [(i.item_id, i.text) for i in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns
        kept.append(sorted(docs.collect(), key=lambda r: r.doc_id))
    known, single, clean, safe = kept
    assert len(known) >= 195
    # The groups hold all links of four bits, and no others but of pairs that share four fifths of their shingles.
    fewest, most = plain_groups([r.text for r in known], False), plain_groups([r.text for r in known], True)
    left = {r.doc_id for r in single}
    assert {r.doc_id for i, r in enumerate(known) if most[i] == i} <= left
    assert left <= {r.doc_id for i, r in enumerate(known) if fewest[i] == i}
    leaking = {d for d, *_ in plain_leaks([(r.doc_id, r.text) for r in single], items)}
    assert [r.doc_id for r in clean] == [r.doc_id for r in single if r.doc_id not in leaking]
    for before, after in zip(clean, safe):
        assert before.doc_id == after.doc_id and not plain_base(after.text)
        assert after.n_chars == len(after.text)
        assert plain_base(before.text) or "[SECRET]" in after.text or before.text == after.text
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.RANKS)))
    last = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert sorted(last) == [r.doc_id for r in safe]
    for r in safe:
        assert last[r.doc_id].ids == library.encode_ordinary(r.text) and last[r.doc_id].round_trip


def test_odd_rows(spark, odd_docs):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd_docs, FOLDER)
        assert got.count() <= odd_docs.count(), name
        assert stage(spark, odd_docs.limit(0), FOLDER).count() == 0, name
    one = corpus_pipeline.one_of_each_group(spark, odd_docs, FOLDER)
    assert one.filter(F.col("doc_id").isNull()).count() == 0 and one.filter("doc_id = 2").count() == 0


def test_null_and_repeated_ids(spark):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    texts = [" ".join(f"{name}{i * i}" for i in range(60)) for name in ("oak", "elm", "fir", "ash")]
    rows = [(None, texts[0]), (None, texts[0]), (7, texts[1]), (7, texts[2]), (7, texts[2]), (None, texts[1]), (9, texts[1]),
            (None, item), (8, item + " " + texts[3]), (8, texts[3]), (None, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    one = corpus_pipeline.one_of_each_group(spark, docs, FOLDER)
    wanted = [(None, texts[0]), (7, texts[1]), (7, texts[2]), (None, item), (8, item + " " + texts[3]), (8, texts[3]), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in one.collect()), key=str) == sorted(wanted, key=str)
    clean = corpus_pipeline.decontaminated(spark, docs, FOLDER)
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted(rows[:7] + rows[9:], key=str)
