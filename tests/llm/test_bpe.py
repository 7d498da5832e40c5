import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from twinframe.llm import bpe

PATH = public_tokenizers.path(bpe.RANKS)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_words_as_the_library(library):
    rng = random.Random(5)
    alphabets = ["abcdefgh", "aA1 '", "éèñß中文😀́", "\n\t  　", "=-_#*", "aaaaab"]
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 60))) for a in alphabets for _ in range(200)]
    texts += ["", "a" * 5000, "ab" * 3000, " " * 300 + "x", "<|endoftext|>", "I'll we've don't'S"]
    encoder = bpe.Encoder(bpe.load_ranks(PATH), public_tokenizers.PATTERN, known=50)
    for at in range(0, len(texts), 37):
        part = texts[at:at + 37]
        packed = encoder.encode(part)
        for text, ids in zip(part, packed):
            assert memoryview(ids).cast("i").tolist() == library.encode_ordinary(text), text


def test_a_merge_that_makes_an_earlier_one_possible():
    ranks = {bytes([b]): b for b in range(256)}
    # "ab" comes late, yet with "c" it makes the early "abc"; equal ranks go leftmost first.
    ranks |= {b"abc": 256, b"zz": 257, b"ab": 258, b"zzz": 259, b"bb": 260}
    words = [b"abcab", b"zzzzz", b"ababcabb", b"bbb", b"abcabczzabzz"]
    own = tiktoken.Encoding("t", pat_str=r"[a-z]+", mergeable_ranks=ranks, special_tokens={})
    wanted = [own.encode_ordinary(w.decode()) for w in words]
    for copies in (1, 300):  # few places of a pair, and many
        packed = bpe.MergeReplay(ranks).encode(words * copies)
        assert [memoryview(p).cast("i").tolist() for p in packed] == wanted * copies
    assert 258 in bpe.MergeReplay(ranks).turning


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = bpe.decode(bpe.encode(docs)).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.ids == library.encode_ordinary(r.text) and bytes(r.decoded).decode() == r.text


def test_odd_rows(spark, odd_docs, library):
    got = bpe.decode(bpe.encode(odd_docs))
    assert got.columns == ["doc_id", "ids", "decoded"]
    assert got.filter(F.size("ids") == 0).count() == 3
    wanted = sorted(str((r.doc_id, library.encode_ordinary(r.text or ""), (r.text or "").encode())) for r in odd_docs.collect())
    assert sorted(str((r.doc_id, r.ids, bytes(r.decoded))) for r in got.collect()) == wanted
    assert bpe.decode(bpe.encode(odd_docs.limit(0))).count() == 0
    assert sorted(map(str, bpe.encode(odd_docs, decoded=True).collect())) == sorted(map(str, got.collect()))
    null = spark.sql("SELECT CAST(NULL AS array<int>) AS ids")
    assert bpe.decode(null).first().decoded is None
