import public_tokenizers
import tiktoken

from twinframe.llm import bpe, lengths


def test_against_plain_sums(spark):
    from twinframe.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.RANKS)))
    own = sorted(len(library.encode_ordinary(r.text)) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    table = QUERIES["op10_token_counts"](spark, folder)
    got = table.orderBy("n_tokens").collect()
    assert [r.n_tokens for r in got] == sorted(set(own))
    for r in got:
        limit = r.n_tokens
        assert r.n_docs == own.count(limit) and r.tokens_total == sum(own)
        assert r.docs_within == sum(n <= limit for n in own) and r.docs_beyond == sum(n > limit for n in own)
        assert r.tokens_within == sum(n for n in own if n <= limit)
        assert r.tokens_truncated == sum(min(n, limit) for n in own)
        assert r.tokens_beyond == sum(max(0, n - limit) for n in own)
        assert r.share_within == r.docs_within / len(own)
    for r in lengths.at_limits(table, [0, 1, 100, 777, 10**9]).collect():
        assert r.docs_within == sum(n <= r.context for n in own)
        assert r.docs_beyond == sum(n > r.context for n in own)
        assert r.tokens_truncated == sum(min(n, r.context) for n in own)
    for share in (0.1, 0.5, 0.9, 1.0):
        assert lengths.quantile(table, share).first()[0] == next(
            n for i, n in enumerate(own) if sum(m <= n for m in own) >= share * len(own))


def test_sums_over_several_parts(spark):
    counts = spark.createDataFrame([(n * n % 5000,) for n in range(300)], "n_tokens long")
    own = [n * n % 5000 for n in range(300)]
    for r in lengths.limits(counts).collect():
        assert r.tokens_truncated == sum(min(n, r.n_tokens) for n in own)


def test_odd_rows(spark, odd_docs):
    counts = lengths.lengths(odd_docs)
    assert counts.count() == odd_docs.count()
    table = lengths.limits(counts)
    zero = table.filter("n_tokens = 0").first()
    assert zero.n_docs == 3 and zero.tokens_truncated == 0
    none = lengths.limits(counts.limit(0))
    assert none.count() == 0 and lengths.at_limits(none, [5]).first().tokens_truncated == 0
    assert lengths.quantile(none, 0.5).first()[0] is None
