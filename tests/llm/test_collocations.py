import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinframe.llm import collocations


def plain_counts(rows, longest=3):
    """Occurrences by language and phrase; the empty phrase counts words."""
    found = defaultdict(Counter)
    for lang, text in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            found["und" if lang is None else lang][()] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    found["und" if lang is None else lang][tuple(words[i:i + k])] += 1
    return found


def plain(rows, longest=3, least=10, top=2000, share=50):
    out = []
    for lang, f in plain_counts(rows, longest).items():
        kept = []
        candidates = [p for p, a in f.items() if len(p) > 1 and a >= least]
        for p in candidates:
            inside = [q for q in candidates if len(q) > len(p) and any(
                q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * f[q] >= share * f[p] for q in inside):
                continue
            cuts = [(1000000 * f[p] ** 2 // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, f[()], -score))
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("grp", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.fixture(scope="module")
def noisy():
    rng = random.Random(9)
    vocabulary = [*"abcdefgh", "New", "york", "ÉTÉ", "é", "x" * 300, "中文"]
    rows = []
    for i in range(300):
        words = rng.choices(vocabulary, k=rng.choice((0, 1, 5, 40, 400)))
        text = "".join(w + rng.choice((" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0c", " ")) for w in words)
        rows.append((i, text, rng.choice(("en", "en", "fr", None))))
    return rows + [(-1, None, "en"), (-2, "", None), (None, "New York " * 30, "solo"), (-3, " ,. ", "none")]


@pytest.mark.parametrize("tuning", [{}, {"size": 200, "mass": 50, "most_bits": 16}])
def test_against_plain_counts(spark, noisy, tuning):
    """Also with blocks far shorter than texts and many hash partitions, whose summaries have few counters."""
    docs = spark.createDataFrame(noisy, "doc_id long, text string, lang string").repartition(5)
    own = [(lang, text) for _, text, lang in noisy]
    assert rows_of(collocations.collocations(docs, **tuning)) == plain(own)
    for options in ({"longest": 4, "least": 3, "top": 7, "share": 80}, {"longest": 2, "least": 25}):
        assert rows_of(collocations.collocations(docs, **options, **tuning)) == plain(own, **options)


def test_query_against_plain_counts(spark):
    from twinframe.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = QUERIES["op12_collocations"](spark, folder).withColumnRenamed("lang", "grp")
    assert rows_of(got) == plain(rows)


def test_odd_rows(spark, odd_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert rows_of(collocations.collocations(odd_docs, least=2)) == plain(rows, least=2)
    assert collocations.collocations(odd_docs.limit(0)).count() == 0


def test_products_beyond_64_bits(spark):
    known = spark.createDataFrame(
        [("en", "a", 1, 9 * 10**14), ("en", "b", 1, 8 * 10**14), ("en", "a b", 2, 7 * 10**14 + 1), ("en", "", 0, 10**15)],
        "grp string, phrase string, words int, a long")
    real, collocations.frequent_phrases = collocations.frequent_phrases, lambda *_, **__: known
    try:
        got = collocations.collocations(known).first()
    finally:
        collocations.frequent_phrases = real
    assert got.score == 1000000 * (7 * 10**14 + 1) ** 2 // (72 * 10**28)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=60), max_size=12), st.integers(1, 12))
def test_frequent_hashes_survive(parts, least):
    exact = Counter(x for part in parts for x in part)
    summary = collocations.MisraGries(least, sum(exact.values()))
    for part in parts:
        hashes, counts = np.unique(np.array(part, np.uint64), return_counts=True)
        summary.add(hashes, counts)
    left = set(summary.survivors().tolist())
    assert {h for h, n in exact.items() if n >= least} <= left
    assert summary.taken < least and len(left) <= summary.capacity == sum(exact.values()) // least + 1


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab ,.\t", max_size=60), st.integers(1, 9), st.integers(0, 3))
def test_cut_texts_keep_every_phrase(text, size, carry):
    parts = list(collocations._cut(text.encode(), size, carry))
    block = collocations.Block(["g"] * len(parts), [p for _, p in parts], [c for c, _ in parts])
    words = block.vocabulary.to_pylist()
    for n, (value, _, counts) in enumerate(block.hashes(carry + 1), 1):
        got = Counter(" ".join(words[c].decode() for c in block.codes[i:i + n]) for i in np.flatnonzero(counts))
        wanted = Counter({" ".join(k): v for k, v in plain_counts([("g", text)], carry + 1)["g"].items() if len(k) == n})
        assert got == wanted
