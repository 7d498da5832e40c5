import re
import time
from fractions import Fraction

from twinframe.llm import decontaminate


def shingles(text, n=5):
    words = re.findall(r"\w+", (text or "").lower())
    n = min(n, len(words)) or 1
    return n, words, {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()


def plain_leaks(docs, items):
    out = set()
    for item, text in items:
        n, _, own = shingles(text)
        if not own:
            continue
        for doc, body in docs:
            words = shingles(body)[1]
            there = {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}
            shared = len(own & there)
            if Fraction(shared, len(own)) >= Fraction(4, 5):
                out.add((doc, item, len(own), shared))
    return out


def result(df):
    return {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in df.collect()}


def test_partial_items_at_the_threshold(spark):
    words = [f"w{i}" for i in range(400)]
    items = [(n, " ".join(words[n:n + n])) for n in (1, 3, 4, 5, 6, 9, 14, 19, 24, 33, 54, 64, 90)] + [(99, ""), (98, None)]
    docs = []
    for item, text in items[:-2]:
        own = text.split()
        for cut in range(0, len(own) // 3 + 2):
            filler = [f"x{item}y{cut}z{k}" for k in range(300)]
            docs.append((len(docs), " ".join(filler + own[cut:] + filler)))
            docs.append((len(docs), " ".join(filler + own[:len(own) - cut] + filler).upper()))
        middle = own[:len(own) // 2] + ["other"] + own[len(own) // 2 + 1:]
        docs.append((len(docs), ", ".join(middle)))
    docs += [(1000, None), (1001, ""), (1002, " ".join(words))]
    got = decontaminate.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"))
    wanted = plain_leaks(docs, items)
    assert result(got) == wanted and got.count() == len(wanted) and len(wanted) > 50


def test_blocks_give_the_same(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    whole = result(decontaminate.leaks(docs, items))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    assert result(decontaminate.leaks(docs, items)) == whole and whole
    assert whole == plain_leaks(
        [(d.doc_id, d.text) for d in docs.collect()], [(i.item_id, i.text) for i in items.collect()])


def test_shared_phrases_make_no_candidates():
    """Items that begin alike: the time of a document does not grow with their number."""
    prefix = "which of the following statements about the given passage is the correct one in every case"
    spent = []
    for n in (500, 16_000):
        items = decontaminate.prepare(
            [(i, f"{prefix} {' '.join(f'w{i}x{k}' for k in range(12))}") for i in range(n)], 0.8)
        known = decontaminate.WordHashes()
        words = decontaminate.words_of(f"{'some other words ' * 300}{prefix} and {' '.join(f'w3x{k}' for k in range(8))}")
        hashes = decontaminate.np.array([known[w] for w in words], decontaminate.np.uint64)
        list(decontaminate.contained(words, hashes, items, 0.8))
        start = time.perf_counter()
        for _ in range(20):
            assert list(decontaminate.contained(words, hashes, items, 0.8)) == []
        spent.append(time.perf_counter() - start)
        assert [f[0] for f in decontaminate.contained(
            *_hashed(f"{prefix} {' '.join(f'w3x{k}' for k in range(12))}", known), items, 0.8)] == [3]
    assert spent[1] < 5 * spent[0] + 0.05


def _hashed(text, known):
    words = decontaminate.words_of(text)
    return words, decontaminate.np.array([known[w] for w in words], decontaminate.np.uint64)


def test_equal_and_overlapping_items(spark):
    """Copies of an item are all found; so are items that share most of their shingles."""
    base = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(base)) for i in range(5)] + [
        (10 + i, " ".join(base[:30] + [f"y{i}{k}" for k in range(6)])) for i in range(30)] + [
        (50, " ".join(base[:3])), (51, " ".join(base[:3])), (52, "w1 w2"), (52, "w7 w8 w9 w10 w11 w12")]
    docs = [(0, " ".join(base)), (1, " ".join(base[:32])), (2, " ".join(["x", *base[:30], *(f"y4{k}" for k in range(6))])),
            (3, " ".join(base * 3))]
    got = decontaminate.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert result(got) - {r for r in result(got) if r[1] == 52} == plain_leaks(docs, items[:-2])


def test_odd_rows(spark, odd_docs):
    items = spark.createDataFrame(
        [(1, "The quick brown fox, jumps over the lazy dog"), (None, "the quick brown fox jumps"), (3, None),
         (4, "word5 AND5"), (5, "??")], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontaminate.leaks(odd_docs, items).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 1), (2, 1), (8, 1), (None, 1), (7, 4)], key=str)
    assert decontaminate.leaks(odd_docs.limit(0), items).count() == 0
    assert decontaminate.leaks(odd_docs, items.limit(0)).count() == 0
