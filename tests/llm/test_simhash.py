import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from twinframe.llm import simhash
from twinframe.llm.common import components


def plain_fingerprint(text):
    words = (text or "").encode().translate(bytes.maketrans(
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, budget=4):
    """Smallest index of each class, by comparing all pairs."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def near(rng, center, flips):
    for bit in rng.sample(range(64), flips):
        center ^= 1 << bit
    return center


def test_fingerprint_as_stated():
    for text in ("", "A b", "a b c d", "A b C d e", "Ä B c  d\x0be f", "to be or not to be " * 50):
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_trie_equals_all_pairs():
    rng = random.Random(1)
    centers = [rng.getrandbits(64) for _ in range(40)]
    prints = sorted({near(rng, rng.choice(centers), rng.randint(0, 5)) for _ in range(600)})
    got = simhash.trie_classes(np.zeros(len(prints), np.int64), np.array(prints, np.uint64))
    assert got.tolist() == plain_classes(prints)


def test_trie_keeps_keys_apart_and_takes_equal_prints():
    keys = np.array([1, 1, 2, 2, 3], np.int64)
    prints = np.array([5, 5, 5, 4, 1 << 63], np.uint64)
    order = np.lexsort((prints, keys))
    got = simhash.trie_classes(keys[order], prints[order])
    assert got.tolist() == [0, 0, 2, 2, 4]


def test_small_frontier_gives_the_same(monkeypatch):
    rng = random.Random(2)
    prints = sorted({near(rng, 12345678901234567, rng.randint(0, 6)) for _ in range(400)})
    wanted = plain_classes(prints)
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    assert simhash.trie_classes(
        np.zeros(len(prints), np.int64), np.array(prints, np.uint64)).tolist() == wanted


def test_links_lose_nothing(spark):
    rng = random.Random(3)
    centers = [rng.getrandbits(64) for _ in range(30)] + [(1 << 64) - 1, 0, 1 << 63]
    prints = sorted({near(rng, rng.choice(centers), rng.randint(0, 4)) for _ in range(500)})
    rows = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)]
    found = components(simhash.trie_links(spark.createDataFrame(rows, "fp long, rep long")))
    got = {r.node: r.component for r in found.collect()}
    assert [got.get(i, i) for i in range(len(prints))] == plain_classes(prints)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame(
        [(i, i + 1) for i in range(200)] + [(300, 301), (301, 300), (7, 7), (400, 400)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 300: 300, 301: 300}


def test_whole_query_against_all_pairs(spark):
    from twinframe.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    prints = [plain_fingerprint(d.text) for d in docs]
    wanted = {
        d.doc_id: (f"{p:016x}", docs[c].doc_id) for d, p, c in zip(docs, prints, plain_classes(prints))}
    got = QUERIES["op8_simhash_near_duplicates"](spark, folder).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == wanted and len(got) == len(docs)


def test_odd_rows(spark, odd_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by[1] == by[2] == 1 and by[3] == by[4] == by[5] == 3 and by[7] == 7
    assert sorted(r.component_id for r in got if r.doc_id is None) == [1, 3]
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0
    alone = simhash.near_duplicates(odd_docs.filter(F.col("doc_id").isNull())).collect()
    assert [r.component_id for r in alone] == [None, None]
