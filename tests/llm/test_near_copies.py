import random

import numpy as np

from twinframe.llm import near_copies, simhash

from .test_simhash import plain_fingerprint


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    n = min(n, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()


def plain_groups(texts, similar):
    """Smallest index of each group, by comparing all pairs: four bits, and with `similar` four fifths of the shingles."""
    prints, sets = [plain_fingerprint(t) for t in texts], [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            close = (prints[i] ^ prints[j]).bit_count() <= 4
            if close or similar and len(a & b) >= 0.8 * len(a | b) > 0:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


def edited(rng, words, changes):
    words = list(words)
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"new{rng.random()}"
    return words


def test_near_copies_are_found_and_nothing_else(spark):
    """Copies with shingles shared to 0.8 and more: over nine in ten go; texts that share less stay."""
    rng = random.Random(12)
    texts = []
    for i in range(90):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(120, 500))]
        texts.append(" ".join(base))
        # About 0.8 to 0.9 of the shingles stay; every third group has a text beyond that too.
        for _ in range(rng.randint(1, 3)):
            texts.append(" ".join(edited(rng, base, len(base) // 50)))
        if i % 3 == 0:
            texts.append(" ".join(edited(rng, base, len(base) // 8)))
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order] + ["", None, "one", "one two", "ONE  two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    got = {r.first for r in near_copies.first_of_groups(docs, "id").collect()}
    fewest, most = plain_groups(texts, False), plain_groups(texts, True)
    firsts = {i for i, g in enumerate(most) if g == i}
    assert firsts <= got <= {i for i, g in enumerate(fewest) if g == i}
    gone, by_four_bits = len(texts) - len(got), sum(g != i for i, g in enumerate(fewest))
    assert gone >= 0.9 * (len(texts) - len(firsts)) > by_four_bits
    empty = docs.limit(0)
    assert near_copies.first_of_groups(empty, "id").count() == 0


def test_a_large_group_of_copies_gives_few_pairs(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)] + [" ".join(edited(rng, base, 2)) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    prints = near_copies._prints(docs, "id", "text")
    reps = prints.groupBy("fp", "wide").count().selectExpr("wide", "xxhash64(fp, wide) as rep")
    assert near_copies.candidates(reps).count() < 2 * near_copies.TABLES * len(texts)
    assert [r.first for r in near_copies.first_of_groups(docs, "id").collect()] == [0]


def test_edges_join_the_classes_of_the_trie():
    rng = np.random.default_rng(5)
    centers = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    prints = np.unique(centers[rng.integers(0, 30, 800)] ^ np.bitwise_or.reduce(
        np.uint64(1) << rng.integers(0, 64, (3, 800), dtype=np.uint64)))
    keys = np.zeros(len(prints), np.int64)
    u, v = simhash.trie_edges(keys, prints, 6)
    assert (np.bitwise_count(prints[u] ^ prints[v]) <= 6).all()
    labels = simhash._labels(len(prints), u, v, np.arange(len(prints)))
    assert (labels == simhash.trie_classes(keys, prints, 6)).all()
    assert [len(x) for x in simhash.trie_edges(keys[:0], prints[:0], 6)] == [0, 0]
