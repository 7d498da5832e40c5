import math
import random
from collections import defaultdict

import pytest

from twinframe.llm import mixing

FOLDER = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def n_words(text):
    for c in BLANK:
        text = (text or "").replace(c, " ")
    return len([w for w in text.split(" ") if w])


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Shares by weight; what is over a limit goes to the others, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, rest = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weight[s] * level >= most * sizes[s]]
        if not over:
            return {**full, **{s: weight[s] * level for s in open_}}
        for s in over:
            full[s] = most * sizes[s]
            rest -= full[s]


def check(rows, got, **options):
    assert sorted(map(str, ((r["doc_id"], r["source"], n_words(r["text"])) for r in rows))) == sorted(
        map(str, ((g["key"], g["source"], g["size"]) for g in got)))
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for g in got:
        sizes[g["source"]] += g["size"]
        taken[g["source"]] += g["taken"]
        largest[g["source"]] = max(largest[g["source"]], g["size"])
    wanted = plain_targets(sizes, **options)
    for g in got:
        rate = wanted[g["source"]] / sizes[g["source"]] if sizes[g["source"]] else 0
        assert g["source_size"] == sizes[g["source"]]
        assert math.isclose(g["target"], wanted[g["source"]], rel_tol=1e-9)
        assert math.floor(rate - 1e-9) <= g["copies"] <= math.ceil(rate + 1e-9)
        assert g["taken"] == g["copies"] * g["size"] <= 2 * g["size"]
    for s, total in taken.items():
        assert abs(total - wanted[s]) < max(1, largest[s]) + 1e-6


def test_query_against_plain_targets(spark):
    from twinframe.llm.queries import QUERIES

    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    table = QUERIES["op11_source_mixing"](spark, FOLDER)
    got = [{**r.asDict(), "key": r.doc_id} for r in table.collect()]
    check(rows, got)
    again = [{**r.asDict(), "key": r.doc_id} for r in QUERIES["op11_source_mixing"](spark, FOLDER).collect()]
    assert sorted(got, key=str) == sorted(again, key=str)


def test_deep_tree_however_rows_lie(spark):
    rng = random.Random(5)
    rows = [
        (i, " ".join(["w"] * int(rng.paretovariate(0.9))), rng.choice(["a", "b", "b", "b", "é", "Z", None]))
        for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies(docs.repartition(7), leaf=8, fan=3).collect()
    check([r.asDict() for r in docs.collect()], [r.asDict() for r in got])
    other = mixing.copies(docs.repartition(2, "text"), leaf=8, fan=3).collect()
    assert sorted(got, key=str) == sorted(other, key=str)
    assert sorted(mixing.copies(docs, leaf=8, fan=3, seed=8).collect(), key=str) != sorted(got, key=str)


def test_batches_of_a_node_change_nothing():
    """A node that goes on over several batches is rounded as in one."""
    rng = random.Random(1)
    nodes = [("a", i // 50) for i in range(200)]
    sizes = [rng.randint(1, 90) for _ in nodes]
    fractions = [rng.random() for _ in nodes]
    draws = [rng.random() for _ in nodes]
    whole = list(fractions)
    mixing.settle(nodes, sizes, whole, draws, None)
    parts, carry, owner = list(fractions), None, None
    for a in range(0, 200, 7):
        some = parts[a:a + 7]
        held, node, size, p, first = mixing.settle(nodes[a:a + 7], sizes[a:a + 7], some, draws[a:a + 7], carry)
        parts[a:a + 7] = some
        if owner is not None:
            parts[owner] = first
        owner = owner if held == -1 else None if held is None else a + held
        carry = (node, size, p) if held is not None else None
    assert parts == whole
    for k in range(4):
        own = slice(50 * k, 50 * k + 50)
        assert math.isclose(
            sum(s * p for s, p in zip(sizes[own], parts[own])), sum(s * p for s, p in zip(sizes[own], fractions[own])))
        assert sum(0 < p < 1 for p in parts[own]) <= 1


def test_expected_copies_stay():
    rng = random.Random(2)
    sizes, fractions = [40, 13, 12, 7, 1], [0.3, 0.9, 0.5, 0.25, 0.6]
    sums, n = [0.0] * 5, 20_000
    for _ in range(n):
        p = list(fractions)
        held, *_ = mixing.settle([0] * 5, sizes, p, [rng.random() for _ in p], None)
        for i, x in enumerate(p):
            sums[i] += x
    assert all(abs(s / n - f) < 0.02 for s, f in zip(sums, fractions))


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 0, "b": 0}, {"a": 1, "b": 1000, "c": 7, None: 3}, {"b": 5, "a": 5, "c": 10**6}])
def test_targets(spark, sizes):
    rows = [("~" if s is None else f"={s}", n, 1) for s, n in sizes.items()]
    got = mixing.targets(spark.createDataFrame(rows, "place string, size long, rows long")).collect()
    wanted = plain_targets(sizes)
    for r in got:
        assert math.isclose(r.target, wanted[None if r.place == "~" else r.place[1:]], rel_tol=1e-12)


def test_odd_rows_and_the_mix_itself(spark, odd_docs):
    got = mixing.copies(odd_docs)
    check([r.asDict() for r in odd_docs.collect()], [r.asDict() for r in got.collect()])
    mix = mixing.mixture(odd_docs)
    assert mix.columns == odd_docs.columns
    wanted = {r.source: r.target for r in got.select("source", "target").distinct().collect()}
    mixed, largest = defaultdict(int), defaultdict(int)
    for r in mix.collect():
        mixed[r.source] += n_words(r.text)
        largest[r.source] = max(largest[r.source], n_words(r.text))
    for s, target in wanted.items():
        assert abs(mixed[s] - target) <= largest[s]
    none = mixing.copies(odd_docs.limit(0))
    assert none.count() == 0 and mixing.mixture(odd_docs.limit(0)).count() == 0


def test_many_equal_rows(spark):
    docs = spark.range(150_000).selectExpr("cast(null as long) as doc_id", "'a b c' as text", "'s' as source")
    got = mixing.copies(docs).groupBy("copies").count().collect()
    assert {r["copies"]: r["count"] for r in got} == {1: 75_000, 2: 75_000}
