import math
import operator
import random
from collections import Counter

import pytest
from pairloom.functions.tokenizers import WhiteSpaceTokenizer
from pairloom.operators import bm25
from pairloom.operators.bm25 import K1, B, bm25_top_k
from pairloom.plans.executor import Blocker
from pairloom.plans.predicates import BM25TopkPredicate, CosinePredicate, ExactMatchPredicate
from pairloom.plans.program import DropRule, KeepRule, Program


def brute(index, search, k):
    docs = {i: Counter(t.lower().split()) for i, t in index if t is not None}
    if not docs:
        return set()
    n, avg = len(docs), sum(sum(c.values()) for c in docs.values()) / len(docs)
    df = Counter(w for c in docs.values() for w in c)
    out = set()
    for j, text in search:
        scores = {}
        for i, c in docs.items():
            shared = [w for w in set((text or "").lower().split()) if w in c]
            if shared:
                share = lambda w: c[w] / (c[w] + K1 * (1 - B + B * sum(c.values()) / avg))  # noqa: E731, B023
                scores[i] = round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * share(w) for w in shared), 6)
        for rank, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.add((i, j, s, rank))
    return out


@pytest.mark.parametrize("k", [1, 3, 200])
@pytest.mark.parametrize("seed", [1, 2])
def test_pruned_search_is_exact(spark, k, seed, monkeypatch):
    if seed == 2:  # several blocks, several slices, parted tokens
        monkeypatch.setattr(bm25, "SLICE", 50)
    r = random.Random(seed)
    common, rare = ["the", "of", "for"], [f"w{i}" for i in range(60)]
    text = lambda: " ".join(r.choice(common) if r.random() < 0.5 else r.choice(rare) for _ in range(r.randrange(1, 9)))
    rows = [(i, text()) for i in range(120)] + [(900, None), (901, ""), (902, "the " * 3000)]
    search = [(1000 + i, text()) for i in range(40)] + [(2000, "the"), (2001, "of the for"), (2002, None), (2003, "unknown"), (2004, "w1"), (2005, " ")]
    a, b = spark.createDataFrame(rows, "id long, t string"), spark.createDataFrame(search, "id long, t string")
    index = bm25.bm25_index(a, "t", WhiteSpaceTokenizer(), block_docs=30) if seed == 2 else a
    got = {(x["id1"], x["id2"], x["score"], x["rank"]) for x in bm25_top_k(index, b, "t", "t", WhiteSpaceTokenizer(), k, salt_queries=7 if seed == 2 else 20_000).collect()}
    assert {(i, j, rank) for i, j, _, rank in got} == {(i, j, rank) for i, j, _, rank in brute(rows, search, k)}
    assert got == brute(rows, search, k)


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "id long, t string"), spark.createDataFrame([(1, "a")], "id long, t string")
    for a, b in ((none, one), (one, none), (none, none)):
        assert bm25_top_k(a, b, "t", "t", WhiteSpaceTokenizer(), 2).count() == 0


def test_postings_are_not_shuffled(spark):
    r = random.Random(3)
    rows = [(i, " ".join(f"w{r.randrange(100)}" for _ in range(6))) for i in range(2000)]
    a, b = spark.createDataFrame(rows, "id long, t string"), spark.createDataFrame([(5000 + i, t) for i, t in rows], "id long, t string")
    store = spark.sparkContext._jsc.sc().statusStore()

    def written() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        held = store.executorList(False)
        return sum(held.apply(i).totalShuffleWrite() for i in range(held.size()))

    before = written()
    assert bm25_top_k(a, b, "t", "t", WhiteSpaceTokenizer(), 3).where("rank = 1").count() == 2000
    assert 0 < written() - before < 1_000_000


def works(spark, n, seed):
    """Rows (_id, t, u) of A and of B, some texts of either field null or empty."""
    r = random.Random(seed)
    text = lambda: None if r.random() < 0.05 else " ".join(f"w{int(r.random() ** 2 * 150)}" for _ in range(r.randrange(9)))
    rows = [(i, text(), text()) for i in range(2 * n)]
    return rows[:n], rows[n:], *(spark.createDataFrame(x, "_id long, t string, u string") for x in (rows[:n], rows[n:]))


def written_by(spark, run):
    store = spark.sparkContext._jsc.sc().statusStore()

    def written() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        held = store.executorList(False)
        return sum(held.apply(i).totalShuffleWrite() for i in range(held.size()))

    before = written()
    out = run()
    return out, written() - before


def cosine(x, y):
    x, y = set((x or "").lower().split()), set((y or "").lower().split())
    return len(x & y) / math.sqrt(len(x) * len(y)) if x and y else 0.0


@pytest.mark.parametrize("lookup", [7, 500_000])
def test_rules_of_searches_and_filters_are_exact(spark, lookup, monkeypatch):
    monkeypatch.setattr(bm25, "LOOKUP", lookup)
    one, two, a, b = works(spark, 150, 5)
    first, second = ({(i, j) for i, j, _, _ in brute([(r[0], r[at]) for r in one], [(r[0], r[at]) for r in two if r[at] is not None], k)} for at, k in ((1, 3), (2, 5)))
    t, u = {r[0]: r[1] for r in one + two}, {r[0]: r[2] for r in one + two}
    by_t, by_u, near = BM25TopkPredicate("t", "t", "whitespace", 3), BM25TopkPredicate("u", "u", "whitespace", 5), CosinePredicate("t", "t", WhiteSpaceTokenizer(), operator.ge, 0.5)
    run = lambda keep, drop=(): sorted(map(tuple, Blocker(a, b).pairs(Program([KeepRule(x) for x in keep], [DropRule(x) for x in drop])).collect()))
    assert run([[by_t, by_u]]) == sorted(first & second)
    assert run([[by_t], [by_u]]) == sorted(first | second)
    assert run([[by_t, near]]) == sorted(x for x in first if cosine(t[x[0]], t[x[1]]) >= 0.5)
    differ = ExactMatchPredicate("u", "u", True)
    assert run([[by_t], [by_u, near]], [[differ]]) == sorted(x for x in first | {x for x in second if cosine(t[x[0]], t[x[1]]) >= 0.5} if u[x[1]] is None or u[x[0]] == u[x[1]])


def test_pairs_of_two_searches_are_not_shuffled(spark):
    *_, a, b = works(spark, 3000, 6)
    keep = [BM25TopkPredicate("t", "t", "whitespace", 10), BM25TopkPredicate("u", "u", "whitespace", 20)]
    _, written = written_by(spark, lambda: Blocker(a, b).pairs(Program([KeepRule(keep)])).count())
    assert 0 < written < 900_000


def test_tokens_of_searched_pairs_are_not_shuffled(spark):
    *_, a, b = works(spark, 3000, 7)
    keep = [BM25TopkPredicate("t", "t", "whitespace", 10), CosinePredicate("t", "t", WhiteSpaceTokenizer(), operator.ge, 0.6)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        _, written = written_by(spark, lambda: Blocker(a, b).pairs(Program([KeepRule(keep)])).count())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < written < 500_000
