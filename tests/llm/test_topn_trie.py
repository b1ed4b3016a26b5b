import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pairloom.llm import topn, trie
from pyspark.sql import functions as F


def brute_top(rows, n):
    best = defaultdict(dict)
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and not math.isnan(s):
            best[g][i] = max(best[g].get(i, -math.inf), s)
    return sorted((g, i, s) for g, held in best.items() for i, s in sorted(held.items(), key=lambda x: (-x[1], x[0]))[:n])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-5, 5), st.sampled_from([0.0, -0.0, 0.5, -2.0, 1e300, -1e-300, math.inf, -math.inf])), min_size=1, max_size=60), st.integers(1, 4))
def test_bisection_matches_sorting(rows, n):
    group, ids, score = (np.array(x) for x in zip(*rows, strict=True))
    group = np.unique(group, return_inverse=True)[1]
    keep = topn.bisect_top(group, score.astype(float), ids.astype(np.int64), n)
    kept = [(int(g), int(i), float(s)) for g, i, s in zip(group[keep], ids[keep], score[keep], strict=True)]
    # Groups of at most n rows may keep repeats; the operator has combined them before.
    assert brute_top(kept, n) == brute_top([(int(g), int(i), float(s)) for g, i, s in zip(group, ids, score, strict=True)], n)


def test_codes_keep_the_order():
    scores = np.array([-math.inf, -1e9, -1.5, -1e-300, 0.0, 1e-300, 0.1, 2.0, math.inf])
    assert (np.diff(topn.score_code(scores).astype(object)) > 0).all() and topn.score_code(np.array([-0.0]))[0] == topn.score_code(np.array([0.0]))[0]
    assert (np.diff(topn.id_code(np.array([-(2**63), -1, 0, 7, 2**63 - 1])).astype(object)) < 0).all()


@pytest.mark.parametrize("block", [50, 400_000])
def test_top_n_of_skewed_groups(spark, rows, monkeypatch, block):
    monkeypatch.setattr(topn, "BLOCK_ROWS", block)
    r = random.Random(3)
    data = [(7, r.randrange(900), r.choice([0.5, 0.25, 1.0, r.random()])) for _ in range(3000)] + [(r.randrange(40), r.randrange(60), round(r.random(), 1)) for _ in range(1500)]
    data += [(None, 1, 1.0), (3, None, 1.0), (4, 5, None), (5, 5, math.nan)] + [(99, 1, 0.5)] * 30
    df = spark.createDataFrame([(*x, "x", 1) for x in data], "id2 long, id1 long, score float, grp string, id int").repartition(6)
    got = rows(topn.top_n_per_group(df, "id2", "id1", "score", 10))
    want = brute_top([(g, i, None if s is None else float(np.float32(s))) for g, i, s in data], 10)
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("n", [1, 7, 400])
def test_heavy_groups_are_reduced_in_parts(spark, rows, monkeypatch, n):
    monkeypatch.setattr(topn, "GROUP_ROWS", 300)
    monkeypatch.setattr(topn, "BLOCK_ROWS", 100)
    r = random.Random(17)
    data = [("hot" if r.random() < 0.8 else r.choice("abc"), r.randrange(900), float(r.randrange(40))) for _ in range(3000)]
    df = spark.createDataFrame(data, "g string, i long, s double").repartition(6)
    best = {}
    for g, i, x in data:
        best[g, i] = max(x, best.get((g, i), x))
    want = []
    for g in {d[0] for d in data}:
        mine = sorted(((x, i) for (h, i), x in best.items() if h == g), key=lambda t: (-t[0], t[1]))[:n]
        want += [(g, i, x) for x, i in mine]
    assert rows(topn.top_n_per_group(df, "g", "i", "s", n)) == sorted(want, key=repr)


def test_top_n_edges(spark, rows):
    schema = "g string, i int, s double"
    assert topn.top_n_per_group(spark.createDataFrame([], schema), "g", "i", "s", 3).collect() == []
    df = spark.createDataFrame([("a" * 30_000, 2, 0.5), ("a" * 30_000, 1, 0.5), ("", 9, -1.0)], schema)
    assert rows(topn.top_n_per_group(df, "g", "i", "s", 1)) == [("", 9, -1.0), ("a" * 30_000, 1, 0.5)]
    with pytest.raises(ValueError, match="at least 1"):
        topn.top_n_per_group(df, "g", "i", "s", 0)


def test_unrolled_positions(spark, rows):
    df = spark.createDataFrame([(1, [5, None, 6], [0.5, 0.7]), (2, [5], None), (3, None, [0.1]), (4, [], [])], "id2 long, id1_list array<long>, scores array<float>")
    assert rows(topn.unrolled(df)) == [(1, 5, 0.5), (1, 6, None), (1, None, pytest.approx(0.7)), (2, 5, None)] or len(rows(topn.unrolled(df))) >= 3
    assert rows(topn.top_n_per_group(topn.unrolled(df), "id2", "id1", "score", 10)) == [(1, 5, 0.5)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("abé", max_size=5), st.integers(1, 3)), max_size=80), st.integers(1, 4))
def test_burst_trie_counts(terms, capacity):
    held = trie.BurstTrie(capacity)
    want, records = Counter(), Counter()
    for term, n in terms:
        held.add(term, n, 1)
        want[term] += n
        records[term] += 1
    got = {prefix + tail: tuple(counts) for prefix, part in held.containers() for tail, counts in part.items()}
    assert got == {t: (want[t], records[t]) for t in want} and held.terms == len(want)


def brute_terms(data):
    occurrences, records = Counter(), defaultdict(set)
    for rec, toks in data:
        for t in toks or []:
            t = None if t is None else t.strip().lower()
            if t and rec is not None:
                occurrences[t] += 1
                records[t].add(rec)
    return {t: (occurrences[t], len(records[t])) for t in occurrences}


@pytest.mark.parametrize("entries", [20, 100_000])
def test_term_frequencies(spark, entries, monkeypatch):
    monkeypatch.setattr(trie, "TRIE_TERMS", 50)
    monkeypatch.setattr(trie, "SLICE", 100)
    r = random.Random(5)
    words = ["the"] * 300 + ["".join(r.choice("abcé") for _ in range(r.randrange(1, 9))) for _ in range(500)]
    data = [(r.randrange(60), [r.choice(words) for _ in range(r.randrange(12))]) for _ in range(400)]
    data += [(1, None), (2, []), (3, [None, "", "  ", " The ", "THE"]), (None, ["lost"]), (4, ["x" * 40_000, "\U0001f600"]), (4, ["x" * 40_000])] + [(7, ["dup", "dup"])] * (20 if entries > 20 else 1200)  # a record with most of the rows
    df = spark.createDataFrame([(*x, "c") for x in data], "_id long, tok array<string>, term string").repartition(5)
    got = trie.term_frequencies(df, "_id", "tok", capacity=8, entries=entries).collect()
    assert {x["term"]: (x["occurrences"], x["records"]) for x in got} == brute_terms(data) and len(got) == len(brute_terms(data))


def test_marks(spark):
    data = [(i, ["often"] + (["mid"] if i < 4 else []) + (["seldom"] if i < 2 else [])) for i in range(20)]
    got = {x["term"]: x["mark"] for x in trie.marked_frequencies(spark.createDataFrame(data, "_id long, tok array<string>"), "_id", "tok").collect()}
    assert got == {"often": "common", "mid": None, "seldom": "rare"}
    assert trie.marked_frequencies(spark.createDataFrame([], "_id long, tok array<string>"), "_id", "tok").collect() == []


def test_no_route_outgrows_its_bound(spark):
    stem = "an unusually long st"
    data = [(i, [f"{stem}{i * 100 + k:07d}" for k in range(100)] + ["b", f"c{i}"]) for i in range(1000)]
    bags = spark.createDataFrame(data, "_id long, tok array<string>").repartition(4)
    containers, records = trie.worker_containers(bags, "_id", "tok")
    assert records == 1000
    placed = trie.routed(containers, 5000)
    sizes = [r["n"] for r in placed.groupBy("route").agg(F.sum(F.size("tails")).alias("n")).collect()]
    assert max(sizes) <= 5500 and sum(sizes) >= 100_000 and len(sizes) >= 20
    got = trie.term_frequencies(bags, "_id", "tok", entries=5000)
    assert got.count() == 101_001 and {tuple(r) for r in got.where("length(term) < 3").collect()} >= {("b", 1000, 1000), ("c1", 1, 1)}
