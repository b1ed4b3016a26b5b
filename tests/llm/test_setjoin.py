import random
from itertools import combinations, product

import pytest
from pairloom.llm import setjoin
from pyspark.sql import functions as F


def as_set(values):
    return frozenset(v for v in values or [] if v is not None)


def alike(x, y, t):
    return bool(x and y) and len(x & y) / len(x | y) >= t - 1e-12


def sets_of(r, n, base):
    out = []
    for i in range(n):
        size = r.choice([0, 1, 2, 3, 5, 8, 13])
        values = [r.choice([0, 0, 1, 2] + list(range(25))) for _ in range(size)]
        out.append((base + i, values + values[:1] + ([None] if i % 9 == 0 else [])))
    for i in range(0, n, 3):  # near copies
        out.append((base + n + i, out[i][1][1:] + [r.randrange(40)]))
    out += [(base + 900 + i, list(range(10))) for i in range(8)] + [(base + 950, None), (base + 951, []), (base + 952, [None])]
    return out


SCHEMA = "key long, v array<long>, sid int, toks string"


@pytest.mark.parametrize("t", [0.4, 0.7, 1.0])
def test_pairs_within_a_table(spark, rows, t):
    data = sets_of(random.Random(1), 60, 0)
    df = spark.createDataFrame([(*x, 1, "x") for x in data + data[:5]], SCHEMA).repartition(4)
    found = setjoin.similar_sets(df, None, "key", "v", t)
    got = [(a, b) for a, b, _ in rows(setjoin.record_pairs(found, False))]
    want = sorted({tuple(sorted((a, b))) for (a, x), (b, y) in combinations(data, 2) if a != b and alike(as_set(x), as_set(y), t)}, key=repr)
    assert sorted(got, key=repr) == want
    links = {r["key"]: r["sid"] for r in setjoin.record_links(found).collect()}
    assert set(links) == {a for a, x in data if as_set(x)}
    assert {tuple(sorted(p)) for p in combinations(links, 2) if links[p[0]] == links[p[1]]} <= set(want)


def test_pairs_between_tables(spark, rows):
    a, b = sets_of(random.Random(2), 50, 0), sets_of(random.Random(2), 40, 5000) + sets_of(random.Random(3), 20, 9000)
    frame = lambda data: spark.createDataFrame([(*x, 1, "x") for x in data], SCHEMA)
    got = [(x, y) for x, y, _ in rows(setjoin.record_pairs(setjoin.similar_sets(frame(a), frame(b), "key", "v", 0.6), True))]
    assert got == sorted(((i, j) for (i, x), (j, y) in product(a, b) if alike(as_set(x), as_set(y), 0.6)), key=repr)


def test_empty_tables_and_long_texts(spark, rows):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, [3], 1, ""), (2, [3], 1, "")], SCHEMA)
    assert rows(setjoin.record_pairs(setjoin.similar_sets(none, None, "key", "v", 0.7), False)) == []
    assert rows(setjoin.record_pairs(setjoin.similar_sets(none, one, "key", "v", 0.7), True)) == []
    assert rows(setjoin.record_pairs(setjoin.similar_sets(one, None, "key", "v", 0.7), False)) == [(1, 2, 1.0)]
    long = spark.createDataFrame([(1, ["x" * 60_000, "y"]), (2, ["y", "x" * 60_000]), (3, ["y"])], "key long, v array<string>")
    assert rows(setjoin.record_pairs(setjoin.similar_sets(long, None, "key", "v", 0.7), False)) == [(1, 2, 1.0)]
    with pytest.raises(ValueError, match="threshold"):
        setjoin.similar_sets(one, None, "key", "v", 0.0)


@pytest.mark.parametrize("literal", [1000, 1])
def test_name_sets(spark, literal):
    names = spark.createDataFrame([("robert", "bob"), ("robert", "rob"), ("anna", None), (None, "x"), ("eva", "ev")], "name string, short string")
    df = spark.createDataFrame([(1, "Robert P. Smith"), (2, "anna, EVA & Robert"), (3, None), (4, " ."), (5, "robert bob")], "_id long, authors string").repartition(3)
    got = {r["_id"]: None if r["words"] is None else set(r["words"]) for r in setjoin.name_sets(df, "_id", "authors", names, literal).collect()}
    assert got == {1: {"bob", "smith"}, 2: {"anna", "ev", "bob"}, 3: None, 4: set(), 5: {"bob"}}


def test_a_class_of_most_records_and_colliding_hashes(spark, monkeypatch):
    rows = [(i, [1, 2, 3]) for i in range(300)] + [(1000 + i, [i, i + 1, i + 2, 7]) for i in range(20)]
    found = setjoin.similar_sets(spark.createDataFrame(rows, "k long, v array<long>"), None, "k", "v", 0.7)
    links = {r["key"]: (r["class_key"], r["n_links"]) for r in setjoin.record_links(found).collect()}
    assert links[299] == links[0] and links[0][0] == 0 and len(links) == 320
    calls = []
    real = F.xxhash64

    def colliding(*cols):  # the first seed gives every set one hash
        calls.append(cols)
        return F.lit(5).cast("long") if len(calls) == 1 else real(*cols)

    monkeypatch.setattr(setjoin.F, "xxhash64", colliding)
    again = setjoin.similar_sets(spark.createDataFrame(rows, "k long, v array<long>"), None, "k", "v", 0.7)
    monkeypatch.undo()
    assert again.members.select("sid").distinct().count() == found.members.select("sid").distinct().count() > 1
