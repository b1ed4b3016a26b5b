import random

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pairloom.llm import matching as M
from pyspark.sql import functions as F


FOLDER = Path("/root/testdata/sf0.001")


def words_of(text, short=()):
    coded, n = M.plain_words(pa.array([text], pa.string()), dict(short))
    assert n.tolist() == [len(coded)]
    return coded.to_pylist()


def test_words_and_signatures():
    assert words_of("Clustèred-Hypergraph  2nd; a_b") == ["clustered", "hypergraph", "2nd"]
    assert words_of("Tobesel L.", {"tobesel": "tobe"}) == ["tobe"] and words_of(None) == [] and words_of("  ") == []
    coded, n = M.plain_words(pa.array(["ab cd ab", None, "", "ef"]), {"ef": "cd"})
    assert coded.to_pylist() == ["ab", "cd", "ab", "cd"] and n.tolist() == [3, 0, 0, 1]
    same = ["Journal of Lattice Data", "JLD vol. 3", "J. Lattice Data", "JOURNAL OF LATTICE DATA", "Proc. JLD"]
    assert {M.signature(t) for t in same} == {"jd"} and M.signature("IFRS-R") == M.signature("Int. Forum Record Syst.") == "is" and M.signature("(12)") is None


def test_word_masks_change_little_with_small_errors():
    one, two = M.word_mask("partition", 256), M.word_mask("partitoin", 256)
    assert one.bit_count() <= 9 and 0 < (one ^ two).bit_count() <= 8 and M.word_mask("ab", 64) > 0


def vectors(r, n, bits, longs):
    out = []
    for _ in range(n):
        if out and r.random() < 0.6:
            v = r.choice(out)
            for _ in range(r.randrange(4)):
                v ^= 1 << r.randrange(bits)
        else:
            v = sum(1 << i for i in r.sample(range(bits), 14))
        out.append(v)
    return [tuple(int(x) for x in np.frombuffer(v.to_bytes(bits // 8, "little"), np.int64)) for v in out]


@pytest.mark.parametrize(("heavy", "chunks"), [(1, 8), (50, 10), (100_000, 7)])
def test_close_pairs_are_exact_within_the_radius(spark, heavy, chunks):
    r, f = random.Random(8), M.TextField("v", "v", "v", 256, dice=0.0001, chunks=chunks)
    data = [(1 + i % 2, i, 2000, *v) for i, v in enumerate(vectors(r, 160, 256, 4))]
    df = spark.createDataFrame(data, "side int, sid long, number int, v_0 long, v_1 long, v_2 long, v_3 long").repartition(3)
    got = {(x["s1"], x["s2"]) for x in M.close_pairs(df, f, heavy).collect()}
    as_int = {d[1]: int.from_bytes(np.array(d[3:], np.int64).tobytes(), "little") for d in data}
    ones, twos = [d[1] for d in data if d[0] == 1], [d[1] for d in data if d[0] == 2]
    near = {(a, b) for a in ones for b in twos if (as_int[a] ^ as_int[b]).bit_count() <= f.chunks - 1}
    assert near and near <= got
    edges = [256 * i // chunks for i in range(chunks + 1)]
    agree = lambda a, b: any(not (as_int[a] ^ as_int[b]) >> lo & (1 << hi - lo) - 1 for lo, hi in zip(edges, edges[1:], strict=False))
    assert got == {(a, b) for a in ones for b in twos if agree(a, b) and as_int[a] & as_int[b]}


@pytest.mark.parametrize("heavy", [1, 50, 100_000])
def test_crowded_buckets_lose_no_pair(spark, heavy):
    # All agree in the first chunk and hardly any pair in another one.
    r, f = random.Random(9), M.TextField("v", "v", "v", 128, dice=0.4, chunks=4)
    values = [0b1011011 | sum(1 << i for i in r.sample(range(32, 128), 6)) for _ in range(150)]
    data = [(1 + i % 2, i, 2000, *(int(x) for x in np.frombuffer(v.to_bytes(16, "little"), np.int64))) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "side int, sid long, number int, v_0 long, v_1 long").repartition(3)
    got = [(x["s1"], x["s2"]) for x in M.close_pairs(df, f, heavy).collect()]
    alike = lambda a, b: 2 * (a & b).bit_count() >= 0.4 * (a.bit_count() + b.bit_count())
    want = {(i, k) for i in range(0, 150, 2) for k in range(1, 150, 2) if alike(values[i], values[k])}
    assert len(want) > 4000 and set(got) == want


def test_near_numbers_meet_once(spark):
    numbers = [None, *range(1996, 2004)]
    data = [(side, 100 * side + i, n, 0b1011) for side in (1, 2) for i, n in enumerate(numbers)]
    df = spark.createDataFrame(data, "side int, sid long, number int, v_0 long")
    got = sorted((x["s1"], x["s2"]) for x in M.close_pairs(df, M.TextField("v", "v", "v", 64, 0.9, near_number=True, chunks=2)).distinct().collect())
    near = lambda m, n: m is None or n is None or abs(m - n) <= 1
    assert got == sorted((100 + i, 200 + k) for i, m in enumerate(numbers) for k, n in enumerate(numbers) if near(m, n))


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
@pytest.mark.parametrize(("field", "column", "least"), [(M.TextField("title", "title", "title", 256, 0.7, chunks=10), "title", 0.9), (M.TextField("description", "description", "description", 192, 0.7, chunks=9), "description", 0.9), (M.TextField("names", "authors", "authors", 128, 0.8, chunks=5), "authors", 0.9)])
def test_recall_of_the_lookup_by_brute_force(spark, field, column, least):
    a, b = (spark.read.parquet(str(FOLDER / f"{n}.parquet")).where(f"`{column}` is not null") for n in ("table_a", "table_b"))
    records = M.encoded(a, b, "_id", (field,), "year", "venue").withColumnRenamed("id", "sid").cache()
    rows = records.select("side", "sid", *field.columns()).collect()
    number = lambda r: int.from_bytes(np.array(r[2:], np.int64).tobytes(), "little")
    one, two = [(r[1], number(r)) for r in rows if r[0] == 1 and any(r[2:])], [(r[1], number(r)) for r in rows if r[0] == 2 and any(r[2:])]
    want = {(i, k) for i, x in one for k, y in two if 2 * (x & y).bit_count() >= field.dice * (x.bit_count() + y.bit_count()) - 1e-9}
    got = {(x["s1"], x["s2"]) for x in M.close_pairs(records, field).collect()}
    records.unpersist()
    print(column, len(want), len(got) / max(len(want), 1))
    assert got <= want and len(got) >= least * len(want)


def test_dice_and_nulls(spark):
    f = M.TextField("v", "v", "v", 64)
    df = spark.createDataFrame([(0b1111, 0b0111), (0, 1), (-1, -1)], "l_v_0 long, r_v_0 long")
    assert [x[0] for x in df.select(M.dice(f, "l_", "r_")).collect()] == [pytest.approx(6 / 7), None, 1.0]


def works(r):
    words = ["".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(4)) for _ in range(120)]
    people = [("".join(r.choice("bdfgkl") + r.choice("aeiou") for _ in range(3)), "".join(r.choice("mnprst") + r.choice("aeiou") for _ in range(4))) for _ in range(80)]
    a, b, truth = [], [], set()
    for i in range(500):
        title, about, who = r.sample(words, 6), r.sample(words, 6), r.sample(people, 1 + i % 3)
        year, venue = r.randrange(1990, 2024), r.choice(["Journal of Big Data", "Letters on Maps", "Symposium on Trees"])
        a.append((i, " ".join(title), " ".join(about) if i % 7 else None, "; ".join(" ".join(p) for p in who), venue, year))
        kind = i % 4
        if kind == 3:
            continue
        noisy = list(title)
        if kind == 0:  # a copy with errors, other order and other notation of names
            noisy[0] = noisy[0][:2] + noisy[0][3:]
            r.shuffle(noisy)
            truth.add((i, 10_000 + i))
        elif kind == 1:
            truth.add((i, 10_000 + i))
        else:  # a later work of the same people
            noisy[1], about, year, venue = r.choice(words), r.sample(words, 6), year + r.randrange(3, 9), "Annals of Tables"
        names = ", ".join(f"{p[0][0]}. {p[1]}" if kind == 0 else f"{p[1]} {p[0]}" for p in who).upper()
        b.append((10_000 + i, " ".join(noisy), " ".join(about) if i % 3 else None, names, venue if i % 5 else None, year if i % 6 else None))
    return a, b, truth


SCHEMA = "_id long, title string, about string, who string, venue string, year int, sid string, number int"
FIELDS = (M.TextField("title", "title", "title", 256, chunks=10), M.TextField("about", "about", "about", 192, 0.6), M.TextField("who", "who", "who", 128, 0.6, near_number=True, chunks=5))


def run(spark, a, b):
    frame = lambda rows: spark.createDataFrame([(*x, "c", 1) for x in rows], SCHEMA).repartition(3)
    return M.match_records(frame(a), frame(b), "_id", FIELDS, "year", "venue")


def test_matches_and_confidences(spark):
    a, b, truth = works(random.Random(11))
    got = {(x["id1"], x["id2"]): x["confidence"] for x in run(spark, a, b).collect()}
    sure = {p for p, c in got.items() if c >= 0.5}
    assert len(sure & truth) >= 0.97 * len(truth) and len(sure & truth) >= 0.97 * len(sure)
    assert all(0.0 <= c <= 1.0 for c in got.values())
    # Calibration: as many true pairs as the confidences add up to.
    assert sum(got.values()) == pytest.approx(len(set(got) & truth), rel=0.05)


def test_copies_nulls_and_empty_tables(spark):
    a, b, _ = works(random.Random(12))
    odd = [(-1, None, None, None, None, None), (-2, "", " ", "", "", 2000), (None, "lost record", None, None, None, 1), (-3, "x" * 50_000, None, None, None, 2001)]
    copies = [(700 + i, *a[1][1:]) for i in range(6)]
    got = {(x["id1"], x["id2"]): x["confidence"] for x in run(spark, a + odd + copies + a[:3], b).collect()}
    assert {(i, 10_001) for i in [1, *range(700, 706)]} <= {p for p, c in got.items() if c >= 0.5}
    assert not {p for p in got if p[0] is None or p[0] in (-1, -2)}
    assert run(spark, [], b).count() == 0 and run(spark, a, []).count() == 0 and run(spark, [], []).count() == 0


@pytest.mark.parametrize("driver", [1000, 0])
def test_mixture_finds_two_plain_classes(spark, driver):
    r = np.random.default_rng(3)
    matches = np.c_[r.integers(17, 22, 500), r.integers(17, 22, 500), r.integers(1, 2, 500)]
    others = np.c_[r.integers(12, 22, 1500), r.integers(1, 8, 1500), r.integers(2, 4, 1500)]
    patterns, counts = np.unique(np.concatenate([matches, others]), axis=0, return_counts=True)
    names = ["o0", "o1", "o2"]
    table = spark.createDataFrame([(*map(int, p), int(c)) for p, c in zip(patterns, counts, strict=True)], "o0 int, o1 int, o2 int, count long").repartition(3)
    model = M.fit_patterns(table, names, [22, 22, 5], 2, driver)
    got = {tuple(x[:3]): x[3] for x in table.select(*names, model.posterior(names)).collect()}
    assert all(c > 0.9 for p, c in got.items() if p[1] >= 17) and all(c < 0.1 for p, c in got.items() if p[1] < 8)
    table_of = model.classes(patterns)[:, 0]
    assert np.allclose(table_of, [got[tuple(p)] for p in patterns.tolist()])


def test_confidences_are_calibrated(spark):
    a, b, truth = works(random.Random(14))
    got = [(x["confidence"], (x["id1"], x["id2"]) in truth) for x in run(spark, a, b).collect()]
    # A reliability table: in every band about as many are true as the confidences say.
    for low, high in ((0.0, 0.2), (0.2, 0.8), (0.8, 1.01)):
        band = [x for x in got if low <= x[0] < high]
        assert abs(sum(c for c, _ in band) - sum(t for _, t in band)) <= max(8.0, 0.05 * len(band))


def test_classes_hold_copies_once(spark):
    a, b, _ = works(random.Random(15))
    frame = lambda rows: spark.createDataFrame([(*x, "c", 1) for x in rows], SCHEMA).repartition(3)
    copies = [(9000 + i, *a[1][1:]) for i in range(20)]
    links, members = M.match_classes(frame(a + copies), frame(b), "_id", FIELDS, "year", "venue")
    sid = {r["id"]: r["sid"] for r in members.collect()}
    assert len({sid[1], *(sid[9000 + i] for i in range(20))}) == 1
    assert links.where(F.col("s1") == sid[1]).where(F.col("s2") == sid[10_001]).count() == 1


def test_outcomes_are_within_their_sizes(spark):
    f = (M.TextField("v", "v", "v", 64),)
    df = spark.createDataFrame([(1, 1, 2000, None, "a", "b", "", "ii"), (3, 0, None, 2, None, "b", "ii", "ii")], "l_v_0 long, r_v_0 long, l_number int, r_number int, l_label string, r_label string, l_ending string, r_ending string")
    rows = [tuple(x) for x in df.select(*M.outcomes(f)).collect()]
    assert rows[0] == (21, 0, 2, 3, 1) and rows[1] == (0, 0, 0, 2, 0)
    assert F is not None
