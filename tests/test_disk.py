"""What similarity joins leave on disk while they run."""

import random
import time
from pathlib import Path

from pairloom.functions.tokenizers import QGramTokenizer
from pairloom.operators import setsim
from pairloom.sources.scratch import materialize
from pyspark.sql import functions as F


def texts(spark, n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9))) for _ in range(300)]
    rows = [(i, None if r.random() < 0.05 else " ".join(r.choice(words) for _ in range(r.randrange(9)))) for i in range(n)]
    changed = [(n + i, t if t is None or r.random() < 0.5 else t[: r.randrange(len(t) + 1)] + "xyz") for i, t in rows]
    return [spark.createDataFrame(x, "sid long, t string").select("sid", QGramTokenizer(3).token_set(F.col("t")).alias("toks")) for x in (rows, changed)]


def shuffled(spark, run):
    store = spark.sparkContext._jsc.sc().statusStore()

    def written() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        held = store.executorList(False)
        return sum(held.apply(i).totalShuffleWrite() for i in range(held.size()))

    before = written()
    run()
    return written() - before


def test_sets_are_ranked_without_shuffling_their_tokens(spark):
    one, _ = texts(spark, 4000, 1)
    assert 0 < shuffled(spark, lambda: setsim.set_index(one)) < 200_000


def test_shuffles_of_a_written_table_do_not_stay(spark):
    where = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    held = lambda: {p for d in where for p in Path(d.getPath()).rglob("shuffle_*") if p.stat().st_size}
    before = held()
    assert materialize(spark.range(100_000).groupBy((F.col("id") % 50_000).alias("k")).agg(F.max("id").alias("m"))).count() == 50_000
    for _ in range(100):  # the executors delete a little later
        left = sum(p.stat().st_size for p in held() - before)
        if left < 100_000:
            break
        time.sleep(0.05)
    assert left < 100_000


def test_rounds_of_tokens_lose_no_pair(spark, rows, monkeypatch):
    one, two = texts(spark, 300, 2)
    brute = lambda x: {r["sid"]: set(r["toks"] or ()) for r in x.collect()}
    a, b = brute(one), brute(two)
    want = sorted(((i, j) for i, x in a.items() for j, y in b.items() if x and y and len(x & y) / len(x | y) >= 0.6), key=repr)
    for least, each in ((1_000_000, 4), (1000, 0), (1000, 2)):
        monkeypatch.setattr(setsim, "LEAST_ROUND", least)
        monkeypatch.setattr(setsim, "PER_SET", each)
        monkeypatch.setattr(setsim, "PASS", 500)
        monkeypatch.setattr(setsim, "WORDS", 100)
        assert want and rows(setsim.similarity_join(one, two, "jaccard", 0.6).select("s1", "s2")) == want


def test_tables_without_sets_match_nothing(spark):
    one, _ = texts(spark, 20, 3)
    none = one.where("sid < 0")
    empty = one.withColumn("toks", F.when(F.col("sid") % 2 == 0, F.array().cast("array<string>")))
    for a, b in ((none, one), (one, none), (none, none), (empty, one), (one, empty)):
        assert setsim.similarity_join(a, b, "jaccard", 0.5).count() == 0
