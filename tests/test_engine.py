import operator
import random
from itertools import product
from pathlib import Path

import pytest
from pairloom.functions import similarity
from pairloom.functions import tokenizers as tok
from pairloom.operators import setops, setsim, topk
from pairloom.operators.skew import block_join, crowded_keys, lookup_skewed
from pairloom.plans import estimate, nodes, optimizer
from pairloom.plans import predicates as P
from pairloom.plans.evaluate import evaluate
from pairloom.plans.executor import Blocker
from pairloom.plans.program import DropRule, KeepRule, Program
from pairloom.sources import checks, partitioning, scratch
from pyspark.sql import functions as F

WORDS = tok.WhiteSpaceTokenizer()
NAMES = "red green blue dark light sky sea sand stone tree".split()
A = [(i, " ".join(NAMES[(i * k) % 10] for k in range(1, 2 + i % 5)), None if i % 7 == 0 else i % 4) for i in range(40)] + [(40, None, 1), (41, "", 2)]
B = [(100 + i, " ".join(NAMES[(i * k + 1) % 10] for k in range(1, 2 + i % 4)), None if i % 5 == 0 else i % 4) for i in range(40)] + [(200, None, 1), (201, "", None)]
SCHEMA = "_id long, t string, y int"


def jac(val, op=operator.ge):
    return P.JaccardPredicate("t", "t", WORDS, op, val)


def same_year(invert=False):
    return P.ExactMatchPredicate("y", "y", invert)


def words(text):
    return None if text is None else set(text.lower().split())


def jaccard(x, y):
    x, y = words(x), words(y)
    return None if x is None or y is None else 0.0 if not x or not y else len(x & y) / len(x | y)


def pairs_where(test):
    return sorted((a[0], b[0]) for a, b in product(A, B) if test(a, b))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(A, SCHEMA), spark.createDataFrame(B, SCHEMA)


@pytest.mark.parametrize("val", [0.2, 0.5, 0.75, 1.0])
@pytest.mark.parametrize("op", [operator.ge, operator.gt])
def test_jaccard_join(tables, rows, val, op):
    got = rows(Blocker(*tables).pairs(Program([KeepRule([jac(val, op)])]))) if not (val == 1.0 and op is operator.gt) else []
    assert got == sorted(pairs_where(lambda a, b: (jaccard(a[1], b[1]) or 0.0) > 0 and op(jaccard(a[1], b[1]), val)), key=repr)


@pytest.mark.parametrize("op", list(P.COMPARATORS))
def test_comparators_as_filters(tables, rows, op):
    got = rows(Blocker(*tables).pairs(Program([KeepRule([same_year(), jac(0.5, op)])])))
    assert got == sorted(pairs_where(lambda a, b: a[2] is not None and a[2] == b[2] and jaccard(a[1], b[1]) is not None and op(jaccard(a[1], b[1]), 0.5)), key=repr)


def test_keep_and_drop_is_not_keep_and_not(tables, rows):
    run = Blocker(*tables)
    dropped = rows(run.pairs(Program([KeepRule([jac(0.3)])], [DropRule([same_year(True)])])))
    kept = rows(run.pairs(Program([KeepRule([jac(0.3), same_year()])])))
    assert dropped == sorted(pairs_where(lambda a, b: (jaccard(a[1], b[1]) or 0) >= 0.3 and (b[2] is None or a[2] == b[2])), key=repr)
    assert set(kept) < set(dropped)


def test_optimized_equals_default_plan(tables, rows):
    edit = P.EditDistancePredicate("t", "t", operator.ge, 0.6)
    programs = [
        Program([KeepRule([jac(0.3), jac(0.6)]), KeepRule([same_year(), edit])], [DropRule([jac(0.9)])]),
        Program([KeepRule([same_year(), jac(0.4)]), KeepRule([same_year(), P.JaroPredicate("t", "t", operator.ge, 0.8)])]),
        Program([KeepRule([P.BM25TopkPredicate("t", "t", "whitespace", 3), jac(0.3)]), KeepRule([P.BM25TopkPredicate("t", "t", "whitespace", 1)])]),
    ]
    for program in programs:
        assert rows(Blocker(*tables).pairs(program)) == rows(Blocker(*tables, optimize=False).pairs(program)) != []


def test_simplify_and_producers():
    simple = optimizer.simplify(Program([KeepRule([jac(0.5), jac(0.7)]), KeepRule([jac(0.8)]), KeepRule([same_year()]), KeepRule([same_year()])]))
    assert [r.predicates for r in simple.keep] == [(jac(0.7),), (same_year(),)]
    two = Program([KeepRule([jac(0.4), same_year()]), KeepRule([jac(0.6), P.NameMatchPredicate("t", "t")])])
    assert optimizer.choose_producers(two, lambda p: 1.0) == [jac(0.4)]
    many = Program([KeepRule([jac(0.02 * i + 0.1), P.ExactMatchPredicate(f"c{i}", "y", False)]) for i in range(9)])
    assert optimizer.choose_producers(many, lambda p: 1.0) == [jac(0.1)]


def test_contains():
    assert jac(0.5).contains(jac(0.7)) and not jac(0.7).contains(jac(0.5))
    assert jac(0.5).contains(jac(0.5, operator.gt)) and not jac(0.5, operator.gt).contains(jac(0.5))
    assert not jac(0.5, operator.ne).contains(jac(0.6, operator.ne)) and jac(0.5, operator.ne).contains(jac(0.5, operator.ne))
    assert P.BM25TopkPredicate("t", "t", "standard", 9).contains(P.BM25TopkPredicate("t", "t", "standard", 3))


def test_validation_and_display(tables):
    with pytest.raises(TypeError):
        jac(1)
    with pytest.raises(ValueError, match="op must be"):
        jac(0.5, operator.add)
    with pytest.raises(ValueError, match="at least one indexable"):
        KeepRule([same_year(True)])
    with pytest.raises(ValueError, match="streamable"):
        DropRule([P.BM25TopkPredicate("t", "t", "standard", 3)])
    with pytest.raises(ValueError, match="keep rule"):
        Program([])
    with pytest.raises(TypeError):
        P.BM25TopkPredicate("t", "t", "standard", 1.5)
    with pytest.raises(ValueError, match="k must"):
        P.BM25TopkPredicate("t", "t", "standard", 0)
    with pytest.raises(RuntimeError):
        P.BM25TopkPredicate("t", "t", "standard", 3).holds(None, None)
    with pytest.raises(NotImplementedError):
        P.EditDistancePredicate("t", "t", operator.ge, 0.5).candidates(*tables)
    assert str(P.EditDistancePredicate("name", "name", operator.ge, 0.5)) == "edit_distance(name, name) >= 0.5"
    assert str(P.ExactMatchPredicate("title", "title", False)) == "exact_match(title, title) == True"
    assert str(P.BM25TopkPredicate("title", "title", "standard", 10)) == "BM25_topk(standard, title, title, 10) "
    assert str(jac(0.5).invert()) == "jaccard_whitespace_tokens(t, t) < 0.5"
    assert "KEEP ((jaccard" in Program([KeepRule([jac(0.5)])], [DropRule([same_year(True)])]).pretty_str()


def test_grouped_result_has_every_search_record(tables):
    out, stats = Blocker(*tables).execute(Program([KeepRule([jac(0.99)])]), ["y"])
    assert out.columns == ["y", "id2", "id1_list"] and out.count() == len(B)
    assert all(r["id1_list"] == sorted(r["id1_list"]) for r in out.collect())
    assert stats.plan_seconds >= 0 and stats.producers
    with pytest.raises(ValueError, match="projection"):
        Blocker(*tables).execute(Program([KeepRule([jac(0.99)])]), ["no"])


def test_nodes_and_estimates(tables, rows):
    run = Blocker(*tables)
    one, two = nodes.PredicateNode(jac(0.3)), nodes.PredicateNode(same_year())
    both = nodes.IntersectNode((one, two))
    assert rows(both.pairs(run)) == rows(nodes.PredicateNode(jac(0.3), two).pairs(run)) == rows(run.pairs(Program([KeepRule([jac(0.3), same_year()])])))
    left = nodes.MinusNode(nodes.UnionNode((one, two)), both)
    assert set(rows(left.pairs(run))) == set(rows(one.pairs(run))) ^ set(rows(two.pairs(run)))
    assert left.ancestors() == {one, two, both, nodes.UnionNode((one, two))} and "n0 -> n" in nodes.to_dot(left)
    assert nodes.execute(left, run).count() == len(B)
    with pytest.raises(ValueError, match="at least two"):
        nodes.UnionNode((one,))
    found = estimate.Estimator(run, partners=50)
    assert 0 < found.selectivity(same_year()) < 1 and found.cost(jac(0.5)) > 0
    assert estimate.union([0.5, 0.5]) == 0.75 and estimate.intersect([0.5, 0.5]) == 0.25 and estimate.minus(0.5, 0.5) == 0.25
    assert rows(Blocker(*tables, cost=found.cost).pairs(Program([KeepRule([jac(0.3), same_year()])]))) == rows(both.pairs(run))


def test_string_similarities(spark):
    assert similarity.jaro("martha", "marhta") == pytest.approx(0.9444, abs=1e-4) and similarity.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert similarity.jaro("dixon", "dicksonx") == pytest.approx(0.7667, abs=1e-4) and similarity.jaro("", "a") == 0.0 and similarity.jaro("", "") == 1.0
    assert similarity.smith_waterman("cat", "hat") == pytest.approx(2 / 3) and similarity.smith_waterman("", "") == 0.0
    assert similarity.smith_waterman("abcxdef", "abcdef", 0.5) == pytest.approx(5.5 / 7)
    df = spark.createDataFrame([("John Doe", "Jon Doe"), (None, "x"), ("", "")], "a string, b string")
    got = [r[0] for r in df.select(similarity.edit_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(7 / 8), None, 1.0]
    assert [r[0] for r in df.select(similarity.pairwise(similarity.jaro_batch, similarity.jaro)(F.col("a"), F.col("b"))).collect()][1:] == [None, 1.0]


def test_tokenizers(spark):
    df = spark.createDataFrame([("Héllo  World 42!",), ("ab",), ("",), (None,), ("\U0001f600abc",)], "t string")
    got = lambda t: [r[0] for r in df.select(t.tokens(F.col("t"))).collect()]
    assert got(tok.WhiteSpaceTokenizer())[:4] == [["héllo", "world", "42!"], ["ab"], [], None]
    assert got(tok.StrippedWhiteSpaceTokenizer())[0] == ["hllo", "world", "42"]
    assert got(tok.NumericTokenizer())[:4] == [["42"], [], [], None]
    assert got(tok.AlphaNumericTokenizer())[0] == ["h", "llo", "world", "42"]
    assert got(tok.QGramTokenizer(3))[1:] == [[], [], None, ["\U0001f600ab", "abc"]]
    assert got(tok.QGramTokenizer(2))[1] == ["ab"]
    assert got(tok.StrippedQGramTokenizer(8))[0] == ["hélloworld42"[i : i + 8] for i in range(5)]
    assert got(tok.ShingleTokenizer(2))[:4] == [["hlloworld", "world42"], [], [], None]
    assert got(tok.FunctionTokenizer("comma", lambda s: s.split(",")))[1:4] == [["ab"], [""], None]
    assert tok.QGramTokenizer(3) == tok.QGramTokenizer(3) != tok.QGramTokenizer(4)


def test_set_operations_and_top_k(spark, rows):
    df = lambda *p: spark.createDataFrame(list(p), "id1 long, id2 long")
    x, y = df((1, 1), (2, 1), (1, 1)), df((2, 1), (3, 1))
    assert rows(setops.union(x, y)) == [(1, 1), (2, 1), (3, 1)] and rows(setops.intersect(x, y)) == [(2, 1)] and rows(setops.minus(x, y)) == [(1, 1)]
    scored = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.5), (3, 1, 0.9), (4, 2, 0.1)], "id1 long, id2 long, score double")
    assert rows(topk.merge_top_k([scored.where("id1 < 3"), scored.where("id1 >= 3")], 2)) == [(1, 1, 0.5), (3, 1, 0.9), (4, 2, 0.1)]
    assert evaluate(x, y).first().asDict() == {"true_positives": 1, "n_pairs": 2, "n_gold": 2, "recall": 0.5, "precision": 0.5, "f1": 0.5}


def test_lookup_of_skewed_keys(spark):
    data = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(100)] + [(None, 1)], "k string, v long")
    counts = data.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    got = lookup_skewed(data, counts, "k", "n", F.lit(1000), 10)
    assert got.count() == 1001 and got.where("k = 'hot' and n = 900").count() == 900 and got.where("n = 1").count() == 100 and got.where("n is null").count() == 1


def test_bad_similarity():
    with pytest.raises(ValueError, match="threshold"):
        setsim._check("jaccard", 0.0)
    with pytest.raises(ValueError, match="unknown"):
        setsim._check("dice", 0.5)


def test_checks_and_partitions(spark, tables):
    checks.validate_tables(tables[0], "_id", tables[1], "_id")
    bad = spark.createDataFrame([(1, 1.0), (1, None)], "i int, d double")
    for args, message in (((bad, "no"), "missing id column"), ((bad, "d"), "must be an integer"), ((bad, "i"), "duplicate"), ((bad.where("i > 9"), "i"), "empty")):
        with pytest.raises(ValueError, match=message):
            checks.validate_tables(*args, tables[1], "_id")
    with pytest.raises(ValueError, match="null"):
        checks.validate_tables(bad.select(F.when(F.col("d") > 0, 1).alias("i")), "i", tables[1], "_id")
    with pytest.raises(TypeError):
        checks.validate_tables([1], "_id", tables[1], "_id")
    parts = partitioning.HashPartitioner("_id", 4)
    assert sum(parts.get_partition(tables[0], p).count() for p in range(4)) == len(A)
    with pytest.raises(ValueError, match="not between"):
        parts.get_partition(tables[0], 4)
    lists = spark.createDataFrame([([1, 2, 3], ["a", "b", "c"])], "i array<long>, v array<string>")
    assert sorted(sum((lists.select(parts.filter_array(F.col("i"), F.col("v"), p)).first()[0] for p in range(4)), [])) == ["a", "b", "c"]
    assert partitioning.partitions_for(tables[0], 2) == max(21, 2 * spark.sparkContext.defaultParallelism)
    with partitioning.persisted(tables[0]) as kept:
        assert kept.is_cached
    assert partitioning.human_bytes(2048) == "2.0 KiB" and partitioning.size_in_bytes(__file__) > 0


def files(folder):
    return {p.name for p in Path(scratch.shared_dir(folder).removeprefix("file://")).glob("pairloom-*")}


def test_scratch_tables_live_as_long_as_their_scope(spark):
    before = files(spark)
    with scratch.scope():
        assert scratch.materialize(spark.range(3)).count() == 3 and len(files(spark) - before) == 1
        with scratch.outliving():
            kept = scratch.materialize(spark.range(4))
    assert len(files(spark) - before) == 1 and kept.count() == 4
    with scratch.dry():
        assert scratch.materialize(spark.range(5)).count() == 5
    assert len(files(spark) - before) == 1


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

    class Session:
        conf, sparkContext = {}, Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session)


@pytest.mark.parametrize("most", [1, 10, 10_000])
def test_crowded_keys_in_blocks_lose_no_pair(spark, rows, most):
    keys = [1] * 40 + [2] * 3 + list(range(10, 20))
    one = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key long, x long").repartition(3)
    two = spark.createDataFrame([(k, 100 + i) for i, k in enumerate(keys)], "key long, y long").repartition(2)
    want = sorted(((k, i, 100 + j) for i, k in enumerate(keys) for j, m in enumerate(keys) if k == m), key=repr)
    assert rows(block_join(one, two, "key", most).select("key", "x", "y")) == want
    assert (crowded_keys(one, two, "key", most) is None) == (most == 10_000)


@pytest.mark.parametrize("few", [0, 100_000])
@pytest.mark.parametrize("sim, val", [("jaccard", 0.4), ("cosine", 0.75)])
def test_similarity_join_with_crowded_tokens_is_whole(spark, tables, rows, monkeypatch, sim, val, few):
    monkeypatch.setattr("pairloom.operators.skew.FEW_KEYS", few)
    left, right = (t.select(F.col("_id").alias("sid"), WORDS.token_set(F.col("t")).alias("toks")) for t in tables)
    want = rows(setsim.similarity_join(left, right, sim, val))
    assert want and rows(setsim.similarity_join(left, right, sim, val, most=4)) == want


def test_parts_and_shared_indexes_and_explain(spark, tables, rows):
    program = Program([KeepRule([jac(0.4)]), KeepRule([P.BM25TopkPredicate("t", "t", "whitespace", 2), same_year()])], [DropRule([jac(0.9)])])
    run = Blocker(*tables, check=True)
    want = rows(run.pairs(program))
    assert want and rows(run.pairs_in_parts(program, 2)) == want
    assert len(run._indexes) == 2 and run.parts_for(program, 10) >= 1
    before = files(spark)
    assert "PRODUCED BY" in Blocker(*tables).explain(program) and files(spark) == before
    _, stats = run.execute(program, profile=True)
    assert {s.role for s in stats.predicates} == {"produce", "filter"} and all(s.pairs >= 0 for s in stats.predicates)
    with pytest.raises(ValueError, match="duplicate"):
        Blocker(tables[0].union(tables[0]), tables[1], check=True)


def test_bm25_is_asked_only_for_records_of_the_other_predicates(tables, rows):
    top = P.BM25TopkPredicate("t", "t", "whitespace", 2)
    both = Program([KeepRule([top, same_year()])])
    best = {tuple(r) for r in Blocker(*tables).pairs(Program([KeepRule([top])])).collect()}
    years = {tuple(r) for r in Blocker(*tables).pairs(Program([KeepRule([same_year()])])).collect()}
    assert rows(Blocker(*tables).pairs(both)) == sorted(best & years, key=repr) != []


def test_pairs_of_two_tables_under_one_name_differ(spark):
    one, two = spark.createDataFrame([(1, 2)], "id1 long, id2 long"), spark.createDataFrame([(3, 4)], "id1 long, id2 long")
    assert P.PairsPredicate("x", one) != P.PairsPredicate("x", two) and P.PairsPredicate("x", one) == P.PairsPredicate("x", one)


def test_graphs_are_edited_into_new_ones(tables, rows):
    base, drop = nodes.PredicateNode(jac(0.3)), same_year()
    graph = nodes.UnionNode((base, nodes.PredicateNode(same_year())))
    after = nodes.insert_after(graph, base, drop)
    assert after.sources[0] == nodes.PredicateNode(drop, base) and graph.sources[0] == base
    assert nodes.pop(after, after.sources[0]) == graph
    with pytest.raises(ValueError, match="taken out"):
        nodes.pop(graph, base)
    first = nodes.insert_before(after, after.sources[0], jac(0.2)).sources[0]
    assert first.source.predicate == jac(0.2) and first.source.source == base
    copy = nodes.clone(graph)
    assert copy == graph and copy is not graph
    turned = nodes.UnionNode((nodes.PredicateNode(same_year()), base))
    assert turned != graph and nodes.equivalent(turned, graph) and not nodes.equivalent(after, graph)
    x, y = jac(0.3), P.EditDistancePredicate("t", "t", operator.ge, 0.1)
    assert nodes.equivalent(nodes.PredicateNode(x, nodes.PredicateNode(y, turned)), nodes.PredicateNode(y, nodes.PredicateNode(x, turned)))


@pytest.mark.parametrize("least", [0.0, 0.5, 0.8, 1.0])
def test_edit_distance_stops_early_without_another_result(spark, least):
    texts = ["", "a", "abc" * 9, "abd" * 9, "x" * 300, "x" * 280, "y" * 2000, "y" * 1990 + "z" * 10, None]
    df = spark.createDataFrame([(x, y) for x in texts for y in texts], "x string, y string")
    for row in df.select(similarity.edit_at_least(F.col("x"), F.col("y"), least).alias("got"), (similarity.edit_similarity(F.col("x"), F.col("y")) >= least).alias("want")).collect():
        assert row["got"] == row["want"]


def test_vocabulary(spark):
    df = spark.createDataFrame([("a b a",), ("B",), (None,), ("",)], "t string")
    assert sorted(map(tuple, WORDS.vocabulary(df, "t").collect())) == [("a", 1, 2), ("b", 2, 2)] and WORDS.nunique_tokens(df, "t") == 2


def test_batches_of_pairs_are_compared_as_single_ones():
    r = random.Random(19)
    texts = ["", "a", "\U0001f600b", "é", "x" * 40] + ["".join(r.choice("abcd e") for _ in range(r.randrange(1, 30))) for _ in range(60)]
    pairs = [(x, y) for x in texts for y in texts]
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    for batch, one in ((similarity.jaro_batch, similarity.jaro), (similarity.jaro_winkler_batch, similarity.jaro_winkler), (similarity.smith_waterman_batch, similarity.smith_waterman)):
        assert batch(a, b) == pytest.approx([one(*p) for p in pairs])
    assert similarity.smith_waterman_batch(a, b, 0.3) == pytest.approx([similarity.smith_waterman(*p, 0.3) for p in pairs])
    assert len(similarity.jaro_batch([], [])) == 0


@pytest.mark.parametrize("kind", [P.JaroPredicate, P.JaroWinklerPredicate, P.SmithWatermanPredicate])
def test_length_bounds_lose_no_pair(tables, rows, kind):
    for op in (operator.ge, operator.lt):
        got = rows(Blocker(*tables).pairs(Program([KeepRule([same_year(), kind("t", "t", op, 0.7)])])))
        one = {"jaro": similarity.jaro, "jaro_winkler": similarity.jaro_winkler, "smith_waterman": similarity.smith_waterman}[kind.sim_name]
        assert got == sorted(pairs_where(lambda a, b: a[2] is not None and a[2] == b[2] and a[1] is not None and b[1] is not None and op(one(a[1], b[1]), 0.7)), key=repr)  # noqa: B023
