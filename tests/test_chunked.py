from collections import defaultdict

from pairloom.operators import chunked

SCHEMA = "slice_no int, key string, ids array<bigint>, row_no bigint"


def brute(data):
    out = defaultdict(set)
    for _, key, ids, _ in data:
        if key is None:
            continue
        key = " ".join(key.replace("\t", " ").lower().split(" ")).strip()
        while "  " in key:
            key = key.replace("  ", " ")
        for i in ids or []:
            if key and i is not None:
                out[key].add(i)
    return {k: v for k, v in out.items() if v}


DATA = [
    (0, "Hot", list(range(50)), 1), (0, "hot ", list(range(25, 90)), 1), (1, "\thot", [89, 89, None], 2), (1, None, [1], 3), (1, "  ", [1], 3),
    (1, "a  b", [7, 7, 3], 1), (1, "A\tB", [7, 9], 4), (2, "x", None, 5), (2, "y", [], 5), (2, "z", [None], 5), (2, "one", [5], 5), (2, "one", [5], 5),
    (3, "w" * 50_000, [4], 1),
]


def test_summary_matches_brute_force_for_every_chunk_size(spark):
    want = {k: (len(v), min(v), max(v)) for k, v in brute(DATA).items()}
    for chunk_rows in (1, 7, 1000):
        got = chunked.key_summary(spark.createDataFrame(DATA, SCHEMA), chunk_rows).collect()
        assert {r["key"]: (r["n_ids"], r["first_id"], r["last_id"]) for r in got} == want
        assert {r["total"] for r in got} == {sum(n for n, _, _ in want.values())}
        assert all(r["n_chunks"] <= -(-r["n_ids"] // chunk_rows) + 1 for r in got)


def test_numbers_have_no_gaps_and_chunks_are_equal(spark):
    pairs = chunked.exploded_postings(spark.createDataFrame(DATA, SCHEMA).repartition(5))
    got = chunked.numbered_pairs(pairs, 10).orderBy("row_no").collect()
    assert [r["row_no"] for r in got] == list(range(len(got)))
    assert [(r["key"], r["id"]) for r in got] == sorted((k, i) for k, v in brute(DATA).items() for i in v)
    assert all(r["chunk"] == r["row_no"] // 10 for r in got)


def test_merged_pieces_join_to_the_ordered_ids(spark):
    numbered = chunked.numbered_pairs(chunked.exploded_postings(spark.createDataFrame(DATA, SCHEMA)), 16)
    lists = defaultdict(list)
    for r in sorted(chunked.merged_postings(numbered).collect(), key=lambda r: (r["key"], r["piece"])):
        assert r["n"] == len(r["ids"]) <= 16 and (r["first_id"], r["last_id"]) == (r["ids"][0], r["ids"][-1])
        lists[r["key"]] += r["ids"]
    assert lists == {k: sorted(v) for k, v in brute(DATA).items()}


def test_empty_table(spark):
    assert chunked.key_summary(spark.createDataFrame([], SCHEMA)).count() == 0
