"""Queries over the test tables for the operators of the core, and their SQL."""

from __future__ import annotations

import operator

from pyspark.sql import functions as F

from pairloom.functions import tokenizers as tok
from pairloom.functions import vectors
from pairloom.operators import chunked, setops, topk
from pairloom.plans import nodes
from pairloom.plans.evaluate import evaluate
from pairloom.plans.executor import Blocker
from pairloom.plans.predicates import (
    BM25TopkPredicate,
    CosinePredicate,
    EditDistancePredicate,
    ExactMatchPredicate,
    JaccardPredicate,
    JaroPredicate,
    JaroWinklerPredicate,
    NameMatchPredicate,
    OverlapCoeffPredicate,
    PairsPredicate,
    SmithWatermanPredicate,
)
from pairloom.plans.program import DropRule, KeepRule, Program
from pairloom.sources.partitioning import HashPartitioner
from pairloom.sources.tables import table

GE, GT, LT = operator.ge, operator.gt, operator.lt
ALNUM, GRAMS = tok.AlphaNumericTokenizer(), tok.QGramTokenizer(3)


def blocker(spark, folder, **how):
    """Works of A against works of B; ``ascii_title`` is the title without other than printable ASCII characters."""
    ascii_title = F.regexp_replace("title", "[^ -~]", "")
    a, b = (table(spark, folder, name).withColumn("ascii_title", ascii_title) for name in ("table_a", "table_b"))
    return Blocker(a, b, **how)


def jaccard(val, tokenizer=ALNUM, op=GE, column="title"):
    return JaccardPredicate(column, column, tokenizer, op, val)


def flagship(spark, folder):
    """Titles whose 3-grams have a Jaccard similarity of at least 0.6."""
    return blocker(spark, folder).pairs(Program([KeepRule([jaccard(0.6, GRAMS)])]))


def program(keep, drop=()):
    """A query that runs one program over the works."""
    return lambda spark, folder: blocker(spark, folder).pairs(Program([KeepRule(r) for r in keep], [DropRule(r) for r in drop]))


def tokens(tokenizer):
    """A query that lists the tokens of every title of A."""
    return lambda spark, folder: table(spark, folder, "table_a").select("_id", tokenizer.tokens(F.col("title")).alias("tokens"))


def exact_int(spark, folder):
    """Orders with their customer, matched on integer keys."""
    run = Blocker(table(spark, folder, "customer"), table(spark, folder, "orders"), "c_custkey", "o_orderkey")
    return run.pairs(Program([KeepRule([ExactMatchPredicate("c_custkey", "o_custkey", False)])]))


def grouped_output(spark, folder):
    """One row per work of B with its list, empty ones included."""
    rule = Program([KeepRule([jaccard(0.6)])])
    out, _ = blocker(spark, folder).execute(rule, ["title", "year"])
    return out


def bm25_top10(spark, folder):
    """The ten best titles of A for every title of B, with scores."""
    run = blocker(spark, folder)
    a, b = run._side(run.table_a, "_id"), run._side(run.table_b, "_id")
    return BM25TopkPredicate("title", "title", "standard", 10).scored(a, b)


def hand_built(spark, folder):
    """A graph put together by hand: (titles alike, or equal authors) without pairs of different years."""
    alike = nodes.PredicateNode(jaccard(0.7))
    same = nodes.PredicateNode(ExactMatchPredicate("authors", "authors", False))
    either = nodes.UnionNode((alike, same))
    differ = nodes.PredicateNode(ExactMatchPredicate("year", "year", True), either)
    return nodes.MinusNode(either, differ).pairs(blocker(spark, folder))


def hand_built_intersect(spark, folder):
    """Titles alike and names equal, as an intersection."""
    parts = (nodes.PredicateNode(jaccard(0.5)), nodes.PredicateNode(NameMatchPredicate("authors", "authors")))
    return nodes.IntersectNode(parts).pairs(blocker(spark, folder))


def external_pairs(spark, folder):
    """Pairs of another blocker, kept where the years agree."""
    lists = table(spark, folder, "result_lists")
    pairs = lists.select(F.explode("id1_list").alias("id1"), "id2").where("id1 is not null")
    keep = [PairsPredicate("result_lists", pairs), ExactMatchPredicate("year", "year", False)]
    return blocker(spark, folder).pairs(Program([KeepRule(keep)]))


def set_operations(spark, folder):
    """Union, intersection and difference of the lists of neighbouring search records, as arrays."""
    lists = table(spark, folder, "result_lists").where("id1_list is not null").groupBy("id2").agg(F.array_distinct(F.flatten(F.array_sort(F.collect_set("id1_list")))).alias("ids"))
    right = lists.select((F.col("id2") - 1).alias("id2"), F.col("ids").alias("others"))
    both = lists.join(right, "id2")
    known = lambda c: F.filter(c, lambda x: x.isNotNull())
    x, y = known("ids"), known("others")
    return both.select("id2", setops.union_lists(x, y).alias("any"), setops.intersect_lists(x, y).alias("both"), setops.minus_lists(x, y).alias("only"))


def top_k_merge(spark, folder):
    """The three best of partial results over the even and the odd ids of A."""
    run = blocker(spark, folder)
    a, b = run._side(run.table_a, "_id"), run._side(run.table_b, "_id")
    scored = BM25TopkPredicate("title", "title", "standard", 5).scored(a, b).drop("rank")
    return topk.merge_top_k([scored.where("id1 % 2 = 0"), scored.where("id1 % 2 = 1")], 3)


def sparse_dot(spark, folder):
    """Dot products of vectors with their successors."""
    held = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), vectors.sparse_vector(F.col("embedding")).alias("vec"))
    pairs = held.select(F.col("id").alias("id1"), (F.col("id") + 1).alias("id2"))
    return vectors.dot_pairs(held, held, pairs).select("id1", "id2", F.round("score", 4).alias("score"))


def hash_partition(spark, folder):
    """Rows and listed ids of each of four hash parts."""
    by_row, by_id = HashPartitioner("_id", 4), HashPartitioner("id1", 4)
    a, lists = table(spark, folder, "table_a"), table(spark, folder, "result_lists")
    ids = [F.coalesce(F.sum(F.greatest(F.size(by_id.filter_array(F.col("id1_list"), None, p)), F.lit(0))), F.lit(0)) for p in range(4)]
    held = lists.agg(F.array(*ids).alias("n")).select(F.posexplode("n").alias("part", "n_ids"))
    rows = [by_row.get_partition(a, p).agg(F.count("*").alias("n_rows")).withColumn("part", F.lit(p)) for p in range(4)]
    merged = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return merged.join(held, "part")


def name_match_short(spark, folder):
    """Works of the same authors by short forms of their given names, as name_map has them."""
    rows = table(spark, folder, "name_map").where("name is not null").groupBy("name").agg(F.min("short").alias("short")).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("the short forms are a literal map of at most 1,000 names")
    known = {r["name"]: r["short"] for r in rows}
    return blocker(spark, folder).pairs(Program([KeepRule([NameMatchPredicate("authors", "authors", nicknames=known)])]))


def hash_partition_sums(spark, folder):
    """What the four hash parts of the rows and of the listed ids add up to."""
    parts = hash_partition(spark, folder)
    return parts.agg(F.count("*").cast("int").alias("parts"), F.sum("n_rows").cast("long").alias("n_rows"), F.sum("n_ids").cast("long").alias("n_ids"))


def in_parts(spark, folder):
    """The flagship query and the best titles, run over three parts of B one after the other."""
    rules = [KeepRule([jaccard(0.8, GRAMS)]), KeepRule([BM25TopkPredicate("title", "title", "standard", 2)])]
    return blocker(spark, folder).pairs_in_parts(Program(rules), 3)


def bm25_by(tokenizer):
    """The five best titles by another analyzer."""

    def run(spark, folder):
        works = blocker(spark, folder)
        a, b = works._side(works.table_a, "_id"), works._side(works.table_b, "_id")
        return BM25TopkPredicate("title", "title", tokenizer, 5).scored(a, b)

    return run


def recall_eval(spark, folder):
    """How the flagship query finds pairs of equal lower-cased titles."""
    gold = blocker(spark, folder).pairs(Program([KeepRule([ExactMatchPredicate("title", "title", False, lowercase=True)])]))
    scores = evaluate(flagship(spark, folder), gold)
    return scores.select("true_positives", "n_pairs", "n_gold", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


def p2_found(spark, folder):
    """Keys that hold at least one percent of all distinct pairs of key and id."""
    summary = chunked.key_summary(table(spark, folder, "hash_postings"))
    return summary.where(F.col("n_ids") * 100 >= F.col("total")).select("key", "first_id")


def p2_keys(spark, folder):
    """Every key with its number of ids, its ends and its share."""
    summary = chunked.key_summary(table(spark, folder, "hash_postings"))
    return summary.select("key", "n_ids", "first_id", "last_id", F.round("share", 9).alias("share"))


def p2_merged(spark, folder):
    """The merged ids of every key, heavy keys in ordered pieces."""
    rows = chunked.exploded_postings(table(spark, folder, "hash_postings"))
    merged = chunked.merged_postings(chunked.numbered_pairs(rows))
    return merged.select("key", "piece", "n", "first_id", "last_id", "ids")


P2_PAIRS = """
with read as (
  select trim(regexp_replace(lower(key), '[ \\t]+', ' ', 'g')) as key, unnest(ids) as id from hash_postings
), pairs as (select distinct key, id from read where key <> '' and id is not null)
"""


def _sql_sets(name, column, expr):
    return f"select _id, unnest(list_distinct({expr.format(column)})) as tok from {name}"


SQL_TOKENS = {
    "alnum": "regexp_extract_all(lower({0}), '[a-z0-9]+')",
    "3gram": "list_transform(generate_series(1, length({0}) - 2), lambda i: substr(lower({0}), i, 3))",
}


def sql_sim(sim, tokens, column="title"):
    """SQL for (id1, id2, score) of all pairs that share a token."""
    score = {
        "jaccard": "o / (n1 + n2 - o)",
        "cosine": "o / sqrt(n1 * n2)",
        "overlap": "o / least(n1, n2)",
    }[sim]
    sets = [_sql_sets(name, column, SQL_TOKENS[tokens]) for name in ("table_a", "table_b")]
    return f"""(with x as ({sets[0]}), y as ({sets[1]}), nx as (select _id, count(*) as n1 from x group by 1), ny as (select _id, count(*) as n2 from y group by 1),
p as (select x._id as id1, y._id as id2, count(*)::double as o from x join y using (tok) group by 1, 2)
select id1, id2, {score} as score from p join nx on nx._id = id1 join ny on ny._id = id2)"""


ASCII = "regexp_replace({}.title, '[^ -~]', '', 'g')"
SQL_WORKS = " join table_a a on a._id = id1 join table_b b on b._id = id2 "
SQL_NAME = "array_to_string(list_sort(list_filter(regexp_extract_all(lower({}), '[a-z]+'), lambda w: length(w) > 1)), ' ')"
GRAMS_SQL = SQL_TOKENS["3gram"]
WORDS_SQL = r"list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda w: w <> '')"


def sql_short(name):
    """SQL for (_id, name) with short forms put in."""
    return f"""(with w as (select _id, unnest(regexp_extract_all(lower(authors), '[a-z][a-z]+')) as w from {name} where authors is not null),
m as (select name, min(short) as short from name_map where name is not null group by 1)
select t._id, coalesce(string_agg(coalesce(short, w), ' ' order by coalesce(short, w)), '') as name from {name} t left join w on w._id = t._id left join m on m.name = w.w where t.authors is not null group by 1)"""


SQL_EDIT = f"1 - levenshtein({ASCII.format('a')}, {ASCII.format('b')}) / greatest(length({ASCII.format('a')}), length({ASCII.format('b')}))"
SQL_JARO = f"jaro_similarity({ASCII.format('a')}, {ASCII.format('b')})"
def sql_smith_waterman(a, b):
    """SQL for the similarity: the alignment matrix row after row, as lists with the best cell at the end. A gap in a row is a running maximum."""
    codes = lambda t: f"list_transform(string_split({t}, ''), lambda c: ord(c)::double)"
    fresh = f"list_transform(range(1, length({b}) + 1), lambda j: greatest(r[j] + ({codes(b)}[j] = ch[1])::int, r[j + 1] - 1, 0.0) + j)"
    row = f"list_transform([{fresh}], lambda t: list_transform(range(1, length({b}) + 1), lambda j: list_max(t[:j]) - j))[1]"
    step = f"list_transform([{row}], lambda n: [0.0] || n || [greatest(r[-1], list_max(n))])[1]"
    rows = f"list_transform({codes(a)}, lambda c: [c])"
    return f"list_reduce({rows}, lambda r, ch: {step}, list_resize([0.0::double], length({b}) + 2, 0.0))[-1] / greatest(length({a}), length({b}))"


SQL_SAME_START = f"""list_sum(list_transform(generate_series(1, 4), lambda i: (length({ASCII.format('a')}) >= i and left({ASCII.format('a')}, i) = left({ASCII.format('b')}, i))::int))"""


def sql_bm25(column, k, tokens=r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"):
    """SQL for (id1, id2, score, rank) of the BM25 top k."""
    return f"""(with d as (select _id as id1, {tokens.format(column)} as toks from table_a where {column} is not null),
st as (select count(*) as n, avg(len(toks)) as avgdl from d),
tf as (select id1, len(toks) as dl, unnest(toks) as tok from d), post as (select id1, dl, tok, count(*) as tf from tf group by all),
df as (select tok, count(*) as df from post group by 1),
q as (select _id as id2, unnest(list_distinct({tokens.format(column)})) as tok from table_b),
s as (select id1, id2, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score
  from q join post using (tok) join df using (tok), st group by 1, 2),
r as (select *, row_number() over (partition by id2 order by score desc, id1)::int as rank from s)
select id1, id2, score, rank from r where rank <= {k})"""


def _sim(sim, tokens, op, val, column="title"):
    return f"select id1, id2 from {sql_sim(sim, tokens, column)} where round(score, 12) {op} {val}"


SQL_STRIPPED = r"list_filter(regexp_split_to_array(regexp_replace(lower(regexp_replace(title, '\s+', ' ', 'g')), '[^a-z0-9 ]+', '', 'g'), ' +'), lambda w: w <> '')"

QUERIES = {
    "flagship": flagship,
    "jaccard_3gram_ge": program([[jaccard(0.7, GRAMS)]]),
    "jaccard_gt_strict": program([[jaccard(0.5, op=GT)]]),
    "jaccard_author_3gram": program([[jaccard(0.8, GRAMS, column="authors")]]),
    "cosine_alnum_ge": program([[CosinePredicate("title", "title", ALNUM, GE, 0.75)]]),
    "overlap_filter": program([[jaccard(0.4), OverlapCoeffPredicate("title", "title", ALNUM, GE, 0.8)]]),
    "overlap_drop": program([[jaccard(0.4)]], [[OverlapCoeffPredicate("title", "title", ALNUM, LT, 0.8)]]),
    "exact_str": program([[ExactMatchPredicate("title", "title", False)]]),
    "exact_lower": program([[ExactMatchPredicate("title", "title", False, lowercase=True)]]),
    "exact_int": exact_int,
    "exact_invert_keep": program([[jaccard(0.6), ExactMatchPredicate("venue", "venue", True)]]),
    "exact_invert_drop": program([[jaccard(0.6)]], [[ExactMatchPredicate("year", "year", True)]]),
    "name_match": program([[NameMatchPredicate("authors", "authors")]]),
    "edit_filter": program([[jaccard(0.4), EditDistancePredicate("ascii_title", "ascii_title", GE, 0.8)]]),
    "jaro_filter": program([[jaccard(0.4), JaroPredicate("ascii_title", "ascii_title", GE, 0.85)]]),
    "jw_filter": program([[jaccard(0.4), JaroWinklerPredicate("ascii_title", "ascii_title", GE, 0.9)]]),
    "sw_filter": program([[jaccard(0.4), SmithWatermanPredicate("ascii_title", "ascii_title", GE, 0.8)]]),
    "bm25_top10": bm25_top10,
    "bm25_3gram": bm25_by("3gram"),
    "bm25_whitespace": bm25_by("whitespace"),
    "in_parts": in_parts,
    "name_match_short": name_match_short,
    "hash_partition_sums": hash_partition_sums,
    "bm25_two_fields_intersect": program([[BM25TopkPredicate("title", "title", "standard", 10), BM25TopkPredicate("description", "description", "standard", 20)]]),
    "bm25_then_cosine": program([[BM25TopkPredicate("title", "title", "standard", 10), CosinePredicate("title", "title", ALNUM, GE, 0.6)]]),
    "union_two_rules": program([[jaccard(0.7)], [NameMatchPredicate("authors", "authors"), ExactMatchPredicate("year", "year", False)]]),
    "keep_and_drop": program([[jaccard(0.5)]], [[ExactMatchPredicate("authors", "authors", False)]]),
    "drop_null_semantics": program([[jaccard(0.6)]], [[jaccard(0.5, op=LT, column="description")]]),
    "complex_program": program(
        [[jaccard(0.6), ExactMatchPredicate("year", "year", False)], [jaccard(0.8)], [BM25TopkPredicate("title", "title", "standard", 3), NameMatchPredicate("authors", "authors")]],
        [[ExactMatchPredicate("venue", "venue", True), EditDistancePredicate("ascii_title", "ascii_title", LT, 0.7)]],
    ),
    "grouped_output": grouped_output,
    "hand_built": hand_built,
    "hand_built_intersect": hand_built_intersect,
    "external_pairs": external_pairs,
    "set_operations": set_operations,
    "top_k_merge": top_k_merge,
    "sparse_dot": sparse_dot,
    "hash_partition": hash_partition,
    "recall_eval": recall_eval,
    "tok_ws": tokens(tok.WhiteSpaceTokenizer()),
    "tok_stripped_ws": tokens(tok.StrippedWhiteSpaceTokenizer()),
    "tok_num": tokens(tok.NumericTokenizer()),
    "tok_alnum": tokens(ALNUM),
    "tok_standard": tokens(tok.StandardTokenizer()),
    "tok_qgram": tokens(GRAMS),
    "tok_stripped_qgram": tokens(tok.StrippedQGramTokenizer(4)),
    "tok_shingle": tokens(tok.ShingleTokenizer(2)),
    "p2_found": p2_found,
    "p2_keys": p2_keys,
    "p2_merged": p2_merged,
}

SQL = {
    "flagship": _sim("jaccard", "3gram", ">=", 0.6),
    "jaccard_3gram_ge": _sim("jaccard", "3gram", ">=", 0.7),
    "jaccard_gt_strict": _sim("jaccard", "alnum", ">", 0.5),
    "jaccard_author_3gram": _sim("jaccard", "3gram", ">=", 0.8, "authors"),
    "cosine_alnum_ge": _sim("cosine", "alnum", ">=", 0.75),
    "overlap_filter": f"with o as {sql_sim('overlap', 'alnum')} select id1, id2 from o where score >= 0.8 intersect " + _sim("jaccard", "alnum", ">=", 0.4),
    "overlap_drop": _sim("jaccard", "alnum", ">=", 0.4) + f" except select id1, id2 from {sql_sim('overlap', 'alnum')} where score < 0.8",
    "exact_str": "select a._id as id1, b._id as id2 from table_a a join table_b b on a.title = b.title",
    "exact_lower": "select a._id as id1, b._id as id2 from table_a a join table_b b on lower(a.title) = lower(b.title)",
    "exact_int": "select c_custkey as id1, o_orderkey as id2 from customer join orders on c_custkey = o_custkey",
    "exact_invert_keep": f"select id1, id2 from {sql_sim('jaccard', 'alnum')}{SQL_WORKS}where round(score, 12) >= 0.6 and b.venue is not null and b.venue is distinct from a.venue",
    "exact_invert_drop": f"select id1, id2 from {sql_sim('jaccard', 'alnum')}{SQL_WORKS}where round(score, 12) >= 0.6 and not (b.year is not null and b.year is distinct from a.year)",
    "name_match": f"select a._id as id1, b._id as id2 from table_a a join table_b b on {SQL_NAME.format('a.authors')} = {SQL_NAME.format('b.authors')}",
    "edit_filter": f"select id1, id2 from {sql_sim('jaccard', 'alnum')}{SQL_WORKS}where round(score, 12) >= 0.4 and {SQL_EDIT} >= 0.8",
    "jaro_filter": f"select id1, id2 from {sql_sim('jaccard', 'alnum')}{SQL_WORKS}where round(score, 12) >= 0.4 and {SQL_JARO} >= 0.85",
    "jw_filter": f"select id1, id2 from {sql_sim('jaccard', 'alnum')}{SQL_WORKS}where round(score, 12) >= 0.4 and {SQL_JARO} + {SQL_SAME_START} * 0.1 * (1 - {SQL_JARO}) >= 0.9",
    "sw_filter": f"""with p as (select id1, id2, {ASCII.format('a')} as x, {ASCII.format('b')} as y from {sql_sim('jaccard', 'alnum')}{SQL_WORKS}where round(score, 12) >= 0.4)
select id1, id2 from p where x <> '' and y <> '' and {sql_smith_waterman('x', 'y')} >= 0.8""",
    "bm25_top10": f"select * from {sql_bm25('title', 10)}",
    "bm25_3gram": f"select * from {sql_bm25('title', 5, GRAMS_SQL)}",
    "bm25_whitespace": f"select * from {sql_bm25('title', 5, WORDS_SQL)}",
    "in_parts": _sim("jaccard", "3gram", ">=", 0.8) + f" union select id1, id2 from {sql_bm25('title', 2)}",
    "name_match_short": f"with x as {sql_short('table_a')}, y as {sql_short('table_b')} select x._id as id1, y._id as id2 from x join y using (name)",
    "hash_partition_sums": "select 4 as parts, (select count(*) from table_a) as n_rows, (select count(*) from (select unnest(id1_list) as id from result_lists)) as n_ids",
    "bm25_two_fields_intersect": f"select id1, id2 from {sql_bm25('title', 10)} intersect select id1, id2 from {sql_bm25('description', 20)}",
    "bm25_then_cosine": f"select id1, id2 from {sql_bm25('title', 10)} intersect " + _sim("cosine", "alnum", ">=", 0.6),
    "union_two_rules": _sim("jaccard", "alnum", ">=", 0.7) + f" union select a._id, b._id from table_a a join table_b b on a.year = b.year and {SQL_NAME.format('a.authors')} = {SQL_NAME.format('b.authors')}",
    "keep_and_drop": _sim("jaccard", "alnum", ">=", 0.5) + " except select a._id, b._id from table_a a join table_b b on a.authors = b.authors",
    "drop_null_semantics": f"""select j.id1, j.id2 from {sql_sim('jaccard', 'alnum')} j left join {sql_sim('jaccard', 'alnum', 'description')} d on j.id1 = d.id1 and j.id2 = d.id2
join table_a a on a._id = j.id1 join table_b b on b._id = j.id2
where round(j.score, 12) >= 0.6 and not (a.description is not null and b.description is not null and coalesce(d.score, 0.0) < 0.5)""",
    "complex_program": f"""with j as materialized {sql_sim('jaccard', 'alnum')},
k as (select id1, id2 from j{SQL_WORKS}where round(score, 12) >= 0.8 or (round(score, 12) >= 0.6 and a.year = b.year)
  union select id1, id2 from {sql_bm25('title', 3)}{SQL_WORKS}where {SQL_NAME.format('a.authors')} = {SQL_NAME.format('b.authors')})
select id1, id2 from k{SQL_WORKS}where not coalesce(b.venue is not null and b.venue is distinct from a.venue and {SQL_EDIT} < 0.7, false)""",
    "grouped_output": f"""with j as ({_sim('jaccard', 'alnum', '>=', 0.6)}), g as (select id2, list(id1 order by id1) as l from j group by 1)
select title, year, _id as id2, coalesce(l, []::bigint[]) as id1_list from table_b left join g on _id = id2""",
    "hand_built": f"""with k as ({_sim('jaccard', 'alnum', '>=', 0.7)} union select a._id, b._id from table_a a join table_b b on a.authors = b.authors)
select id1, id2 from k{SQL_WORKS}where not (b.year is not null and b.year is distinct from a.year)""",
    "hand_built_intersect": _sim("jaccard", "alnum", ">=", 0.5) + f" intersect select a._id, b._id from table_a a join table_b b on {SQL_NAME.format('a.authors')} = {SQL_NAME.format('b.authors')}",
    "external_pairs": f"with p as (select distinct id2, unnest(id1_list) as id1 from result_lists) select id1, id2 from p{SQL_WORKS}where a.year = b.year",
    "set_operations": """with l as (select id2, list_filter(list_distinct(flatten(list(id1_list))), lambda x: x is not null) as ids from result_lists where id1_list is not null group by 1),
p as (select l.id2, l.ids as x, r.ids as y from l join l r on r.id2 = l.id2 + 1)
select id2, list_sort(list_distinct(x || y)) as any, list_sort(list_filter(x, lambda i: list_contains(y, i))) as both, list_sort(list_filter(x, lambda i: not list_contains(y, i))) as only from p""",
    "top_k_merge": f"select id1, id2, score from {sql_bm25('title', 3)}",
    "sparse_dot": """select x.vec_id as id1, x.vec_id + 1 as id2, round(list_sum(list_transform(range(1, len(x.embedding) + 1), lambda i: x.embedding[i]::double * y.embedding[i]::double)), 4) as score
from embeddings x left join embeddings y on y.vec_id = x.vec_id + 1""",
    "recall_eval": f"""with p as ({_sim('jaccard', '3gram', '>=', 0.6)}), g as (select a._id as id1, b._id as id2 from table_a a join table_b b on lower(a.title) = lower(b.title)),
c as (select (select count(*) from (from p intersect from g)) as t, (select count(*) from p) as p, (select count(*) from g) as g)
select t as true_positives, p as n_pairs, g as n_gold, round(t / g, 6) as recall, round(t / p, 6) as precision, round(2 * t / (p + g), 6) as f1 from c""",
    "tok_ws": r"select _id, list_filter(regexp_split_to_array(lower(title), '\s+'), lambda w: w <> '') as tokens from table_a",
    "tok_stripped_ws": f"select _id, {SQL_STRIPPED} as tokens from table_a",
    "tok_num": "select _id, regexp_extract_all(title, '[0-9]+') as tokens from table_a",
    "tok_alnum": "select _id, regexp_extract_all(lower(title), '[a-z0-9]+') as tokens from table_a",
    "tok_standard": r"select _id, regexp_extract_all(lower(title), '[\p{L}\p{N}]+') as tokens from table_a",
    "tok_qgram": "select _id, list_transform(generate_series(1, length(title) - 2), lambda i: substr(lower(title), i, 3)) as tokens from table_a",
    "tok_stripped_qgram": r"""with s as (select _id, lower(regexp_replace(title, '[^\p{L}\p{M}\p{N}_]+', '', 'g')) as t from table_a)
select _id, list_transform(generate_series(1, length(t) - 3), lambda i: substr(t, i, 4)) as tokens from s""",
    "tok_shingle": f"""with s as (select _id, {SQL_STRIPPED} as w from table_a)
select _id, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || w[i + 1]) as tokens from s""",
    "p2_found": P2_PAIRS
    + "select key, min(id) as first_id from pairs group by key having count(*) * 100 >= (select count(*) from pairs)",
    "p2_keys": P2_PAIRS
    + "select key, count(*) as n_ids, min(id) as first_id, max(id) as last_id,"
    + " round(count(*) / (select count(*) from pairs), 9) as share from pairs group by key",
    "p2_merged": P2_PAIRS
    + """, numbered as (select key, id, (row_number() over (order by key, id) - 1) // 65536 as chunk from pairs),
starts as (select key, min(chunk) as first_chunk from numbered group by key)
select key, chunk - first_chunk as piece, count(*)::int as n, min(id) as first_id, max(id) as last_id, list(id order by id) as ids
from numbered join starts using (key) group by key, chunk, first_chunk""",
}
