"""Queries over the test tables for the operators of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.llm import matching, mixing, packing, quality, setjoin, tokens, topn, trie
from pairloom.sources.scratch import materialize
from pairloom.sources.tables import table


def p1_found(spark, folder):
    """The ten best items of every search record."""
    return p1_top(spark, folder).select("id1", "id2")


def p1_top(spark, folder):
    """The ten best items of every search record, with score and rank."""
    items = topn.unrolled(table(spark, folder, "predicate_out"))
    best = topn.top_n_per_group(items, "id2", "id1", "score", 10)
    rank = F.row_number().over(Window.partitionBy("id2").orderBy(F.desc("score"), "id1"))  # over ten rows at most
    return best.select("id1", "id2", "score", rank.alias("rank"))


def p3_matches(spark, folder):
    """Pairs of works with the confidence that they are the same."""
    # A fixed list of short forms; of two for a name the first in the alphabet.
    held = table(spark, folder, "name_map").where("name is not null and short is not null").groupBy("name").agg(F.min("short").alias("short")).limit(100_001).collect()
    if len(held) > 100_000:
        raise ValueError("more than 100,000 names")
    names = {r["name"]: r["short"] for r in held}
    compared = table(spark, folder, "bootleg_sim").where("not invert").select("index_col", "search_col").distinct().orderBy("index_col", "search_col").collect()
    people = [matching.TextField(f"names{i}", r["index_col"], r["search_col"], 128, 0.8, names, near_number=True, chunks=5) for i, r in enumerate(compared)]
    fields = (matching.TextField("title", "title", "title", 256, 0.7, chunks=10), matching.TextField("description", "description", "description", 192, 0.7, chunks=9), *people)
    return matching.match_records(table(spark, folder, "table_a"), table(spark, folder, "table_b"), "_id", fields, "year", "venue")


def p3_found(spark, folder):
    """Pairs of works that are more likely the same than not."""
    return p3_matches(spark, folder).where("confidence >= 0.5").select("id1", "id2")


def p4_found(spark, folder):
    """Tokens that are too rare or too common."""
    marked = trie.marked_frequencies(table(spark, folder, "token_bags"), "_id", "tok")
    return marked.where("mark is not null").select(F.col("term").alias("tok"), "mark")


def p4_frequencies(spark, folder):
    """Every token with its counts and mark."""
    return trie.marked_frequencies(table(spark, folder, "token_bags"), "_id", "tok").withColumnRenamed("term", "tok")


def _author_sets(spark, folder, name):
    return setjoin.name_sets(table(spark, folder, name), "_id", "authors", table(spark, folder, "name_map"))


def _p5_lists(spark, folder):
    return setjoin.similar_sets(table(spark, folder, "result_lists"), None, "id2", "id1_list", 0.7)


def _p5_authors(spark, folder):
    return setjoin.similar_sets(_author_sets(spark, folder, "table_a"), _author_sets(spark, folder, "table_b"), "_id", "words", 0.7)


def p5_found(spark, folder):
    """Pairs of search records with alike lists, and of records of A and B with alike author names."""
    lists = setjoin.record_pairs(_p5_lists(spark, folder), False).select(F.lit("id1_list").alias("field"), "key1", "key2")
    names = setjoin.record_pairs(_p5_authors(spark, folder), True).select(F.lit("authors").alias("field"), "key1", "key2")
    return lists.unionByName(names)


def p5_links(spark, folder):
    """Each search record with the smallest record of the class of its list, and the number of other lists alike to it."""
    return setjoin.record_links(_p5_lists(spark, folder)).select("key", "class_key", "n_links")


def p5_author_links(spark, folder):
    """Each record of A and B with the smallest record of the class of its author names, and the number of other classes of the other side alike to it."""
    return setjoin.record_links(_p5_authors(spark, folder)).select("key", "class_key", "n_links")


def p6_packed(spark, folder):
    """The container of each document, or piece of one, for every capacity."""
    sizes = tokens.token_counts(table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")
    return packing.pack(materialize(sizes), "doc_id", "n_tokens", table(spark, folder, "pack_sizes"), "pack", "capacity")


def p6_fill(spark, folder):
    """How well the containers of each capacity are filled."""
    return packing.fill_summary(p6_packed(spark, folder), table(spark, folder, "pack_sizes"), "pack", "capacity")


def p6_kept(spark, folder):
    """What must hold of the containers of each capacity: all documents are there, none is overfull, only longer texts are cut."""
    packed = p6_packed(spark, folder)
    kinds = F.broadcast(table(spark, folder, "pack_sizes").select("pack", F.col("capacity").cast("long").alias("capacity")))
    fills = packed.where("container is not null").groupBy("pack", "container").agg(F.sum("tokens").alias("fill")).join(kinds, "pack")
    over = fills.groupBy("pack").agg(F.count_if(F.col("fill") > F.col("capacity")).alias("overfull"))
    documents = packed.groupBy("pack", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens")).join(kinds, "pack")
    needed = F.greatest(F.ceil(F.col("tokens") / F.col("capacity")), F.lit(1))
    cut = documents.groupBy("pack", "capacity").agg(F.count("*").alias("documents"), F.count_if(F.col("pieces") != needed).alias("cut_without_need"))
    return cut.join(over, "pack").select("pack", "capacity", "documents", "overfull", "cut_without_need")


def p7_kept(spark, folder):
    """What must hold of the mix: no document is used too often or under another source than its own, and the shares sum to 1."""
    documents, targets = table(spark, folder, "documents"), table(spark, folder, "mix_targets")
    chosen, shares = mixing.mix(documents, "doc_id", "text", "source", targets)
    name = mixing.source_name(F.col("source"))
    caps = F.broadcast(targets.select(name.alias("source"), "max_repeats"))
    own = documents.select("doc_id", name.alias("own"))
    used = chosen.join(own, "doc_id").join(caps, "source", "left").groupBy("source").agg(
        F.count_if(F.coalesce(F.col("repeats") > F.col("max_repeats"), F.lit(True))).alias("too_often"),
        F.count_if(F.col("own").isNotNull() & (F.col("own") != F.col("source"))).alias("not_of_source"),
    )
    whole = shares.agg(F.round(F.sum("share"), 6).alias("all_shares"))
    held = shares.select("source", "target_share").join(used, "source", "left").crossJoin(F.broadcast(whole))
    return held.select("source", "target_share", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("too_often", "not_of_source")], "all_shares")


def p7_mixed(spark, folder):
    """The chosen documents with their repeats, with the target and the reached share of their source."""
    chosen, shares = mixing.mix(table(spark, folder, "documents"), "doc_id", "text", "source", table(spark, folder, "mix_targets"))
    return chosen.join(F.broadcast(shares.select("source", "target_share", "share")), "source")


def p7_shares(spark, folder):
    """The share that each source reached."""
    return mixing.mix(table(spark, folder, "documents"), "doc_id", "text", "source", table(spark, folder, "mix_targets"))[1]


def p8_found(spark, folder):
    """Documents more than half of whose characters are in lists, tables or junk."""
    return p8_statistics(spark, folder).where("not is_prose").select("doc_id")


def p8_statistics(spark, folder):
    """The text statistics of every document."""
    return quality.text_statistics(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "common_words"))


def p8_plain(spark, folder):
    """The statistics of every document that need no model."""
    stats = quality.plain_statistics(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "common_words"))
    return stats.select("doc_id", "n_chars", "n_words", "n_lines", *[F.round(c, 9).alias(c) for c in ("mean_word_length", "symbol_ratio", "punct_line_share", "common_word_share")])


TOP_ITEMS = """
with items as (
  select id2, unnest(id1_list) as id1, unnest(list_resize(coalesce(scores, []::float[]), len(id1_list))) as score from predicate_out
), best as (select id2, id1, max(score) as score from items where id1 is not null and score is not null and not isnan(score) group by id2, id1),
ranked as (select id2, id1, score, row_number() over (partition by id2 order by score desc, id1)::int as rank from best)
"""

TERMS = r"""
with read as (select _id, unnest(tok) as tok from token_bags),
terms as (select _id, regexp_replace(lower(tok), '^\s+|\s+$', '', 'g') as tok from read where _id is not null),
held as (select * from terms where tok <> ''),
counts as (select tok, count(*) as occurrences, count(distinct _id) as records from held group by tok),
marked as (select tok, occurrences, records,
  case when records <= 2 then 'rare' when records > 0.2 * (select count(distinct _id) from held) then 'common' end as mark from counts)
"""

def _alike(sets, other=None):
    """SQL for (a, b) of the rows r of ``sets`` (r, s) whose sets share at least 70 percent of their union; within one table r < r."""
    two = other or sets
    order = "" if other else " and x.r < y.r"
    return f"""(with x as (select r, len(s) as n, unnest(s) as t from {sets}), y as (select r, len(s) as n, unnest(s) as t from {two}),
m as (select x.r as a, y.r as b, x.n as na, y.n as nb, count(*) as o from x join y on x.t = y.t{order} group by all)
select a, b from m where 10 * o >= 7 * (na + nb - o))"""


LISTS = """
with held as (select distinct id2, list_sort(list_distinct(list_filter(id1_list, lambda i: i is not null))) as s from result_lists where id2 is not null),
lists as (select row_number() over () as r, s from (select distinct s from held where len(s) > 0))
"""

NAMES = """
{0}_words as (select _id, unnest(regexp_extract_all(lower(authors), '[a-z][a-z]+')) as w from table_{0}),
{0}_sets as (select _id as r, list(distinct coalesce(short, w)) as s from {0}_words left join (select name, min(short) as short from name_map group by 1) on name = w group by 1)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_top": p1_top,
    "p3_found": p3_found,
    "p3_matches": p3_matches,
    "p4_found": p4_found,
    "p4_frequencies": p4_frequencies,
    "p5_found": p5_found,
    "p5_links": p5_links,
    "p5_author_links": p5_author_links,
    "p6_packed": p6_packed,
    "p6_fill": p6_fill,
    "p6_kept": p6_kept,
    "p7_mixed": p7_mixed,
    "p7_shares": p7_shares,
    "p7_kept": p7_kept,
    "p8_found": p8_found,
    "p8_statistics": p8_statistics,
    "p8_plain": p8_plain,
}

SQL = {
    "p1_found": TOP_ITEMS + "select id1, id2 from ranked where rank <= 10",
    "p1_top": TOP_ITEMS + "select id1, id2, score, rank from ranked where rank <= 10",
    "p5_found": LISTS
    + f", links as {_alike('lists')}, same as (select a, b from links union all select r, r from lists), classes as (select id2, r from held join lists using (s)), "
    + NAMES.format("a") + "," + NAMES.format("b")
    + f"""select distinct 'id1_list' as field, least(x.id2, y.id2) as key1, greatest(x.id2, y.id2) as key2 from same join classes x on x.r = a join classes y on y.r = b where x.id2 <> y.id2
union all select 'authors', a, b from {_alike('a_sets', 'b_sets')}""",
    "p5_links": LISTS
    + f", links as {_alike('lists')}, ends as (select a as r from links union all select b from links), counts as (select r, count(*) as n from ends group by 1)"
    + "select id2 as key, min(id2) over (partition by r) as class_key, coalesce(n, 0) as n_links from held join lists using (s) left join counts using (r)",
    "p5_author_links": "with " + NAMES.format("a").strip() + "," + NAMES.format("b")
    + f""", one as (select r, list_sort(s) as s, 1 as side from a_sets), two as (select r, list_sort(s) as s, 2 as side from b_sets), records as (select * from one union all select * from two),
classes as (select row_number() over () as r, s, bool_or(side = 1) as a, bool_or(side = 2) as b from records group by s), a_classes as (select r, s from classes where a), b_classes as (select r, s from classes where b),
links as (select distinct least(a, b) as a, greatest(a, b) as b from {_alike('a_classes', 'b_classes')} where a <> b), ends as (select a as r from links union all select b from links), counts as (select r, count(*) as n from ends group by 1)
select records.r as key, min(records.r) over (partition by classes.r) as class_key, coalesce(n, 0) as n_links from records join classes using (s) left join counts on counts.r = classes.r""",
    "p6_kept": "select pack, capacity::bigint as capacity, (select count(*) from documents) as documents, 0::bigint as overfull, 0::bigint as cut_without_need from pack_sizes",
    "p7_kept": r"select regexp_replace(lower(trim(source)), '[\s_-]+', '_', 'g') as source, target_share, 0::bigint as too_often, 0::bigint as not_of_source, 1.0::double as all_shares from mix_targets",
    "p8_plain": r"""with d as (select doc_id, coalesce(text, '') as t from documents),
c as (select list(distinct lower(word)) as common from common_words where word is not null),
m as (select doc_id, length(regexp_replace(t, '[ \t\r\n\x0b\x0c]', '', 'g')) as chars, regexp_extract_all(t, '[A-Za-zÀ-ӿ]+') as words, length(regexp_replace(t, '[^0-9]', '', 'g')) as digits,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\r\x0b\x0c]')) as lines from d),
n as (select *, len(words) as n_words, len(lines) as n_lines, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as letters,
  len(list_filter(lines, lambda x: regexp_matches(x, '[.!?:;][ \t\r\x0b\x0c]*$'))) as ends, len(list_filter(words, lambda x: list_contains(common, lower(x)))) as n_common from m, c)
select doc_id, chars as n_chars, n_words, n_lines, round(coalesce(letters / nullif(n_words, 0), 0), 9) as mean_word_length, round(coalesce((chars - letters - digits) / nullif(chars, 0), 0), 9) as symbol_ratio,
  round(coalesce(ends / nullif(n_lines, 0), 0), 9) as punct_line_share, round(coalesce(n_common / nullif(n_words, 0), 0), 9) as common_word_share from n""",
    "p4_found": TERMS + "select tok, mark from marked where mark is not null",
    "p4_frequencies": TERMS + "select tok, occurrences, records, mark from marked",
}
