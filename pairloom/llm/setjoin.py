"""All pairs of records whose sets of values overlap above a threshold.

Equal sets are collapsed into classes first, so copies are compared once. The classes are joined by
the prefix filter with length and positional filters over tokens ordered by rarity, and exact
overlaps are verified. Class pairs, with the members of each class, hold every pair of records;
they are expanded only where pairs of records are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators import setsim
from pairloom.operators.skew import lookup_skewed
from pairloom.sources.scratch import materialize


@dataclass(frozen=True)
class SimilarSets:
    """``links`` (s1, s2, score): pairs of alike classes, s1 < s2. ``members`` (side, key, sid): the class of each record."""

    links: DataFrame
    members: DataFrame


def _classes(records: DataFrame, seeds: int = 8) -> tuple[DataFrame, DataFrame]:
    """(side, sid, toks) of the distinct sets, side 3 if on both, and (side, key, sid).

    ``sid`` is a 64-bit hash of the set, so the members of a class need not be joined to it, however many they are.
    A second hash tells whether two sets share one; then another seed is taken.
    """
    held = materialize(records)
    for seed in range(seeds):
        sid = F.xxhash64(F.lit(seed), "toks").alias("sid")
        hashed = held.select("side", sid, "toks", F.xxhash64("toks", F.lit(seed)).alias("h"))
        both = hashed.groupBy("sid").agg(F.first("toks").alias("toks"), F.bit_or("side").alias("side"), F.min("h").alias("h1"), F.max("h").alias("h2"))
        sets = materialize(both)
        if not sets.where("h1 <> h2").count():
            return sets.select("side", "sid", "toks"), materialize(held.select("side", "key", sid).distinct())
    raise RuntimeError("no hash without collisions")


def similar_sets(left: DataFrame, right: DataFrame | None, key: str, values: str, threshold: float) -> SimilarSets:
    """Classes of equal sets and the links between alike ones, by Jaccard similarity of ``threshold`` or more.

    ``values`` is an array column read as a set: nulls and repeats in it do not count. Null and empty
    sets are in no class. A key that comes in several rows counts once per distinct set. Rows with a
    null key are no records. Other columns are ignored. Empty tables give empty results.
    """
    setsim._check("jaccard", threshold)

    def read(df, side):
        toks = F.array_sort(F.array_distinct(F.filter(F.col(f"`{values}`"), lambda x: x.isNotNull())))
        rows = df.select(F.lit(side).alias("side"), F.col(f"`{key}`").alias("key"), toks.alias("toks"))
        return rows.where(F.col("key").isNotNull() & (F.size("toks") > 0))

    records = read(left, 1) if right is None else read(left, 1).unionByName(read(right, 2))
    sets, members = _classes(records)
    ordered = materialize(setsim.rarity_ordered(sets, bitmap=False))
    if right is None:
        one = two = ordered
        pairs = setsim.candidates(ordered, None, "jaccard", threshold)
    else:  # a class with members on both sides is on both
        one, two = ordered.where(F.col("side") != 2), ordered.where(F.col("side") != 1)
        pairs = setsim.candidates(one, two, "jaccard", threshold).where("s1 <> s2")
        pairs = pairs.select(F.least("s1", "s2").alias("s1"), F.greatest("s1", "s2").alias("s2")).distinct()
    links = setsim.verified(pairs, ordered, ordered, "jaccard", threshold)
    return SimilarSets(materialize(links), members)


def record_pairs(found: SimilarSets, two_tables: bool) -> DataFrame:
    """(key1, key2, score): every pair of records, from the links and from within the classes.

    Of one table key1 < key2; of two tables key1 is of the left and key2 of the right one.
    """
    score = found.links
    both = score.select("s1", "s2", "score")
    turned = score.select(F.col("s2").alias("s1"), F.col("s1").alias("s2"), "score")
    # Within a class there are pairs only if it has two members, or one on either side.
    other = F.col("n2") > 0 if two_tables else F.lit(True)
    sizes = found.members.groupBy("sid").agg(F.count("*").alias("n"), F.count_if(F.col("side") == 2).alias("n2"))
    same = sizes.where((F.col("n") > 1) & other).select(F.col("sid").alias("s1"), F.col("sid").alias("s2"), F.lit(1.0).alias("score"))
    left = found.members.where("side = 1").select(F.col("sid").alias("s1"), F.col("key").alias("key1"))
    right = found.members.where(f"side = {2 if two_tables else 1}").select(F.col("sid").alias("s2"), F.col("key").alias("key2"))
    if two_tables:
        pairs = both.unionByName(turned).unionByName(same)
        return pairs.join(left, "s1").join(right, "s2").select("key1", "key2", "score").distinct()
    pairs = both.unionByName(same).join(left, "s1").join(right, "s2")
    ends = pairs.where("key1 <> key2").select(F.least("key1", "key2").alias("key1"), F.greatest("key1", "key2").alias("key2"), "score")
    return ends.groupBy("key1", "key2").agg(F.max("score").alias("score"))


def record_links(found: SimilarSets) -> DataFrame:
    """(side, key, sid, class_key, n_links): one row per record with its class, the smallest key in it, and the number of other classes alike to it."""
    ends = found.links.select(F.explode(F.array("s1", "s2")).alias("sid")).groupBy("sid").agg(F.count("*").alias("n_links"))
    classes = found.members.groupBy("sid").agg(F.min("key").alias("class_key"), F.count("*").alias("n")).join(ends, "sid", "left")
    rows = lookup_skewed(found.members, classes, "sid", "n", found.members.count())
    return rows.select("side", "key", "sid", "class_key", F.coalesce("n_links", F.lit(0)).alias("n_links"))


#: Up to so many names are a literal map, more are joined.
LITERAL_NAMES = 1000


def name_sets(records: DataFrame, key: str, authors: str, names: DataFrame, literal: int = LITERAL_NAMES) -> DataFrame:
    """(key, words) of each record: the runs of two or more letters a-z of a lower-cased column, each short where ``names`` (name, short) has a short form.

    Of several short forms of a name the first in the alphabet counts. ``words`` is null where the column is, and is a set where
    the names are joined.
    """
    short = names.where("name is not null and short is not null").groupBy("name").agg(F.min("short").alias("short"))
    words = F.regexp_extract_all(F.lower(F.col(f"`{authors}`")), F.lit("([a-z]{2,})"), 1)
    rows = records.select(F.col(f"`{key}`").alias(key), words.alias("words"))
    few = short.limit(literal + 1).collect()
    if not few:
        return rows
    if len(few) <= literal:
        known = F.create_map(*[F.lit(x) for r in few for x in (r["name"], r["short"])])
        # The set of names is looked up by hash, the map by reading through it: most words are in neither.
        return rows.select(key, F.transform("words", lambda w: F.when(w.isin([r["name"] for r in few]), known[w]).otherwise(w)).alias("words"))
    numbered = materialize(rows.withColumn("_row", F.monotonically_increasing_id()))
    each = numbered.select("_row", F.explode("words").alias("name"))
    weights = each.groupBy("name").agg(F.count("*").alias("n")).join(short, "name", "left")
    found = lookup_skewed(each, weights, "name", "n", weights.agg(F.sum("n")).first()[0] or 1)
    sets = found.groupBy("_row").agg(F.collect_set(F.coalesce("short", "name")).alias("_set"))
    out = numbered.join(sets, "_row", "left")
    return out.select(key, F.when(F.col("words").isNotNull(), F.coalesce("_set", F.array().cast("array<string>"))).alias("words"))
