"""Looking values up, and joining, by a skewed key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.sources.scratch import is_dry, materialize


def lookup_skewed(rows: DataFrame, lookup: DataFrame, key: str, weight: str, total: Column | int, parts: int = 1000) -> DataFrame:
    """Left join of ``rows`` with ``lookup`` on ``key``, however unevenly the keys are spread over ``rows``.

    ``lookup`` has one row per key, with the number of the key's rows in ``weight``. Keys with more
    than ``total / parts`` rows are fewer than ``parts``, so they are broadcast; their rows then stay
    where they are, each under a key of its own that meets nothing in the shuffled join of the rest.
    All rows of ``rows`` come out, with the columns of ``lookup`` (null where the key is missing).
    """
    values = [c for c in lookup.columns if c != key]
    heavy = lookup.where(F.col(weight) * parts > total)
    light = lookup.where(~(F.col(weight) * parts > total))
    near = heavy.select(F.col(key).alias("_hk"), F.struct(*values).alias("_hv"))
    far = light.select(F.col(key).alias("_lk"), F.lit(0).cast("long").alias("_ls"), F.struct(*values).alias("_lv"))
    out = rows.join(F.broadcast(near), rows[key] == near["_hk"], "left")
    out = out.withColumn("_s", F.when(F.col("_hk").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(*rows.columns).bitwiseOR(F.lit(1))))
    out = out.join(far, (out[key] == far["_lk"]) & (out["_s"] == far["_ls"]), "left")
    value = F.coalesce("_hv", "_lv")
    return out.select(*[out[c] for c in rows.columns], *[value[v].alias(v) for v in values])


#: Keys are counted in so many hash buckets first; only where a bucket is crowded the keys themselves are counted.
BUCKETS = 65_536
#: Pairs that one key may make within one task; a key with more is joined in blocks of about so many.
MOST_PAIRS = 4_000_000
#: Up to so many crowded keys are broadcast.
FEW_KEYS = 100_000


def crowded_keys(one: DataFrame, two: DataFrame, key: str, most: int = MOST_PAIRS) -> DataFrame | None:
    """(key, _cut1, _cut2): keys that make more than ``most`` pairs, with the parts that either side is cut into; None if there are none.

    A key cannot be more crowded than its bucket, so counting buckets misses none. The buckets come to
    the driver: at most :data:`BUCKETS` numbers.
    """
    if is_dry():  # a plan that is shown: nothing is counted
        return None
    ends = one.select(key, F.lit(True).alias("left")).unionByName(two.select(key, F.lit(False).alias("left")))
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    n1, n2 = F.count_if(F.col("left")).alias("n1"), F.count_if(~F.col("left")).alias("n2")
    over = F.col("n1") * F.col("n2").cast("double") > most
    full = [r["bucket"] for r in ends.groupBy(bucket.alias("bucket")).agg(n1, n2).where(over).select("bucket").collect()]
    if not full:
        return None
    marked = F.broadcast(one.sparkSession.createDataFrame([(b,) for b in full], "bucket int"))
    width = max(1.0, most**0.5)
    counts = ends.withColumn("bucket", bucket).join(marked, "bucket").groupBy(key).agg(n1, n2).where(over)
    return materialize(counts.select(key, *[F.ceil(F.col(n) / width).cast("int").alias(p) for n, p in (("n1", "_cut1"), ("n2", "_cut2"))]))


def block_join(one: DataFrame, two: DataFrame, key: str, most: int = MOST_PAIRS) -> DataFrame:
    """Inner join on a long ``key``; all other columns have names of their own, which do not begin with an underscore.

    A crowded key is cut into parts by the hash of its rows, and each part of one side meets each of the
    other in a task of its own, so all pairs come out, however many rows a key has.
    """
    crowded = crowded_keys(one, two, key, most)
    if crowded is None:
        return one.join(two, key)
    few = crowded.count() <= FEW_KEYS

    def placed(rows: DataFrame, own: str, other: str, left: bool) -> DataFrame:
        values = [c for c in rows.columns if c != key]
        if few:
            found = rows.join(F.broadcast(crowded), key, "left")
        else:
            weighed = crowded.withColumn("weight", F.col("_cut1") + F.col("_cut2"))
            found = lookup_skewed(rows, weighed, key, "weight", weighed.agg(F.sum("weight")).first()[0] or 1)
        mine = F.pmod(F.xxhash64(*values), F.col(own)).cast("int")
        place = lambda x: F.xxhash64(key, mine if left else x, x if left else mine)
        blocks = F.transform(F.sequence(F.lit(0), F.col(other) - 1), place)
        keys = F.when(F.col(own).isNotNull(), blocks).otherwise(F.array(key))
        return found.select(*values, F.col(key).alias("_key"), F.explode(keys).alias("_place"))

    x = placed(one, "_cut1", "_cut2", True)
    y = placed(two, "_cut2", "_cut1", False).withColumnsRenamed({"_key": "_key2", "_place": "_place2"})
    # A block's hash may equal another one: the key itself tells.
    met = x.join(y, (x["_place"] == y["_place2"]) & (x["_key"] == y["_key2"]))
    return met.withColumnRenamed("_key", key).drop("_key2", "_place", "_place2")
