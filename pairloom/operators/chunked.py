"""Per-key results over skewed keys by exact offset chunking.

Distinct (key, value) pairs are put into one global order by range partitions that may cut a key
anywhere. Rows are counted per partition, the counts are prefix-summed into offsets, every row gets
its exact number, and chunks of equally many consecutive rows are processed whatever their keys
are. A key that crosses chunk boundaries leaves one state per chunk; the states are merged in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.sources.scratch import materialize


def fold_blanks(key):
    """Lower case, tabs and runs of blanks as one blank, no outer blanks."""
    return F.trim(F.regexp_replace(F.lower(key), "[ \t]+", " "))


def exploded_postings(postings: DataFrame, key: str = "key", ids: str = "ids") -> DataFrame:
    """(key, id) rows of a table of posting pieces, keys as read by :func:`fold_blanks`.

    Null and blank keys, null and empty lists and null ids give no row. Other columns are ignored.
    """
    rows = postings.select(fold_blanks(F.col(f"`{key}`")).alias("key"), F.col(f"`{ids}`").alias("ids"))
    rows = rows.where(F.col("key") != "")
    return rows.select("key", F.explode("ids").alias("id")).where(F.col("id").isNotNull())


def numbered_pairs(pairs: DataFrame, chunk_rows: int = 65_536) -> DataFrame:
    """(key, id, row_no, chunk): the distinct pairs in order of (key, id), numbered from 0 without gaps.

    ``chunk`` is ``row_no`` divided by ``chunk_rows``. Exact duplicates are combined before the
    shuffle. The per-partition offsets have one row per partition, so they are broadcast.
    """
    if chunk_rows < 1:
        raise ValueError("chunk_rows must be at least 1")
    distinct = pairs.select("key", "id").distinct()
    placed = distinct.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    # The id made here holds the partition in its upper bits and the row within it in its lower 33.
    placed = materialize(placed.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # One task, over one row per partition.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    row_no = F.col("offset") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.withColumn("part", part).join(F.broadcast(offsets), "part")
    return numbered.select("key", "id", row_no.alias("row_no"), F.floor(row_no / chunk_rows).alias("chunk"))


def chunk_states(numbered: DataFrame) -> DataFrame:
    """(key, chunk, n, first_id, last_id): what each chunk tells of each key in it."""
    return numbered.groupBy("chunk", "key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def merge_states(states: DataFrame) -> DataFrame:
    """(key, n_ids, first_id, last_id, n_chunks): the chunks' boundary states merged per key."""
    return states.groupBy("key").agg(
        F.sum("n").alias("n_ids"),
        F.min_by("first_id", "chunk").alias("first_id"),
        F.max_by("last_id", "chunk").alias("last_id"),
        F.count("*").alias("n_chunks"),
    )


def merged_postings(numbered: DataFrame) -> DataFrame:
    """(key, piece, n, first_id, last_id, ids): the merged ids of each key.

    A key within one chunk has one row with all its ids in order. A heavier key has its ordered ids
    in consecutive pieces of at most one chunk each, so no task and no row ever holds a whole heavy key.
    """
    pieces = numbered.groupBy("chunk", "key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    first = numbered.groupBy("key").agg(F.min("chunk").alias("first_chunk"))
    placed = pieces.join(first, "key")
    return placed.select(
        "key",
        (F.col("chunk") - F.col("first_chunk")).alias("piece"),
        F.size("ids").alias("n"),
        F.element_at("ids", 1).alias("first_id"),
        F.element_at("ids", -1).alias("last_id"),
        "ids",
    )


def key_summary(postings: DataFrame, chunk_rows: int = 65_536) -> DataFrame:
    """Per key of a table of posting pieces: n_ids, first_id, last_id, n_chunks and share of all distinct pairs.

    An empty table gives no rows. Repeated rows and ids count once. The total is one row and is broadcast.
    """
    numbered = numbered_pairs(exploded_postings(postings), chunk_rows)
    total = numbered.agg(F.count("*").alias("total"))
    merged = merge_states(chunk_states(numbered)).crossJoin(F.broadcast(total))
    return merged.withColumn("share", F.col("n_ids") / F.col("total"))
