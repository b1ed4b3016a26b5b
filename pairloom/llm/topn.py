"""The N best items of every group by simultaneous bisection.

Each item has a code that orders it within its group: the score as an order-preserving 64-bit
number, then the identifier inverted, so that of equal scores the smaller identifier is the greater
code. For all groups at once a cutoff is refined: rows at or above the middle of each group's
interval are counted, and the half that cannot hold the cutoff is dropped, until every group holds
exactly N items. Nothing is sorted by score; the rows of groups above N are ordered by identifier once,
to drop repeats.

First every block of input rows is reduced so, where it lies, to the N best of each of its groups;
a group with millions of items leaves N rows per block. Only these rows are shuffled. A group of which
very many blocks hold rows is reduced once more in parts, by the hash of the identifier, before its parts meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.sources.scratch import materialize

#: Rows that are bisected at once.
BLOCK_ROWS = 400_000
#: Rows of one group that a task takes after the first reduction.
GROUP_ROWS = 4_000_000
#: Blocks that an input partition has at most, as a rule.
PARTITION_BLOCKS = 128


def score_code(score: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers in the same order; -0.0 equals 0.0."""
    bits = (score.astype(np.float64) + 0.0).view(np.uint64)
    sign = np.uint64(1) << np.uint64(63)
    return np.where(bits & sign, ~bits, bits | sign)


def id_code(ids: np.ndarray) -> np.ndarray:
    """Identifiers as unsigned numbers in inverse order."""
    return ~(ids.astype(np.int64).view(np.uint64) ^ (np.uint64(1) << np.uint64(63)))


def _refine(group: np.ndarray, code: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bisect every group at once down to its cutoff.

    ``need`` is the number of rows wanted per group, less than the group has. Returns the positions
    of rows surely kept, of rows exactly at a cutoff that is shared by too many, and the rows still
    needed per group.
    """
    groups = len(need)
    low = np.full(groups, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(groups, np.uint64)
    np.minimum.at(low, group, code)
    np.maximum.at(high, group, code)
    need = need.copy()
    at, kept, tied = np.arange(len(group)), [], []
    while len(at):
        g, c = group[at], code[at]
        level = (low == high)[g]
        if level.any():
            tied.append(at[level])
            at, g, c = at[~level], g[~level], c[~level]
            if not len(at):
                break
        gap = high - low
        middle = low + (gap >> np.uint64(1)) + (gap & np.uint64(1))
        above = c >= middle[g]
        count = np.bincount(g[above], minlength=groups)
        up = count >= need  # the cutoff is at the middle or above it
        done = count == need
        low = np.where(up, middle, low)
        high = np.where(up, high, middle - np.uint64(1))
        need = np.where(up & ~done, need, need - count)
        sure = above & (done | ~up)[g]
        kept.append(at[sure])
        at = at[(above & (up & ~done)[g]) | (~above & ~up[g])]
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(kept), join(tied), need


def bisect_top(group: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Mask of the ``n`` best rows of every group; each identifier at most once per group.

    ``group`` numbers the groups from 0. Equal scores go to the smaller identifier, of equal
    identifiers the higher score counts.
    """
    size = np.bincount(group)
    keep = size[group] <= n
    rows = np.flatnonzero(~keep)
    if not len(rows):
        return keep
    order = rows[np.lexsort((ids[rows], group[rows]))]
    same = np.zeros(len(order), bool)
    same[1:] = (group[order][1:] == group[order][:-1]) & (ids[order][1:] == ids[order][:-1])
    if same.any():
        start = np.flatnonzero(~same)
        run = np.cumsum(~same) - 1
        best = np.maximum.reduceat(score[order], start)
        hits = np.flatnonzero(score[order] == best[run])
        rows = order[hits[np.unique(run[hits], return_index=True)[1]]]
    numbers, dense = np.unique(group[rows], return_inverse=True)
    size = np.bincount(dense)
    few = size[dense] <= n
    keep[rows[few]] = True
    rows, dense = rows[~few], dense[~few]
    if not len(rows):
        return keep
    numbers, dense = np.unique(dense, return_inverse=True)
    kept, tied, need = _refine(dense, score_code(score[rows]), np.full(len(numbers), n, np.int64))
    keep[rows[kept]] = True
    if len(tied):
        at = rows[tied]
        open_groups, g = np.unique(dense[tied], return_inverse=True)
        want = need[open_groups]
        enough = np.bincount(g) <= want
        keep[at[enough[g]]] = True
        at, g = at[~enough[g]], g[~enough[g]]
        if len(at):
            left, g = np.unique(g, return_inverse=True)
            kept, _, _ = _refine(g, id_code(ids[at]), want[left])
            keep[at[kept]] = True
    return keep


def _arrays(block: pa.Table) -> tuple[pa.ChunkedArray, np.ndarray, np.ndarray]:
    return block["grp"], block["score"].to_numpy(), block["id"].to_numpy()


def _reduce_blocks(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def reduced():
            block = pa.Table.from_batches(held)
            group, score, ids = _arrays(block)
            codes = group.combine_chunks().dictionary_encode().indices.to_numpy()
            yield from block.filter(pa.array(bisect_top(codes, score, ids, n))).to_batches()

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                yield from reduced()
                held, rows = [], 0
        if rows:
            yield from reduced()

    return run


def _reduce_sorted(n: int):
    """The same over rows that come group by group: what is open at the end of a block goes into the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def reduced(block, last):
            group, score, ids = _arrays(block.combine_chunks())
            flat = group.combine_chunks()
            flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
            fresh = np.ones(len(flat), bool)
            fresh[1:] = pc.not_equal(flat.slice(1), flat.slice(0, len(flat) - 1)).to_numpy(zero_copy_only=False)
            if "salt" in block.column_names:
                salt = block["salt"].to_numpy()
                fresh[1:] |= salt[1:] != salt[:-1]
            codes = np.cumsum(fresh) - 1
            keep = bisect_top(codes, score, ids, n)
            opened = codes == codes[-1] if not last else np.zeros(len(codes), bool)
            return block.filter(pa.array(keep & ~opened)), block.filter(pa.array(keep & opened))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                done, rest = reduced(pa.Table.from_batches(held), False)
                yield from done.to_batches()
                held, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield from reduced(pa.Table.from_batches(held), True)[0].to_batches()

    return run


def _reduced_in_parts(rows: DataFrame, near: DataFrame, n: int) -> DataFrame:
    """``near`` with groups of more than :data:`GROUP_ROWS` input rows reduced in as many parts. There are few such groups; they are broadcast."""
    sizes = rows.groupBy("grp").agg(F.count("*").alias("rows")).where(F.col("rows") > GROUP_ROWS)
    salts = F.broadcast(materialize(sizes.select("grp", F.ceil(F.col("rows") / GROUP_ROWS).cast("int").alias("salts"))))
    salted = near.join(salts, "grp").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    parts = salted.repartition("grp", "salt").groupBy("grp", "salt", "id").agg(F.max("score").alias("score"))
    parts = parts.sortWithinPartitions("grp", "salt").mapInArrow(_reduce_sorted(n), parts.schema)
    return near.join(salts, "grp", "left_anti").unionByName(parts.select(*near.columns))


def top_n_per_group(items: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """(group, item, score): of every group the ``n`` items with the highest score.

    Of equal scores the smaller identifier comes first. An item counts once per group, with its
    highest score, however often it is repeated. Rows with a null group, a null item, or a null or
    NaN score are no items. A group with fewer than ``n`` items keeps them all; an empty table gives
    an empty result. ``item`` is an integer, ``group`` of any type that can be grouped. Other
    columns are ignored, whatever their names are.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    col = lambda name: F.col(f"`{name}`")
    rows = items.select(col(group).alias("grp"), col(item).cast("long").alias("id"), col(score).cast("double").alias("score"))
    rows = rows.where(F.col("grp").isNotNull() & F.col("id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    near = rows.mapInArrow(_reduce_blocks(n), rows.schema)
    if n * rows.rdd.getNumPartitions() * PARTITION_BLOCKS > GROUP_ROWS:
        near = _reduced_in_parts(rows, near, n)
    # Hashed by group alone, the exchange serves the aggregate and the group-wise order too.
    far = near.repartition("grp").groupBy("grp", "id").agg(F.max("score").alias("score"))
    best = far.sortWithinPartitions("grp").mapInArrow(_reduce_sorted(n), far.schema)
    kind = items.schema[score].dataType
    out = [F.col("grp").alias(group), F.col("id").cast(items.schema[item].dataType).alias(item)]
    return best.select(*out, F.col("score").cast(kind if not isinstance(kind, T.StringType) else "double").alias(score))


def unrolled(outputs: DataFrame, group: str = "id2", scores: str = "scores", ids: str = "id1_list") -> DataFrame:
    """(group, id1, score) rows of predicate outputs: one row per position that has both an id and a score."""
    pairs = outputs.select(F.col(group), F.explode(F.arrays_zip(F.col(ids).alias("i"), F.col(scores).alias("s"))).alias("p"))
    return pairs.select(group, F.col("p.i").alias("id1"), F.col("p.s").alias("score"))
