"""Filling containers of fixed capacity by best-two-fit.

A container is filled greedily with the largest item that fits. If a gap stays, its smallest item
is taken out again when two items not yet packed fill the widened gap better. Sizes are whole
numbers, so the sizes in stock are the bits of one number: the largest fitting size and the best
pair are found by bit operations and not by searching.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that are packed together. More fill better, fewer run on more machines.
SHARD_ITEMS = 50_000


class _Stock:
    """Unpacked items by size."""

    def __init__(self, sizes: list[int], capacity: int):
        self.capacity = capacity
        self.items: dict[int, list[int]] = {}
        self.have = self.twin = self.mirror = 0  # bits: sizes in stock, sizes in stock twice, capacity - size
        for item, size in enumerate(sizes):
            self.put(item, size)

    def put(self, item: int, size: int) -> None:
        held = self.items.setdefault(size, [])
        held.append(item)
        if len(held) == 1:
            self.have |= 1 << size
            self.mirror |= 1 << (self.capacity - size)
        elif len(held) == 2:
            self.twin |= 1 << size

    def take(self, size: int) -> int:
        held = self.items[size]
        item = held.pop()
        if not held:
            self.have ^= 1 << size
            self.mirror ^= 1 << (self.capacity - size)
        elif len(held) == 1:
            self.twin ^= 1 << size
        return item

    def largest(self, room: int) -> int:
        """The largest size in stock of at most ``room``; -1 if none."""
        return (self.have & ((1 << (room + 1)) - 1)).bit_length() - 1

    def best_two(self, room: int, above: int) -> tuple[int, int] | None:
        """Two sizes in stock with the greatest sum of at most ``room`` and more than ``above``."""
        for total in range(room, above, -1):
            fits = self.have & (self.mirror >> (self.capacity - total)) & ((1 << total) - 1)  # x and total - x
            if not total & 1 and fits >> (total // 2) & 1 and not self.twin >> (total // 2) & 1:
                fits ^= 1 << (total // 2)
            if fits:
                first = fits.bit_length() - 1
                return first, total - first
        return None


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of positions in ``sizes``. Every size is between 1 and ``capacity``."""
    stock, out = _Stock(sizes, capacity), []
    while stock.have:
        packed: list[tuple[int, int]] = []
        room = capacity
        while room:
            size = stock.largest(room)
            if size > 0:
                packed.append((size, stock.take(size)))
                room -= size
                continue
            # Nothing fits: two others may do better than the smallest item.
            size, item = min(packed)
            pair = stock.best_two(room + size, size)
            if pair is None:
                break
            packed.remove((size, item))
            packed += [(x, stock.take(x)) for x in pair]
            room += size - sum(pair)
            stock.put(item, size)
        out.append([item for _, item in packed])
    return out


def pack_shard(sizes: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(position, piece, tokens, container) of items of any size; an item above ``capacity`` is cut into full pieces and a rest."""
    rest, origin, container = [], [], 0
    for position, size in enumerate(sizes.tolist()):
        for piece in range(size // capacity if size > capacity else 0):
            yield position, piece, capacity, container
            container += 1
        left = size % capacity if size > capacity else size
        if left:
            rest.append(left)
            origin.append((position, size // capacity if size > capacity else 0))
    for held in best_two_fit(rest, capacity):
        for at in held:
            yield *origin[at], rest[at], container
        container += 1


def with_shards(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with a ``shard`` that depends on what the rows hold and not on how they are stored.

    Equal rows are counted and numbered, so that they do not gather in one shard.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    first = counted.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(10_000).cast("long"))))
    each = first.withColumn("_copy", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + 9_999, F.col("_n") - 1))))
    return each.select(*rows.columns, F.pmod(F.xxhash64(*rows.columns, "_copy"), F.lit(shards)).cast("int").alias("shard"))


def pack(sizes: DataFrame, item: str, size: str, packs: DataFrame, pack_name: str, capacity: str, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(pack, container, item, piece, tokens): the container of each item, or of each of its pieces, for every capacity.

    Only items larger than a capacity are cut. Items are packed in shards of about ``shard_items``
    rows, by a hash of their id, size and number among equal ones, so the containers do not depend on how the table is stored; a container
    belongs to one shard, and each shard leaves at most one container barely filled. An item of size 0,
    null or less takes no room and has a null container. ``packs`` is a fixed list and is broadcast;
    rows of it with a null or non-positive capacity are left out. Empty tables give no rows.
    """
    rows = sizes.select(F.col(f"`{item}`").alias("item"), F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)).alias("size"))
    shards = max(1, math.ceil(sizes.count() / shard_items))
    rows = with_shards(rows, shards)
    kinds = packs.select(F.col(f"`{pack_name}`").alias("pack"), F.col(f"`{capacity}`").cast("long").alias("capacity")).where("capacity > 0")
    n_kinds = kinds.limit(1001).count()
    if n_kinds > 1000:
        raise ValueError("more than 1,000 capacities")
    kind = sizes.schema[item].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "item"], kind="stable", ignore_index=True)
        held = frame[frame["size"] > 0].reset_index(drop=True)
        shard = int(frame["shard"].iat[0])
        placed = np.array(list(pack_shard(held["size"].to_numpy(), int(frame["capacity"].iat[0]))), np.int64).reshape(-1, 4)
        out = pd.DataFrame({"item": held["item"].to_numpy()[placed[:, 0]], "piece": placed[:, 1], "tokens": placed[:, 2], "container": pd.array(placed[:, 3] + (shard << 32), "Int64")})
        none = frame.loc[frame["size"] <= 0, "item"].to_numpy()
        out = pd.concat([out, pd.DataFrame({"item": none, "piece": 0, "tokens": 0, "container": pd.array([None] * len(none), "Int64")})], ignore_index=True)
        return out.assign(pack=frame["pack"].iat[0])[["pack", "container", "item", "piece", "tokens"]]

    spread = rows.crossJoin(F.broadcast(kinds))
    # The rows are small and the work on them is not: the partitions are counted by shards and not by size.
    tasks = min(shards * max(n_kinds, 1), 8 * max(sizes.sparkSession.sparkContext.defaultParallelism, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    spread = spread.repartition(tasks, "shard", "pack", "capacity")
    packed = spread.groupBy("shard", "pack", "capacity").applyInPandas(run, f"pack string, container long, item {kind}, piece int, tokens long")
    return packed.withColumnRenamed("item", item)


def fill_summary(packed: DataFrame, packs: DataFrame, pack_name: str, capacity: str) -> DataFrame:
    """(pack, capacity, containers, tokens, fill): how well the containers of each capacity are filled."""
    held = packed.where("container is not null").groupBy("pack", "container").agg(F.sum("tokens").alias("tokens"))
    sums = held.groupBy("pack").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    kinds = packs.select(F.col(f"`{pack_name}`").alias("pack"), F.col(f"`{capacity}`").alias("capacity"))
    return sums.join(F.broadcast(kinds), "pack").withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity")))
