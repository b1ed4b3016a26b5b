"""Set algebra on pairs (id1, id2) and on arrays of ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIR = ["id1", "id2"]


def union(*pairs: DataFrame) -> DataFrame:
    """Pairs in any input, once each. At least two inputs."""
    _least_two(pairs)
    return reduce(DataFrame.unionByName, [p.select(*PAIR) for p in pairs]).distinct()


def intersect(*pairs: DataFrame) -> DataFrame:
    """Pairs in every input, once each. At least two inputs."""
    _least_two(pairs)
    return reduce(DataFrame.intersect, [p.select(*PAIR) for p in pairs])


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of ``left`` that are not in ``right``, once each."""
    return left.select(*PAIR).distinct().join(right.select(*PAIR), PAIR, "left_anti")


def _least_two(pairs: tuple) -> None:
    if len(pairs) < 2:
        raise ValueError("at least two inputs are needed")


def union_lists(*lists: Column) -> Column:
    """The sorted distinct ids in any array."""
    return F.array_sort(reduce(F.array_union, lists))


def intersect_lists(*lists: Column) -> Column:
    """The sorted distinct ids in every array."""
    return F.array_sort(reduce(F.array_intersect, lists))


def minus_lists(left: Column, right: Column) -> Column:
    """The sorted distinct ids of ``left`` that are not in ``right``."""
    return F.array_sort(F.array_except(left, right))


def concat_lists(*lists: Column) -> Column:
    """The arrays one after another."""
    return F.concat(*lists)


def grouped(pairs: DataFrame, searched: DataFrame, id_col: str, projection: list[str] | None = None) -> DataFrame:
    """One row per search record: the projected columns, the id as ``id2``, and its sorted ``id1_list``, empty if none."""
    wanted = list(projection or [id_col])
    missing = [c for c in wanted if c not in searched.columns]
    if missing:
        raise ValueError(f"projection columns not in the search table: {missing}")
    if id_col not in wanted:
        wanted.append(id_col)
    lists = pairs.groupBy("id2").agg(F.array_sort(F.collect_set("id1")).alias("id1_list"))
    rows = searched.select(*[F.col(f"`{c}`").alias("id2") if c == id_col else F.col(f"`{c}`") for c in wanted])
    names = ["id2" if c == id_col else c for c in wanted]
    out = rows.join(lists, "id2", "left")
    return out.select(*names, F.coalesce("id1_list", F.array().cast("array<bigint>")).alias("id1_list"))
