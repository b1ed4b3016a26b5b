"""Sparse vectors as ``array<struct<ind:int,val:float>>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sparse_vector(dense: Column) -> Column:
    """The nonzero entries of an array of numbers."""
    packed = F.transform(dense, lambda v, i: F.struct(i.cast("int").alias("ind"), v.cast("float").alias("val")))
    return F.filter(packed, lambda e: e["val"] != 0)


def vector_from_arrays(indexes: Column, values: Column) -> Column:
    """A sparse vector from an array of indexes and one of values."""
    return F.transform(F.arrays_zip(indexes.alias("i"), values.alias("v")), lambda e: F.struct(e["i"].cast("int").alias("ind"), e["v"].cast("float").alias("val")))


def sparse_dot(left: Column, right: Column) -> Column:
    """The dot product of two sparse vectors on one row; null if either is null, 0.0 if either is empty."""
    lookup = F.map_from_arrays(F.transform(right, lambda e: e["ind"]), F.transform(right, lambda e: e["val"]))
    terms = F.transform(left, lambda e: e["val"].cast("double") * F.coalesce(lookup[e["ind"]], F.lit(0.0)).cast("double"))
    return F.aggregate(terms, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot_pairs(queries: DataFrame, store: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id1, id2, score): the dot products of candidate pairs (id1, id2).

    ``store`` (id, vec) holds the vectors of id1, ``queries`` (id, vec) those of id2. A pair without a
    vector on either side has a null score.
    """
    pairs = candidates.join(store.select(F.col("id").alias("id1"), F.col("vec").alias("v1")), "id1", "left")
    pairs = pairs.join(queries.select(F.col("id").alias("id2"), F.col("vec").alias("v2")), "id2", "left")
    return pairs.select("id1", "id2", sparse_dot(F.col("v2"), F.col("v1")).alias("score"))
