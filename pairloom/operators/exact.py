"""Equality joins of two tables on one column each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def comparable(column: Column, lowercase: bool = False) -> Column:
    """The value as text, integers in decimal, lower-cased if asked."""
    text = column.cast("string")
    return F.lower(text) if lowercase else text


def exact_join(index: DataFrame, search: DataFrame, key1: Column, key2: Column) -> DataFrame:
    """(id1, id2) of the index and search records (id, …) with equal keys; null equals nothing."""
    one = index.select(F.col("id").alias("id1"), key1.alias("k1")).where("k1 is not null")
    two = search.select(F.col("id").alias("id2"), key2.alias("k2")).where("k2 is not null")
    return one.join(two, F.col("k1") == F.col("k2")).select("id1", "id2")
