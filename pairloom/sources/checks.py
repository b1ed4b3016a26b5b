"""Checks of the two tables' ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _check(df: DataFrame, id_col: str, name: str) -> None:
    if id_col not in df.columns:
        raise ValueError(f"{name}: missing id column {id_col}")
    kind = dict(df.dtypes)[id_col]
    ids = F.col(f"`{id_col}`")
    found = df.agg(F.count("*").alias("n"), F.count_if(ids.isNull()).alias("nulls"), F.count_distinct(ids).alias("distinct")).first()
    if not found["n"]:
        raise ValueError(f"{name}: table is empty")
    if kind not in INTEGERS:
        raise ValueError(f"{name}: id column {id_col} must be an integer type, not {kind}")
    if found["nulls"]:
        raise ValueError(f"{name}: id column {id_col} has {found['nulls']} null values")
    if found["distinct"] != found["n"]:
        raise ValueError(f"{name}: id column {id_col} has duplicate values")


def validate_tables(table_a: DataFrame, id_a: str, table_b: DataFrame, id_b: str) -> None:
    """Raise unless both tables have rows and a unique non-null integer id; one aggregation each."""
    for df, id_col, name in ((table_a, id_a, "table_a"), (table_b, id_b, "table_b")):
        if not isinstance(df, DataFrame):
            raise TypeError(f"{name}: not a Spark DataFrame")
        _check(df, id_col, name)
