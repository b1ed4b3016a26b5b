"""The k best pairs per search record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def check_k(k: int) -> int:
    if isinstance(k, bool) or not isinstance(k, int):
        raise TypeError("k must be an int")
    if k < 1:
        raise ValueError("k must be at least 1")
    return k


def top_k(scored: DataFrame, k: int, by: str = "id2", score: str = "score", tie: str = "id1", rank: str = "rank") -> DataFrame:
    """Rows with rank up to ``k`` within ``by``: higher score first, then smaller ``tie``. Spark prunes before the shuffle."""
    window = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= check_k(k))


def merge_top_k(parts: list[DataFrame], k: int) -> DataFrame:
    """The k best of the union of partial results (id1, id2, score)."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return top_k(merged, k).drop("rank")
