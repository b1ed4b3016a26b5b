"""Partitioning of tables and arrays by hash, and scopes of caching."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class HashPartitioner:
    """Parts of a table by the hash of a column."""

    def __init__(self, column: str, parts: int):
        if parts < 1:
            raise ValueError("parts must be at least 1")
        self.column, self.parts = column, parts

    def _number(self, value: Column) -> Column:
        return F.abs(F.xxhash64(value) % self.parts)

    def _valid(self, part: int) -> None:
        if not 0 <= part < self.parts:
            raise ValueError(f"part {part} is not between 0 and {self.parts - 1}")

    def get_partition(self, df: DataFrame, part: int) -> DataFrame:
        """The rows of one part; all rows if there is only one."""
        self._valid(part)
        return df if self.parts == 1 else df.where(self._number(F.col(self.column)) == part)

    def filter_array(self, ids: Column, values: Column | None, part: int) -> Column:
        """The elements of ``values`` (or of ``ids``) whose id is in the part."""
        self._valid(part)
        if values is None:
            return F.filter(ids, lambda x: self._number(x) == part)
        return F.filter(values, lambda _, i: self._number(F.get(ids, i)) == part)


def partitions_for(df: DataFrame, rows: int = 2000) -> int:
    """Partitions of about ``rows`` rows, at least two per core."""
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / rows))


@contextmanager
def persisted(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """``df`` is cached within the scope."""
    kept = df.persist(level)
    try:
        yield kept
    finally:
        kept.unpersist()


def size_in_bytes(path: str | Path) -> int:
    """Bytes of a local file or of all files below a folder."""
    where = Path(path)
    return where.stat().st_size if where.is_file() else sum(p.stat().st_size for p in where.rglob("*") if p.is_file())


def human_bytes(size: float) -> str:
    """A size with a binary unit."""
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if abs(size) < 1024:
            return f"{size:.1f} {unit}"
        size /= 1024
    return f"{size:.1f} PiB"
