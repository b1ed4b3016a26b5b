"""Selectivities and costs of predicates from bounded samples, and the algebra to combine them."""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.plans.predicates import Predicate

if TYPE_CHECKING:
    from pairloom.plans.executor import Blocker


def union(selectivities: Iterable[float]) -> float:
    """Of independent pair sets: the share in any."""
    return 1.0 - math.prod(1.0 - s for s in selectivities)


def intersect(selectivities: Iterable[float]) -> float:
    """Of independent pair sets: the share in all."""
    return math.prod(selectivities)


def minus(left: float, right: float) -> float:
    """Of independent pair sets: the share in the left but not in the right one."""
    return left * (1.0 - right)


class Estimator:
    """Estimates on a sample of at most ``rows`` records of each table; the estimates choose plans and change no result."""

    def __init__(self, blocker: Blocker, rows: int = 10_000, partners: int = 10, seed: int = 7):
        self.blocker, self.rows, self.partners, self.seed = blocker, rows, partners, seed
        self._known: dict[Predicate, float] = {}
        self._sizes: tuple[int, int] | None = None

    def sizes(self) -> tuple[int, int]:
        """Rows of A and of B."""
        if self._sizes is None:
            self._sizes = (self.blocker.table_a.count(), self.blocker.table_b.count())
        return self._sizes

    def _sample(self, df: DataFrame, id_col: str, count: int) -> DataFrame:
        share = min(1.0, self.rows / max(count, 1))
        return self.blocker._side(df.sample(share, self.seed) if share < 1.0 else df, id_col)

    def selectivity(self, predicate: Predicate) -> float:
        """The share of random pairs for which a streamable predicate is true; k / |A| for a top-k one."""
        if predicate in self._known:
            return self._known[predicate]
        n_a, n_b = self.sizes()
        if not predicate.streamable:
            value = min(1.0, getattr(predicate, "k", 1) / max(n_a, 1))
        else:
            a = self._sample(self.blocker.table_a, self.blocker.id_a, n_a)
            b = self._sample(self.blocker.table_b, self.blocker.id_b, n_b)
            slots = max(1, min(self.rows, n_a) // self.partners)
            one = a.select(F.col("id").alias("id1"), (F.abs(F.xxhash64("id")) % slots).alias("slot"))
            two = b.select(F.col("id").alias("id2"), (F.abs(F.xxhash64("id", F.lit(self.seed))) % slots).alias("slot"))
            met = one.join(two, "slot").select("id1", "id2")
            rows, left, right = self.blocker._with_features(met, [predicate], a, b)
            value = rows.agg(F.avg(predicate.holds(left, right).cast("double"))).first()[0] or 0.0
        self._known[predicate] = float(value)
        return self._known[predicate]

    def cost(self, predicate: Predicate) -> float:
        """A weight for choosing producers: the candidates to be expected plus the cost of finding them."""
        n_a, n_b = self.sizes()
        return predicate.cost * (n_a + n_b) + self.selectivity(predicate) * n_a * n_b
