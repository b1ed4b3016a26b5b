"""Predicates between a column of the index table A and one of the search table B.

An *indexable* predicate can produce its pairs by itself (:meth:`Predicate.candidates`); a
*streamable* one can be evaluated on given pairs (:meth:`Predicate.holds`). Inputs of a predicate
are features: expressions over one table alone, computed once per record and not once per pair.
"""

from __future__ import annotations

import hashlib
import operator
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import names, similarity
from pairloom.functions.tokenizers import ANALYZERS, Tokenizer
from pairloom.operators import bm25, exact, setsim, topk

#: Comparators with their spelling and complement.
COMPARATORS: dict[Callable, tuple[str, Callable]] = {
    operator.ge: (">=", operator.lt),
    operator.gt: (">", operator.le),
    operator.eq: ("==", operator.ne),
    operator.ne: ("!=", operator.eq),
    operator.le: ("<=", operator.gt),
    operator.lt: ("<", operator.ge),
}
_UPPER, _LOWER = (operator.ge, operator.gt), (operator.le, operator.lt)


class Predicate:
    """Base of all predicates. Subclass to plug in another one."""

    indexable = False
    streamable = True
    is_topk = False
    #: Whether :meth:`holds` runs Python; such predicates are evaluated last.
    python = False
    #: Rough cost of producing candidates, to choose between several.
    cost = 1.0

    def key(self) -> tuple:
        """What makes two predicates the same."""
        raise NotImplementedError

    def features(self) -> tuple[dict[str, Column], dict[str, Column]]:
        """Named expressions over A and over B that :meth:`holds` needs."""
        return {}, {}

    def score(self, a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        """The similarity of one pair; ``a`` and ``b`` give the features by name. Null if unknown."""
        raise NotImplementedError

    def holds(self, a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        """Whether the predicate is true of a pair; never null."""
        raise NotImplementedError

    def index_key(self) -> tuple | None:
        """What an index of A depends on; None if the predicate has none. Predicates with equal keys share one."""
        return None

    def index(self, table_a: DataFrame) -> object:
        """The index of A, built once for any number of search tables."""
        raise NotImplementedError(f"{self} has no index")

    def candidates(self, table_a: DataFrame, table_b: DataFrame) -> DataFrame:
        """(id1, id2) of all pairs for which the predicate is true, once each. Both tables have their id as ``id``.

        A predicate with an index takes it as a third argument, ``prepared``.
        """
        raise NotImplementedError(f"{self} is not indexable")

    def contains(self, other: Predicate) -> bool:
        """Whether every pair of ``other`` is surely one of this predicate too."""
        return self == other

    def invert(self) -> Predicate:
        """The complement."""
        raise NotImplementedError(f"{self} cannot be inverted")

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and self.key() == other.key()

    def __hash__(self) -> int:
        return hash((type(self), self.key()))

    def __repr__(self) -> str:
        return str(self)


class ThresholdPredicate(Predicate):
    """A similarity compared with a value."""

    sim_name = ""

    def __init__(self, index_col: str, search_col: str, op: Callable, val: float):
        if op not in COMPARATORS:
            raise ValueError("op must be one of operator.ge, gt, eq, ne, le, lt")
        if not isinstance(val, float):
            raise TypeError("val must be a float")
        self.index_col, self.search_col, self.op, self.val = index_col, search_col, op, val

    def sim(self) -> tuple:
        """What the similarity depends on, without the comparison."""
        return (self.sim_name, self.index_col, self.search_col)

    def key(self) -> tuple:
        return (*self.sim(), COMPARATORS[self.op][0], self.val)

    def contains(self, other: Predicate) -> bool:
        if type(self) is not type(other) or self.sim() != other.sim():
            return False
        if self.op == other.op and self.val == other.val:
            return True
        for side in (_UPPER, _LOWER):
            if self.op in side and other.op in side:
                strict = self.op is side[1] and other.op is side[0]
                return side[1](other.val, self.val) or (other.val == self.val and not strict)
            if self.op in side and other.op is operator.eq:
                return self.op(other.val, self.val)
        return False

    def features(self) -> tuple[dict[str, Column], dict[str, Column]]:
        return {f"text:{self.index_col}": F.col(f"`{self.index_col}`").cast("string")}, {f"text:{self.search_col}": F.col(f"`{self.search_col}`").cast("string")}

    def holds(self, a, b) -> Column:
        return F.coalesce(self.op(self.score(a, b), F.lit(self.val)), F.lit(False))

    def _again(self, op: Callable) -> Predicate:
        return type(self)(self.index_col, self.search_col, op, self.val)

    def invert(self) -> Predicate:
        return self._again(COMPARATORS[self.op][1])

    def __str__(self) -> str:
        return f"{self.sim_name}({self.index_col}, {self.search_col}) {COMPARATORS[self.op][0]} {self.val}"


class SetSimPredicate(ThresholdPredicate):
    """Similarity of token sets."""

    def __init__(self, index_col: str, search_col: str, tokenizer: Tokenizer, op: Callable, val: float):
        super().__init__(index_col, search_col, op, val)
        self.tokenizer = tokenizer

    @property
    def indexable(self) -> bool:
        return self.sim_name in setsim.SIMS and self.op in _UPPER and 0.0 < self.val <= 1.0

    @property
    def cost(self) -> float:
        return 10.0 * (2.0 - self.val)

    def sim(self) -> tuple:
        return (self.sim_name, str(self.tokenizer), self.index_col, self.search_col)

    def features(self):
        one = self.tokenizer.token_set(F.col(f"`{self.index_col}`").cast("string"))
        two = self.tokenizer.token_set(F.col(f"`{self.search_col}`").cast("string"))
        return {f"{self.tokenizer}:{self.index_col}": one}, {f"{self.tokenizer}:{self.search_col}": two}

    def score(self, a, b) -> Column:
        x, y = a(f"{self.tokenizer}:{self.index_col}"), b(f"{self.tokenizer}:{self.search_col}")
        known = x.isNotNull() & y.isNotNull()
        return F.when(known, setsim.score_of(self.sim_name, F.size(F.array_intersect(x, y)), F.size(x), F.size(y)))

    def index_key(self):
        return ("sets", str(self.tokenizer), self.index_col) if self.indexable else None

    def index(self, table_a) -> setsim.SetIndex:
        (one,) = self.features()[0].values()
        return setsim.set_index(table_a.select(F.col("id").alias("sid"), one.alias("toks")))

    def candidates(self, table_a, table_b, prepared: setsim.SetIndex | None = None) -> DataFrame:
        if not self.indexable:
            return super().candidates(table_a, table_b)
        (two,) = self.features()[1].values()
        right = table_b.select(F.col("id").alias("sid"), two.alias("toks"))
        found = setsim.similarity_join(prepared or self.index(table_a), right, self.sim_name, self.val, strict=self.op is operator.gt)
        return found.select(F.col("s1").alias("id1"), F.col("s2").alias("id2"))

    def _again(self, op):
        return type(self)(self.index_col, self.search_col, self.tokenizer, op, self.val)

    def __str__(self) -> str:
        return f"{self.sim_name}_{self.tokenizer}({self.index_col}, {self.search_col}) {COMPARATORS[self.op][0]} {self.val}"


class JaccardPredicate(SetSimPredicate):
    sim_name = "jaccard"


class CosinePredicate(SetSimPredicate):
    sim_name = "cosine"


class OverlapCoeffPredicate(SetSimPredicate):
    sim_name = "overlap_coeff"


class EditDistancePredicate(ThresholdPredicate):
    sim_name = "edit_distance"

    def score(self, a, b) -> Column:
        return similarity.edit_similarity(a(f"text:{self.index_col}"), b(f"text:{self.search_col}"))

    def holds(self, a, b) -> Column:
        x, y = a(f"text:{self.index_col}"), b(f"text:{self.search_col}")
        if self.op in (operator.ge, operator.lt):
            at_least = similarity.edit_at_least(x, y, self.val)
            return F.coalesce(at_least if self.op is operator.ge else ~at_least, F.lit(False))
        return super().holds(a, b)


class _PairwisePredicate(ThresholdPredicate):
    """A similarity computed in Python, many pairs at once. Pairs whose lengths rule the threshold out are not handed over."""

    python = True

    def _score(self) -> Callable[[Column, Column], Column]:
        raise NotImplementedError

    def score(self, a, b) -> Column:
        return self._score()(a(f"text:{self.index_col}"), b(f"text:{self.search_col}"))

    def holds(self, a, b) -> Column:
        if self.op not in _UPPER:
            return super().holds(a, b)
        x, y = a(f"text:{self.index_col}"), b(f"text:{self.search_col}")
        bound = similarity.length_bound(x, y, self.sim_name, getattr(self, "prefix_weight", 0.0))
        return F.coalesce(self.op(self._score()(F.when(bound >= self.val - 1e-9, x), y), F.lit(self.val)), F.lit(False))


class JaroPredicate(_PairwisePredicate):
    sim_name = "jaro"

    def _score(self):
        return similarity.pairwise(similarity.jaro_batch, similarity.jaro)


class JaroWinklerPredicate(_PairwisePredicate):
    sim_name = "jaro_winkler"

    def __init__(self, index_col, search_col, op, val, prefix_weight: float = 0.1):
        super().__init__(index_col, search_col, op, val)
        self.prefix_weight = prefix_weight

    def sim(self) -> tuple:
        return (*super().sim(), self.prefix_weight)

    def _score(self):
        return similarity.pairwise(partial(similarity.jaro_winkler_batch, prefix_weight=self.prefix_weight), partial(similarity.jaro_winkler, prefix_weight=self.prefix_weight))

    def _again(self, op):
        return type(self)(self.index_col, self.search_col, op, self.val, self.prefix_weight)


class SmithWatermanPredicate(_PairwisePredicate):
    sim_name = "smith_waterman"

    def __init__(self, index_col, search_col, op, val, gap_cost: float = 1.0):
        super().__init__(index_col, search_col, op, val)
        self.gap_cost = gap_cost

    def sim(self) -> tuple:
        return (*super().sim(), self.gap_cost)

    def _score(self):
        return similarity.pairwise(partial(similarity.smith_waterman_batch, gap_cost=self.gap_cost), partial(similarity.smith_waterman, gap_cost=self.gap_cost))

    def _again(self, op):
        return type(self)(self.index_col, self.search_col, op, self.val, self.gap_cost)


class _Equality(Predicate):
    """Equality of a comparable form of the two columns; inverted, their difference where the search value is known."""

    def __init__(self, index_col: str, search_col: str, invert: bool):
        self.index_col, self.search_col, self.inverted = index_col, search_col, invert

    @property
    def indexable(self) -> bool:
        return not self.inverted

    def form(self, column: Column) -> Column:
        raise NotImplementedError

    def sim(self) -> tuple:
        raise NotImplementedError

    def key(self) -> tuple:
        return (*self.sim(), self.inverted)

    def _name(self, column: str) -> str:
        return ":".join(map(str, (*self.sim()[:-2], column)))

    def features(self):
        return {self._name(self.index_col): self.form(F.col(f"`{self.index_col}`"))}, {self._name(self.search_col): self.form(F.col(f"`{self.search_col}`"))}

    def score(self, a, b) -> Column:
        return F.when(a(self._name(self.index_col)).eqNullSafe(b(self._name(self.search_col))), 1.0).otherwise(0.0)

    def holds(self, a, b) -> Column:
        x, y = a(self._name(self.index_col)), b(self._name(self.search_col))
        same = x.eqNullSafe(y)
        return y.isNotNull() & (~same if self.inverted else same)

    def candidates(self, table_a, table_b) -> DataFrame:
        if self.inverted:
            return super().candidates(table_a, table_b)
        return exact.exact_join(table_a, table_b, self.form(F.col(f"`{self.index_col}`")), self.form(F.col(f"`{self.search_col}`")))

    def __str__(self) -> str:
        return f"{self.sim()[0]}({self.index_col}, {self.search_col}) == {not self.inverted}"


class ExactMatchPredicate(_Equality):
    """Equal texts or integers, in lower case if ``lowercase``."""

    def __init__(self, index_col: str, search_col: str, invert: bool, lowercase: bool = False):
        super().__init__(index_col, search_col, invert)
        self.lowercase = lowercase

    def form(self, column: Column) -> Column:
        return exact.comparable(column, self.lowercase)

    def sim(self) -> tuple:
        return ("lower_exact_match" if self.lowercase else "exact_match", self.index_col, self.search_col)

    def invert(self) -> Predicate:
        return ExactMatchPredicate(self.index_col, self.search_col, not self.inverted, self.lowercase)


class NameMatchPredicate(_Equality):
    """Equal person names after normalisation; ``nicknames`` (name: short form) replaces the built-in list."""

    def __init__(self, index_col: str, search_col: str, invert: bool = False, nicknames: dict[str, str] | None = None):
        super().__init__(index_col, search_col, invert)
        self.nicknames = nicknames

    def form(self, column: Column) -> Column:
        return names.normalize_name(column, self.nicknames)

    def sim(self) -> tuple:
        known = "" if self.nicknames is None else hashlib.sha256(repr(sorted(self.nicknames.items())).encode()).hexdigest()[:16]
        return ("name_match", known, self.index_col, self.search_col)

    def invert(self) -> Predicate:
        return NameMatchPredicate(self.index_col, self.search_col, not self.inverted, self.nicknames)


class BM25TopkPredicate(Predicate):
    """The k best index records per search record by BM25. It cannot be evaluated on given pairs."""

    indexable, streamable, is_topk = True, False, True
    cost = 20.0

    def __init__(self, index_col: str, search_col: str, tokenizer: str, k: int):
        if tokenizer not in ANALYZERS:
            raise ValueError(f"unknown tokenizer {tokenizer}, choose from {sorted(ANALYZERS)}")
        self.index_col, self.search_col, self.tokenizer, self.k = index_col, search_col, tokenizer, topk.check_k(k)

    def sim(self) -> tuple:
        return ("bm25", self.tokenizer, self.index_col, self.search_col)

    def key(self) -> tuple:
        return (*self.sim(), self.k)

    def contains(self, other: Predicate) -> bool:
        return type(self) is type(other) and self.sim() == other.sim() and self.k >= other.k

    def index_key(self):
        return ("bm25", self.tokenizer, self.index_col)

    def index(self, table_a) -> bm25.BM25Index:
        return bm25.bm25_index(table_a, self.index_col, ANALYZERS[self.tokenizer])

    def scored(self, table_a: DataFrame, table_b: DataFrame, k: int | None = None, prepared: bm25.BM25Index | None = None) -> DataFrame:
        """(id1, id2, score, rank) of the ``k`` best."""
        return bm25.bm25_top_k(prepared or table_a, table_b, self.index_col, self.search_col, ANALYZERS[self.tokenizer], k or self.k)

    def candidates(self, table_a, table_b, prepared: bm25.BM25Index | None = None) -> DataFrame:
        return self.scored(table_a, table_b, prepared=prepared).select("id1", "id2")

    def holds(self, a, b) -> Column:
        raise RuntimeError("a top-k predicate cannot be used as a filter")

    def __str__(self) -> str:
        return f"BM25_topk({self.tokenizer}, {self.index_col}, {self.search_col}, {self.k}) "


class PairsPredicate(Predicate):
    """The pairs (id1, id2) of another blocker's result."""

    indexable, streamable = True, False
    cost = 0.0

    def __init__(self, name: str, pairs: DataFrame):
        self.name, self.pairs = name, pairs

    def key(self) -> tuple:
        return (self.name, id(self.pairs))  # two tables under one name are two predicates

    def candidates(self, table_a, table_b) -> DataFrame:
        return self.pairs.select("id1", "id2").distinct()

    def __str__(self) -> str:
        return f"pairs({self.name})"
