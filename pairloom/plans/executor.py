"""Lowering of a program to one DataFrame of pairs.

:meth:`Blocker.pairs` is lazy but for the tables that similarity and BM25 joins read several times: indexes of A, which a
blocker keeps and uses again, prepared search records, and candidates of similarity joins. :meth:`Blocker.explain` runs nothing.

Producers give candidate pairs, each tagged with the producers it came from. The features that the
remaining predicates need are joined on once, rules are evaluated in three-valued logic reduced to
true and not true, expressions before Python, and drop rules remove what is true of them.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.tokenizers import ANALYZERS
from pairloom.operators import bm25, setops
from pairloom.plans import estimate, optimizer
from pairloom.plans.predicates import BM25TopkPredicate, Predicate
from pairloom.plans.program import Program, Rule
from pairloom.sources import scratch
from pairloom.sources.checks import validate_tables
from pairloom.sources.partitioning import HashPartitioner


@dataclass(frozen=True)
class PredicateStats:
    """What one predicate did: ``produce`` or ``filter``, the pairs it was true of, and the seconds it took.

    Filters are measured together over the candidates, so they share one time.
    """

    predicate: str
    role: str
    pairs: int
    seconds: float


@dataclass(frozen=True)
class ExecutionStats:
    """What the planning of an execution did; with ``profile`` also what each predicate did."""

    program: str
    producers: tuple[str, ...]
    plan_seconds: float
    predicates: tuple[PredicateStats, ...] = ()


class Blocker:
    """Runs programs over an index table A and a search table B.

    ``cost`` weighs predicates where there is a choice of producers; without it bounded samples are measured
    (:class:`pairloom.plans.estimate.Estimator`). With ``check`` both tables must have unique non-null integer ids and rows.
    """

    def __init__(self, table_a: DataFrame, table_b: DataFrame, id_a: str = "_id", id_b: str = "_id", optimize: bool = True, cost: Callable[[Predicate], float] | None = None, check: bool = False):
        self.table_a, self.table_b, self.id_a, self.id_b, self.optimize, self.cost = table_a, table_b, id_a, id_b, optimize, cost
        self._indexes: dict[tuple, object] = {}
        self._estimator: estimate.Estimator | None = None
        if check:
            validate_tables(table_a, id_a, table_b, id_b)
        for name, df, id_col in (("table_a", table_a, id_a), ("table_b", table_b, id_b)):
            if id_col not in df.columns:
                raise ValueError(f"{name}: missing id column {id_col}")

    def estimator(self) -> estimate.Estimator:
        """Estimates over the two tables; what was measured is kept."""
        self._estimator = self._estimator or estimate.Estimator(self)
        return self._estimator

    def over(self, table_b: DataFrame) -> Blocker:
        """The same for another search table; indexes of A are shared."""
        out = Blocker(self.table_a, table_b, self.id_a, self.id_b, self.optimize, self.cost)
        out._indexes = self._indexes
        return out

    def _produce(self, p: Predicate, a: DataFrame, b: DataFrame, scored: bool = False) -> DataFrame:
        find = p.scored if scored else p.candidates
        key = p.index_key()
        if key is None:
            return find(a, b)
        if scratch.is_dry():
            return find(a, b)
        return find(a, b, prepared=self._index(p, a))

    def _index(self, p: Predicate, a: DataFrame) -> object:
        if scratch.is_dry():
            return p.index(a)
        key = p.index_key()
        if key not in self._indexes:
            with scratch.outliving():
                self._indexes[key] = p.index(a)
        return self._indexes[key]

    def _side(self, df: DataFrame, id_col: str) -> DataFrame:
        rest = [F.col(f"`{c}`") for c in df.columns if c not in (id_col, "id")]
        extra = [F.col(f"`{id_col}`")] if id_col != "id" else []
        return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), *extra, *rest)

    def plan(self, program: Program) -> tuple[Program, list[Predicate]]:
        """The program that is run, and the predicates that produce candidates."""
        program = optimizer.simplify(program) if self.optimize else program
        if self.optimize:
            return program, optimizer.choose_producers(program, self.cost or self.estimator().cost)
        firsts = [next(p for p in rule if p.indexable) for rule in program.keep]
        forced = [p for rule in program.keep for p in rule if not p.streamable]
        return program, list(dict.fromkeys(firsts + forced))

    def pairs(self, program: Program) -> DataFrame:
        """(id1, id2) of the pairs that some keep rule is true of and no drop rule."""
        program, producers = self.plan(program)
        a, b = self._side(self.table_a, self.id_a), self._side(self.table_b, self.id_b)
        return self._run(program, producers, a, b)

    def _run(self, program: Program, producers: list[Predicate], a: DataFrame, b: DataFrame) -> DataFrame:
        flags = {p: F.col(f"_p{i}") for i, p in enumerate(producers)}
        open_rules = [r for r in program.keep if any(self._open(p, flags) for p in r)]
        needed = list(dict.fromkeys(p for r in (*open_rules, *program.drop) for p in r if self._open(p, flags)))
        searched = self._searched(program, producers, needed, a, b)
        if searched is not None:  # written when decided: the search is run once
            return scratch.materialize(self._decided(program, flags, needed, *searched))
        found = self._candidates(program, producers, a, b)
        if not needed and len(producers) == 1 and not any(p.is_topk for p in producers):
            return found.select("id1", "id2")
        return self._decided(program, flags, needed, *self._with_features(found, needed, a, b))

    def _decided(self, program: Program, flags: dict[Predicate, Column], needed: list[Predicate], rows: DataFrame, left: Callable, right: Callable) -> DataFrame:
        native = [p for p in needed if not p.python]

        def true_of(p: Predicate) -> Column:
            flag = self._flag(p, flags)
            return flag if flag is not None else p.holds(left, right)

        both = lambda rule, keep: reduce(Column.__and__, [true_of(p) for p in rule if keep(p)], F.lit(True))
        cheap = lambda p: p in native or not self._open(p, flags)
        rows = rows.where(reduce(Column.__or__, [both(r, cheap) for r in program.keep]))
        cheap_drops = [r for r in program.drop if all(cheap(p) for p in r)]
        if cheap_drops:
            rows = rows.where(~reduce(Column.__or__, [both(r, cheap) for r in cheap_drops]))
        slow = [p for p in needed if p.python]
        if slow:
            for i, p in enumerate(slow):  # each once, over what is left
                rows = rows.withColumn(f"_s{i}", p.holds(left, right))
            known = {p: F.col(f"_s{i}") for i, p in enumerate(slow)}
            full = lambda rule: reduce(Column.__and__, [known[p] if p in known else true_of(p) for p in rule], F.lit(True))
            rows = rows.where(reduce(Column.__or__, [full(r) for r in program.keep]))
            late = [r for r in program.drop if r not in cheap_drops]
            if late:
                rows = rows.where(~reduce(Column.__or__, [full(r) for r in late]))
        return rows.select("id1", "id2")

    @staticmethod
    def _flag(p: Predicate, flags: dict[Predicate, Column]) -> Column | None:
        """The tag that tells whether ``p`` is true, if a producer tells it."""
        if p in flags and not p.is_topk:
            return flags[p] == 1
        if p.is_topk:
            for producer, flag in flags.items():
                if producer.contains(p):
                    return (flag > 0) & (flag <= p.k)
        return None

    def _open(self, p: Predicate, flags: dict[Predicate, Column]) -> bool:
        return self._flag(p, flags) is None

    @staticmethod
    def _partners(p: Predicate, program: Program) -> list[Predicate] | None:
        """For a top-k producer: equalities of which every rule it serves has one, so that only their search records need it; else None."""
        out = []
        for rule in program.keep:
            if not any(p.contains(q) for q in rule):
                continue
            narrow = [q for q in rule if q.indexable and q.streamable and q.cost <= 1.0]
            if not narrow:
                return None
            out.append(narrow[0])
        return list(dict.fromkeys(out)) or None

    @staticmethod
    def _asked(partners: list[Predicate] | None, a: DataFrame, b: DataFrame) -> DataFrame:
        """The search records that one of ``partners`` has a pair of; all if there are none."""
        if not partners:
            return b
        # The k best of a record depend on that record and A alone.
        held = reduce(DataFrame.unionByName, [q.candidates(a, b).select("id2") for q in partners]).distinct()
        return b.join(held, b["id"] == held["id2"], "left_semi")

    def _candidates(self, program: Program, producers: list[Predicate], a: DataFrame, b: DataFrame) -> DataFrame:
        """(id1, id2, _p0, …): a tag is 0 for pairs not of that producer, the rank for a top-k one, else 1."""
        parts = []
        for i, p in enumerate(producers):
            if isinstance(p, BM25TopkPredicate):
                asked = self._asked(self._partners(p, program), a, b)
                rows = self._produce(p, a, asked, True).select("id1", "id2", F.col("rank").cast("int").alias("tag"))
            else:
                rows = self._produce(p, a, b).select("id1", "id2", F.lit(1).alias("tag"))
            tags = [(F.col("tag") if i == j else F.lit(0)).alias(f"_p{j}") for j in range(len(producers))]
            parts.append(rows.select("id1", "id2", *tags))
        if len(parts) == 1:
            return parts[0]
        merged = reduce(DataFrame.unionByName, parts)
        return merged.groupBy("id1", "id2").agg(*[F.max(f"_p{j}").alias(f"_p{j}") for j in range(len(producers))])

    def _searched(self, program: Program, producers: list[Predicate], needed: list[Predicate], a: DataFrame, b: DataFrame):
        """As :meth:`_with_features`, if all candidates come from BM25: found, merged and joined with their features within a task; else None."""
        if not all(isinstance(p, BM25TopkPredicate) for p in producers) or (len(producers) == 1 and not needed):
            return None
        narrow = {frozenset(self._partners(p, program) or ()) for p in producers}
        at, exprs = self._features(needed)
        kinds = [f.dataType for side, df in zip(exprs, (a, b), strict=True) for f in df.select(*side).schema]
        plain = lambda kind: isinstance(kind, (T.StringType, T.BooleanType, T.IntegralType, T.FractionalType, T.DateType))
        if len(narrow) > 1 or not all(plain(kind.elementType if isinstance(kind, T.ArrayType) else kind) for kind in kinds):
            return None
        asks = [(self._index(p, a), p.search_col, ANALYZERS[p.tokenizer], p.k) for p in producers]
        rows = bm25.bm25_pairs(asks, a, self._asked(self._partners(producers[0], program), a, b), *exprs)
        return rows, lambda name: F.col(at[0][name]), lambda name: F.col(at[1][name])

    @staticmethod
    def _features(needed: list[Predicate]) -> tuple[tuple[dict, dict], tuple[list, list]]:
        """The columns of the features of both sides by name, and the expressions of these columns."""
        at: tuple[dict, dict] = ({}, {})
        exprs: tuple[list, list] = ([], [])
        for p in needed:
            for side, features in enumerate(p.features()):
                for name, expr in features.items():
                    if name not in at[side]:
                        at[side][name] = f"_f{side}_{len(at[side])}"
                        exprs[side].append(expr.alias(at[side][name]))
        return at, exprs

    @classmethod
    def _with_features(cls, found: DataFrame, needed: list[Predicate], a: DataFrame, b: DataFrame):
        """``found`` with the features of both sides, and functions from a feature's name to its column."""
        at, exprs = cls._features(needed)
        if exprs[0]:
            found = found.join(a.select(F.col("id").alias("id1"), *exprs[0]), "id1")
        if exprs[1]:
            found = found.join(b.select(F.col("id").alias("id2"), *exprs[1]), "id2")
        return found, lambda name: F.col(at[0][name]), lambda name: F.col(at[1][name])

    def pairs_in_parts(self, program: Program, parts: int) -> DataFrame:
        """:meth:`pairs` for one hash part of B after the other, to bound candidates and scratch tables at a time.

        A record's pairs depend on that record and A alone, top-k predicates included, so the parts are
        independent. Indexes of A are built once. Each part's pairs are written and its scratch tables deleted.
        """
        split, out = HashPartitioner(self.id_b, parts), []
        for part in range(parts):
            with scratch.scope():
                found = self.over(split.get_partition(self.table_b, part)).pairs(program)
                with scratch.outliving():
                    out.append(scratch.materialize(found))
        return reduce(DataFrame.unionByName, out)

    def parts_for(self, program: Program, most_pairs: int) -> int:
        """Parts of B with about ``most_pairs`` candidates each, by estimate."""
        guess = self.estimator()
        n_a, n_b = guess.sizes()
        _, producers = self.plan(program)
        return max(1, math.ceil(sum(guess.selectivity(p) for p in producers) * n_a * n_b / most_pairs))

    def profile(self, program: Program) -> tuple[PredicateStats, ...]:
        """Pairs and seconds of each predicate of the program as it is run. Every producer is run once and written."""
        program, producers = self.plan(program)
        a, b = self._side(self.table_a, self.id_a), self._side(self.table_b, self.id_b)
        out = []
        with scratch.scope():
            parts = []
            for p in producers:
                began = time.perf_counter()
                parts.append(scratch.materialize(self._produce(p, a, b).select("id1", "id2")))
                out.append(PredicateStats(str(p), "produce", parts[-1].count(), time.perf_counter() - began))
            filters = list(dict.fromkeys(p for r in (*program.keep, *program.drop) for p in r if p not in producers and p.streamable))
            if filters:
                began = time.perf_counter()
                found = setops.union(*parts) if len(parts) > 1 else parts[0]
                rows, left, right = self._with_features(found, filters, a, b)
                for i, p in enumerate(filters):
                    rows = rows.withColumn(f"_h{i}", p.holds(left, right))
                counts = rows.agg(*[F.count_if(F.col(f"_h{i}")) for i in range(len(filters))]).first()
                took = time.perf_counter() - began
                out += [PredicateStats(str(p), "filter", n, took) for p, n in zip(filters, counts, strict=True)]
        return tuple(out)

    def execute(self, program: Program, projection: list[str] | None = None, parts: int = 1, profile: bool = False) -> tuple[DataFrame, ExecutionStats]:
        """One row per record of B with its projected columns, ``id2`` and its sorted ``id1_list``; and statistics.

        With more than one part B is run part by part (:meth:`pairs_in_parts`).
        """
        began = time.perf_counter()
        run, producers = self.plan(program)
        found = self.pairs(program) if parts == 1 else self.pairs_in_parts(program, parts)
        out = setops.grouped(found, self.table_b, self.id_b, projection)
        took = time.perf_counter() - began
        return out, ExecutionStats(run.pretty_str(), tuple(map(str, producers)), took, self.profile(program) if profile else ())

    def explain(self, program: Program) -> str:
        """The program as run, its producers, and Spark's plan. Nothing is run but the samples of a choice of producers."""
        run, producers = self.plan(program)
        a, b = self._side(self.table_a, self.id_a), self._side(self.table_b, self.id_b)
        with scratch.dry():
            plan = self._run(run, producers, a, b)._jdf.queryExecution().toString()
        return f"{run.pretty_str()}\nPRODUCED BY {', '.join(map(str, producers))}\n{plan}"

    def rule_pairs(self, rule: Rule) -> DataFrame:
        """The pairs of one keep rule alone."""
        return self.pairs(Program([rule]))
