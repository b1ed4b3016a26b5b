"""Hand-built plans: immutable graphs of predicates and set operations."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame

from pairloom.operators import setops
from pairloom.plans.executor import Blocker
from pairloom.plans.predicates import Predicate


@dataclass(frozen=True)
class Node:
    """A step that yields pairs."""

    @property
    def inputs(self) -> tuple[Node, ...]:
        return ()

    @property
    def label(self) -> str:
        return type(self).__name__

    def pairs(self, blocker: Blocker) -> DataFrame:
        """(id1, id2) of this node over the tables of ``blocker``."""
        raise NotImplementedError

    def ancestors(self) -> set[Node]:
        """All nodes this one depends on."""
        return {n for n in ordered(self) if n is not self and n != self}


@dataclass(frozen=True)
class PredicateNode(Node):
    """Without a source the predicate produces its pairs, with one it filters them."""

    predicate: Predicate
    source: Node | None = None

    @property
    def inputs(self) -> tuple[Node, ...]:
        return () if self.source is None else (self.source,)

    @property
    def label(self) -> str:
        return str(self.predicate)

    def pairs(self, blocker: Blocker) -> DataFrame:
        a = blocker._side(blocker.table_a, blocker.id_a)
        b = blocker._side(blocker.table_b, blocker.id_b)
        if self.source is None:
            return blocker._produce(self.predicate, a, b)
        if not self.predicate.streamable:
            raise RuntimeError(f"{self.predicate} cannot filter")
        rows, left, right = blocker._with_features(self.source.pairs(blocker).select("id1", "id2"), [self.predicate], a, b)
        return rows.where(self.predicate.holds(left, right)).select("id1", "id2")


@dataclass(frozen=True)
class UnionNode(Node):
    """Pairs of any input."""

    sources: tuple[Node, ...]

    def __post_init__(self) -> None:
        object.__setattr__(self, "sources", tuple(self.sources))
        if len(self.sources) < 2:
            raise ValueError(f"{self.label} needs at least two inputs")

    @property
    def inputs(self) -> tuple[Node, ...]:
        return self.sources

    def pairs(self, blocker: Blocker) -> DataFrame:
        return setops.union(*[n.pairs(blocker) for n in self.sources])


@dataclass(frozen=True)
class IntersectNode(UnionNode):
    """Pairs of every input."""

    def pairs(self, blocker: Blocker) -> DataFrame:
        return setops.intersect(*[n.pairs(blocker) for n in self.sources])


@dataclass(frozen=True)
class MinusNode(Node):
    """Pairs of ``left`` that are not of ``right``."""

    left: Node
    right: Node

    @property
    def inputs(self) -> tuple[Node, ...]:
        return (self.left, self.right)

    def pairs(self, blocker: Blocker) -> DataFrame:
        return setops.minus(self.left.pairs(blocker), self.right.pairs(blocker))


def ordered(sink: Node) -> list[Node]:
    """All nodes of the graph, inputs before the nodes that use them."""
    out: dict[Node, None] = {}

    def visit(node: Node) -> None:
        for source in node.inputs:
            visit(source)
        out.setdefault(node)

    visit(sink)
    return list(out)


def substitute(sink: Node, old: Node, new: Node) -> Node:
    """The graph with ``new`` in the place of every node equal to ``old``. Graphs are immutable; ``sink`` stays as it is."""
    done: dict[Node, Node] = {}

    def visit(node: Node) -> Node:
        if node == old:
            return new
        if node not in done:
            change = {}
            for f in fields(node):
                held = getattr(node, f.name)
                if isinstance(held, Node):
                    change[f.name] = visit(held)
                elif isinstance(held, tuple):
                    change[f.name] = tuple(visit(x) if isinstance(x, Node) else x for x in held)
            done[node] = replace(node, **change)
        return done[node]

    return visit(sink)


def pop(sink: Node, node: PredicateNode) -> Node:
    """The graph without a filter: what read it reads its source."""
    if not isinstance(node, PredicateNode) or node.source is None:
        raise ValueError("only a filter can be taken out")
    return substitute(sink, node, node.source)


def insert_after(sink: Node, node: Node, predicate: Predicate) -> Node:
    """The graph with ``predicate`` as a filter on the pairs of ``node``."""
    return substitute(sink, node, PredicateNode(predicate, node))


def insert_before(sink: Node, node: PredicateNode, predicate: Predicate) -> Node:
    """The graph with ``predicate`` ahead of a predicate node: as a filter on its source, or as the producer of its pairs."""
    if not isinstance(node, PredicateNode):
        raise ValueError("only a predicate has one place before it")
    return substitute(sink, node, PredicateNode(node.predicate, PredicateNode(predicate, node.source)))


def clone(sink: Node) -> Node:
    """An equal graph of nodes of its own."""
    return substitute(sink, Node(), sink)


def equivalent(one: Node, two: Node) -> bool:
    """Whether two graphs give the same pairs by their form: the order of inputs of unions and intersections does not matter, nor that of filters."""

    def form(node: Node) -> tuple:
        if isinstance(node, PredicateNode):
            chain, at = {node.predicate}, node.source
            while isinstance(at, PredicateNode):
                chain.add(at.predicate)
                at = at.source
            return ("predicates", frozenset(chain), form(at) if at is not None else None)
        if isinstance(node, MinusNode):
            return ("minus", form(node.left), form(node.right))
        return (type(node).__name__, frozenset(map(form, node.inputs)))

    return form(one) == form(two)


def execute(sink: Node, blocker: Blocker, projection: list[str] | None = None) -> DataFrame:
    """One row per search record for a hand-built graph."""
    return setops.grouped(sink.pairs(blocker), blocker.table_b, blocker.id_b, projection)


def to_dot(sink: Node) -> str:
    """The graph in the DOT language."""
    nodes = ordered(sink)
    number = {n: i for i, n in enumerate(nodes)}
    quoted = [str(n.label).replace('"', "'") for n in nodes]
    lines = [f'  n{i} [label="{label}"];' for i, label in enumerate(quoted)]
    lines += [f"  n{number[s]} -> n{number[n]};" for n in nodes for s in n.inputs]
    return "\n".join(["digraph {", *lines, "}"])
