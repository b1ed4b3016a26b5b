"""Blocking programs: (any keep rule) except (any drop rule), a rule being true if all its predicates are."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pairloom.plans.predicates import Predicate


@dataclass(frozen=True)
class Rule:
    """A conjunction of predicates."""

    predicates: Sequence[Predicate]

    def __post_init__(self) -> None:
        object.__setattr__(self, "predicates", tuple(self.predicates))
        self.validate()

    def validate(self) -> None:
        if not self.predicates:
            raise ValueError("a rule must contain at least one predicate")

    def __iter__(self) -> Iterator[Predicate]:
        return iter(self.predicates)

    def contains(self, other: Rule) -> bool:
        """Whether every pair of ``other`` is surely one of this rule too."""
        return all(any(p.contains(q) for q in other) for p in self)

    def pretty_str(self) -> str:
        return " AND ".join(map(str, self.predicates))


@dataclass(frozen=True)
class KeepRule(Rule):
    """Pairs to keep. At least one predicate must be able to produce its pairs."""

    def validate(self) -> None:
        super().validate()
        if not all(p.indexable or p.streamable for p in self):
            raise ValueError("keep rule predicates must be indexable or streamable")
        if not any(p.indexable for p in self):
            raise ValueError("keep rule must contain at least one indexable predicate")


@dataclass(frozen=True)
class DropRule(Rule):
    """Pairs to remove. All predicates must be streamable."""

    def validate(self) -> None:
        super().validate()
        if not all(p.streamable for p in self):
            raise ValueError("drop rule predicates must be streamable")


@dataclass(frozen=True)
class Program:
    """Keep rules and drop rules."""

    keep: Sequence[KeepRule]
    drop: Sequence[DropRule] = field(default=())

    def __post_init__(self) -> None:
        object.__setattr__(self, "keep", tuple(self.keep))
        object.__setattr__(self, "drop", tuple(self.drop or ()))
        if not self.keep:
            raise ValueError("a program must contain at least one keep rule")

    def pretty_str(self) -> str:
        either = lambda rules: "(" + " OR ".join(f"({r.pretty_str()})" for r in rules) + ")"
        return f"KEEP {either(self.keep)}" + (f"\nDROP {either(self.drop)}" if self.drop else "")
