"""The logical plan: immutable values that both front ends build."""

from __future__ import annotations

import enum
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame


class Clause(enum.Enum):
    EQUAL = "="
    NOT_EQUAL = "!="
    BIGGER = ">"
    BIGGER_EQUAL = ">="
    SMALLER = "<"
    SMALLER_EQUAL = "<="
    NOT_SMALLER = "not <"
    NOT_BIGGER = "not >"
    CONTAINS = "contains"
    MATCHES = "matches"
    IN = "in"


class Separator(enum.Enum):
    AND = "and"
    OR = "or"


class Sort(enum.Enum):
    ASC = "asc"
    DESC = "desc"


class JoinKind(enum.Enum):
    INNER = "inner"
    LEFT = "left"
    RIGHT = "right"


class Metric(enum.Enum):
    COUNT = "count"
    SUM = "sum"
    AVG = "avg"
    MIN = "min"
    MAX = "max"


class WindowFunction(enum.Enum):
    ROW_NUMBER = "row_number"
    RANK = "rank"
    DENSE_RANK = "dense_rank"
    COUNT = "count"
    SUM = "sum"
    AVG = "avg"
    MIN = "min"
    MAX = "max"

    @property
    def ranking(self) -> bool:
        return self in (WindowFunction.ROW_NUMBER, WindowFunction.RANK, WindowFunction.DENSE_RANK)


@dataclass(frozen=True)
class Rule:
    """``field`` (a column or an arithmetic expression) compared with ``value``."""

    field: str
    clause: Clause
    value: Any
    separator: Separator = Separator.AND
    date_format: str | None = None


@dataclass(frozen=True)
class Both:
    """A boolean node over rules or nodes."""

    operator: Separator
    left: Any
    right: Any


@dataclass(frozen=True)
class InQuery:
    """The value of an IN rule: the single output column of another plan."""

    frame: DataFrame


@dataclass(frozen=True)
class Condition:
    """Flat rules, rule groups, or a tree; groups override flat rules when present."""

    flat: tuple[Rule, ...] = ()
    all_of: tuple[tuple[Rule, ...], ...] = ()
    any_of: tuple[tuple[Rule, ...], ...] = ()
    tree: Any = None
    strict: bool = False  # unknown fields raise instead of being ignored

    @property
    def empty(self) -> bool:
        return not (self.flat or self.all_of or self.any_of or self.tree)

    @property
    def grouped(self) -> bool:
        return bool(self.all_of or self.any_of) or isinstance(self.tree, Both)


@dataclass(frozen=True)
class JoinSpec:
    kind: JoinKind
    child: DataFrame
    parent_field: str
    child_field: str
    null_safe: bool = False
    name: str | None = None


@dataclass(frozen=True)
class MetricSpec:
    metric: Metric
    field: str | None
    alias: str
    hidden: bool = False


@dataclass(frozen=True)
class Bucket:
    """A calendar bucket label; see functions.buckets."""

    unit: str
    zone: str = "UTC"
    week_start: str = "MONDAY"


@dataclass(frozen=True)
class GroupKey:
    field: str
    alias: str
    date_format: str | None = None
    bucket: Bucket | None = None


@dataclass(frozen=True)
class OrderKey:
    field: str
    sort: Sort = Sort.ASC


@dataclass(frozen=True)
class WindowSpec:
    function: WindowFunction
    alias: str
    value: str | None = None
    partition: tuple[str, ...] = ()
    orders: tuple[OrderKey, ...] = ()


@dataclass(frozen=True)
class Output:
    """One output column: a field, an expression or a bucket under a name."""

    source: str
    name: str
    expression: bool = False
    bucket: Bucket | None = None


@dataclass(frozen=True)
class QuerySpec:
    source: DataFrame
    joins: tuple[JoinSpec, ...] = ()
    computed: Any = None
    distinct: tuple[str, ...] = ()
    where: Condition = field(default_factory=Condition)
    groups: tuple[GroupKey, ...] = ()
    metrics: tuple[MetricSpec, ...] = ()
    having: Condition = field(default_factory=Condition)
    windows: tuple[WindowSpec, ...] = ()
    qualify: Condition = field(default_factory=Condition)
    orders: tuple[str, ...] = ()
    sort: Sort | None = None
    limit: int | None = None
    offset: int | None = None
    outputs: tuple[Output, ...] = ()
    index_hints: tuple[str, ...] = ()
    compat: bool = False
    strict_numbers: bool = False
    lenient: bool = False  # unknown group, order and output fields are ignored with a warning

    def with_(self, **changes) -> QuerySpec:
        return replace(self, **changes)

    @property
    def distinct_stage(self) -> str:
        """Distinct runs after the filter where only flat rules and plain columns are used."""
        plain = not (self.joins or self.metrics or self.computed or self.windows or self.groups or self.where.grouped)
        return "after where" if plain else "before where"
