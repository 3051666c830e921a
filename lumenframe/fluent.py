"""The fluent front end: an immutable builder over a logical plan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .computed import ComputedFields
from .functions.buckets import describe, parse_bucket
from .operators.columns import col
from .plans.compiler import ROW_ID, StageHook, compile_query
from .plans.spec import (
    Bucket, Clause, Condition, GroupKey, JoinKind, JoinSpec, Metric, MetricSpec, OrderKey, Output, QuerySpec, Rule,
    Separator, Sort, WindowFunction, WindowSpec,
)

EMPTY_GROUPING = "EMPTY_GROUPING"
NULL_KEY = "<NULL>"


def rule(field: str, clause: Clause, value: Any, date_format: str | None = None) -> Rule:
    """A rule for ``all_of`` and ``any_of``."""
    return Rule(field, clause, value, Separator.AND, date_format)


def _placed(known: tuple, new: tuple, at: int | None) -> tuple:
    return (*known, *new) if at is None else (*known[:at], *new, *known[at:])


@dataclass(frozen=True)
class Query:
    """A query over a DataFrame. Every step returns a new query; nothing runs before a sink."""

    spec: QuerySpec
    listeners: tuple = ()

    @staticmethod
    def of(source: DataFrame) -> Query:
        return Query(QuerySpec(source, lenient=True))

    def _set(self, **changes) -> Query:
        return replace(self, spec=self.spec.with_(**changes))

    # -- rows in ---------------------------------------------------------
    def join(self, child: DataFrame, parent_field: str, child_field: str, kind: JoinKind = JoinKind.INNER, null_safe: bool = False) -> Query:
        return self._set(joins=(*self.spec.joins, JoinSpec(kind, child, parent_field, child_field, null_safe)))

    def computed(self, registry: ComputedFields) -> Query:
        return self._set(computed=registry)

    def distinct(self, *fields: str, at: int | None = None) -> Query:
        """Distinct on the fields, keeping whole rows: the values of the last duplicate."""
        return self._set(distinct=tuple(dict.fromkeys(_placed(self.spec.distinct, fields, at))))

    def index(self, field: str) -> Query:
        """A hint that results never depend on; file statistics do the pruning."""
        return self._set(index_hints=(*self.spec.index_hints, field))

    # -- conditions ------------------------------------------------------
    def where(self, field: str, clause: Clause, value: Any, separator: Separator = Separator.AND, date_format: str | None = None) -> Query:
        c = self.spec.where
        return self._set(where=replace(c, flat=(*c.flat, Rule(field, clause, value, separator, date_format))))

    def all_of(self, *rules: Rule) -> Query:
        c = self.spec.where
        return self._set(where=replace(c, all_of=(*c.all_of, rules)))

    def any_of(self, *rules: Rule) -> Query:
        c = self.spec.where
        return self._set(where=replace(c, any_of=(*c.any_of, rules)))

    def having(self, field: str, clause: Clause, value: Any, separator: Separator = Separator.AND, date_format: str | None = None) -> Query:
        c = self.spec.having
        return self._set(having=replace(c, strict=True, flat=(*c.flat, Rule(field, clause, value, separator, date_format))))

    def having_all_of(self, *rules: Rule) -> Query:
        c = self.spec.having
        return self._set(having=replace(c, all_of=(*c.all_of, rules)))

    def having_any_of(self, *rules: Rule) -> Query:
        c = self.spec.having
        return self._set(having=replace(c, any_of=(*c.any_of, rules)))

    def qualify(self, alias: str, clause: Clause, value: Any, separator: Separator = Separator.AND, date_format: str | None = None) -> Query:
        c = self.spec.qualify
        return self._set(qualify=replace(c, strict=True, flat=(*c.flat, Rule(alias, clause, value, separator, date_format))))

    def qualify_all_of(self, *rules: Rule) -> Query:
        c = self.spec.qualify
        return self._set(qualify=replace(c, all_of=(*c.all_of, rules)))

    def qualify_any_of(self, *rules: Rule) -> Query:
        c = self.spec.qualify
        return self._set(qualify=replace(c, any_of=(*c.any_of, rules)))

    # -- shape -----------------------------------------------------------
    def select(self, *fields: str) -> Query:
        """Output fields in order, repeats dropped. Unknown names are ignored with a warning."""
        have = {o.name for o in self.spec.outputs}
        new = [Output(f, f) for f in dict.fromkeys(fields) if f not in have]
        return self._set(outputs=(*self.spec.outputs, *new))

    def select_as(self, field: str, name: str) -> Query:
        return self._set(outputs=(*self.spec.outputs, Output(field, name)))

    def select_expression(self, expression: str, name: str) -> Query:
        return self._set(outputs=(*self.spec.outputs, Output(expression, name, expression=True)))

    def group(self, field: str, date_format: str | None = None, at: int | None = None) -> Query:
        """A group key, at place ``at`` among the keys. With a date format dates group by its text."""
        return self._set(groups=_placed(self.spec.groups, (GroupKey(field, field, date_format),), at))

    def time_bucket(self, field: str, bucket: Bucket | str, alias: str) -> Query:
        """A calendar label of a date field, as an output and a group key."""
        bucket = parse_bucket(bucket) if isinstance(bucket, str) else bucket
        return self._set(groups=(*self.spec.groups, GroupKey(field, alias, None, bucket)))

    def count(self, alias: str) -> Query:
        return self.metric(Metric.COUNT, None, alias)

    def metric(self, metric: Metric, field: str | None, alias: str) -> Query:
        if any(m.alias == alias for m in self.spec.metrics):
            raise ValueError(f"Duplicate metric alias '{alias}'")
        return self._set(metrics=(*self.spec.metrics, MetricSpec(metric, field, alias)))

    def window(self, function: WindowFunction, alias: str, value: str | None = None, partition: tuple[str, ...] = (), orders: tuple[OrderKey | str, ...] = ()) -> Query:
        keys = tuple(OrderKey(o) if isinstance(o, str) else o for o in orders)
        return self._set(windows=(*self.spec.windows, WindowSpec(function, alias, value, tuple(partition), keys)))

    def order(self, *fields: str, at: int | None = None) -> Query:
        """Sort fields, from place ``at`` on; the direction is given when rows are asked for."""
        return self._set(orders=_placed(self.spec.orders, fields, at))

    def limit(self, n: int) -> Query:
        if n < 0:
            raise ValueError("limit must be >= 0")
        return self._set(limit=n)

    def offset(self, n: int) -> Query:
        if n < 0:
            raise ValueError("offset must be >= 0")
        return self._set(offset=n)

    def compat(self, on: bool = True) -> Query:
        """Group and distinct keys by their text form, null like empty."""
        return self._set(compat=on)

    def telemetry(self, listener) -> Query:
        return replace(self, listeners=(*self.listeners, listener))

    # -- sinks -----------------------------------------------------------
    def _hook(self) -> StageHook | None:
        if not self.listeners:
            return None
        from .telemetry import observe

        return observe("fluent", self.listeners)

    def rows(self, sort: Sort | None = None) -> DataFrame:
        """The result. Without ``sort`` the order fields do not sort."""
        return compile_query(self.spec.with_(sort=sort), self._hook())

    def iterate(self, sort: Sort | None = None) -> Iterator[Row]:
        """Rows one partition at a time; a limit without sort stops the scan early."""
        return self.rows(sort).toLocalIterator()

    def objects(self, make, sort: Sort | None = None) -> list:
        """``make(**fields)`` of every row, or of those fields that ``make`` declares."""
        from .sources.sinks import to_objects

        return to_objects(self.rows(sort), make)

    def grouped(self, date_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
        """Filtered rows with ``group_key``: the texts of the group fields, each with a comma."""
        spec = self.spec
        df = compile_query(spec.with_(groups=(), metrics=(), outputs=(), orders=(), sort=None), self._hook(), project=False)
        if not spec.groups:
            key = F.lit(EMPTY_GROUPING)
        else:
            parts = []
            for g in spec.groups:
                text = F.date_format(col(g.field), g.date_format or date_format) if "timestamp" in df.schema[g.field].dataType.simpleString() else col(g.field).cast("string")
                parts += [F.when(text.isNull() | (text == ""), NULL_KEY).otherwise(text), F.lit(",")]
            key = F.concat(*parts)
        return df.drop(ROW_ID).withColumn("group_key", key)

    def groups(self) -> dict[str, list[Row]]:
        """Rows by group key, on the driver: for results that fit there."""
        from .sources.sinks import bounded

        out: dict[str, list[Row]] = {}
        for row in bounded(self.grouped()):
            fields = row.asDict()
            out.setdefault(fields.pop("group_key"), []).append(Row(**fields))
        return out

    def chart(self, spec, sort: Sort | None = None):
        from .reports.chart import to_chart
        from .telemetry import tell

        out = to_chart(self.rows(sort), spec)
        tell(self.listeners, "chart", "fluent")
        return out

    def schema(self):
        from .reports.table import schema_of

        return schema_of(self.spec, self.rows())

    def explain(self, sort: Sort | None = None, counts: bool = False) -> dict[str, Any]:
        """What the query does; with ``counts`` also the rows after every stage (runs them)."""
        s = self.spec
        out: dict[str, Any] = {
            "type": "fluent",
            "where_rules": len(s.where.flat) + sum(map(len, s.where.all_of)) + sum(map(len, s.where.any_of)),
            "having_rules": len(s.having.flat) + sum(map(len, s.having.all_of)) + sum(map(len, s.having.any_of)),
            "qualify_rules": len(s.qualify.flat) + sum(map(len, s.qualify.all_of)) + sum(map(len, s.qualify.any_of)),
            "joins": len(s.joins), "groups": [g.alias for g in s.groups],
            "metrics": [f"{m.metric.name}({m.field or '*'}) as {m.alias}" for m in s.metrics],
            "time_buckets": {g.alias: describe(g.bucket) for g in s.groups if g.bucket},
            "windows": [w.alias for w in s.windows], "orders": list(s.orders), "sort": sort.name if sort else None,
            "limit": s.limit, "offset": s.offset, "distinct_stage": s.distinct_stage if s.distinct else None,
            "computed": s.computed.names() if s.computed else [], "index_hints": list(s.index_hints),
        }
        if counts:
            out["stage_rows"] = stage_counts(s.with_(sort=sort))
        out["plan"] = self.rows(sort)._jdf.queryExecution().toString()
        return out


def stage_counts(spec: QuerySpec) -> dict[str, int]:
    """Rows after every stage, each counted by a job of its own."""
    counts: dict[str, int] = {}

    def hook(stage: str, df: DataFrame) -> DataFrame:
        if stage != "order":
            counts[stage] = df.count()
        return df

    compile_query(spec, hook)
    return counts
