"""Parsed SQL-like queries: parameters, paging, binding, lint and explain."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, Row

from ..computed import ComputedFields
from ..errors import QueryError
from ..functions.buckets import describe
from ..plans.compiler import compile_query
from ..plans.spec import QuerySpec, Sort
from .bind import Binder, Scope, check_param_types, check_shape, direction, fill_params, params_of
from .cursor import Cursor, continue_from
from .syntax import Ast, Param, SubQuery, parse_text, rules_of

# Lint codes and what they say.
LINT = {
    "LINT-001": "the result follows the source's columns; name the fields you need",
    "LINT-002": "a page of unsorted rows differs from run to run; add ORDER BY",
    "LINT-003": "a text value is written into the query; a parameter would keep it reusable",
}


class ParseCache:
    """Parsed queries by text: least recently used out first, entries may expire.

    ``weight`` bounds the characters of all texts held; a longer text is not kept."""

    def __init__(self, entries: int = 256, ttl_seconds: float | None = None, enabled: bool = True, weight: int = 1 << 20) -> None:
        self.entries, self.ttl, self.enabled, self.weight = entries, ttl_seconds, enabled, weight
        self.held_weight = 0
        self.hits = self.misses = self.evictions = 0
        self._held: OrderedDict[str, tuple[float, Ast]] = OrderedDict()
        self._lock = threading.Lock()

    def parse(self, text: str) -> Ast:
        if not self.enabled or not isinstance(text, str):
            return parse_text(text)
        now = time.monotonic()
        with self._lock:
            found = self._held.get(text)
            if found and (self.ttl is None or now - found[0] < self.ttl):
                self.hits += 1
                self._held.move_to_end(text)
                return found[1]
            self.misses += 1
        ast = parse_text(text)
        if len(text) > self.weight:
            return ast
        with self._lock:
            self.held_weight += 0 if text in self._held else len(text)
            self._held[text] = (now, ast)
            self._held.move_to_end(text)
            while len(self._held) > self.entries or self.held_weight > self.weight:
                self.held_weight -= len(self._held.popitem(last=False)[0])
                self.evictions += 1
        return ast

    def clear(self) -> None:
        with self._lock:
            self._held.clear()
            self.held_weight = 0

    def stats(self) -> dict[str, int]:
        return {"size": len(self._held), "hits": self.hits, "misses": self.misses, "evictions": self.evictions}


DEFAULT_CACHE = ParseCache()


def parse(text: str, cache: ParseCache = DEFAULT_CACHE) -> SqlQuery:
    """The query of a text; syntax errors raise with their place."""
    return SqlQuery(text, cache.parse(text))


@dataclass(frozen=True)
class SqlQuery:
    """A parsed query. Every step returns a new one; nothing runs before a sink."""

    text: str
    ast: Ast
    registry: ComputedFields | None = None
    listeners: tuple = ()
    strict: bool = False
    given: dict[str, Any] = field(default_factory=dict)
    suppressed: frozenset[str] = frozenset()

    def params(self, values: dict[str, Any] | None = None, **more: Any) -> SqlQuery:
        """All parameters at once: missing and unknown names raise."""
        values = {**(values or {}), **more}
        if any(not isinstance(k, str) or not k.strip() for k in values):
            raise QueryError("param_name", "a parameter has no name")
        used = params_of(self.ast)
        if missing := sorted(set(used) - set(values)):
            raise QueryError("param_missing", f"no value given for parameter(s) {missing}")
        if unknown := sorted(set(values) - set(used)):
            raise QueryError("param_unknown", f"the query has no parameter(s) {unknown}")
        return replace(self, given=values) if self.strict else replace(self, ast=fill_params(self.ast, values), given=values)

    def strict_types(self) -> SqlQuery:
        """Parameters must have their field's type when the query meets its source."""
        return replace(self, strict=True)

    def computed(self, registry: ComputedFields) -> SqlQuery:
        return replace(self, registry=registry)

    def telemetry(self, listener) -> SqlQuery:
        return replace(self, listeners=(*self.listeners, listener))

    def keyset_after(self, cursor: Cursor | str) -> SqlQuery:
        return replace(self, ast=continue_from(self.ast, Cursor.from_token(cursor) if isinstance(cursor, str) else cursor))

    def keyset_before(self, cursor: Cursor | str) -> SqlQuery:
        return replace(self, ast=continue_from(self.ast, Cursor.from_token(cursor) if isinstance(cursor, str) else cursor, before=True))

    def plan(self, source: DataFrame, joins: dict[str, DataFrame] | None = None) -> QuerySpec:
        from ..sources.bindings import DatasetBundle, JoinBindings

        if isinstance(source, DatasetBundle):
            source, joins = source.primary, source.joins
        if isinstance(joins, JoinBindings):
            joins = joins.frames
        ast = self.ast
        if self.strict and self.given and params_of(ast):
            check_param_types(ast, self.given, Scope(ast, source, joins or {}, self.registry))
            ast = fill_params(ast, self.given)
        if left := sorted(params_of(ast)):
            raise QueryError("param_unresolved", f"parameter(s) {left} have no value yet; give them with params()")
        return Binder(ast, source, joins or {}, self.registry).plan()

    def _hook(self):
        if not self.listeners:
            return None
        from ..telemetry import observe

        return observe("sql-like", self.listeners, self.text)

    def rows(self, source: DataFrame, joins: dict[str, DataFrame] | None = None) -> DataFrame:
        return compile_query(self.plan(source, joins), self._hook())

    def iterate(self, source: DataFrame, joins: dict[str, DataFrame] | None = None) -> Iterator[Row]:
        return self.rows(source, joins).toLocalIterator()

    def objects(self, source: DataFrame, make, joins: dict[str, DataFrame] | None = None) -> list:
        from ..sources.sinks import to_objects

        return to_objects(self.rows(source, joins), make)

    def chart(self, source: DataFrame, spec, joins: dict[str, DataFrame] | None = None):
        from ..reports.chart import to_chart
        from ..telemetry import tell

        out = to_chart(self.rows(source, joins), spec)
        tell(self.listeners, "chart", "sql-like", self.text)
        return out

    def bind(self, source: DataFrame, joins: dict[str, DataFrame] | None = None) -> BoundQuery:
        """The query with its sources, checked now."""
        return BoundQuery(self, source, joins or {}, self.plan(source, joins))

    def schema(self, source: DataFrame, joins: dict[str, DataFrame] | None = None):
        from ..reports.table import schema_of

        spec = self.plan(source, joins)
        return schema_of(spec, compile_query(spec))

    def sort_direction(self) -> Sort | None:
        return direction(self.ast)

    def suppress(self, *codes: str) -> SqlQuery:
        return replace(self, suppressed=self.suppressed | set(codes))

    def lint(self) -> list[dict[str, str]]:
        """Warnings about the text, without the suppressed ones."""
        ast = self.ast

        def inline(a: Ast) -> bool:
            rules = [*rules_of(a.where), *rules_of(a.having)]
            return any(isinstance(r.value, str) or (isinstance(r.value, SubQuery) and inline(r.value.query)) for r in rules)

        found = {
            "LINT-001": ast.wildcard,
            "LINT-002": (ast.limit is not None or ast.offset is not None) and not ast.orders,
            "LINT-003": inline(parse_text(self.text)),
        }
        return [{"code": c, "message": LINT[c]} for c, hit in found.items() if hit and c not in self.suppressed]

    def explain(self, source: DataFrame | None = None, joins: dict[str, DataFrame] | None = None, counts: bool = False) -> dict[str, Any]:
        """What the query does; given a source also Spark's plan, and with ``counts`` the
        rows after every stage (which runs them)."""
        ast, joins = self.ast, joins or {}
        check_shape(ast)
        kinds = {o.sort.name for o in ast.orders}
        out: dict[str, Any] = {
            "type": "sql-like", "source": self.text, "has_join": bool(ast.joins),
            "where_rules": len(rules_of(ast.where)), "having_rules": len(rules_of(ast.having)), "qualify_rules": len(rules_of(ast.qualify)),
            "group_by": list(ast.group_by), "order_by": [f"{o.field} {o.sort.name}" for o in ast.orders],
            "sort_direction": None if not kinds else kinds.pop() if len(kinds) == 1 else "MIXED",
            "offset": _page(ast.offset), "limit": _page(ast.limit), "select": [i.name for i in ast.items] or ["*"],
            "projection": "direct" if not ast.aggregated and all(i.kind == "field" and not i.alias for i in ast.items) else "alias/computed",
            "metrics": [f"{i.metric.name}({i.text}) as {i.name}" for i in ast.metrics],
            "time_buckets": {i.name: describe(i.bucket) for i in ast.items if i.bucket},
            "computed": self.registry.names() if self.registry else [],
            "join_sources": {j.source: "bound" if j.source in joins else "unbound" for j in ast.joins},
            "parameters": {n: self.given.get(n, "unresolved") for n in params_of(parse_text(self.text))},
            "lint": self.lint(), "parse_cache": DEFAULT_CACHE.stats(),
        }
        if source is not None:
            spec = self.plan(source, joins)
            out["plan"] = compile_query(spec)._jdf.queryExecution().toString()
            if counts:
                from ..fluent import stage_counts

                out["stage_rows"] = stage_counts(spec)
        return out


def _page(p):
    return f":{p.name}" if isinstance(p, Param) else p


@dataclass(frozen=True)
class BoundQuery:
    """A query and its sources; the plan is checked and can be run many times."""

    query: SqlQuery
    source: DataFrame
    joins: dict[str, DataFrame]
    spec: QuerySpec

    def rows(self) -> DataFrame:
        return compile_query(self.spec, self.query._hook())

    def iterate(self) -> Iterator[Row]:
        return self.rows().toLocalIterator()

    def chart(self, spec):
        from ..reports.chart import to_chart

        return to_chart(self.rows(), spec)


@dataclass(frozen=True)
class Template:
    """A reusable text with its declared parameters."""

    text: str
    names: tuple[str, ...]

    def __post_init__(self) -> None:
        if len(set(self.names)) != len(self.names) or any(not n.strip() for n in self.names):
            raise QueryError("param_name", "Template parameters must be named once each")
        used = set(params_of(parse_text(self.text)))
        if missing := sorted(used - set(self.names)):
            raise QueryError("param_missing", f"Template does not declare parameter(s): {missing}")
        if unknown := sorted(set(self.names) - used):
            raise QueryError("param_unknown", f"Template declares unknown parameter(s): {unknown}")

    def bind(self, **values: Any) -> SqlQuery:
        return parse(self.text).params(values)
