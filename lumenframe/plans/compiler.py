"""Compiles a QuerySpec to one lazy DataFrame.

Stages: join, computed fields, distinct, where, then group/aggregate/having or
window/qualify, order, page, project. Filters are emitted bare, so that they reach the
scan; a row number is attached only where source order matters, and after the filter.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..computed import apply_computed
from ..errors import QueryError, unknown_field
from ..functions.buckets import bucket_label
from ..functions.expressions import compile_expression, identifiers, is_expression
from ..functions.predicates import predicate
from ..operators.aggregates import aggregate, distinct_rows
from ..operators.columns import col, find, flatten
from ..operators.joins import flag_join, join, semi_join
from ..operators.windows import window_column
from .spec import Both, Clause, Condition, InQuery, QuerySpec, Rule, Separator, Sort, WindowFunction

ROW_ID = "__row_id"
StageHook = Callable[[str, DataFrame], DataFrame]


def _rule(rule: Rule, schema: T.StructType, grouped: bool, strict: bool, clause_name: str) -> Column | None:
    """The rule's predicate, or None where a lenient rule names no column."""
    if is_expression(rule.field) and rule.field not in schema.names:
        if rule.clause in (Clause.CONTAINS, Clause.MATCHES):
            raise QueryError("expression_reference", f"arithmetic in {clause_name} compares as a number only")

        def resolve(name: str) -> Column:
            if name not in schema.names:
                raise unknown_field(name, schema.names, clause_name)
            return col(name)

        return predicate(compile_expression(rule.field, resolve), T.DoubleType(), rule.clause, rule.value, grouped)
    if rule.field not in schema.names:
        if strict:
            raise unknown_field(rule.field, schema.names, clause_name)
        warnings.warn(f"Rule on unknown field '{rule.field}' is ignored", stacklevel=2)
        return None
    if rule.clause in (Clause.CONTAINS, Clause.MATCHES) and not isinstance(schema[rule.field].dataType, T.StringType):
        warnings.warn(f"{rule.clause.name} on '{rule.field}', which is no text, is never true", stacklevel=2)
        return F.lit(False)
    return predicate(col(rule.field), schema[rule.field].dataType, rule.clause, rule.value, grouped, rule.date_format)


def _fold(parts: list[Column], operator: Separator) -> Column:
    return reduce(lambda a, b: a & b if operator is Separator.AND else a | b, parts)


def condition(cond: Condition, schema: T.StructType, clause_name: str = "WHERE") -> Column | None:
    """The condition as one column; None if nothing is left to test.

    Flat rules: all AND rules hold, or any OR rule does. Groups: ``all_of`` groups are
    ORed and so are ``any_of`` groups, and both kinds must hold; they replace flat rules."""
    if cond.tree is not None:

        def walk(node) -> Column:
            if isinstance(node, Both):
                return _fold([walk(node.left), walk(node.right)], node.operator)
            if isinstance(node, Column):
                return node
            return _rule(node, schema, cond.grouped, True, clause_name)

        return walk(cond.tree)
    if cond.all_of or cond.any_of:
        out = []
        for groups, inner in ((cond.all_of, Separator.AND), (cond.any_of, Separator.OR)):
            folded = [[p for p in (_rule(r, schema, True, cond.strict, clause_name) for r in g) if p is not None] for g in groups]
            if any(folded):
                out.append(_fold([_fold(g, inner) for g in folded if g], Separator.OR))
        return _fold(out, Separator.AND) if out else None
    known = [(r, _rule(r, schema, False, cond.strict, clause_name)) for r in cond.flat]
    ands = [p for r, p in known if p is not None and r.separator is Separator.AND]
    ors = [p for r, p in known if p is not None and r.separator is Separator.OR]
    parts = ([_fold(ands, Separator.AND)] if ands else []) + ors
    return _fold(parts, Separator.OR) if parts else None


def _where(df: DataFrame, cond: Condition) -> DataFrame:
    """Filters; IN plans become semi joins where they are conjuncts, else flagged left joins."""
    if cond.tree is None:
        test = condition(cond, df.schema)
        return df if test is None else df.filter(test)
    columns, plain, n = df.columns, [], 0

    def conjuncts(node):
        if isinstance(node, Both) and node.operator is Separator.AND:
            return [*conjuncts(node.left), *conjuncts(node.right)]
        return [node]

    def is_query(node) -> bool:
        return isinstance(node, Rule) and isinstance(node.value, InQuery)

    def resolved(node):
        nonlocal df, n
        if isinstance(node, Both):
            return Both(node.operator, resolved(node.left), resolved(node.right))
        if is_query(node):
            n += 1
            df = flag_join(df, node.field, node.value.frame, f"__in{n}")
            return F.col(f"__in{n}")
        return node

    parts = conjuncts(cond.tree)
    grouped = cond.grouped
    queries = [p for p in parts if is_query(p)]
    for p in queries:
        if p.field not in columns:
            raise unknown_field(p.field, columns, "WHERE")
    others = [p for p in parts if not is_query(p)]
    for p in others:
        node = resolved(p)
        leaf = isinstance(node, Rule)
        plain.append(_rule(node, df.schema, grouped, True, "WHERE") if leaf else condition(Condition(tree=node), df.schema))
    if plain:
        df = df.filter(_fold(plain, Separator.AND))
    for p in queries:
        df = semi_join(df, p.field, p.value.frame)
    return df.select(*[col(c) for c in columns]) if n else df


def _known(spec: QuerySpec, names: list[str], columns: list[str], clause: str, ignore_case: bool = False) -> list[str | None]:
    """The column of every name. An unknown one raises, or is None where the plan is lenient."""
    out = [find(n, columns, ignore_case) for n in names]
    for n, c in zip(names, out):
        if c is None:
            if not spec.lenient:
                raise unknown_field(n, [k for k in columns if k != ROW_ID], clause)
            warnings.warn(f"Unknown field '{n}' in {clause} is ignored", stacklevel=3)
    return out


def _needed(spec: QuerySpec) -> set[str] | None:
    """Fields that anything behind distinct reads; None where that is every field."""
    if not spec.outputs and not spec.metrics:
        return None
    texts = [o.source for o in spec.outputs] + list(spec.orders) + [m.field for m in spec.metrics if m.field] + [g.field for g in spec.groups]
    for w in spec.windows:
        texts += [*w.partition, *(o.field for o in w.orders), *([w.value] if w.value else [])]
    for rules in (spec.where.flat, *spec.where.all_of, *spec.where.any_of):
        texts += [r.field for r in rules]
    todo = [spec.where.tree]
    while todo:
        node = todo.pop()
        if isinstance(node, Both):
            todo += [node.left, node.right]
        elif isinstance(node, Rule):
            texts.append(node.field)
    names = {n for t in texts for n in ([t] if not is_expression(t) else identifiers(t))}
    return names | {n.lower() for n in names}


def compile_query(spec: QuerySpec, hook: StageHook | None = None, project: bool = True) -> DataFrame:
    """The DataFrame of a plan. ``hook(stage, df)`` may observe every stage."""
    seen = hook or (lambda stage, df: df)
    df = seen("source", flatten(spec.source))
    for j in spec.joins:
        df = join(df, replace(j, child=flatten(j.child)))
    if spec.joins:
        df = seen("join", df)
    if spec.computed:
        df = apply_computed(df, spec.computed, strict=spec.strict_numbers)
    stable = bool(spec.distinct or any(w.function not in (WindowFunction.RANK, WindowFunction.DENSE_RANK) for w in spec.windows) or (spec.orders and spec.sort and not spec.metrics) or (spec.compat and spec.groups) or any(g.date_format for g in spec.groups))

    def numbered(frame: DataFrame) -> DataFrame:
        return frame if ROW_ID in frame.columns or not stable else frame.withColumn(ROW_ID, F.monotonically_increasing_id())

    def distinct(frame: DataFrame) -> DataFrame:
        fields = tuple(f for f in spec.distinct if f in frame.columns)
        if not fields:
            return frame
        needed = _needed(spec)
        if needed is not None:  # rows are rebuilt from an aggregate, which only holds what is read
            frame = frame.select(*[col(c) for c in frame.columns if c in fields or c == ROW_ID or c in needed or c.lower() in needed])
        return distinct_rows(numbered(frame), fields, ROW_ID, spec.compat)

    if spec.distinct_stage == "before where" and spec.distinct:
        df = distinct(df)
    if not spec.where.empty:
        df = seen("where", _where(df, spec.where))
    if spec.distinct_stage == "after where" and spec.distinct:
        df = distinct(df)
    df = numbered(df)
    if spec.metrics:
        if spec.windows:
            raise QueryError("aggregation", "an aggregate query cannot have window functions")
        known = _known(spec, [g.field for g in spec.groups], df.columns, "GROUP BY")
        groups = tuple(g for g, c in zip(spec.groups, known) if c)
        df = seen("aggregate", aggregate(df, groups, spec.metrics, spec.compat, ROW_ID if ROW_ID in df.columns else None))
        if not spec.having.empty:
            test = condition(spec.having, df.schema, "HAVING")
            df = seen("having", df if test is None else df.filter(test))
    elif not spec.having.empty:
        raise QueryError("having_reference", "HAVING needs groups or metrics")
    if spec.windows:
        df = df.withColumns({w.alias: window_column(w, df.schema, ROW_ID) for w in spec.windows})
        df = seen("window", df)
        if not spec.qualify.empty:
            aliases = T.StructType([df.schema[w.alias] for w in spec.windows])
            test = condition(spec.qualify, aliases, "QUALIFY")
            df = seen("qualify", df if test is None else df.filter(test))
    elif not spec.qualify.empty:
        raise QueryError("aggregation", "QUALIFY needs a window function")
    if spec.orders and spec.sort:
        names = [n for n in _known(spec, list(spec.orders), df.columns, "ORDER BY", ignore_case=True) if n]
        keys = [col(n).asc_nulls_first() if spec.sort is Sort.ASC else col(n).desc_nulls_last() for n in names]
        if keys:
            df = seen("order", df.orderBy(*keys, *([F.col(ROW_ID)] if ROW_ID in df.columns else [])))
    if spec.offset:
        df = df.offset(spec.offset)
    if spec.limit is not None:
        df = df.limit(spec.limit)
    return seen("project", _project(df, spec)) if project else df


def _project(df: DataFrame, spec: QuerySpec) -> DataFrame:
    plain = [o for o in spec.outputs if not o.expression]
    lost = {o.source for o, c in zip(plain, _known(spec, [o.source for o in plain], df.columns, "SELECT")) if c is None}
    outputs = [o for o in spec.outputs if o.expression or o.source not in lost]
    if not outputs:
        hidden = {ROW_ID, *(m.alias for m in spec.metrics if m.hidden)}
        return df.select(*[col(c) for c in df.columns if c not in hidden]) if hidden & set(df.columns) else df
    out = []
    for o in outputs:
        if o.bucket and not spec.metrics:
            out.append(bucket_label(col(o.source), o.bucket).alias(o.name))
        elif o.expression:

            def resolve(name: str) -> Column:
                if name not in df.columns:
                    raise unknown_field(name, [c for c in df.columns if c != ROW_ID], "SELECT")
                return col(name)

            out.append(compile_expression(o.source, resolve, spec.strict_numbers).alias(o.name))
        else:
            out.append(col(o.source).alias(o.name))
    return df.select(*out)
