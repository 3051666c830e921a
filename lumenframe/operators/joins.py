"""Equi-joins with stable output names: left columns, then renamed right columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, unknown_field
from ..functions.predicates import kind_of
from ..plans.spec import JoinKind, JoinSpec
from .columns import col

PREFIX = "child_"


def joined_names(left: list[str], right: list[str]) -> dict[str, str]:
    """Output name of every right column: ``child_<name>`` and then a number on collision."""
    taken, out = set(left), {}
    for name in right:
        new, n = name, 0
        while new in taken:
            new = f"{PREFIX}{name}" + (f"_{n}" if n else "")
            n += 1
        out[name] = new
        taken.add(new)
    return out


def join(parent: DataFrame, spec: JoinSpec) -> DataFrame:
    """The join of ``parent`` with the spec's child. A right join keeps the child's
    columns first. Broadcast or sort-merge is left to the optimizer and its statistics."""
    if spec.parent_field not in parent.columns:
        raise unknown_field(spec.parent_field, parent.columns, "JOIN")
    if spec.child_field not in spec.child.columns:
        raise unknown_field(spec.child_field, spec.child.columns, "JOIN")
    left, right, left_key, right_key = parent, spec.child, spec.parent_field, spec.child_field
    if spec.kind is JoinKind.RIGHT:
        left, right, left_key, right_key = right, left, right_key, left_key
    names = joined_names(left.columns, right.columns)
    renamed = right.select(*[col(c).alias(n) for c, n in names.items()])
    kept = left.select(*[col(c).alias(c) for c in left.columns])  # new ids: a table may join itself
    a, b = kept.schema[left_key].dataType, renamed.schema[names[right_key]].dataType
    if isinstance(a, (T.ArrayType, T.MapType)) or isinstance(b, (T.ArrayType, T.MapType)):
        raise QueryError("invalid_join_rows", f"Cannot join on '{left_key}' = '{right_key}'")
    x, y = col(left_key), col(names[right_key])
    if kind_of(a) != kind_of(b):
        x, y = x.cast("string"), y.cast("string")
    on = x.eqNullSafe(y) if spec.null_safe else x == y
    return kept.join(renamed, on, "inner" if spec.kind is JoinKind.INNER else "left")


def semi_join(df: DataFrame, field: str, keys: DataFrame) -> DataFrame:
    """Rows whose ``field`` is among the single column of ``keys``."""
    key = keys.select(F.col(keys.columns[0]).alias("__key"))
    return df.join(key, _same(df, field, key), "left_semi")


def flag_join(df: DataFrame, field: str, keys: DataFrame, flag: str) -> DataFrame:
    """``df`` with a boolean ``flag``: is ``field`` among the single column of ``keys``?"""
    key = keys.select(F.col(keys.columns[0]).alias("__key")).distinct().withColumn(flag, F.lit(True))
    return df.join(key, _same(df, field, key), "left").drop("__key").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def _same(df: DataFrame, field: str, key: DataFrame):
    a, b = kind_of(df.schema[field].dataType), kind_of(key.schema["__key"].dataType)
    if a == b:
        return col(field) == F.col("__key")
    if a == "number":
        return col(field).cast("double") == F.col("__key").try_cast("double")
    return col(field).cast("string") == F.col("__key").cast("string")
