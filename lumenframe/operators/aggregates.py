"""Metrics over groups and over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, unknown_field
from ..functions.buckets import bucket_label
from ..functions.predicates import kind_of
from ..plans.spec import GroupKey, Metric, MetricSpec
from .columns import col

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NULL_KEY = "<NULL>"


def metric_column(spec: MetricSpec, schema: T.StructType) -> Column:
    """COUNT counts rows, nulls too; SUM is long or double; AVG is double."""
    if spec.metric is Metric.COUNT:
        return F.count(F.lit(1))
    if spec.field not in schema.names:
        raise unknown_field(spec.field, schema.names, "SELECT")
    dtype, value = schema[spec.field].dataType, col(spec.field)
    if kind_of(dtype) != "number":
        raise QueryError("aggregation", f"{spec.metric.name} needs a numeric field, '{spec.field}' is {dtype.simpleString()}")
    match spec.metric:
        case Metric.SUM:
            return F.sum(value.cast("long" if isinstance(dtype, INTEGRAL) else "double"))
        case Metric.AVG:
            return F.avg(value.cast("double"))
        case Metric.MIN:
            return F.min(value)
    return F.max(value)


def key_column(key: GroupKey) -> Column:
    if key.bucket:
        return bucket_label(col(key.field), key.bucket)
    return col(key.field)


def aggregate(df: DataFrame, keys: tuple[GroupKey, ...], metrics: tuple[MetricSpec, ...], compat: bool = False, row_id: str | None = None) -> DataFrame:
    """One row a group (or one row in all). Keys with a date format group by the text and
    show the first date; ``compat`` groups by the text of every key, null like empty."""
    for k in keys:
        if k.field not in df.columns:
            raise unknown_field(k.field, df.columns, "GROUP BY")
    values = [metric_column(m, df.schema).alias(m.alias) for m in metrics]
    if not keys:
        return df.agg(*values)
    by, shown = [], []
    for i, k in enumerate(keys):
        first = F.min_by(col(k.field), F.col(row_id)) if row_id else F.min(col(k.field))
        if k.date_format:
            by.append(F.date_format(col(k.field), k.date_format).alias(f"__k{i}"))
            shown.append(first.alias(k.alias))
        elif compat and not k.bucket:
            text = col(k.field).cast("string")
            by.append(F.when(text.isNull() | (text == ""), NULL_KEY).otherwise(text).alias(f"__k{i}"))
            shown.append(first.alias(k.alias))
        else:
            by.append(key_column(k).alias(k.alias))
    out = df.groupBy(*by).agg(*shown, *values)
    return out.select(*[col(k.alias) for k in keys], *[col(m.alias) for m in metrics])


def distinct_rows(df: DataFrame, fields: tuple[str, ...], row_id: str, compat: bool = False) -> DataFrame:
    """One row a key: the place of the first, the values of the last duplicate.

    Written as an aggregate, so that copies meet after map-side merging, not in one task.
    ``compat`` drops empty texts from the key, moves the rest up, and drops rows whose
    key is empty."""
    rest = [c for c in df.columns if c != row_id]
    keys = [col(f) for f in fields]
    if compat:
        parts = F.filter(F.array(*[F.coalesce(k.cast("string"), F.lit("null")) for k in keys]), lambda p: p != "")
        df, keys = df.withColumn("__key", parts).filter(F.size("__key") > 0), [F.col("__key")]
    packed = F.max_by(F.struct(*[col(c) for c in rest]), F.col(row_id)).alias("__row")
    out = df.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(keys)]).agg(packed, F.min(row_id).alias(row_id))
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in rest], row_id)
