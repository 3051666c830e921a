"""Ranking and running window functions."""

from __future__ import annotations

import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import QueryError, unknown_field
from ..functions.predicates import kind_of
from ..plans.spec import Sort, WindowFunction, WindowSpec
from .aggregates import INTEGRAL
from .columns import col


def window_column(spec: WindowSpec, schema: T.StructType, row_id: str) -> Column:
    """Ranks are long. Running metrics skip nulls and are null before the first value.
    Order is nulls lowest; source order settles ties, except in ranks."""
    if not spec.orders:
        raise QueryError("aggregation", "a window function needs an order")
    for name in (*spec.partition, *(o.field for o in spec.orders), *([spec.value] if spec.value else [])):
        if name not in schema.names:
            raise unknown_field(name, schema.names, "SELECT")
    order = [col(o.field).asc_nulls_first() if o.sort is Sort.ASC else col(o.field).desc_nulls_last() for o in spec.orders]
    if not spec.partition:
        warnings.warn("a window without partition fields puts all rows in one task", stacklevel=2)
    over = Window.partitionBy(*[col(p) for p in spec.partition])
    if spec.function is WindowFunction.RANK:
        return F.rank().over(over.orderBy(*order)).cast("long")
    if spec.function is WindowFunction.DENSE_RANK:
        return F.dense_rank().over(over.orderBy(*order)).cast("long")
    stable = over.orderBy(*order, F.col(row_id))
    if spec.function is WindowFunction.ROW_NUMBER:
        return F.row_number().over(stable).cast("long")
    running = stable.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if spec.function is WindowFunction.COUNT:
        return F.count(col(spec.value) if spec.value else F.lit(1)).over(running)
    if not spec.value:
        raise QueryError("aggregation", f"{spec.function.name} window needs a value field")
    dtype, value = schema[spec.value].dataType, col(spec.value)
    if kind_of(dtype) != "number":
        raise QueryError("aggregation", f"{spec.function.name} window needs a numeric field, '{spec.value}' is {dtype.simpleString()}")
    match spec.function:
        case WindowFunction.SUM:
            return F.sum(value.cast("long" if isinstance(dtype, INTEGRAL) else "double")).over(running)
        case WindowFunction.AVG:
            return F.avg(value.cast("double")).over(running)
        case WindowFunction.MIN:
            return F.min(value).over(running)
    return F.max(value).over(running)
