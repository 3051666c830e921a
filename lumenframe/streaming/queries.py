"""Queries over unbounded tables.

Filters, projections, computed fields and stream-static joins run as they are. Grouped
metrics need an event time: windows close behind a watermark, so state stays bounded.
Sorting, paging, distinct-last and window functions need the end of the input and raise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fluent import Query
from ..functions.buckets import bucket_label
from ..operators.aggregates import metric_column
from ..operators.columns import col
from ..plans.compiler import compile_query, condition
from ..plans.spec import Bucket


def _check(spec) -> None:
    if spec.orders or spec.limit is not None or spec.offset or spec.distinct or spec.windows:
        raise ValueError("Order, paging, distinct and window functions need a bounded table")


@dataclass(frozen=True)
class StreamQuery:
    """A fluent query whose source is a streaming DataFrame."""

    query: Query
    event_time: str | None = None
    late: str = "1 hour"

    def rows(self, every: str = "1 day") -> DataFrame:
        """The streaming result. Groups are kept per event-time window of length ``every``."""
        spec = self.query.spec
        _check(spec)
        if not spec.source.isStreaming:
            raise ValueError("The source is no stream; use the query itself")
        if not spec.metrics:
            return compile_query(spec)
        if not self.event_time:
            raise ValueError("Metrics over a stream need an event time column")
        timed = spec.source.withColumn(self.event_time, col(self.event_time).cast("timestamp")).withWatermark(self.event_time, self.late)
        rows = compile_query(spec.with_(source=timed, groups=(), metrics=(), having=type(spec.having)()), project=False)
        keys = [(bucket_label(col(g.field), g.bucket) if g.bucket else col(g.field)).alias(g.alias) for g in spec.groups]
        values = [metric_column(m, rows.schema).alias(m.alias) for m in spec.metrics]
        out = rows.groupBy(F.window(col(self.event_time), every).alias("window"), *keys).agg(*values)
        test = condition(spec.having, out.schema, "HAVING") if not spec.having.empty else None
        return out if test is None else out.filter(test)


def stream_bucket_counts(events: DataFrame, event_time: str, bucket: Bucket, alias: str = "period", late: str = "1 hour") -> DataFrame:
    """Rows by calendar bucket of a stream, one count an event-time day and label."""
    query = Query.of(events).time_bucket(event_time, bucket, alias).count("n")
    return StreamQuery(query, event_time, late).rows("1 day")
