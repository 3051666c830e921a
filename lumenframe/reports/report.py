"""Reusable reports: a query with its optional chart and schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..fluent import Query
from ..plans.spec import Sort
from ..sql.query import SqlQuery, parse
from .chart import ChartData, ChartSpec, to_chart
from .table import TabularSchema, schema_of


@dataclass(frozen=True)
class Report:
    """Runs one definition over any source. Fluent definitions take no joins."""

    run: Callable[..., DataFrame]
    schema: Callable[..., TabularSchema]
    chart_spec: ChartSpec | None = None

    @staticmethod
    def sql(query: SqlQuery | str, chart: ChartSpec | None = None) -> Report:
        q = parse(query) if isinstance(query, str) else query
        return Report(q.rows, q.schema, chart)

    @staticmethod
    def fluent(configure: Callable[[Query], Query], sort: Sort | None = None, chart: ChartSpec | None = None) -> Report:
        def query(source: DataFrame) -> Query:
            q = configure(Query.of(source))
            if q.spec.joins:
                raise ValueError("Fluent reports do not support joins")
            return q

        return Report(lambda s: query(s).rows(sort), lambda s: schema_of(query(s).spec, query(s).rows()), chart)

    def with_chart(self, chart: ChartSpec) -> Report:
        return replace(self, chart_spec=chart)

    def rows(self, source: DataFrame, *joins) -> DataFrame:
        return self.run(source, *joins)

    def chart(self, source: DataFrame, *joins) -> ChartData:
        if self.chart_spec is None:
            raise ValueError("This report has no chart")
        return to_chart(self.rows(source, *joins), self.chart_spec)
