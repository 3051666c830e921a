"""Statistics tables: grouped rows with totals, from preset queries."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from ..plans.spec import Metric
from ..sources.sinks import bounded
from ..sql.query import parse
from .chart import metric_text
from .table import TabularSchema


@dataclass(frozen=True)
class StatsTable:
    rows: DataFrame
    totals: dict[str, Any]
    schema: TabularSchema

    def payload(self) -> dict[str, Any]:
        """Rows, totals and columns as plain values; for tables that fit the driver."""
        columns = [{"name": c.name, "label": c.label, "type": c.type, "order": c.order, "formatHint": c.format_hint} for c in self.schema.columns]
        return {"columns": columns, "rows": [r.asDict() for r in bounded(self.rows)], "totals": self.totals}


@dataclass(frozen=True)
class StatsPreset:
    text: str
    totals_text: str | None = None

    def rows(self, source: DataFrame) -> DataFrame:
        return parse(self.text).rows(source)

    def totals(self, source: DataFrame) -> dict[str, Any]:
        return parse(self.totals_text).rows(source).first().asDict() if self.totals_text else {}

    def table(self, source: DataFrame) -> StatsTable:
        return StatsTable(self.rows(source), self.totals(source), parse(self.text).schema(source))


def summary(metric: Metric = Metric.COUNT, value_field: str | None = None, value: str = "value") -> StatsPreset:
    """One metric over all rows."""
    return StatsPreset(f"select {metric_text(metric, value_field)} as {value}")


def by(group: str, metric: Metric = Metric.COUNT, value_field: str | None = None, value: str = "value") -> StatsPreset:
    """A metric by group, largest first, with the metric over all rows as totals."""
    metric_sql = metric_text(metric, value_field)
    text = f"select {group}, {metric_sql} as {value} group by {group} order by {value} desc, {group} desc"
    return StatsPreset(text, f"select {metric_sql} as {value}")


def top_n_by(group: str, n: int, metric: Metric = Metric.COUNT, value_field: str | None = None, value: str = "value") -> StatsPreset:
    """The ``n`` groups of largest metric."""
    if n <= 0:
        raise ValueError("n must be positive")
    preset = by(group, metric, value_field, value)
    return StatsPreset(f"{preset.text} limit {n}", preset.totals_text)
