"""Chart data from small results, presets that write the query, and a Chart.js payload."""

from __future__ import annotations

import datetime as dt
import enum
import json
from dataclasses import dataclass, field, replace
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame

from ..functions.buckets import parse_bucket
from ..operators.columns import col
from ..plans.spec import Bucket, Metric

MAX_POINTS = 1_000_000
# Default dataset colours, in order.
PALETTE = ("#0d6efd", "#198754", "#fd7e14", "#dc3545", "#6610f2", "#20c997", "#ffc107", "#6f42c1")


class ChartType(enum.Enum):
    BAR = "bar"
    LINE = "line"
    PIE = "pie"
    AREA = "area"
    SCATTER = "scatter"


class NullPoints(enum.Enum):
    """What a series shows where it has no row for a label."""

    PRESERVE = "PRESERVE"
    ZERO = "ZERO"


@dataclass(frozen=True)
class ChartSpec:
    type: ChartType
    x: str
    y: str
    series: str | None = None
    title: str | None = None
    x_label: str | None = None
    y_label: str | None = None
    date_format: str | None = None
    sort_labels: bool = False
    stacked: bool = False
    percent_stacked: bool = False
    null_points: NullPoints = NullPoints.PRESERVE
    colors: dict[str, str] = field(default_factory=dict)
    stacks: dict[str, str] = field(default_factory=dict)
    axes: dict[str, str] = field(default_factory=dict)

    def check(self) -> None:
        if not self.x or not self.x.strip() or not self.y or not self.y.strip():
            raise ValueError("a chart needs an x and a y field")
        if self.series is not None and not self.series.strip():
            raise ValueError("the series field is blank")
        if self.type is ChartType.PIE and self.series:
            raise ValueError("a pie has no series")
        if self.percent_stacked and not self.stacked:
            raise ValueError("percentages need stacking")
        if self.stacked and not self.series:
            raise ValueError("stacking needs a series field")
        if self.stacked and self.type not in (ChartType.BAR, ChartType.AREA):
            raise ValueError("only bars and areas stack")


@dataclass
class Dataset:
    label: str
    values: list[float | None]
    color: str | None = None
    stack: str | None = None
    axis: str | None = None


@dataclass
class ChartData:
    spec: ChartSpec
    labels: list[str | None]
    datasets: list[Dataset]


def _label(value: Any, spec: ChartSpec) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, (dt.datetime, dt.date)):
        return value.strftime(_strftime(spec.date_format or "yyyy-MM-dd HH:mm:ss"))
    if isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
        return str(value)
    raise ValueError(f"'{spec.x}' holds a {type(value).__name__}, which is no label")


def _strftime(pattern: str) -> str:
    for a, b in (("yyyy", "%Y"), ("MM", "%m"), ("dd", "%d"), ("HH", "%H"), ("mm", "%M"), ("ss", "%S")):
        pattern = pattern.replace(a, b)
    return pattern


def _number(value: Any, spec: ChartSpec) -> float:
    if value is None:
        raise ValueError(f"'{spec.y}' is null")
    if isinstance(value, bool) or not isinstance(value, (int, float, Decimal)):
        raise ValueError(f"'{spec.y}' is no number")
    return float(value)


def to_chart(df: DataFrame, spec: ChartSpec) -> ChartData:
    """Chart data of an aggregated result (at most a million points reach the driver).

    Labels and series stand in the order of first appearance; of several rows for one
    point of a series the last counts."""
    spec.check()
    for name in (spec.x, spec.y, *([spec.series] if spec.series else [])):
        if name not in df.columns:
            raise ValueError(f"the result has no field '{name}'")
    wanted = [col(spec.x).alias("x"), col(spec.y).alias("y"), *([col(spec.series).alias("s")] if spec.series else [])]
    rows = df.select(*wanted).limit(MAX_POINTS + 1).collect()
    if len(rows) > MAX_POINTS:
        raise ValueError(f"A chart takes at most {MAX_POINTS} points; aggregate first")
    points = [(_label(r["x"], spec), _number(r["y"], spec), (None if r["s"] is None else str(r["s"])) if spec.series else None) for r in rows]
    if not spec.series:
        if spec.sort_labels:
            points.sort(key=lambda p: (p[0] is not None, p[0] or ""))
        return ChartData(spec, [p[0] for p in points], [_dataset(spec.y, [p[1] for p in points], spec)])
    labels = list(dict.fromkeys(p[0] for p in points))
    if spec.sort_labels:
        labels.sort(key=lambda x: (x is not None, x or ""))
    names = list(dict.fromkeys(p[2] for p in points))
    cells = {(x, s): y for x, y, s in points}
    missing = 0.0 if spec.null_points is NullPoints.ZERO else None
    matrix = [[cells.get((x, s), missing) for x in labels] for s in names]
    if spec.percent_stacked:
        totals = [sum(v or 0.0 for v in column) for column in zip(*matrix)]
        matrix = [[None if v is None else v / t * 100 if t else v for v, t in zip(row, totals)] for row in matrix]
    return ChartData(spec, labels, [_dataset("null" if n is None else n, row, spec) for n, row in zip(names, matrix)])


def _dataset(label: str, values: list[float | None], spec: ChartSpec) -> Dataset:
    return Dataset(label, values, spec.colors.get(label), spec.stacks.get(label), spec.axes.get(label))


def chartjs(chart: ChartData) -> dict[str, Any]:
    """The payload that the Chart.js constructor takes."""
    spec, pie = chart.spec, chart.spec.type is ChartType.PIE
    datasets = []
    for i, d in enumerate(chart.datasets):
        color = d.color or PALETTE[i % len(PALETTE)]
        entry: dict[str, Any] = {"label": d.label, "data": list(d.values)}
        entry["backgroundColor"] = [PALETTE[k % len(PALETTE)] for k in range(len(chart.labels))] if pie else color
        optional = {
            "borderColor": None if pie else color, "stack": d.stack, "yAxisID": d.axis,
            "fill": True if spec.type is ChartType.AREA else None,
            "tension": 0.25 if spec.type in (ChartType.AREA, ChartType.LINE) else None,
        }
        datasets.append(entry | {k: v for k, v in optional.items() if v is not None})

    def titled(text: str | None) -> dict[str, Any]:
        return {"title": {"display": True, "text": text}} if text and text.strip() else {}

    options: dict[str, Any] = {
        "responsive": True, "maintainAspectRatio": False,
        "plugins": {"legend": {"display": True, "position": "bottom"}} | titled(spec.title),
        "meta": {"stacked": spec.stacked, "percentStacked": spec.percent_stacked, "nullPointPolicy": spec.null_points.value, "xLabel": spec.x_label, "yLabel": spec.y_label},
    }
    if not pie:
        y = {"stacked": spec.stacked, "beginAtZero": True} | ({"max": 100} if spec.percent_stacked else {}) | titled(spec.y_label)
        options["scales"] = {"x": {"stacked": spec.stacked} | titled(spec.x_label), "y": y}
    kind = "line" if spec.type is ChartType.AREA else spec.type.value
    return {"type": kind, "data": {"labels": list(chart.labels), "datasets": datasets}, "options": options}


def chart_json(chart: ChartData) -> str:
    """A compact payload for files: type, data and the spec's display options."""
    spec = chart.spec
    data = {"labels": chart.labels, "datasets": [{"label": d.label, "data": d.values} for d in chart.datasets]}
    options = {"stacked": spec.stacked, "percentStacked": spec.percent_stacked, "nullPointPolicy": spec.null_points.value, "title": spec.title, "xLabel": spec.x_label, "yLabel": spec.y_label}
    return json.dumps({"type": spec.type.value, "data": data, "options": options}, separators=(",", ":"))


@dataclass(frozen=True)
class ChartPreset:
    """A query text and the chart of its result."""

    text: str
    spec: ChartSpec

    def with_spec(self, **changes) -> ChartPreset:
        return replace(self, spec=replace(self.spec, **changes))

    def query(self):
        from ..sql.query import parse

        return parse(self.text)

    def rows(self, source: DataFrame) -> DataFrame:
        return self.query().rows(source)

    def chart(self, source: DataFrame) -> ChartData:
        return to_chart(self.rows(source), self.spec)


def metric_text(metric: Metric, value_field: str | None) -> str:
    if metric is Metric.COUNT and not value_field:
        return "count(*)"
    if not value_field:
        raise ValueError(f"{metric.name} needs a field")
    return f"{metric.value}({value_field})"


def category_totals(category: str, metric: Metric, value_field: str | None, value: str = "value", type: ChartType = ChartType.BAR) -> ChartPreset:
    text = f"select {category}, {metric_text(metric, value_field)} as {value} group by {category} order by {value} desc"
    return ChartPreset(text, ChartSpec(type, category, value))


def category_counts(category: str, value: str = "value", type: ChartType = ChartType.BAR) -> ChartPreset:
    return category_totals(category, Metric.COUNT, None, value, type)


def time_series_totals(date: str, bucket: Bucket | str, metric: Metric, value_field: str | None, period: str = "period", value: str = "value", type: ChartType = ChartType.LINE) -> ChartPreset:
    b = parse_bucket(bucket) if isinstance(bucket, str) else bucket
    args = [b.unit, b.zone, *([b.week_start] if b.unit == "week" else [])]
    quoted = ",".join(f"'{a}'" for a in args)
    text = f"select bucket({date},{quoted}) as {period}, {metric_text(metric, value_field)} as {value} group by {period} order by {period} asc"
    return ChartPreset(text, ChartSpec(type, period, value, sort_labels=True))


def time_series_counts(date: str, bucket: Bucket | str, period: str = "period", value: str = "value", type: ChartType = ChartType.LINE) -> ChartPreset:
    return time_series_totals(date, bucket, Metric.COUNT, None, period, value, type)


def grouped_breakdown(category: str, series: str, metric: Metric, value_field: str | None, value: str = "value", type: ChartType = ChartType.BAR) -> ChartPreset:
    text = f"select {series}, {category}, {metric_text(metric, value_field)} as {value} group by {series}, {category} order by {category} asc"
    return ChartPreset(text, ChartSpec(type, category, value, series, sort_labels=True))
