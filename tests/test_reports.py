"""Charts, statistics tables, reports and schemas."""

import datetime as dt
import json

import pytest

from lumenframe import ChartSpec, ChartType, Metric, NullPoints, Query, Report, Sort, chartjs, parse, to_chart
from lumenframe.reports import chart, stats
from lumenframe.reports.table import label_of


@pytest.fixture(scope="module")
def points(spark):
    rows = [("Engineering", "2025-01", 120), ("Finance", "2025-01", 90), ("Engineering", "2025-02", 100)]
    return spark.createDataFrame(rows, "department string, period string, payroll int").coalesce(1)


def test_single_series(points):
    data = to_chart(points.groupBy("department").sum("payroll").withColumnRenamed("sum(payroll)", "p").orderBy("department"), ChartSpec(ChartType.BAR, "department", "p"))
    assert data.labels == ["Engineering", "Finance"] and data.datasets[0].values == [220.0, 90.0]
    want = '{"type":"bar","data":{"labels":["Engineering","Finance"],"datasets":[{"label":"p","data":[220.0,90.0]}]},"options":{"stacked":false,"percentStacked":false,"nullPointPolicy":"PRESERVE","title":null,"xLabel":null,"yLabel":null}}'
    assert chart.chart_json(data) == want


def test_series_matrix(points):
    spec = ChartSpec(ChartType.BAR, "period", "payroll", "department", sort_labels=True)
    data = to_chart(points, spec)
    assert data.labels == ["2025-01", "2025-02"]
    assert {d.label: d.values for d in data.datasets} == {"Engineering": [120.0, 100.0], "Finance": [90.0, None]}
    zero = to_chart(points, ChartSpec(ChartType.BAR, "period", "payroll", "department", null_points=NullPoints.ZERO, stacked=True, percent_stacked=True))
    assert [round(v, 4) for v in zero.datasets[0].values] == [57.1429, 100.0] and zero.datasets[1].values[1] == 0.0


def test_labels(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 2, 1), 1.0), (None, 2.0), (dt.datetime(2025, 1, 1), 3.0)], "at timestamp_ntz, y double").coalesce(1)
    data = to_chart(df, ChartSpec(ChartType.LINE, "at", "y", date_format="yyyy-MM", sort_labels=True))
    assert data.labels == [None, "2025-01", "2025-02"] and data.datasets[0].values == [2.0, 3.0, 1.0]


def test_bad_specs(points, spark):
    for spec in (
        ChartSpec(ChartType.PIE, "department", "payroll", "period"), ChartSpec(ChartType.BAR, "", "payroll"), ChartSpec(ChartType.LINE, "period", "payroll", "department", stacked=True),
        ChartSpec(ChartType.BAR, "period", "payroll", stacked=True), ChartSpec(ChartType.BAR, "period", "payroll", "department", percent_stacked=True), ChartSpec(ChartType.BAR, "nope", "payroll"), ChartSpec(ChartType.BAR, "period", "department"),
    ):
        with pytest.raises(ValueError):
            to_chart(points, spec)
    with pytest.raises(ValueError, match="null"):
        to_chart(spark.createDataFrame([("a", None)], "x string, y double"), ChartSpec(ChartType.BAR, "x", "y"))


def test_chartjs_payloads(points):
    pie = chartjs(to_chart(points, ChartSpec(ChartType.PIE, "department", "payroll", title="Pay")))
    assert pie["type"] == "pie" and len(pie["data"]["datasets"][0]["backgroundColor"]) == 3 and "scales" not in pie["options"]
    area = chartjs(to_chart(points, ChartSpec(ChartType.AREA, "period", "payroll", "department", stacked=True, percent_stacked=True, colors={"Finance": "#000"}, y_label="Pay")))
    assert area["type"] == "line" and area["data"]["datasets"][1]["borderColor"] == "#000" and area["data"]["datasets"][0]["fill"] is True
    assert area["options"]["scales"]["y"]["max"] == 100 and area["options"]["scales"]["y"]["title"]["text"] == "Pay"
    json.dumps(area)


def test_presets(points, spark):
    data = chart.category_totals("department", Metric.SUM, "payroll").chart(points)
    assert data.labels == ["Engineering", "Finance"]
    assert chart.category_counts("department").rows(points).count() == 2
    assert len(chart.grouped_breakdown("period", "department", Metric.SUM, "payroll").chart(points).datasets) == 2
    dated = spark.createDataFrame([(dt.datetime(2025, 1, 15), 5), (dt.datetime(2025, 2, 1), 7)], "at timestamp_ntz, v int")
    assert chart.time_series_totals("at", "month", Metric.SUM, "v").chart(dated).labels == ["2025-01", "2025-02"]
    assert chart.time_series_counts("at", "week").chart(dated).labels == ["2025-W03", "2025-W05"]
    with pytest.raises(ValueError):
        chart.category_totals("department", Metric.SUM, None)


def test_stats_tables(points):
    t = stats.top_n_by("department", 1, Metric.SUM, "payroll", "total").table(points)
    assert t.totals == {"total": 310}
    assert t.payload()["rows"] == [{"department": "Engineering", "total": 220}]
    assert t.schema.column("total").format_hint == "metric:SUM"
    assert stats.by("department").rows(points).count() == 2 and stats.summary(Metric.MAX, "payroll").rows(points).first()[0] == 120
    with pytest.raises(ValueError):
        stats.top_n_by("department", 0)


def test_schemas(points, spark):
    assert label_of("annualSalary_usd.total") == "Annual Salary Usd Total"
    dated = spark.createDataFrame([(dt.datetime(2025, 1, 15), 5)], "at timestamp_ntz, v int")
    schema = parse("select bucket(at, 'week', 'UTC', 'sunday') as w, avg(v) as mean group by w").schema(dated)
    assert [(c.name, c.type, c.format_hint) for c in schema.columns] == [("w", "string", "time-bucket:WEEK:UTC:SUNDAY"), ("mean", "double", "metric:AVG")]
    assert parse("select v, rank() over (order by v) as r").schema(dated).column("r").format_hint == "window:RANK"
    assert Query.of(dated).time_bucket("at", "day", "d").count("n").schema().names() == ["d", "n"]


def test_reports(points):
    r = Report.sql("select department, sum(payroll) as total group by department order by total desc", ChartSpec(ChartType.BAR, "department", "total"))
    assert r.chart(points).labels == ["Engineering", "Finance"]
    f = Report.fluent(lambda q: q.group("department").metric(Metric.SUM, "payroll", "total").order("total"), Sort.ASC)
    assert [x["department"] for x in f.rows(points).collect()] == ["Finance", "Engineering"]
    with pytest.raises(ValueError):
        f.chart(points)
    with pytest.raises(ValueError, match="joins"):
        Report.fluent(lambda q: q.join(points, "department", "department")).rows(points)
