"""Lumenframe: declarative analytics queries on PySpark, fluent or SQL-like."""

from .computed import ComputedField, ComputedFields
from .errors import ParseError, QueryError
from .fluent import Query, rule
from .functions.buckets import parse_bucket
from .operators.snapshot import SnapshotComparison, SnapshotSummary
from .plans.spec import Bucket, Clause, JoinKind, Metric, OrderKey, Separator, Sort, WindowFunction
from .reports.chart import ChartSpec, ChartType, NullPoints, chartjs, to_chart
from .reports.report import Report
from .runtime import Runtime, configure
from .sources.bindings import DatasetBundle, JoinBindings
from .sources.readers import from_records, read
from .sources.sinks import to_maps, to_objects, write
from .sql.cursor import Cursor
from .sql.query import ParseCache, SqlQuery, Template, parse

__all__ = [
    "Bucket", "ChartSpec", "ChartType", "Clause", "ComputedField", "ComputedFields", "Cursor", "DatasetBundle", "JoinBindings", "JoinKind", "Metric",
    "NullPoints", "OrderKey", "ParseCache", "ParseError", "Query", "QueryError", "Report", "Runtime", "Separator", "SnapshotComparison",
    "SnapshotSummary", "Sort", "SqlQuery", "Template", "WindowFunction", "chartjs", "configure", "from_records", "parse", "parse_bucket", "read", "rule",
    "to_chart", "to_maps", "to_objects", "write",
]
