"""Tables from files, Python rows and benchmark reports."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Mapping
from typing import Any, get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.columns import flatten

FORMATS = ("parquet", "orc", "json", "csv", "text", "avro")
# Python types of record fields and the columns they become.
COLUMN_TYPES: dict[Any, T.DataType] = {
    int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), str: T.StringType(),
}


def read(spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | str | None = None, exclude: tuple[str, ...] = (), **options: Any) -> DataFrame:
    """A table with struct fields as dotted columns; ``exclude`` hides columns from queries."""
    if format not in FORMATS:
        raise ValueError(f"Unknown format '{format}'; expected one of {', '.join(FORMATS)}")
    reader = spark.read.format(format).options(**options)
    return flatten((reader.schema(schema) if schema else reader).load(path), exclude)


def from_records(spark: SparkSession, records: Iterable[Any], schema: T.StructType | str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Dataclass instances, mappings or Rows as a table; null records are skipped."""
    rows = [r for r in records if r is not None]
    if schema is None and rows and dataclasses.is_dataclass(rows[0]):
        schema = _struct(type(rows[0]))
    plain = [dataclasses.asdict(r) if dataclasses.is_dataclass(r) else dict(r) if isinstance(r, Mapping) else r for r in rows]
    return flatten(spark.createDataFrame(plain, schema) if schema else spark.createDataFrame(plain), exclude)


def _struct(cls: type) -> T.StructType:
    import datetime as dt

    known = COLUMN_TYPES | {dt.datetime: T.TimestampNTZType(), dt.date: T.DateType()}
    hints, out = get_type_hints(cls), []
    for f in dataclasses.fields(cls):
        kinds = [t for t in getattr(hints[f.name], "__args__", (hints[f.name],)) if t is not type(None)]
        kind = kinds[0]
        out.append(T.StructField(f.name, _struct(kind) if dataclasses.is_dataclass(kind) else known.get(kind, T.StringType())))
    return T.StructType(out)


def read_benchmark_report(spark: SparkSession, path: str) -> DataFrame:
    """A benchmark harness report (a JSON array) as rows: benchmark, mode, params (text),
    score, score_error and unit."""
    metric = "primaryMetric struct<score:double,scoreError:string,scoreUnit:string>"
    df = spark.read.schema(f"benchmark string, mode string, params map<string,string>, {metric}").option("multiLine", True).json(path)
    params = F.array_join(F.array_sort(F.transform(F.map_entries("params"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return df.select("benchmark", "mode", params.alias("params"), F.col("primaryMetric.score").alias("score"), F.col("primaryMetric.scoreError").try_cast("double").alias("score_error"), F.col("primaryMetric.scoreUnit").alias("unit"))
