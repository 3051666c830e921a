"""Results as Python values or files."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row

MAX_ROWS = 1_000_000  # rows that a sink brings to the driver; more belong in a table


def bounded(df: DataFrame, most: int = MAX_ROWS) -> Iterator[Row]:
    """Rows one partition at a time; an error beyond ``most`` instead of a full driver."""
    for n, row in enumerate(df.toLocalIterator()):
        if n >= most:
            raise ValueError(f"the result has more than {most} rows; write it, or read it with iterate")
        yield row


def to_objects(df: DataFrame, make: Callable[..., Any]) -> list[Any]:
    """``make(**fields)`` of every row; fields that a dataclass lacks are skipped, and
    those the row lacks are None."""
    if dataclasses.is_dataclass(make):
        wanted = [f.name for f in dataclasses.fields(make)]
        df = df.select(*[c for c in df.columns if c in set(wanted)])
        return [make(**{w: (r[w] if w in df.columns else None) for w in wanted}) for r in bounded(df)]
    return [make(**r.asDict()) for r in bounded(df)]


def to_maps(df: DataFrame, schema=None) -> list[dict[str, Any]]:
    """Rows as dicts, in the schema's column order if given."""
    names = [c.name for c in schema.columns] if schema else df.columns
    return [{n: (r[n] if n in df.columns else None) for n in names} for r in bounded(df)]


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options: Any) -> None:
    """Writes a result where it lies, without the driver."""
    writer = df.write.format(format).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write(df, path, "csv", mode, header=True)
