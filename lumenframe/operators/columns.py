"""Column access by exact name; flattened names hold dots and need quoting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DEPTH = 8


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def flatten(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Struct fields as dotted columns (at most 8 levels deep); arrays, maps and binary stay.

    ``exclude`` names columns or dotted fields that queries must not see."""
    hidden, out = set(exclude), []

    def walk(path: list[str], dtype: T.DataType) -> None:
        name = ".".join(path)
        if name in hidden or path[-1] in hidden:
            return
        if isinstance(dtype, T.StructType) and len(path) < MAX_DEPTH:
            for f in dtype.fields:
                walk([*path, f.name], f.dataType)
        elif not isinstance(dtype, T.StructType):
            out.append(F.col(".".join(map(quoted, path))).alias(name))

    if not hidden and not any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        return df
    for f in df.schema.fields:
        walk([f.name], f.dataType) if "." not in f.name else out.append(col(f.name))
    return df.select(*out)


def find(name: str, columns: list[str], ignore_case: bool = False) -> str | None:
    """The exact column, or (for ORDER BY) the one that differs in case only."""
    if name in columns:
        return name
    return next((c for c in columns if c.lower() == name.lower()), None) if ignore_case else None
