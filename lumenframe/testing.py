"""Helpers for tests of queries: results compared as bags or lists, and parity checks."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame

from .sources.sinks import bounded


def _plain(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if isinstance(value, list):
        return tuple(map(_plain, value))
    return value


def rows_of(df: DataFrame) -> list[tuple]:
    return [tuple(_plain(v) for v in r) for r in bounded(df)]


def assert_rows(df: DataFrame, expected: list[tuple], ordered: bool = False, columns: list[str] | None = None) -> None:
    """The result has these columns and rows; order counts only if asked for."""
    if columns is not None and df.columns != columns:
        raise AssertionError(f"columns {df.columns}, expected {columns}")
    got, want = rows_of(df), [tuple(_plain(v) for v in r) for r in expected]
    if (got != want) if ordered else (Counter(map(repr, got)) != Counter(map(repr, want))):
        raise AssertionError(f"rows\n{got}\nexpected\n{want}")


def assert_same(a: DataFrame, b: DataFrame, ordered: bool = False) -> None:
    """Two ways to write a query agree."""
    assert_rows(a, rows_of(b), ordered, b.columns)


class Fixture:
    """A named source with queries that are kept as a regression suite."""

    def __init__(self, source: DataFrame) -> None:
        self.source, self.cases = source, []

    def case(self, name: str, query: Callable[[DataFrame], DataFrame], expected: list[tuple], ordered: bool = False) -> Fixture:
        self.cases.append((name, query, expected, ordered))
        return self

    def run(self) -> None:
        for name, query, expected, ordered in self.cases:
            try:
                assert_rows(query(self.source), expected, ordered)
            except AssertionError as e:
                raise AssertionError(f"{name}: {e}") from e


class Snapshots:
    """Results kept as JSON files of a folder: columns, and rows as a bag or in order.

    A result without a file is an error unless ``update`` is set; then files are written."""

    def __init__(self, folder: str, update: bool = False) -> None:
        self.folder, self.update = Path(folder), update

    def check(self, name: str, df: DataFrame, ordered: bool = False) -> None:
        rows = [[repr(v) for v in r] for r in rows_of(df)]
        now = {"columns": df.columns, "rows": rows if ordered else sorted(rows)}
        file = self.folder / f"{name}.json"
        if self.update:
            self.folder.mkdir(parents=True, exist_ok=True)
            file.write_text(json.dumps(now, indent=1) + "\n", encoding="utf-8")
        elif not file.exists():
            raise AssertionError(f"no snapshot of '{name}' in {self.folder}")
        elif (then := json.loads(file.read_text(encoding="utf-8"))) != now:
            gone, new = ([r for r in a["rows"] if r not in b["rows"]][:5] for a, b in ((then, now), (now, then)))
            raise AssertionError(f"'{name}' differs from its snapshot\ncolumns {then['columns']} then, {now['columns']} now\ngone {gone}\nnew {new}")
