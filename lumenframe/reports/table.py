"""Tabular schemas: ordered output columns with labels, types and format hints."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.buckets import describe
from ..plans.spec import QuerySpec


@dataclass(frozen=True)
class TabularColumn:
    name: str
    label: str
    type: str
    order: int
    format_hint: str | None = None


@dataclass(frozen=True)
class TabularSchema:
    columns: tuple[TabularColumn, ...]

    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, name: str) -> TabularColumn | None:
        return next((c for c in self.columns if c.name == name), None)


def label_of(name: str) -> str:
    """``annualSalary_usd`` -> ``Annual Salary Usd``."""
    spaced = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", re.sub(r"[._]", " ", name))
    return " ".join(w[0].upper() + w[1:] for w in spaced.split())


def schema_of(spec: QuerySpec, result: DataFrame) -> TabularSchema:
    """The schema of a plan's result; hints tell metrics, time buckets and windows."""
    hints = {m.alias: f"metric:{m.metric.name}" for m in spec.metrics}
    hints |= {g.alias: f"time-bucket:{describe(g.bucket)}" for g in spec.groups if g.bucket}
    hints |= {w.alias: f"window:{w.function.name}" for w in spec.windows}
    hints |= {o.name: hints[o.source] for o in spec.outputs if o.source in hints}
    hints |= {o.name: f"time-bucket:{describe(o.bucket)}" for o in spec.outputs if o.bucket}
    fields = enumerate(result.schema.fields)
    return TabularSchema(tuple(TabularColumn(f.name, label_of(f.name), f.dataType.simpleString(), i, hints.get(f.name)) for i, f in fields))
