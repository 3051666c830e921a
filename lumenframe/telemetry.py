"""Query telemetry: events with row counts, gathered by the job that runs anyway."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

# The event stage of every plan stage.
STAGES = {"source": "BIND", "join": "BIND", "where": "FILTER", "aggregate": "AGGREGATE", "having": "AGGREGATE", "window": "AGGREGATE", "qualify": "FILTER", "order": "ORDER", "project": "PROJECT", "parse": "PARSE", "chart": "CHART"}


@dataclass(frozen=True)
class TelemetryEvent:
    """A stage of a query. ``rows()`` waits for the job that runs the query."""

    stage: str
    step: str
    query_type: str
    source: str | None = None
    counter: Observation | None = field(default=None, compare=False)

    def rows(self) -> int | None:
        return self.counter.get["rows"] if self.counter else None


Listener = Callable[[TelemetryEvent], Any]


def tell(listeners: tuple[Listener, ...], step: str, query_type: str, source: str | None = None) -> None:
    """An event without rows of its own: a text was parsed, a chart was drawn."""
    for listener in listeners:
        listener(TelemetryEvent(STAGES[step], step, query_type, source))


def observe(query_type: str, listeners: tuple[Listener, ...], source: str | None = None) -> Callable[[str, DataFrame], DataFrame]:
    """A stage hook that counts rows on the side (no extra job) and tells the listeners.

    Nothing is counted behind a sort: an observation there would keep a limit from
    becoming a top-k."""

    def hook(step: str, df: DataFrame) -> DataFrame:
        counter = None
        if step not in ("order", "project"):
            counter = Observation()
            df = df.observe(counter, F.count(F.lit(1)).alias("rows"))
        event = TelemetryEvent(STAGES[step], step, query_type, source, counter)
        for listener in listeners:
            listener(event)
        return df

    return hook
