"""A runtime: shared options of many queries, with presets for common uses."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from .computed import ComputedFields
from .fluent import Query
from .sql.query import ParseCache, SqlQuery, parse
from .telemetry import tell

# Session settings that results and plans rely on.
SESSION = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Sets what queries rely on; cluster sizes are the deployment's business."""
    for k, v in SESSION.items():
        spark.conf.set(k, v)
    return spark


@dataclass(frozen=True)
class Runtime:
    strict_types: bool = False
    lint: bool = False
    cache: ParseCache = field(default_factory=ParseCache)
    computed: ComputedFields | None = None
    listeners: tuple = ()

    @staticmethod
    def dev() -> Runtime:
        return Runtime(strict_types=True, lint=True)

    @staticmethod
    def prod() -> Runtime:
        return Runtime(strict_types=False, lint=False, cache=ParseCache(entries=1024))

    @staticmethod
    def test() -> Runtime:
        return Runtime(strict_types=True, lint=True, cache=ParseCache(enabled=False))

    def with_(self, **changes) -> Runtime:
        return replace(self, **changes)

    def parse(self, text: str) -> SqlQuery:
        q = replace(parse(text, self.cache), registry=self.computed, listeners=self.listeners)
        tell(self.listeners, "parse", "sql-like", text)
        return q.strict_types() if self.strict_types else q

    def query(self, source: DataFrame) -> Query:
        q = Query.of(source)
        q = q.computed(self.computed) if self.computed else q
        for listener in self.listeners:
            q = q.telemetry(listener)
        return q
