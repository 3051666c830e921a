"""Named secondary sources and dataset bundles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..errors import QueryError


@dataclass(frozen=True)
class JoinBindings:
    """Secondary sources by name; blank and repeated names raise."""

    frames: dict[str, DataFrame] = field(default_factory=dict)

    def add(self, name: str, frame: DataFrame) -> JoinBindings:
        if not name or not name.strip():
            raise QueryError("source_name", "a join source has no name")
        if name in self.frames:
            raise QueryError("duplicate_source", f"'{name}' is bound twice")
        return JoinBindings({**self.frames, name: frame})

    @staticmethod
    def of(**frames: DataFrame) -> JoinBindings:
        return JoinBindings(dict(frames))


@dataclass(frozen=True)
class DatasetBundle:
    """A primary DataFrame with its join sources, optionally kept in memory."""

    primary: DataFrame
    joins: dict[str, DataFrame] = field(default_factory=dict)

    def persist(self) -> DatasetBundle:
        return DatasetBundle(self.primary.persist(), {n: f.persist() for n, f in self.joins.items()})

    def unpersist(self) -> None:
        for f in (self.primary, *self.joins.values()):
            f.unpersist()
