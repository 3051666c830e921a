"""Comparison of two snapshots of a table by key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import col, flatten


@dataclass(frozen=True)
class SnapshotSummary:
    current_rows: int
    previous_rows: int
    added: int
    removed: int
    changed: int
    unchanged: int

    @property
    def net_row_delta(self) -> int:
        return self.current_rows - self.previous_rows


@dataclass(frozen=True)
class SnapshotComparison:
    """``current`` against ``previous``; keys must be unique, and null only if allowed."""

    current: DataFrame
    previous: DataFrame
    key: str
    allow_null_keys: bool = False
    check_keys: bool = True

    def _flat(self, df: DataFrame, side: str) -> DataFrame:
        df = flatten(df)
        if self.key not in df.columns:
            raise ValueError(f"Unknown snapshot key '{self.key}' in {side} rows")
        return df

    def rows(self) -> DataFrame:
        """A row a key: key, key_text, change, changed_field_count, changed_field_summary,
        current and previous (structs). One aggregate over both sides, no join and no sort:
        order as you need. Duplicate and null keys raise an error where the rows are read."""
        now, then = self._flat(self.current, "current"), self._flat(self.previous, "previous")
        fields = list(dict.fromkeys([*now.columns, *then.columns]))
        whole = lambda df: F.struct(*[col(c).alias(c) for c in df.columns])
        none = lambda df: F.lit(None).cast(df.select(whole(df).alias("s")).schema["s"].dataType)
        a = now.select(col(self.key).alias("key"), whole(now).alias("current"), none(then).alias("previous"))
        b = then.select(col(self.key).alias("key"), none(now).alias("current"), whole(then).alias("previous"))
        sides = ("current", "previous")
        both = a.union(b).groupBy("key").agg(*[F.first(n, ignorenulls=True).alias(n) for n in sides], *[F.count(n).alias(f"__{n}") for n in sides])
        if self.check_keys:
            text = F.coalesce(F.col("key").cast("string"), F.lit("null"))
            for n in sides:
                twice = F.concat(F.lit("Duplicate snapshot key '"), text, F.lit(f"' in {n} rows"))
                bad = F.when(F.col(f"__{n}") > 1, F.raise_error(twice)).otherwise(F.col(n))
                if not self.allow_null_keys:
                    bad = F.when((F.col(f"__{n}") > 0) & F.col("key").isNull(), F.raise_error(F.lit(f"Null snapshot key in {n} rows"))).otherwise(bad)
                both = both.withColumn(n, bad)
        side = lambda name, df, c: F.col(f"{name}.`{c}`") if c in df.columns else F.lit(None)
        names = F.array(*[F.when(~side("current", now, c).eqNullSafe(side("previous", then, c)), F.lit(c)) for c in fields])
        changed = F.filter(names, lambda n: n.isNotNull())
        here, there = F.col("current").isNotNull(), F.col("previous").isNotNull()
        both = both.withColumn("__changed", F.when(here & there, changed).otherwise(F.array().cast("array<string>")))
        change = F.when(here & ~there, "ADDED").when(~here, "REMOVED").when(F.size("__changed") > 0, "CHANGED").otherwise("UNCHANGED")
        return both.select(
            "key", F.coalesce(F.col("key").cast("string"), F.lit("null")).alias("key_text"), change.alias("change"),
            F.size("__changed").alias("changed_field_count"), F.array_join("__changed", ",").alias("changed_field_summary"), "current", "previous",
        )

    def summary(self) -> SnapshotSummary:
        """Counts of every kind, in one aggregate."""
        kinds = ("ADDED", "REMOVED", "CHANGED", "UNCHANGED")
        row = self.rows().agg(*[F.count_if(F.col("change") == k) for k in kinds]).first()
        added, removed, changed, same = row
        return SnapshotSummary(added + changed + same, removed + changed + same, added, removed, changed, same)
