"""Registered computed fields: named numeric expressions over other fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.expressions import compile_expression, identifiers
from .operators.columns import col

INTEGERS = ("byte", "short", "int", "long", "tinyint", "smallint", "integer", "bigint")


@dataclass(frozen=True)
class ComputedField:
    """``name`` = ``expression`` as ``dtype`` (a Spark type name; integers round half up)."""

    name: str
    expression: str
    dtype: str = "double"

    def __post_init__(self) -> None:
        if not self.name or not self.name.strip() or not self.expression or not self.expression.strip():
            raise ValueError("A computed field needs a name and an expression")


@dataclass(frozen=True)
class ComputedFields:
    """An immutable registry; a field may use others, in any order of registration."""

    fields: tuple[ComputedField, ...] = ()

    def add(self, name: str, expression: str, dtype: str = "double") -> ComputedFields:
        if any(f.name == name for f in self.fields):
            raise ValueError(f"Computed field '{name}' is already registered")
        return ComputedFields((*self.fields, ComputedField(name, expression, dtype)))

    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def applicable(self, columns: list[str]) -> list[ComputedField]:
        """Definitions whose inputs exist, in an order that respects their dependencies."""
        known, todo, out = set(columns), list(self.fields), []
        waiting = {f.name for f in todo}
        while True:
            ready = [f for f in todo if all(i in known and (i not in waiting or i == f.name) for i in identifiers(f.expression))]
            ready = ready or [f for f in todo if all(i in known for i in identifiers(f.expression))][:1]
            if not ready:
                return out
            for f in ready:
                out.append(f)
                todo.remove(f)
                known.add(f.name)
                waiting.discard(f.name)


def apply_computed(df: DataFrame, registry: ComputedFields, strict: bool = False) -> DataFrame:
    """``df`` with every applicable field; one whose inputs are missing is left out."""
    for f in registry.applicable(df.columns):
        value = compile_expression(f.expression, col, strict)
        if f.dtype in INTEGERS:
            value = F.floor(value + 0.5)
        df = df.withColumn(f.name, value.cast(f.dtype))
    return df
