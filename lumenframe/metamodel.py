"""Column-name constants generated from a schema."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .operators.columns import flatten


def constants(df: DataFrame, class_name: str) -> str:
    """Python source of a class with one constant a column, nested fields included."""
    if not class_name.isidentifier():
        raise ValueError(f"'{class_name}' is no class name")
    lines, used = [f"class {class_name}:"], set()
    for name in flatten(df).columns:
        base = re.sub(r"\W", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)).upper()
        const, n = base if not base[:1].isdigit() else "_" + base, 2
        while const in used:
            const, n = f"{base}_{n}", n + 1
        used.add(const)
        lines.append(f"    {const} = {name!r}")
    return "\n".join(lines if used else [*lines, "    pass"]) + "\n"
