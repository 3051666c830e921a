"""Numeric expressions as text, compiled to double columns.

Grammar: + - * / with the usual precedence, unary signs, parentheses, numbers, field
names (dots allowed) and abs, round (half even), floor, ceil, ceiling of one argument.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError

_TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*(?:\.\w+)*)|(?P<op>[-+*/(),]))")
NEAR_ZERO = 1e-12

FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs,
    "round": F.rint,
    "floor": lambda c: F.floor(c).cast("double"),
    "ceil": lambda c: F.ceil(c).cast("double"),
    "ceiling": lambda c: F.ceil(c).cast("double"),
}


def is_expression(text: str) -> bool:
    """True for anything but a plain field name."""
    return re.fullmatch(r"[A-Za-z_]\w*(?:\.\w+)*", text.strip()) is None


def tokens(text: str) -> list[tuple[str, str]]:
    out, at, end = [], 0, len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError("expression_reference", f"Unexpected character in expression '{text}' at {at}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def identifiers(text: str) -> list[str]:
    """Field names of an expression in order, functions left out."""
    found = tokens(text)
    names = [t for (k, t), nxt in zip(found, [*found[1:], ("", "")]) if k == "name" and nxt[1] != "("]
    return list(dict.fromkeys(names))


def compile_expression(text: str, resolve: Callable[[str], Column], strict: bool = False) -> Column:
    """The expression as a double column; ``strict`` raises on nulls and divisors near zero."""
    found, at = tokens(text), 0

    def peek() -> str:
        return found[at][1] if at < len(found) else ""

    def take(wanted: str | None = None) -> tuple[str, str]:
        nonlocal at
        if at >= len(found) or (wanted and found[at][1] != wanted):
            raise QueryError("expression_reference", f"Malformed expression '{text}'")
        at += 1
        return found[at - 1]

    def total() -> Column:
        left = product()
        while peek() in ("+", "-"):
            left = left + product() if take()[1] == "+" else left - product()
        return left

    def product() -> Column:
        left = signed()
        while peek() in ("*", "/"):
            if take()[1] == "*":
                left = left * signed()
            else:
                right = signed()
                left = left / (F.when(F.abs(right) < NEAR_ZERO, F.raise_error(F.lit(f"division by zero in '{text}'"))).otherwise(right) if strict else right)
        return left

    def signed() -> Column:
        if peek() in ("+", "-"):
            return signed() if take()[1] == "+" else -signed()
        kind, word = take()
        if kind == "num":
            return F.lit(float(word))
        if word == "(":
            inner = total()
            take(")")
            return inner
        if kind != "name":
            raise QueryError("expression_reference", f"Malformed expression '{text}'")
        if peek() == "(":
            if word.lower() not in FUNCTIONS:
                raise QueryError("expression_reference", f"Unknown function '{word}' in '{text}'")
            take("(")
            inner = total()
            take(")")
            return FUNCTIONS[word.lower()](inner)
        value = resolve(word).cast("double")
        return F.when(value.isNull(), F.raise_error(F.lit(f"'{word}' is not a number in '{text}'"))).otherwise(value) if strict else value

    out = total()
    if at != len(found):
        raise QueryError("expression_reference", f"Malformed expression '{text}'")
    return out
