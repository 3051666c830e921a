"""Keyset cursors: the ORDER BY values of a row, as an object or an opaque token."""

from __future__ import annotations

import base64
import binascii
import datetime as dt
from dataclasses import dataclass, replace
from decimal import Decimal
from typing import Any
from urllib.parse import quote_plus, unquote_plus

from ..errors import QueryError
from ..plans.spec import Both, Clause, Rule, Separator, Sort
from .syntax import Ast

VERSION = "v1"
INT_RANGE = range(-(1 << 31), 1 << 31)


def _encode(value: Any) -> tuple[str, str]:
    if isinstance(value, bool):
        return "BOOL", str(value).lower()
    if isinstance(value, int):
        return ("INT" if value in INT_RANGE else "LONG" if -(1 << 63) <= value < 1 << 63 else "BIGINT"), str(value)
    if isinstance(value, float):
        return "DOUBLE", repr(value)
    if isinstance(value, Decimal):
        return "BIGDEC", format(value, "f")
    if isinstance(value, dt.datetime):
        at = value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
        return "DATE", str((at - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(milliseconds=1))
    if isinstance(value, str):
        return "STR", value
    raise QueryError("cursor_value", f"a cursor cannot hold a {type(value).__name__}")


def _boolean(text: str) -> bool:
    return text.lower() == "true"


def _date(text: str) -> dt.datetime:
    return dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=int(text))


# The value types of a token.
DECODERS = {
    "STR": str, "BOOL": _boolean, "INT": int, "LONG": int, "SHORT": int, "BYTE": int, "BIGINT": int,
    "DOUBLE": float, "FLOAT": float, "BIGDEC": Decimal, "DATE": _date,
}


@dataclass(frozen=True)
class Cursor:
    """Field values of the row to continue from. Tokens keep milliseconds of dates."""

    values: tuple[tuple[str, Any], ...]

    @staticmethod
    def of(**values: Any) -> Cursor:
        return Cursor(tuple(values.items()))

    @staticmethod
    def at(row, fields: list[str]) -> Cursor:
        """The cursor of a result row."""
        return Cursor(tuple((f, row[f]) for f in fields))

    def token(self) -> str:
        if not self.values:
            raise QueryError("cursor_value", "an empty cursor has no token")
        parts = [VERSION]
        for field, value in self.values:
            kind, text = _encode(value)
            parts.append(f"{quote_plus(field)},{kind},{quote_plus(text)}")
        return base64.urlsafe_b64encode(";".join(parts).encode()).decode().rstrip("=")

    @staticmethod
    def from_token(token: str) -> Cursor:
        bad = lambda why: QueryError("cursor_token", why)
        if not token or not token.strip():
            raise bad("the cursor token is empty")
        try:
            text = base64.b64decode(token + "=" * (-len(token) % 4), altchars=b"-_", validate=True).decode()
        except (binascii.Error, ValueError) as e:
            raise bad("the cursor token does not decode") from e
        head, *entries = text.split(";")
        if head != VERSION or not entries:
            raise bad("the cursor token is of no known version")
        values: dict[str, Any] = {}
        for entry in entries:
            field, kind, value = (entry.split(",", 2) + ["", ""])[:3] if entry.count(",") >= 2 else ("", "", "")
            field = unquote_plus(field)
            if not field.strip():
                raise bad("the cursor token has a broken entry")
            if kind not in DECODERS:
                raise bad(f"the cursor token has a value of unknown type '{kind}'")
            if field in values:
                raise bad(f"the cursor token names '{field}' twice")
            try:
                values[field] = DECODERS[kind](unquote_plus(value))
            except (ValueError, ArithmeticError) as e:
                raise bad(f"the cursor token's value of '{field}' is no {kind}") from e
        return Cursor(tuple(values.items()))


def continue_from(ast: Ast, cursor: Cursor, before: bool = False) -> Ast:
    """``ast`` limited to rows after (or before) the cursor in its ORDER BY.

    Only the comparison depends on the side, the sort does not."""
    if not ast.orders:
        raise QueryError("cursor_order", "a cursor continues a sorted query; add ORDER BY")
    values, fields = dict(cursor.values), [o.field for o in ast.orders]
    if not values:
        raise QueryError("cursor_value", "the cursor holds no values")
    if sorted(values) != sorted(fields):
        raise QueryError("cursor_fields", f"the cursor holds {list(values)}, the query sorts by {fields}")
    if any(v is None for v in values.values()):
        raise QueryError("cursor_value", "a cursor value is null")
    later, tree, equal = None, None, []
    for order in ast.orders:
        up = (order.sort is Sort.ASC) != before
        step = Rule(order.field, Clause.BIGGER if up else Clause.SMALLER, values[order.field])
        later = step
        for e in reversed(equal):
            later = Both(Separator.AND, e, later)
        tree = later if tree is None else Both(Separator.OR, tree, later)
        equal.append(Rule(order.field, Clause.EQUAL, values[order.field]))
    return replace(ast, where=tree if ast.where is None else Both(Separator.AND, ast.where, tree))
