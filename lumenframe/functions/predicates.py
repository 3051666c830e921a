"""Comparison rules as boolean columns.

Predicates are two-valued in effect: null results filter like false. A value that
does not convert to the field's kind makes the predicate false, never an error.
"""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spec import Clause

DEFAULT_DATE_FORMAT = "yyyy-MM-dd HH:mm:ss"
# Patterns whose comparison is a truncation, and its unit.
TRUNCATIONS = {
    "yyyy": "year", "yyyy-MM": "month", "yyyy-MM-dd": "day", "yyyy-MM-dd HH": "hour",
    "yyyy-MM-dd HH:mm": "minute", "yyyy-MM-dd HH:mm:ss": "second",
}
TRUE_WORDS, FALSE_WORDS = frozenset(("true", "1", "yes", "on")), frozenset(("false", "0", "no", "off"))
NEGATED = (Clause.NOT_EQUAL, Clause.NOT_SMALLER, Clause.NOT_BIGGER)


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    return "string"


def as_text(value) -> str:
    """The text form that comparisons with string fields use."""
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def as_number(value):
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return value
    if isinstance(value, Decimal):
        return float(value)
    text = str(value).strip()
    if not re.fullmatch(r"[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?", text):
        return None
    return int(text) if re.fullmatch(r"[-+]?\d+", text) else float(text)


def as_boolean(value):
    if isinstance(value, bool):
        return value
    word = as_text(value).strip().lower()
    return True if word in TRUE_WORDS else False if word in FALSE_WORDS else None


def as_date(value, date_format: str | None) -> Column:
    """A constant timestamp without zone; null where a text does not parse."""
    if isinstance(value, dt.datetime):
        if value.tzinfo:
            value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(value, dt.date):
        return F.lit(value.isoformat()).cast("timestamp_ntz")
    text = as_text(value)
    return F.try_to_timestamp(F.lit(text), F.lit(date_format or DEFAULT_DATE_FORMAT)).cast("timestamp_ntz")


def _compare(left: Column, clause: Clause, right) -> Column:
    match clause:
        case Clause.EQUAL | Clause.IN:
            return left == right
        case Clause.NOT_EQUAL:
            return left != right
        case Clause.BIGGER:
            return left > right
        case Clause.BIGGER_EQUAL | Clause.NOT_SMALLER:
            return left >= right
        case Clause.SMALLER:
            return left < right
        case Clause.SMALLER_EQUAL | Clause.NOT_BIGGER:
            return left <= right
    return F.lit(False)


def _single(column: Column, dtype: T.DataType, clause: Clause, value, date_format: str | None) -> Column:
    kind = kind_of(dtype)
    if kind == "number":
        number = as_number(value)
        return F.lit(False) if number is None else _compare(column, clause, F.lit(number))
    if kind == "boolean":
        truth = as_boolean(value)
        if truth is None or clause not in (Clause.EQUAL, Clause.NOT_EQUAL, Clause.IN):
            return F.lit(False)
        return _compare(column, clause, F.lit(truth))
    if kind == "date":
        when, at = as_date(value, date_format), column if isinstance(dtype, T.TimestampNTZType) else column.cast("timestamp_ntz")
        if date_format in TRUNCATIONS:
            unit = TRUNCATIONS[date_format]
            at, when = F.date_trunc(unit, at), F.date_trunc(unit, when)
        elif date_format:
            pattern = F.lit(date_format)
            at, when = (F.try_to_timestamp(F.date_format(c, date_format), pattern) for c in (at, when))
        return _compare(at, clause, when)
    text = as_text(value)
    if clause is Clause.CONTAINS:
        return column.contains(text)
    if clause is Clause.MATCHES:
        return column.rlike(rf"\A(?:{text})\z")
    if clause in (Clause.EQUAL, Clause.NOT_EQUAL, Clause.IN):
        return _compare(column, clause, F.lit(text))
    return F.lit(False)  # strings have no order here


def predicate(column: Column, dtype: T.DataType, clause: Clause, value, grouped: bool = False, date_format: str | None = None) -> Column:
    """``column <clause> value``. ``grouped``: a null field satisfies NOT_EQUAL, as it does
    inside rule groups and AND/OR trees, but not in a flat rule list."""
    if value is None:
        return column.isNull() if clause is Clause.EQUAL else column.isNotNull() if clause is Clause.NOT_EQUAL else F.lit(False)
    if isinstance(value, dict):
        value = list(value.values())
    if isinstance(value, (list, tuple, set, frozenset)):
        items = [v for v in value if v is not None]
        if clause in (Clause.EQUAL, Clause.IN) and kind_of(dtype) in ("number", "string"):
            convert = as_number if kind_of(dtype) == "number" else as_text
            known = [c for c in map(convert, items) if c is not None]
            return column.isin(known) if known else F.lit(False)
        parts = [_single(column, dtype, clause, v, date_format) for v in items]
        if clause in NEGATED:
            out = reduce(lambda a, b: a & b, parts, F.lit(True))
            out = out & column.isNotNull() if not grouped else out
        else:
            return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)
    else:
        out = _single(column, dtype, clause, value, date_format)
    return out | column.isNull() if grouped and clause is Clause.NOT_EQUAL else out
