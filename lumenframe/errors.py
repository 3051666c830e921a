"""Errors with stable codes. A message ends in its code; the code is also an attribute."""

from __future__ import annotations

# The stable code of each kind of failure.
CODES = {
    "query_null": "EQ-SQL-API-001",
    "query_blank": "EQ-SQL-API-002",
    "syntax": "EQ-SQL-PAR-001",
    "query_length": "EQ-SQL-PAR-002",
    "token_limit": "EQ-SQL-PAR-003",
    "clause_limit": "EQ-SQL-PAR-004",
    "unknown_field": "EQ-SQL-VAL-001",
    "duplicate_output": "EQ-SQL-VAL-002",
    "missing_join_source": "EQ-SQL-VAL-003",
    "invalid_join_rows": "EQ-SQL-VAL-004",
    "having_reference": "EQ-SQL-VAL-005",
    "aggregation": "EQ-SQL-VAL-006",
    "computed_select": "EQ-SQL-VAL-007",
    "time_bucket": "EQ-SQL-VAL-008",
    "expression_reference": "EQ-SQL-VAL-009",
    "subquery": "EQ-SQL-VAL-010",
    "ambiguous_field": "EQ-SQL-VAL-011",
    "param_missing": "EQ-SQL-PRM-001",
    "param_unknown": "EQ-SQL-PRM-002",
    "param_unresolved": "EQ-SQL-PRM-003",
    "param_name": "EQ-SQL-PRM-004",
    "param_type": "EQ-SQL-PRM-005",
    "cursor_order": "EQ-SQL-CUR-001",
    "cursor_fields": "EQ-SQL-CUR-002",
    "cursor_token": "EQ-SQL-CUR-003",
    "cursor_value": "EQ-SQL-CUR-004",
    "mixed_order": "EQ-SQL-BIND-001",
    "boolean_size": "EQ-SQL-BIND-002",
    "duplicate_source": "EQ-SQL-JOIN-001",
    "source_name": "EQ-SQL-JOIN-002",
    "alias_projection": "EQ-SQL-RUN-001",
    "expression_identifier": "EQ-SQL-RUN-002",
}


class QueryError(ValueError):
    """A query that cannot run, with the ``code`` of its kind."""

    def __init__(self, kind: str, message: str) -> None:
        self.kind, self.code = kind, CODES[kind]
        super().__init__(f"{message} [{self.code}]")


class ParseError(QueryError):
    """A syntax failure with its place: ``line``, ``column`` and a ``snippet``."""

    def __init__(self, kind: str, message: str, source: str, position: int) -> None:
        before = source[:position]
        self.position, self.line = position, before.count("\n") + 1
        self.column = position - (before.rfind("\n") + 1) + 1
        text = source.split("\n")[self.line - 1] if source else ""
        self.snippet = f"{text}\n{' ' * (self.column - 1)}^"
        super().__init__(kind, f"{message} at line {self.line}, column {self.column}")


def suggestions(name: str, known) -> list[str]:
    """At most three known names that start alike or are within two edits."""

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            diagonal, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
        return row[-1]

    low = name.lower()
    scored = ((distance(low, k.lower()), k) for k in known)
    return [k for d, k in sorted(scored) if d <= 2 or k.lower().startswith(low) or low.startswith(k.lower())][:3]


def unknown_field(name: str, known, clause: str) -> QueryError:
    near = suggestions(name, known)
    hint = f"; close to {', '.join(near)}" if near else ""
    return QueryError("unknown_field", f"{clause} names '{name}', which is no field{hint}")
