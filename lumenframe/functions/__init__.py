"""Expressions, predicates and calendar buckets as Catalyst columns."""
