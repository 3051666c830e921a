"""Relational building blocks used by the plan compiler."""
