"""Logical query plans and their compilation to DataFrames."""
