"""Operators: each a DataFrame -> DataFrame (or Column) building block."""
