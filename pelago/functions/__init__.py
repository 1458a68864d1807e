"""Typed scalar functions, operators and casts over Spark columns."""
