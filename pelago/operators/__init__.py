"""Relational operators over DataFrames with PostgreSQL scopes."""
