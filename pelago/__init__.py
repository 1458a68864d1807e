"""PostgreSQL query semantics for Spark DataFrames and SQL."""
