"""Registered queries over the given tables, each with an equivalent DuckDB statement where one exists."""
