"""Registered queries: each takes (spark, folder) and returns a DataFrame; SQL holds their DuckDB equivalents."""
