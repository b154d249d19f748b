"""Derived inputs, registered queries and their DuckDB counterparts."""
