"""Derived input views, registered queries and their DuckDB counterparts."""
