"""Registered query plans (``catalog``) and their DuckDB oracle SQL (``oracle``)."""
