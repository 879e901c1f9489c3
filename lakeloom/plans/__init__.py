"""The registered queries and, where SQL can express them, their DuckDB equivalents."""

from importlib import import_module

QUERIES, ORACLE_SQL = {}, {}
for _name in ("publications", "corpus", "records", "mart", "index"):
    _part = import_module(f"lakeloom.plans.{_name}")
    QUERIES.update(_part.QUERIES)
    ORACLE_SQL.update(_part.ORACLE_SQL)
