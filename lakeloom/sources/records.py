"""Publication records as JSON lines, made of the order tables by one SQL text that Spark and DuckDB both run.

Some records are malformed on purpose, by the number of the order: blank or repeated ids, wrong shapes, bad dates.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources.tables import table

BASE = "https://records.example/"
#: How DuckDB joins strings of a group in order of line; Spark gathers and sorts the lines of an order once for all lists.
DUCK_LIST = "string_agg({x}, ',' ORDER BY l_linenumber, l_partkey, l_suppkey)"
_LINE = ("l_linenumber", "l_partkey", "l_suppkey", "p_size", "p_type", "p_brand")
_LINES = {
    "refs": f"""'"{BASE}W' || l_partkey || '"'""",
    "signed": f"""'{{"author":{{"id":' || CASE WHEN l_linenumber = 3 THEN 'null' ELSE '"{BASE}A' || l_suppkey || '"' END || ',"display_name":"Supplier ' || l_suppkey || '"}}}}'""",
    "about": f"""'{{"id":' || CASE WHEN p_size = 7 THEN 'null' ELSE '"{BASE}T' || p_size || '"' END || ',"display_name":"' || p_type || '","domain":{{"display_name":"Goods"}},"field":{{"display_name":"' || p_brand || '"}}}}'""",
}
#: Field and its JSON, with k the number of the order; a field whose JSON is '' is absent.
_FIELDS = {
    "id": f"""CASE WHEN k % 97 = 0 THEN 'null' WHEN k % 89 = 0 THEN '"bad ' || k || '"' WHEN k % 29 = 0 THEN '"{BASE}W' || (k - 1) || '"' ELSE '"{BASE}W' || k || '"' END""",
    "doi": """CASE k % 5 WHEN 0 THEN 'null' WHEN 1 THEN '"10.1000/AB' || k || '"' WHEN 2 THEN '"https://doi.org/10.1000/Ab' || k || '"' WHEN 3 THEN '"doi:10.1000/' || k || '"' ELSE '" "' END""",
    "title": """CASE k % 11 WHEN 0 THEN 'null' WHEN 1 THEN '"  "' ELSE '"  ' || o_orderpriority || ': Order,  No. ' || k || ' "' END""",
    "display_name": """CASE WHEN k % 22 = 0 THEN '"Fallback ' || k || '"' ELSE 'null' END""",
    "publication_date": """CASE k % 13 WHEN 0 THEN '"2024-13-01"' WHEN 1 THEN 'null' WHEN 2 THEN '"2999-01-01"' ELSE '"' || CAST(CAST(o_orderdate AS DATE) AS STRING) || '"' END""",
    "publication_year": """CASE WHEN k % 31 = 0 THEN 'null' ELSE CAST(year(o_orderdate) + CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END AS STRING) END""",
    "type": """'"' || o_orderstatus || '"'""",
    "cited_by_count": """CASE WHEN k % 37 = 0 THEN '-1' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END""",
    "language": """CASE k % 3 WHEN 0 THEN '"en"' WHEN 1 THEN '"de"' ELSE 'null' END""",
    "abstract_inverted_index": """CASE WHEN k % 4 = 0 THEN 'null' WHEN k % 41 = 0 THEN '{"a":[-1]}' ELSE '{"order":[0,2],"number":[1]}' END""",
    "referenced_works": f"""CASE WHEN k % 43 = 0 THEN '{{}}' WHEN refs IS NULL THEN '[]' WHEN k % 7 = 0 THEN '[' || refs || ',"{BASE}W' || k || '"]' ELSE '[' || refs || ']' END""",
    "authorships": """CASE WHEN k % 47 = 0 THEN '{"x":1}' WHEN k % 19 = 0 OR signed IS NULL THEN '[]' ELSE '[' || signed || ']' END""",
    "primary_location": f"""CASE WHEN k % 53 = 0 THEN '[]' WHEN k % 6 = 0 THEN 'null' ELSE '{{"source":{{"id":"{BASE}S' || o_orderpriority || '","display_name":"' || o_orderpriority || '"}}}}' END""",
    "locations": """CASE WHEN k % 59 = 0 THEN '{}' ELSE '[]' END""",
    "concepts": """CASE WHEN k % 61 = 0 THEN '"x"' ELSE '[{"id":"C' || (k % 30) || '","display_name":"concept ' || (k % 30) || '","level":1,"score":0.5}]' END""",
    "topics": """CASE WHEN k % 67 = 0 THEN '{}' WHEN about IS NULL THEN '[]' ELSE '[' || about || ']' END""",
    "open_access": """CASE WHEN k % 71 = 0 THEN '"open"' ELSE '{"is_oa":true}' END""",
}
EXPECTED = [*_FIELDS, "grants"]


def _gathered(x: str) -> str:
    """The texts x of the lines of an order, joined; null if there are none."""
    return f"nullif(array_join(transform(lines, e -> {re.sub('|'.join(_LINE), lambda m: f'e.{m[0]}', x)}), ','), '')"


def records_sql(joined: str | None = None) -> str:
    """SELECT k, value over lineitem, part and orders: with joined, as DUCK_LIST, for DuckDB, else for Spark."""
    each = ((name, joined.format(x=x) if joined else _gathered(x)) for name, x in _LINES.items())
    lists = ", ".join(f"{sql} AS {name}" for name, sql in each)
    grouped = f"SELECT l_orderkey AS k, {lists} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey"
    if not joined:
        grouped = f"SELECT k, {lists} FROM (SELECT l_orderkey AS k, sort_array(collect_list(struct({', '.join(_LINE)}))) AS lines FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"
    body = " || ',' || ".join(f"""'"{name}":' || {sql}""" for name, sql in _FIELDS.items())
    extra = """CASE WHEN k % 73 = 0 THEN ',"note":"x"' ELSE '' END"""
    return f"""SELECT k, '{{' || {body} || {extra} || '}}' AS value FROM (SELECT o_orderkey AS k, o_orderpriority, o_orderdate, o_orderstatus, o_totalprice FROM orders) o
  LEFT JOIN ({grouped}) l USING (k)"""


def record_lines(spark: SparkSession, folder: str) -> DataFrame:
    """value: one JSON record a row."""
    tables = {n: table(spark, folder, n) for n in ("orders", "lineitem", "part")}
    sql = records_sql()
    for name in tables:
        for before in ("FROM ", "JOIN "):
            sql = sql.replace(f"{before}{name} ", f"{before}{{{name}}} ").replace(f"{before}{name})", f"{before}{{{name}}})")
    return spark.sql(_escaped(sql, tables), **tables).select("k", "value")


def _escaped(sql: str, tables: dict) -> str:
    """sql for spark.sql's own formatting: every brace doubled but for those around the tables' names."""
    out = sql.replace("{", "{{").replace("}", "}}")
    for name in tables:
        out = out.replace(f"{{{{{name}}}}}", f"{{{name}}}")
    return out


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of JSON-lines files that are not blank, unparsed."""
    return spark.read.text(path).where(F.trim("value") != "")
