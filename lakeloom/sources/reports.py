"""Writers: Parquet and CSV tables, JSON and Markdown reports, on any file system that Spark reaches."""

from __future__ import annotations

import json
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession

MOST_ROWS = 1000  # of a table in a Markdown report; more are refused, never cut off


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    """df as Parquet in place of what is at path."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """df as CSV with a header in place of what is at path; nulls are empty, empty strings are quoted."""
    df.write.mode("overwrite").option("emptyValue", '""').csv(path, header=True)
    return path


def write_text(spark: SparkSession, text: str, path: str) -> str:
    """One text file, in a folder, in place of what is at path."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def write_json(spark: SparkSession, payload: dict, path: str) -> str:
    """payload as indented JSON with sorted keys; dates as ISO text."""
    return write_text(spark, json.dumps(payload, indent=2, sort_keys=True, default=lambda x: x.isoformat() if isinstance(x, date | datetime) else str(x)), path)


def cell(value) -> str:
    return "" if value is None else str(value).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")


def markdown(title: str, sections: dict[str, dict | DataFrame | str], on: date | None = None) -> str:
    """A report: under each heading a list of names and values, a table of a frame of at most MOST_ROWS rows, or a text."""
    lines = [f"# {title}", "", f"Generated on {(on or date.today()).isoformat()}.", ""]
    for heading, body in sections.items():
        lines += [f"## {heading}", ""]
        if isinstance(body, dict):
            lines += [f"- {name}: {cell(value)}" for name, value in body.items()]
        elif isinstance(body, DataFrame):
            rows = body.limit(MOST_ROWS + 1).collect()
            if len(rows) > MOST_ROWS:
                raise ValueError(f"{heading}: more than {MOST_ROWS} rows; write a table instead")
            lines += ["| " + " | ".join(map(cell, body.columns)) + " |", "|" + " --- |" * len(body.columns)]
            lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows]
        else:
            lines.append(body)
        lines.append("")
    return "\n".join(lines)


def write_markdown(spark: SparkSession, title: str, sections: dict[str, dict | DataFrame | str], path: str, on: date | None = None) -> str:
    return write_text(spark, markdown(title, sections, on), path)
