"""Declarative data-quality rules, compiled to one aggregate over the table, and column profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A check: `fails` is true where a row breaks it; `over`, if given, is true for the rows that are counted at all."""

    name: str
    category: str
    severity: str
    fails: Column
    over: Column | None = None


def blank(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column).cast("string")) == "", F.lit(True))


def run_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """name, category, severity, status, failures, denominator, percentage of each rule; one scan and one aggregate.

    A null predicate counts as kept.  status is `pass` without failures, else the severity.  An empty table passes.
    """
    counts = []
    for i, r in enumerate(rules):
        counts.append(F.count_if(r.fails if r.over is None else r.fails & r.over).alias(f"f{i}"))
        counts.append(F.count(F.lit(1)).alias(f"d{i}") if r.over is None else F.count_if(r.over).alias(f"d{i}"))
    lines = [
        F.struct(F.lit(r.name).alias("name"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.col(f"f{i}").alias("failures"), F.col(f"d{i}").alias("denominator"))
        for i, r in enumerate(rules)
    ]
    long = df.agg(*counts).select(F.explode(F.array(*lines)).alias("c")).select("c.*")
    status = F.when(F.col("failures") == 0, "pass").otherwise(F.col("severity"))
    percentage = F.when(F.col("denominator") > 0, F.round(100 * F.col("failures") / F.col("denominator"), 2)).otherwise(0.0)
    return long.withColumns({"status": status, "percentage": percentage})


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """One row (records): the rows whose non-null key occurs more than once; summed by key before anything else."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"))


def profile(df: DataFrame) -> DataFrame:
    """column, type, rows, nulls, null_percentage, distinct of every flat column, in one pass."""
    names = [f.name for f in df.schema.fields]
    measures = []
    for i, c in enumerate(names):
        measures += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}"), F.countDistinct(F.col(f"`{c}`")).alias(f"u{i}")]
    lines = [
        F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type"), F.col("rows"), F.col(f"n{i}").alias("nulls"), F.col(f"u{i}").alias("distinct"))
        for i, c in enumerate(names)
    ]
    long = df.agg(F.count("*").alias("rows"), *measures).select(F.explode(F.array(*lines)).alias("c")).select("c.*")
    return long.withColumn("null_percentage", F.when(F.col("rows") > 0, F.round(100 * F.col("nulls") / F.col("rows"), 2)).otherwise(0.0))
