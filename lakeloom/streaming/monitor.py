"""Numbered micro-batches of a table with threshold alerts, and a monitor of arriving JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.sources.tables import checkpointed


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with `position` from 1 in the given total order, without one task seeing all rows: rows are range-partitioned
    once, numbered within their partition, and shifted by the counts of the partitions before."""
    parts = checkpointed(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))  # one row a partition
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__shift"))
    return parts.withColumn("__row", within).join(F.broadcast(shift), "__part").withColumn("position", F.col("__row") + F.col("__shift")).select(*df.columns, "position")


def batch_metrics(rows: DataFrame, size: int, missing: dict[str, F.Column], averages: tuple[str, ...] = (), year: str | None = None, key: str | None = None) -> DataFrame:
    """batch_id, first and last position, records (distinct keys, if key is given) and, for each name in missing, how many
    rows it holds for and their rate; with `averages` avg_<name> of columns, with `year` its range and the simulated
    event time of the batch, the first of January of its first year."""
    if size <= 0:
        raise ValueError("the batch size must be positive")
    batches = rows.withColumn("batch_id", F.floor((F.col("position") - 1) / size))
    counts = [F.count_if(c).alias(f"missing_{n}") for n, c in missing.items()] + [F.avg(c).alias(f"avg_{c}") for c in averages]
    counts += [F.min(year).alias("first_year"), F.max(year).alias("last_year")] if year else []
    records = F.countDistinct(key) if key else F.count("*")
    out = batches.groupBy("batch_id").agg(F.min("position").alias("first_position"), F.max("position").alias("last_position"), records.alias("records"), *counts)
    out = out.withColumn("event_time", F.try_make_timestamp(F.col("first_year").cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))) if year else out
    return out.withColumns({f"{n}_rate": F.try_divide(f"missing_{n}", "records") for n in missing})


def alerts(metrics: DataFrame, thresholds: dict[str, tuple[float, str]]) -> DataFrame:
    """batch_id, alert_type, observed_value, threshold, severity wherever a rate is over (not at) its threshold."""
    lines = [
        F.when(F.col(f"{n}_rate") > t, F.struct(F.lit(n).alias("alert_type"), F.col(f"{n}_rate").alias("observed_value"), F.lit(t).alias("threshold"), F.lit(s).alias("severity")))
        for n, (t, s) in thresholds.items()
    ]
    return metrics.select("batch_id", F.explode(F.array_compact(F.array(*lines))).alias("a")).select("batch_id", "a.*")


def watch_files(spark, folder: str, schema, checkpoint: str, sink) -> None:
    """Read the JSON files that arrived in folder since the last call, with their names, and give each batch to
    sink(rows, batch_id); the checkpoint remembers what was read, so each file is read once."""
    stream = spark.readStream.schema(schema).json(folder).select("*", F.col("_metadata.file_name").alias("file_name"))
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def file_metrics(rows: DataFrame) -> DataFrame:
    """Records, missing titles and authors, and year range of each file_name."""
    return rows.groupBy("file_name").agg(
        F.count("*").alias("records"), F.count_if(F.coalesce(F.trim("title") == "", F.lit(True))).alias("missing_titles"),
        F.count_if(F.coalesce(F.size("authorships") <= 0, F.lit(True))).alias("missing_authors"), F.min("publication_year").alias("first_year"), F.max("publication_year").alias("last_year"),
    )


def arrivals(spark, folder: str, schema, checkpoint: str, ready: bool = True) -> dict:
    """One look at the folder: status `blocked` where the environment is not ready, `empty` where no file waits (no job is
    started then), else `success`, with the metrics of the files that arrived since the last look and their totals."""
    report = {"status": "blocked", "file_count": 0, "record_count": 0, "missing_title_rate": 0.0, "missing_author_rate": 0.0, "files": []}
    if not ready:
        return report
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(hadoop) if s.isFile()] if system.exists(hadoop) else []
    if not [n for n in names if n.endswith((".json", ".jsonl"))]:
        return {**report, "status": "empty"}
    files: list[dict] = []
    watch_files(spark, folder, schema, checkpoint, lambda rows, batch: files.extend(r.asDict() for r in file_metrics(rows).orderBy("file_name").collect()))  # a row a file
    n = sum(f["records"] for f in files)
    rates = {f"missing_{k}_rate": sum(f[f"missing_{k}s"] for f in files) / n if n else 0.0 for k in ("title", "author")}
    return {"status": "success", "file_count": len(files), "record_count": n, **rates, "files": files}
