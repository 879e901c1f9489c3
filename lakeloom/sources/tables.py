"""Reading tables, cutting lineage, and the publication-shaped views of the order tables that the queries run over."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared folder of spark.checkpoint.dir; a temporary one where it is unset, as in tests.

    It is written as Parquet and read again, which takes a part of the space of rows and reads only the columns in use."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lakeloom-"))
    path, schema = f"{context.getCheckpointDir()}/{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def papers(spark: SparkSession, folder: str) -> DataFrame:
    """paper_id, publication_year, cited_by_count: an order stands for a publication, its price for its citations."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("paper_id"),
        F.year("o_orderdate").cast("bigint").alias("publication_year"),
        F.floor("o_totalprice").cast("bigint").alias("cited_by_count"),
    )


def authorships(spark: SparkSession, folder: str) -> DataFrame:
    """paper_id, author_id: the suppliers of an order."""
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author_id")).distinct()


def topics(spark: SparkSession, folder: str) -> DataFrame:
    """paper_id, topic_name, topic_field: type and brand of the parts of an order."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("p_partkey"))
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_type").alias("topic_name"), F.col("p_brand").alias("topic_field"))
    return lines.join(parts, "p_partkey").select("paper_id", "topic_name", "topic_field").distinct()


def citations(spark: SparkSession, folder: str) -> DataFrame:
    """paper_id, referenced_paper_id: parts (even ids) to suppliers (odd ids), and back where a line was returned."""
    lines = table(spark, folder, "lineitem").select((F.col("l_partkey") * 2).alias("p"), (F.col("l_suppkey") * 2 + 1).alias("s"), "l_returnflag")
    back = lines.where("l_returnflag = 'R'").select("s", "p")
    return lines.select("p", "s").union(back).distinct().toDF("paper_id", "referenced_paper_id")


#: The same views in DuckDB's SQL, by name.
VIEWS = {
    "papers": "SELECT o_orderkey AS paper_id, year(o_orderdate)::BIGINT AS publication_year, floor(o_totalprice)::BIGINT AS cited_by_count FROM orders",
    "authorships": "SELECT DISTINCT l_orderkey AS paper_id, l_suppkey AS author_id FROM lineitem",
    "topics": "SELECT DISTINCT l_orderkey AS paper_id, p_type AS topic_name, p_brand AS topic_field FROM lineitem JOIN part ON l_partkey = p_partkey",
    "citations": "SELECT DISTINCT l_partkey * 2 AS paper_id, l_suppkey * 2 + 1 AS referenced_paper_id FROM lineitem UNION "
    "SELECT DISTINCT l_suppkey * 2 + 1, l_partkey * 2 FROM lineitem WHERE l_returnflag = 'R'",
}


def with_views(names: str, body: str) -> str:
    """SQL body after a WITH clause of the named views; body may go on with more clauses after a leading comma."""
    head = "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names.split())
    return f"{head}{body}" if body.startswith(",") else f"{head} {body}"
