"""Term statistics and TF-IDF of documents (doc_id, text, ...) in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.text import corpus_tokens, smoothed_idf
from lakeloom.sources.tables import checkpointed


def term_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, kept columns, token, tf of the tokens of each document; documents without tokens give no rows.

    `outer` here and elsewhere: otherwise the optimizer first asks which texts have tokens, which cuts each text twice."""
    return docs.select("doc_id", *keep, F.explode_outer(corpus_tokens(F.col("text"))).alias("token")).where("token is not null").groupBy("doc_id", *keep, "token").agg(F.count("*").alias("tf"))


def terms_global(docs: DataFrame) -> DataFrame:
    """token, tf, df, idf and tf * idf over the corpus; one shuffle by (document, token), one by token."""
    size = docs.agg(F.count("*").alias("n"))
    by_token = term_counts(docs).groupBy("token").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
    rows = by_token.crossJoin(F.broadcast(size)).withColumn("idf", smoothed_idf(F.col("n"), F.col("df")))
    return rows.select("token", "tf", "df", "idf", (F.col("tf") * F.col("idf")).alias("tfidf"))


def build_documents(rows: DataFrame, abstracts: DataFrame, language: str | None = None) -> DataFrame:
    """paper_id, title, publication_year, language, abstract_text, document_text (title and abstract, trimmed) of rows with
    their abstracts (paper_id, abstract_text), of one language if it is given; a missing part leaves the other."""
    found = rows.join(abstracts, "paper_id", "left")
    found = found.where(F.col("language") == language) if language else found
    text = F.trim(F.concat_ws(" ", "title", "abstract_text"))
    return found.select("paper_id", "title", "publication_year", "language", "abstract_text", text.alias("document_text"))


def terms_by_topic(docs: DataFrame, topics: DataFrame) -> DataFrame:
    """topic_name, token, tf, df: a document counts once for each of its topics (doc_id, topic_name)."""
    return term_counts(docs).join(topics, "doc_id").groupBy("topic_name", "token").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


def cluster_terms(docs: DataFrame, clusters: DataFrame, top: int = 10) -> DataFrame:
    """cluster, token, tf, rank of the `top` tokens of each cluster (doc_id, cluster), ties by token."""
    counted = term_counts(docs).join(clusters, "doc_id").groupBy("cluster", "token").agg(F.sum("tf").alias("tf"))
    order = Window.partitionBy("cluster").orderBy(F.desc("tf"), "token")
    return counted.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)


def representatives(papers: DataFrame, clusters: DataFrame, top: int = 5) -> DataFrame:
    """cluster, paper_id, publication_year, title, rank: the earliest papers of each cluster, ties by title, then id."""
    order = Window.partitionBy("cluster").orderBy("publication_year", "title", "paper_id")
    return papers.join(clusters, "paper_id").withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster").agg(F.count("*").alias("size"))


def terms_by_group(docs: DataFrame, group: str) -> DataFrame:
    """group, token, tf, df within each group."""
    return term_counts(docs, group).groupBy(group, "token").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


def top_terms(docs: DataFrame, group: str, top: int = 10) -> DataFrame:
    """The `top` tokens of each group by tf, then token."""
    order = Window.partitionBy(group).orderBy(F.desc("tf"), "token")
    return terms_by_group(docs, group).withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)


def doc_tfidf(docs: DataFrame) -> DataFrame:
    """doc_id, token, tf, df, idf, tfidf: the sparse document-term matrix.  Counts are written once for both of their uses."""
    counts = checkpointed(term_counts(docs))
    size = docs.agg(F.count("*").alias("n"))
    idf = counts.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size)).select("token", "df", smoothed_idf(F.col("n"), F.col("df")).alias("idf"))
    return counts.join(idf, "token").select("doc_id", "token", "tf", "df", "idf", (F.col("tf") * F.col("idf")).alias("tfidf"))
