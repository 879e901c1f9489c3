"""The feature mart: one wide row a publication, of the outputs of the other operators, and its coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns that each part gives, and the flags that say whether it has the publication.
PUBLICATION = (
    "paper_id paper_openalex_id doi title publication_date publication_year document_type language cited_by_count reference_count author_count "
    "concept_count topic_count abstract_available quality_flag_count"
).split()
DEGREES = ["out_degree_full", "out_degree_in_sample", "in_degree_in_sample"]
RANKING = ["rank", "composite_score", "citation_count_component", "recency_component"]
YEARLY = ["year_publication_count", "year_citations_per_publication", "publication_count_yoy_growth"]
FLAGS = {"has_text_document": "document_char_count", "has_cluster_assignment": "cluster", "has_ml_prediction": "high_citation_prediction", "has_composite_rank": "rank"}


def text_sizes(texts: DataFrame) -> DataFrame:
    """paper_id, document_char_count, document_word_count of texts (paper_id, document_text), one row a paper."""
    text = F.coalesce("document_text", F.lit(""))
    words = F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))
    return texts.groupBy("paper_id").agg(F.max(F.struct(F.length(text).alias("c"), words.alias("w"))).alias("s")).select("paper_id", F.col("s.c").alias("document_char_count"), F.col("s.w").alias("document_word_count"))


def feature_mart(publications: DataFrame, texts: DataFrame, clusters: DataFrame, degrees: DataFrame, labels: DataFrame, predictions: DataFrame, ranking: DataFrame, yearly: DataFrame) -> DataFrame:
    """34 columns for each row of publications; parts are joined by paper_id, one row a paper each, the years by broadcast.

    Missing sizes, degrees and flag counts are 0; other values that a part does not have stay null, and its flag says so.
    """
    parts = [
        text_sizes(texts), clusters.select("paper_id", "cluster"), degrees.select("paper_id", *DEGREES), labels.select("paper_id", F.col("label").alias("high_citation_label")),
        predictions.select("paper_id", F.col("prediction").alias("high_citation_prediction")), ranking.select("paper_id", *RANKING),
    ]
    base = publications.withColumn("quality_flag_count", F.size("quality_flags")).select(*PUBLICATION)
    rows = reduce(lambda left, right: left.join(right, "paper_id", "left"), parts, base).join(F.broadcast(yearly.select("publication_year", *YEARLY)), "publication_year", "left")
    rows = rows.withColumns({flag: F.col(c).isNotNull() for flag, c in FLAGS.items()})
    return rows.fillna(0, ["document_char_count", "document_word_count", *DEGREES, "quality_flag_count"])


def coverage(mart: DataFrame) -> DataFrame:
    """One row: rows, the share of each flag (0 for an empty mart), and the average words of a document."""
    n = F.greatest(F.count("*"), F.lit(1))
    shares = [(F.count_if(flag) / n).alias(flag.replace("has_", "") + "_coverage") for flag in FLAGS]
    return mart.agg(F.count("*").alias("row_count"), *shares, (F.coalesce(F.sum("document_word_count"), F.lit(0)) / n).alias("average_words"))
