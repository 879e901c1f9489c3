"""A persistent nearest-neighbour index of texts: unit TF-IDF vectors kept as postings, searched exactly by cosine.

The index is a folder of Parquet tables: `vocabulary` (token, idf), `postings` (token, doc_id, weight) and `documents`,
with a text file `metadata`.  A search joins the terms of its queries with the postings; no vector is ever dense.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.text import STOP_WORDS, collapse, smoothed_idf
from lakeloom.operators.retrieval import ranked, small
from lakeloom.sources.reports import write_json, write_parquet
from lakeloom.sources.tables import checkpointed

MAX_FEATURES = 20_000
#: The names of back ends that a caller may ask for.
BACKENDS = ("auto", "chroma", "faiss", "sklearn_tfidf_fallback")


def backend(wanted: str) -> str:
    """The back end that serves a request: always this index, whichever known name is asked for; others are an error."""
    if wanted.strip().lower() not in BACKENDS:
        raise ValueError(f"no such back end: {wanted!r}")
    return "postings"


def index_tokens(text: Column, stop_words: tuple[str, ...] = tuple(STOP_WORDS)) -> Column:
    """Lower-case runs of two or more letters, digits and underscores of any script that are no stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(sorted(set(stop_words))))


def build(docs: DataFrame, folder: str, max_features: int = MAX_FEATURES, stop_words: tuple[str, ...] = tuple(STOP_WORDS)) -> dict:
    """Write the index of docs (doc_id, text and any other columns) and return its metadata.

    Rows with a null doc_id or a null or blank text are left out; doc_id is a key.  The vocabulary is the `max_features`
    tokens that occur most often, ties by token, so its broadcast is bounded.  A text without a token of the vocabulary
    is among `documents` but has no postings; an empty table gives an empty index with status `empty`.
    """
    spark = docs.sparkSession
    given = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"(?U)\S"))
    tokens = given.select("doc_id", F.explode_outer(index_tokens(F.col("text"), stop_words)).alias("token")).where("token is not null")
    counts = checkpointed(tokens.groupBy("doc_id", "token").agg(F.count("*").alias("tf")))
    n = given.count()
    chosen = counts.groupBy("token").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "token").limit(max_features)
    write_parquet(chosen.select("token", smoothed_idf(F.lit(n), F.col("df")).alias("idf")), f"{folder}/vocabulary")
    vocabulary = spark.read.parquet(f"{folder}/vocabulary")
    raw = counts.join(F.broadcast(vocabulary), "token").select("doc_id", "token", (F.col("tf") * F.col("idf")).alias("w"))
    norms = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    write_parquet(raw.join(norms, "doc_id").select("token", "doc_id", (F.col("w") / F.col("norm")).alias("weight")), f"{folder}/postings")
    write_parquet(given.drop("text"), f"{folder}/documents")
    metadata = {"status": "success" if n else "empty", "backend": backend("auto"), "document_count": n, "vocabulary_size": vocabulary.count(), "max_features": max_features}
    write_json(spark, metadata, f"{folder}/metadata")
    return metadata


def metadata(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/metadata", wholetext=True).first()["value"])


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int | None = 10, stop_words: tuple[str, ...] = tuple(STOP_WORDS)) -> DataFrame:
    """query_id, doc_id, score, rank: the `k` documents (all if None) of positive cosine with each query (query_id, text).

    Exact.  Queries with a null or blank text, or with no token of the vocabulary, find nothing; ties go to the smaller doc_id.
    """
    vocabulary, postings = (spark.read.parquet(f"{folder}/{name}") for name in ("vocabulary", "postings"))
    tf = queries.select("query_id", F.explode(index_tokens(collapse(F.col("text")), stop_words)).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("tf"))
    terms = checkpointed(tf.join(F.broadcast(vocabulary), "token").select("query_id", "token", (F.col("tf") * F.col("idf")).alias("w")))
    norms = terms.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    hits = postings.join(small(terms, terms.count()), "token").groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("w")).alias("dot"))
    found = ranked(hits.join(norms, "query_id").select("query_id", "doc_id", (F.col("dot") / F.col("norm")).alias("score")))
    return found.where(F.col("rank") <= k) if k else found
