"""Queries over documents, embeddings and events: terms, retrieval, quality, monitoring, learning; each with its SQL
where it has one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.text import STOP_WORDS, collapse, inverted, rebuild
from lakeloom.operators import dense, learning, quality, retrieval, terms
from lakeloom.plans.publications import paper_features, rounded
from lakeloom.sources.tables import checkpointed, table, with_views
from lakeloom.streaming import monitor

BATCH = 250
CANDIDATES, ALPHAS, EXPECTED = 50, [0.1, 0.3], ["en", "de", "web"]


def documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "source", "lang")


def benchmark(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def terms_global(spark, d):
    return rounded(terms.terms_global(documents(spark, d)), "idf", "tfidf")


def terms_by_source(spark, d):
    return terms.terms_by_group(documents(spark, d), "source")


def top_terms_by_source(spark, d):
    return terms.top_terms(documents(spark, d), "source")


def doc_tfidf(spark, d):
    return rounded(terms.doc_tfidf(documents(spark, d)), "idf", "tfidf")


def abstract_roundtrip(spark, d):
    """Words inverted to token -> positions and rebuilt, each text within its row."""
    words = documents(spark, d).select("doc_id", F.split(collapse(F.col("text")), " ").alias("words")).where("words is not null")
    index = words.select("doc_id", inverted(F.col("words")).alias("m"))
    return index.select("doc_id", F.size("m").cast("bigint").alias("tokens"), F.md5(rebuild(F.col("m")).cast("binary")).alias("text_md5"))


def sparse_rank(spark, d):
    return rounded(retrieval.sparse_rank(documents(spark, d), benchmark(spark, d)), "score")


def bm25_all(spark, d):
    return retrieval.ranked(retrieval.bm25(documents(spark, d), benchmark(spark, d)))


def bm25(spark, d):
    return rounded(bm25_all(spark, d).where("rank <= 10"), "score")


def dense_all(spark, d):
    """Documents by the embedding of their number, queries by that of theirs."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    vectors = v.join(documents(spark, d).select("doc_id").where("doc_id is not null"), v["vec_id"] == F.col("doc_id"), "left_semi").select(F.col("vec_id").alias("doc_id"), F.col("e").alias("v"))
    queries = v.join(F.broadcast(benchmark(spark, d).select("query_id")), v["vec_id"] == F.col("query_id")).select("query_id", F.col("e").alias("q"))
    return retrieval.ranked(dense.cosine(vectors, queries))


def similar_vectors(spark, d):
    """All embeddings (doc_id, v, label) and, as queries (query_id, q, label), those whose number 100 divides."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), "label")
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("e").alias("q"), "label")
    return v.select(F.col("vec_id").alias("doc_id"), F.col("e").alias("v"), "label"), queries


def dense_rank(spark, d):
    vectors, queries = similar_vectors(spark, d)
    return rounded(retrieval.ranked(dense.best(vectors, queries, 10)).where("rank <= 10"), "score")


def prior(spark, d):
    return table(spark, d, "labels").groupBy(F.col("doc_id")).agg(F.max("quality").cast("double").alias("prior"))


def hybrid_all(spark, d):
    return retrieval.ranked(retrieval.fuse([bm25_all(spark, d), dense_all(spark, d)]))


def rrf(spark, d):
    return rounded(hybrid_all(spark, d), "score")


def titled(spark, d):
    """Documents with their first line as title."""
    return documents(spark, d).withColumn("title", F.substring_index("text", "\n", 1))


def reranked(spark, d):
    return retrieval.rerank(hybrid_all(spark, d), titled(spark, d), benchmark(spark, d), prior(spark, d), CANDIDATES)


def rerank(spark, d):
    return rounded(reranked(spark, d), "score")


def graph_blend(spark, d):
    return rounded(retrieval.blend(reranked(spark, d), prior(spark, d), 0.2), "score")


def retrieval_metrics(spark, d):
    """Dense retrieval of embeddings, whole rankings, relevant being those with the same label."""
    return rounded(retrieval.evaluate_by_label(*similar_vectors(spark, d)), "precision", "recall", "mrr", "ndcg", "ap")


def relevance(spark, d):
    """Documents whose language and source, as a topic name, hold what the query expects."""
    topics = documents(spark, d).select("doc_id", F.concat_ws(" ", F.upper("lang"), "source").alias("topic_name"))
    expected = benchmark(spark, d).select("query_id", F.element_at(F.array(*map(F.lit, EXPECTED)), (F.col("query_id") % len(EXPECTED) + 1).cast("int")).alias("expected"))
    return retrieval.relevant_by_topics(topics, expected)


def system_metrics(spark, d):
    """system, query_id and its measures for BM25, dense, fused, reranked and each blend, and for the best blend of each query."""
    found = {"bm25": bm25_all(spark, d), "dense": dense_all(spark, d)}
    bm, dense_ranks = (rows.select(F.lit(name).alias("system"), "query_id", "doc_id", "rank") for name, rows in found.items())
    relevant = checkpointed(relevance(spark, d))
    wanted, hit = checkpointed(relevant.groupBy("query_id").agg(F.count("*").alias("wanted"))), F.coalesce("hit", F.lit(0)).alias("hit")
    # whole rankings meet the relevant documents once; all that is made of them carries the hit along
    marked = bm.union(dense_ranks).join(relevant.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    marked = checkpointed(marked.select("system", "query_id", "doc_id", "rank", hit))
    fused = retrieval.fused(marked, 60, F.max("hit").alias("hit"))
    fused = checkpointed(retrieval.ranked(fused))
    again = checkpointed(retrieval.rerank(fused, titled(spark, d), benchmark(spark, d), prior(spark, d), CANDIDATES))
    hits = fused.where(F.col("rank") <= CANDIDATES).select("query_id", "doc_id", "hit")
    short = {"hybrid_reranked": again, **{f"graph_alpha_{a:g}": retrieval.blend(again, prior(spark, d), a) for a in ALPHAS}}
    rows = [marked, fused.select(F.lit("hybrid_rrf").alias("system"), *marked.columns[1:])]
    rows += [r.join(hits, ["query_id", "doc_id"]).select(F.lit(name).alias("system"), *marked.columns[1:]) for name, r in short.items()]
    out = reduce(DataFrame.union, [retrieval.measures(r, wanted, 10, "system") for r in rows])
    out = checkpointed(out)
    best = retrieval.best_alpha(out.where(F.col("system").startswith("graph_alpha_")))
    return out.unionByName(out.join(best, ["query_id", "system"]).withColumn("system", F.lit("hybrid_reranked_graph")))


def retrieval_systems(spark, d):
    return rounded(system_metrics(spark, d), "precision", "recall", "mrr", "ndcg", "ap")


def ablation(spark, d):
    return system_metrics(spark, d).groupBy("system").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])


def error_analysis(spark, d):
    """The best system of each query by NDCG, ties to the first name."""
    named = system_metrics(spark, d).where(~F.col("system").startswith("graph_alpha_"))
    return named.groupBy("query_id").agg(F.min_by("system", F.struct(-F.round("ndcg", 9), F.col("system"))).alias("best_system"), F.round(F.max("ndcg"), 6).alias("best_ndcg"))


def precision_retrieved(spark, d):
    return rounded(retrieval.precision_over_retrieved(retrieval.sparse_rank(documents(spark, d), benchmark(spark, d)), relevance(spark, d), 10), "precision")


def demo_query(spark, d):
    found = retrieval.excerpt(reranked(spark, d), documents(spark, d), 5)
    return rounded(found.where("query_id = 1"), "score")


def quality_checks(spark, d):
    ok = F.col("text").isNotNull()
    rules = [
        quality.Rule("missing_ids", "identity", "error", F.col("doc_id").isNull()),
        quality.Rule("missing_texts", "text", "warn", quality.blank("text")),
        quality.Rule("missing_language", "metadata", "warn", quality.blank("lang")),
        quality.Rule("missing_source", "metadata", "warn", quality.blank("source")),
        quality.Rule("wrong_length", "text", "error", F.length("text") != F.col("n_chars"), ok),
        quality.Rule("short_texts", "text", "warn", F.length("text") < 100, ok),
    ]
    return quality.run_rules(table(spark, d, "documents"), rules)


def profile_columns(spark, d):
    return quality.profile(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"))


def batches(spark, d):
    rows = monitor.numbered(table(spark, d, "events").select("ts", "event_id", "event_type", "value"), "ts", "event_id")
    return monitor.batch_metrics(rows, BATCH, {"purchase": F.col("event_type") == "purchase", "value": F.col("value") < 10})


def microbatch_metrics(spark, d):
    return rounded(batches(spark, d), "purchase_rate", "value_rate")


def microbatch_alerts(spark, d):
    return rounded(monitor.alerts(batches(spark, d), {"purchase": (0.2, "critical"), "value": (0.1, "warning")}), "observed_value")


FEATURES = ["reference_count", "author_count", "topic_count"]


def ml_features(spark, d):
    return learning.citation_features(paper_features(spark, d), FEATURES)


def logistic_eval(spark, d):
    return learning.logistic(ml_features(spark, d), [*FEATURES, "year_index"])


def kmeans_select(spark, d):
    return learning.kmeans_select(learning.tfidf_vectors(documents(spark, d)).persist(), [4, 8])[0]


def word2vec_dense(spark, d):
    return learning.word_vectors(documents(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        terms_global, terms_by_source, top_terms_by_source, doc_tfidf, abstract_roundtrip, sparse_rank, bm25, dense_rank, rrf, rerank, graph_blend, retrieval_metrics, ablation,
        retrieval_systems, error_analysis, precision_retrieved, demo_query, relevance,
        quality_checks, profile_columns, microbatch_metrics, microbatch_alerts, ml_features, logistic_eval, kmeans_select, word2vec_dense,
    )
}

_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))


def _words(pattern: str, numbers: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower(text), '{pattern}', ' ', 'g'), ' '), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}) AND NOT regexp_matches(w, '{numbers}'))"


ASCII, ANY = _words("[^a-z0-9]+", "^[0-9]+$"), _words("[^\\p{L}\\p{N}]+", "^\\p{N}+$")
COUNTS = f"""counts AS (SELECT doc_id, source, token, count(*) AS tf FROM (SELECT doc_id, source, unnest({ASCII}) AS token FROM documents) GROUP BY ALL)"""
GLOBAL = f"""{COUNTS}, lexicon AS (SELECT *, tf * idf AS tfidf FROM (SELECT token, sum(tf)::BIGINT AS tf, count(*) AS df,
  ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM counts GROUP BY token))"""
GROUPED = f"{COUNTS}, grouped AS (SELECT source, token, sum(tf)::BIGINT AS tf, count(*) AS df FROM counts GROUP BY 1, 2)"
MATRIX = f"{GLOBAL}, matrix AS (SELECT c.doc_id, c.token, c.tf, g.df, g.idf, c.tf * g.idf AS tfidf FROM counts c JOIN lexicon g USING (token))"
TERMS = f"qt AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({ANY}) AS token FROM benchmark) GROUP BY ALL)"


def _ranked(name: str, source: str, top: int | None = 10) -> str:
    limit = f" WHERE rank <= {top}" if top else ""
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ({source})){limit})"


SPARSE = f"{MATRIX}, {TERMS}, " + _ranked("sparse", "SELECT query_id, doc_id, sum(qtf * tfidf) AS score, count(*) AS matched_terms FROM matrix JOIN qt USING (token) GROUP BY 1, 2")
BEST = f"""toks AS (SELECT doc_id, {ANY} AS words FROM documents), lens AS (SELECT doc_id, len(words) AS n FROM toks),
btf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS token FROM toks) GROUP BY ALL),
bdf AS (SELECT token, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM btf GROUP BY 1), """ + _ranked(
    "best",
    """SELECT * FROM (SELECT query_id, doc_id, sum(qtf * (idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / (SELECT avg(n) FROM lens))))) AS score
  FROM btf JOIN qt USING (token) JOIN bdf USING (token) JOIN lens USING (doc_id) GROUP BY 1, 2) WHERE score > 0""",
)
PRIOR = "prior AS (SELECT doc_id, max(quality)::DOUBLE AS prior FROM labels GROUP BY 1)"
DENSE = _ranked(
    "dense",
    """SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
  FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0) WHERE score > 0""",
    None,
)
BEST_ALL = BEST.replace(" WHERE rank <= 10)", ")")
BY_VECTOR = _ranked(
    "byvec",
    """SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
  FROM embeddings v, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND v.vec_id IN (SELECT doc_id FROM documents)) WHERE score > 0""",
    None,
)
HYBRID = f"{TERMS}, {BEST_ALL}, {BY_VECTOR}, " + _ranked("fused", "SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM best UNION ALL SELECT query_id, doc_id, rank FROM byvec) GROUP BY 1, 2", None)
_TITLE = ANY.replace("lower(text)", "lower(coalesce(split_part(text, chr(10), 1), ''))")
AGAIN = f"""{HYBRID}, {PRIOR}, q AS (SELECT item_id AS query_id, list_distinct({ANY}) AS wanted FROM benchmark), titles AS (SELECT doc_id, {_TITLE} AS head FROM documents), """ + _ranked(
    "again",
    f"""SELECT query_id, doc_id, score + 0.1::DOUBLE * len(list_intersect(list_distinct(coalesce(words, [])), wanted)) / greatest(len(wanted), 1) + 0.05::DOUBLE * len(list_intersect(list_distinct(head), wanted)) / greatest(len(wanted), 1)
  + 0.05::DOUBLE * coalesce(prior, 0) AS score FROM fused JOIN toks USING (doc_id) JOIN titles USING (doc_id) JOIN q USING (query_id) LEFT JOIN prior USING (doc_id) WHERE rank <= {CANDIDATES}""",
    None,
)


def _blend(name: str, a: float) -> str:
    return _ranked(name, f"SELECT query_id, doc_id, {1 - a!r}::DOUBLE * score / max(score) OVER (PARTITION BY query_id) + {a!r}::DOUBLE * coalesce(prior, 0) AS score FROM again LEFT JOIN prior USING (doc_id)", None)


_WANTS = "CASE item_id % 3 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(EXPECTED)) + " END"
RELEVANT = f"rel AS (SELECT DISTINCT item_id AS query_id, doc_id FROM documents, benchmark WHERE contains(lower(concat_ws(' ', upper(lang), source)), {_WANTS}))"


def _metrics(source: str) -> str:
    """SELECT of the measures of rows (system, query_id, doc_id, rank) against rel."""
    return f"""SELECT system, query_id, sum(hit) FILTER (rank <= 10) / 10.0::DOUBLE AS precision, coalesce(sum(hit) FILTER (rank <= 10)::DOUBLE / any_value(wanted), 0) AS recall, coalesce(1.0::DOUBLE / min(rank) FILTER (hit = 1), 0) AS mrr,
  coalesce(sum(hit / log2(rank + 1)) FILTER (rank <= 10) / nullif(list_sum(list_transform(range(1, least(sum(hit), 10)::BIGINT + 1), lambda i: 1 / log2(i + 1))), 0), 0) AS ndcg,
  coalesce(sum(hit * hits / rank::DOUBLE) FILTER (rank <= 10) / nullif(sum(hit) FILTER (rank <= 10), 0), 0) AS ap
  FROM (SELECT *, sum(hit) OVER (PARTITION BY system, query_id ORDER BY rank) AS hits FROM (SELECT s.system, s.query_id, rank, (r.doc_id IS NOT NULL)::INT AS hit FROM ({source}) s LEFT JOIN rel r USING (query_id, doc_id)))
  LEFT JOIN (SELECT query_id, count(*) AS wanted FROM rel GROUP BY 1) USING (query_id) GROUP BY 1, 2"""


_BLENDS = {f"graph_alpha_{a:g}": f"blend{i}" for i, a in enumerate(ALPHAS)}
_LISTS = {"bm25": "best", "dense": "byvec", "hybrid_rrf": "fused", "hybrid_reranked": "again", **_BLENDS}
SYSTEMS = (
    f"{AGAIN}, " + ", ".join(_blend(f"blend{i}", a) for i, a in enumerate(ALPHAS)) + f", {RELEVANT}, m0 AS MATERIALIZED (" + _metrics(" UNION ALL ".join(f"SELECT '{s}' AS system, query_id, doc_id, rank FROM {n}" for s, n in _LISTS.items())) + """),
metrics AS (SELECT * FROM m0 UNION ALL SELECT * REPLACE ('hybrid_reranked_graph' AS system) FROM m0 WHERE starts_with(system, 'graph_') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(ndcg, 9) DESC, m0.system) = 1)"""
)
_ROUND = "* REPLACE (round(precision, 6) AS precision, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, round(ap, 6) AS ap)"
METRICS = f"""{DENSE}, rel AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id FROM embeddings v JOIN embeddings q USING (label) WHERE q.vec_id % 100 = 0),
metrics AS (""" + _metrics("SELECT 'dense' AS system, query_id, doc_id, rank FROM dense") + ")"
BATCHES = f"""b AS (SELECT (position - 1) // {BATCH} AS batch_id, * FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS position FROM events)),
m AS (SELECT batch_id, min(position) AS first_position, max(position) AS last_position, count(*) AS records, count(*) FILTER (event_type = 'purchase') AS missing_purchase,
  count(*) FILTER (value < 10) AS missing_value, missing_purchase / records AS purchase_rate, missing_value / records AS value_rate FROM b GROUP BY 1)"""
_RULES = [
    ("missing_ids", "identity", "error", "doc_id IS NULL", "true"),
    ("missing_texts", "text", "warn", "coalesce(trim(text) = '', true)", "true"),
    ("missing_language", "metadata", "warn", "coalesce(trim(lang) = '', true)", "true"),
    ("missing_source", "metadata", "warn", "coalesce(trim(source) = '', true)", "true"),
    ("wrong_length", "text", "error", "length(text) <> n_chars", "text IS NOT NULL"),
    ("short_texts", "text", "warn", "length(text) < 100", "text IS NOT NULL"),
]

ORACLE_SQL = {
    "terms_global": f"WITH {GLOBAL} SELECT token, tf, df, round(idf, 6) AS idf, round(tfidf, 6) AS tfidf FROM lexicon",
    "terms_by_source": f"WITH {GROUPED} SELECT * FROM grouped",
    "top_terms_by_source": f"WITH {GROUPED} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY tf DESC, token) AS rank FROM grouped) WHERE rank <= 10",
    "doc_tfidf": f"WITH {MATRIX} SELECT doc_id, token, tf, df, round(idf, 6) AS idf, round(tfidf, 6) AS tfidf FROM matrix",
    "abstract_roundtrip": r"""WITH w AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(list_distinct(string_split(t, ' '))) AS tokens, md5(t) AS text_md5 FROM w WHERE t <> ''""",
    "sparse_rank": f"WITH {SPARSE} SELECT query_id, doc_id, round(score, 6) AS score, matched_terms, rank FROM sparse",
    "bm25": f"WITH {TERMS}, {BEST} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM best",
    "dense_rank": f"WITH {DENSE} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM dense WHERE rank <= 10",
    "rrf": f"WITH {HYBRID} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM fused",
    "rerank": f"WITH {AGAIN} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM again",
    "graph_blend": f"WITH {AGAIN}, {_blend('blended', 0.2)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM blended",
    "retrieval_metrics": f"WITH {METRICS} SELECT {_ROUND.replace('* REPLACE', '* EXCLUDE (system) REPLACE')} FROM metrics",
    "retrieval_systems": f"WITH {SYSTEMS} SELECT {_ROUND} FROM metrics",
    "ablation": f"WITH {SYSTEMS} SELECT system, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM metrics GROUP BY 1",
    "error_analysis": f"WITH {SYSTEMS} SELECT query_id, system AS best_system, round(ndcg, 6) AS best_ndcg FROM metrics WHERE NOT starts_with(system, 'graph_alpha_') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(ndcg, 9) DESC, system) = 1",
    "precision_retrieved": f"WITH {SPARSE}, {RELEVANT} SELECT query_id, round(avg((r.doc_id IS NOT NULL)::INT), 6) AS precision FROM sparse s LEFT JOIN rel r USING (query_id, doc_id) GROUP BY 1",
    "demo_query": f"WITH {AGAIN} SELECT query_id, doc_id, round(score, 6) AS score, rank, substr(coalesce(text, ''), 1, 300) AS excerpt FROM again JOIN documents USING (doc_id) WHERE query_id = 1 AND rank <= 5",
    "relevance": f"WITH {RELEVANT} SELECT * FROM rel",
    "quality_checks": "SELECT *, CASE WHEN failures = 0 THEN 'pass' ELSE severity END AS status, CASE WHEN denominator > 0 THEN round(100 * failures / denominator, 2) ELSE 0 END AS percentage FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS name, '{c}' AS category, '{s}' AS severity, count(*) FILTER (({p}) AND {o}) AS failures, count(*) FILTER ({o}) AS denominator FROM documents" for n, c, s, p, o in _RULES)
    + ")",
    "profile_columns": "SELECT *, CASE WHEN rows > 0 THEN round(100 * nulls / rows, 2) ELSE 0 END AS null_percentage FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\" FROM documents" for c, t in (("doc_id", "bigint"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")))
    + ")",
    "microbatch_metrics": f"WITH {BATCHES} SELECT * REPLACE (round(purchase_rate, 6) AS purchase_rate, round(value_rate, 6) AS value_rate) FROM m",
    "microbatch_alerts": f"WITH {BATCHES} SELECT batch_id, 'purchase' AS alert_type, round(purchase_rate, 6) AS observed_value, 0.2::DOUBLE AS threshold, 'critical' AS severity FROM m WHERE purchase_rate > 0.2::DOUBLE "
    "UNION ALL SELECT batch_id, 'value', round(value_rate, 6), 0.1::DOUBLE, 'warning' FROM m WHERE value_rate > 0.1::DOUBLE",
    "ml_features": with_views("papers authorships topics", """, f AS (SELECT paper_id, publication_year, cited_by_count, coalesce(author_count, 0) AS author_count, coalesce(topic_count, 0) AS topic_count, coalesce(reference_count, 0) AS reference_count
  FROM papers LEFT JOIN (SELECT paper_id, count(*) AS author_count FROM authorships GROUP BY 1) USING (paper_id)
  LEFT JOIN (SELECT paper_id, count(DISTINCT topic_name) AS topic_count FROM topics GROUP BY 1) USING (paper_id)
  LEFT JOIN (SELECT l_orderkey AS paper_id, count(DISTINCT l_partkey) AS reference_count FROM lineitem GROUP BY 1) USING (paper_id))
SELECT paper_id, reference_count::DOUBLE AS reference_count, author_count::DOUBLE AS author_count, topic_count::DOUBLE AS topic_count,
  (publication_year - (SELECT min(publication_year) FROM f))::DOUBLE AS year_index, (cited_by_count >= (SELECT quantile_disc(cited_by_count, 0.75) FROM f))::INT::DOUBLE AS label FROM f"""),
}
