"""The composite ranking and the feature mart over publications made of raw records; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.operators import features, graph, learning, medallion, temporal
from lakeloom.plans.publications import rounded
from lakeloom.plans.records import SILVER, _list, silver_rows
from lakeloom.sources.records import BASE
from lakeloom.sources.tables import checkpointed
from lakeloom.streaming import monitor

ITERATIONS, BATCH = 10, 250
COMPONENTS = {
    "citation_count": "cited_by_count", "pagerank": "pagerank", "recency": "publication_year", "reference_count": "reference_count", "author_count": "author_count", "topic_count": "topic_count",
}


#: The columns of Silver that the ranking reads, and those that the batches do; of the raw fields behind them.
RANKED = ["paper_id", "title", "publication_year", "cited_by_count", "reference_count", "author_count", "topic_count", "concept_count", "referenced_works"]
BATCHED = ["publication_year", "paper_id", "title", "author_count", "reference_count", "cited_by_count"]
PARSED = ["id", "title", "display_name", "publication_year", "cited_by_count", "referenced_works", "authorships"]


def clean(spark, d, columns, fields=()):
    """These columns of the Silver rows whose id is well formed and occurs once; only they are written, and only the raw
    fields named are parsed, all if none is."""
    rows = silver_rows(spark, d, *fields).where(F.col("paper_id").startswith(BASE)).select(*columns)
    return checkpointed(rows.withColumn("n", F.count("*").over(Window.partitionBy("paper_id"))).where("n = 1").drop("n"))


def scored(rows):
    ranks = graph.pagerank(medallion.cited_once(rows), ITERATIONS).select("paper_id", "pagerank")
    base = rows.select("paper_id", "title", "publication_year", "cited_by_count", "reference_count", "author_count", "topic_count", "concept_count").join(ranks, "paper_id", "left").fillna(0)
    return temporal.ranked_by_score(temporal.composite(base, COMPONENTS, components=True))


def publication_ranking(spark, d):
    return rounded(scored(clean(spark, d, RANKED, [*PARSED, "topics", "concepts"])), "score", "pagerank", *[f"{c}_component" for c in COMPONENTS])


def mart(spark, d):
    rows = clean(spark, d, [c for c in silver_rows(spark, d).columns if c not in ("authorships", "concepts", "topics")])
    publications = rows.drop("referenced_works")
    texts = rows.where("abstract_available").select("paper_id", F.concat_ws(" ", "title", "document_type").alias("document_text"))
    clusters = rows.where("language = 'en'").select("paper_id", F.pmod("cited_by_count", F.lit(3)).alias("cluster"))
    degrees = graph.sample_degrees(medallion.cited_once(rows), rows)
    labels = learning.citation_features(rows, [])
    predictions = rows.where("reference_count > 0").select("paper_id", (F.col("reference_count") >= 4).cast("double").alias("prediction"))
    ranking = scored(rows).withColumnRenamed("score", "composite_score")
    years = temporal.yearly_trends(rows).selectExpr("publication_year", "publication_count AS year_publication_count", "citations_per_publication AS year_citations_per_publication", "yoy_growth AS publication_count_yoy_growth")
    return features.feature_mart(publications, texts, clusters, degrees, labels, predictions, ranking, years)


def feature_mart(spark, d):
    return rounded(mart(spark, d), "composite_score", "citation_count_component", "recency_component", "year_citations_per_publication", "publication_count_yoy_growth")


def mart_coverage(spark, d):
    return rounded(features.coverage(mart(spark, d)), "text_document_coverage", "cluster_assignment_coverage", "ml_prediction_coverage", "composite_rank_coverage", "average_words")


def record_batches(spark, d):
    """Publications in micro-batches by year, then id."""
    rows = monitor.numbered(clean(spark, d, BATCHED, PARSED), "publication_year", "paper_id")
    missing = {"title": F.coalesce(F.trim("title") == "", F.lit(True)), "author": F.col("author_count") <= 0}
    return monitor.batch_metrics(rows, BATCH, missing, ("author_count", "reference_count", "cited_by_count"), "publication_year", "paper_id")


def record_microbatches(spark, d):
    found = rounded(record_batches(spark, d), "title_rate", "author_rate", "avg_author_count", "avg_reference_count", "avg_cited_by_count")
    return found.withColumn("event_time", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"))


def record_alerts(spark, d):
    return rounded(monitor.alerts(record_batches(spark, d), {"title": (0.1, "critical"), "author": (0.05, "warning")}), "observed_value")


QUERIES = {f.__name__: f for f in (publication_ranking, feature_mart, mart_coverage, record_microbatches, record_alerts)}

CLEAN = f"{SILVER}, clean AS (SELECT * FROM silver WHERE starts_with(paper_id, '{BASE}') QUALIFY count(*) OVER (PARTITION BY paper_id) = 1)"
EDGES = f"""edges AS MATERIALIZED (SELECT DISTINCT paper_id AS a, b FROM (SELECT paper_id, unnest({_list('referenced_works').replace("'$.referenced_works", "'$.referenced_works")})->>'$' AS b FROM clean) WHERE paper_id <> b)"""
NODES = """nodes AS MATERIALIZED (SELECT id AS paper_id, sum(o)::BIGINT AS out_degree FROM (SELECT a AS id, 1 AS o FROM edges UNION ALL SELECT b, 0 FROM edges) GROUP BY 1)"""


def _ranks() -> str:
    n = "(SELECT count(*) FROM nodes)"
    steps = [f"r0 AS MATERIALIZED (SELECT paper_id, out_degree, 1.0::DOUBLE / {n} AS pr FROM nodes)"]
    for i in range(1, ITERATIONS + 1):
        p = f"r{i - 1}"
        steps.append(
            f"r{i} AS MATERIALIZED (SELECT r.paper_id, out_degree, 0.15::DOUBLE / {n} + 0.85::DOUBLE * (coalesce(gain, 0) + (SELECT coalesce(sum(pr), 0) FROM {p} WHERE out_degree = 0) / {n}) AS pr "
            f"FROM {p} r LEFT JOIN (SELECT b, sum(pr / out_degree) AS gain FROM edges JOIN {p} ON a = paper_id GROUP BY b) ON b = r.paper_id)"
        )
    return ", ".join(steps)


def _scaled(name: str) -> str:
    return f"CASE WHEN max({name}) OVER () > min({name}) OVER () THEN ({name} - min({name}) OVER ())::DOUBLE / (max({name}) OVER () - min({name}) OVER ()) ELSE 0 END"


_TOTAL = sum(temporal.WEIGHTS.values())
SCORED = f"""{CLEAN}, {EDGES}, {NODES}, {_ranks()},
base2 AS (SELECT c.paper_id, coalesce(title, '') AS title0, title, coalesce(publication_year, 0) AS publication_year, coalesce(cited_by_count, 0) AS cited_by_count, reference_count, author_count, topic_count, concept_count, coalesce(pr, 0) AS pagerank
  FROM clean c LEFT JOIN r{ITERATIONS} USING (paper_id)),
parts AS (SELECT *, {', '.join(f'{_scaled(c)} AS {n}_component' for n, c in COMPONENTS.items())} FROM base2),
scored AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, cited_by_count DESC, paper_id) AS rank FROM (SELECT *, {' + '.join(f'{n}_component * {temporal.WEIGHTS[n] / _TOTAL!r}::DOUBLE' for n in COMPONENTS)} AS score FROM parts))"""
_TEXT = "concat_ws(' ', c.title, document_type)"
MART = f"""{SCORED}, yearly AS (SELECT *, lag(n) OVER (ORDER BY publication_year) AS before FROM (SELECT publication_year, count(*) AS n, sum(coalesce(cited_by_count, 0)) / count(*)::DOUBLE AS c FROM clean WHERE publication_year IS NOT NULL GROUP BY 1)),
deg AS (SELECT a AS paper_id, count(*) AS f, count(*) FILTER (b IN (SELECT paper_id FROM clean)) AS o FROM edges GROUP BY 1), ins AS (SELECT b AS paper_id, count(*) AS i FROM edges GROUP BY 1),
mart AS (SELECT c.paper_id, paper_openalex_id, doi, c.title, publication_date, c.publication_year, document_type, language, c.cited_by_count, c.reference_count, c.author_count, c.concept_count, c.topic_count, abstract_available,
  CASE WHEN quality_flags = '' THEN 0 ELSE len(string_split(quality_flags, ',')) END::INT AS quality_flag_count, CASE WHEN abstract_available THEN length({_TEXT}) ELSE 0 END::INT AS document_char_count,
  CASE WHEN NOT abstract_available OR trim({_TEXT}) = '' THEN 0 ELSE len(regexp_split_to_array(trim({_TEXT}), '\\s+')) END::INT AS document_word_count, CASE WHEN language = 'en' THEN ((c.cited_by_count % 3) + 3) % 3 END::INT AS cluster,
  coalesce(f, 0)::BIGINT AS out_degree_full, coalesce(o, 0)::BIGINT AS out_degree_in_sample, coalesce(i, 0)::BIGINT AS in_degree_in_sample,
  (c.cited_by_count >= (SELECT quantile_disc(cited_by_count, 0.75) FROM clean))::INT::DOUBLE AS high_citation_label, CASE WHEN c.reference_count > 0 THEN (c.reference_count >= 4)::INT::DOUBLE END AS high_citation_prediction,
  rank, round(score, 6) AS composite_score, round(citation_count_component, 6) AS citation_count_component, round(recency_component, 6) AS recency_component,
  n AS year_publication_count, round(y.c, 6) AS year_citations_per_publication, round((n - before)::DOUBLE / nullif(before, 0), 6) AS publication_count_yoy_growth,
  abstract_available AS has_text_document, language = 'en' IS TRUE AS has_cluster_assignment, c.reference_count > 0 AS has_ml_prediction, rank IS NOT NULL AS has_composite_rank
  FROM clean c LEFT JOIN deg USING (paper_id) LEFT JOIN ins USING (paper_id) LEFT JOIN scored s USING (paper_id) LEFT JOIN yearly y ON y.publication_year = c.publication_year)"""
BATCHES = f"""b AS (SELECT (position - 1) // {BATCH} AS batch_id, * FROM (SELECT *, row_number() OVER (ORDER BY publication_year NULLS FIRST, paper_id) AS position FROM clean)),
m AS (SELECT batch_id, min(position) AS first_position, max(position) AS last_position, count(DISTINCT paper_id) AS records, count(*) FILTER (coalesce(trim(title) = '', true)) AS missing_title, count(*) FILTER (author_count <= 0) AS missing_author,
  round(avg(author_count), 6) AS avg_author_count, round(avg(reference_count), 6) AS avg_reference_count, round(avg(cited_by_count), 6) AS avg_cited_by_count, min(publication_year) AS first_year, max(publication_year) AS last_year,
  missing_title / records AS title_rate, missing_author / records AS author_rate FROM b GROUP BY 1)"""

ORACLE_SQL = {
    "publication_ranking": f"WITH {SCORED} SELECT paper_id, title0 AS title, publication_year, cited_by_count, reference_count, author_count, topic_count, concept_count, round(pagerank, 6) AS pagerank, {', '.join(f'round({n}_component, 6) AS {n}_component' for n in COMPONENTS)}, round(score, 6) AS score, rank FROM scored".replace("title0 AS title", "title"),
    "feature_mart": f"WITH {MART} SELECT * REPLACE (coalesce(has_cluster_assignment, false) AS has_cluster_assignment) FROM mart",
    "mart_coverage": f"""WITH {MART} SELECT count(*) AS row_count, round(avg(has_text_document::INT), 6) AS text_document_coverage, round(count(*) FILTER (language = 'en') / count(*)::DOUBLE, 6) AS cluster_assignment_coverage,
  round(avg(has_ml_prediction::INT), 6) AS ml_prediction_coverage, round(avg(has_composite_rank::INT), 6) AS composite_rank_coverage, round(sum(document_word_count) / count(*)::DOUBLE, 6) AS average_words FROM mart""",
    "record_microbatches": f"WITH {CLEAN}, {BATCHES} SELECT * REPLACE (round(title_rate, 6) AS title_rate, round(author_rate, 6) AS author_rate), strftime(make_timestamp(first_year, 1, 1, 0, 0, 0), '%Y-%m-%d %H:%M:%S') AS event_time FROM m",
    "record_alerts": f"WITH {CLEAN}, {BATCHES} SELECT batch_id, 'title' AS alert_type, round(title_rate, 6) AS observed_value, 0.1::DOUBLE AS threshold, 'critical' AS severity FROM m WHERE title_rate > 0.1::DOUBLE "
    "UNION ALL SELECT batch_id, 'author', round(author_rate, 6), 0.05::DOUBLE, 'warning' FROM m WHERE author_rate > 0.05::DOUBLE",
}
