"""Queries over the publication-shaped views: trends, rankings, graphs; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions.text import STOP_WORDS
from lakeloom.operators import graph, temporal, terms
from lakeloom.sources.tables import authorships, citations, papers, table, topics, with_views

AS_OF = 2002
ITERATIONS = 10


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def yearly_trends(spark, d):
    return rounded(temporal.yearly_trends(papers(spark, d)), "citations_per_publication", "yoy_growth")


def topic_trends(spark, d):
    return temporal.topic_trends(papers(spark, d), topics(spark, d))


def emerging_topics(spark, d):
    return rounded(temporal.emerging_topics(topic_trends(spark, d)), "growth_ratio")


def field_normalized(spark, d):
    return rounded(temporal.field_normalized(papers(spark, d), topics(spark, d), AS_OF), "citations_per_year", "z_score", "percent_rank")


def paper_features(spark, d):
    authors = authorships(spark, d).groupBy("paper_id").agg(F.count("*").alias("author_count"))
    names = topics(spark, d).groupBy("paper_id").agg(F.countDistinct("topic_name").alias("topic_count"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id")).agg(F.countDistinct("l_partkey").alias("reference_count"))
    rows = papers(spark, d).join(authors, "paper_id", "left").join(names, "paper_id", "left").join(lines, "paper_id", "left")
    return rows.fillna(0, ["author_count", "topic_count", "reference_count"])


COMPONENTS = {"citation_count": "cited_by_count", "recency": "publication_year", "reference_count": "reference_count", "author_count": "author_count", "topic_count": "topic_count"}


def composite_rank(spark, d):
    return rounded(temporal.composite(paper_features(spark, d), COMPONENTS), "score")


def author_rows(spark, d):
    listed = authorships(spark, d).groupBy("paper_id").agg(F.array_sort(F.collect_list("author_id")).alias("a"))
    return listed.select("paper_id", F.posexplode("a").alias("author_position", "author_id")).withColumn("author_position", F.col("author_position").cast("bigint"))


def degrees(spark, d):
    return graph.degrees(graph.clean_edges(citations(spark, d)))


def pagerank(spark, d):
    return rounded(graph.pagerank(graph.clean_edges(citations(spark, d)), ITERATIONS), "pagerank", digits=9)


def unusual_pagerank(spark, d):
    return rounded(graph.unusual(graph.pagerank(graph.clean_edges(citations(spark, d)), ITERATIONS)), "pagerank", "ratio", digits=9)


def coauthor_edges(spark, d):
    return graph.coauthor_edges(authorships(spark, d))


def author_metrics(spark, d):
    return rounded(graph.author_metrics(author_rows(spark, d), coauthor_edges(spark, d)), "avg_position", "collaborations_per_publication")


def sampled(spark, d):
    """Three of four vertices, as a sample of papers."""
    edges = citations(spark, d)
    return edges.select("paper_id").union(edges.select("referenced_paper_id")).distinct().where("paper_id % 4 <> 0")


def sample_edges(spark, d):
    return graph.clean_edges(citations(spark, d)).where("paper_id % 4 <> 0")


def sample_degrees(spark, d):
    return graph.sample_degrees(sample_edges(spark, d), sampled(spark, d))


def graph_summary(spark, d):
    return graph.graph_summary(sample_edges(spark, d), sampled(spark, d))


def collaborations(spark, d):
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("author_name"))
    found = graph.named_collaborations(authorships(spark, d), names, names.count())
    return found.withColumn("shared_publication_ids", F.array_join(F.transform("shared_publication_ids", lambda x: x.cast("string")), ","))


def topic_terms(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    topics = docs.select("doc_id", F.explode(F.array_distinct(F.array("lang", "source"))).alias("topic_name")).where("topic_name is not null")
    return terms.terms_by_topic(docs, topics)


def year_terms(spark, d):
    """Tokens of order priorities and statuses by year of the order."""
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("publication_year"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text"))
    return terms.terms_by_group(docs, "publication_year")


def clusters(spark, d):
    return table(spark, d, "documents").select("doc_id", F.pmod(F.length("text"), F.lit(3)).alias("cluster")).where("cluster is not null")


def cluster_terms(spark, d):
    return terms.cluster_terms(table(spark, d, "documents").select("doc_id", "text"), clusters(spark, d))


def cluster_sizes(spark, d):
    return terms.cluster_sizes(clusters(spark, d))


def cluster_representatives(spark, d):
    rows = papers(spark, d).select("paper_id", "publication_year", F.concat(F.lit("t"), F.col("paper_id") % 5).alias("title"))
    return terms.representatives(rows, papers(spark, d).select("paper_id", (F.col("paper_id") % 3).alias("cluster")))


def text_documents(spark, d):
    """Documents as papers: the first line is the title, the rest the abstract."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), F.substring_index("text", "\n", 1).alias("title"), F.length("text").alias("publication_year"), F.col("lang").alias("language"))
    rest = table(spark, d, "documents").where(F.contains("text", F.lit("\n"))).select(F.col("doc_id").alias("paper_id"), F.expr("substr(text, instr(text, '\n') + 1)").alias("abstract_text"))
    return terms.build_documents(rows, rest, "en")


def graph_density(spark, d):
    return rounded(graph.density(authorships(spark, d), coauthor_edges(spark, d)), "density")


QUERIES = {
    f.__name__: f
    for f in (yearly_trends, topic_trends, emerging_topics, field_normalized, composite_rank, author_rows, degrees, pagerank, unusual_pagerank, coauthor_edges, author_metrics, graph_density,
              sample_degrees, graph_summary, collaborations, topic_terms, year_terms, cluster_terms, cluster_sizes, cluster_representatives, text_documents)
}

YEARLY = """yearly AS (
  SELECT *, round(total_cited_by_count::DOUBLE / publication_count, 6) AS citations_per_publication,
    round((publication_count - previous_count)::DOUBLE / nullif(previous_count, 0), 6) AS yoy_growth
  FROM (SELECT *, lag(publication_count) OVER (ORDER BY publication_year) AS previous_count FROM (
    SELECT publication_year, count(DISTINCT paper_id) AS publication_count, sum(coalesce(cited_by_count, 0))::BIGINT AS total_cited_by_count,
      max(cited_by_count) AS max_cited_by_count FROM papers WHERE publication_year IS NOT NULL GROUP BY 1)))"""
TRENDS = """trends AS (
  SELECT *, row_number() OVER (PARTITION BY publication_year ORDER BY publication_count DESC, topic_name) AS rank FROM (
    SELECT publication_year, topic_name, count(DISTINCT paper_id) AS publication_count, sum(cited_by_count)::BIGINT AS total_cited_by_count
    FROM topics JOIN papers USING (paper_id) WHERE publication_year IS NOT NULL GROUP BY 1, 2))"""
NORMALIZED = f"""normalized AS (
  SELECT paper_id, field, primary_topic, publication_year, cited_by_count, round(cited_by_count::DOUBLE / greatest(1, {AS_OF} - publication_year + 1), 6) AS citations_per_year,
    round(CASE WHEN sd > 0 THEN (cited_by_count - mean) / sd ELSE 0 END, 6) AS z_score, round(pr, 6) AS percent_rank
  FROM (SELECT *, avg(cited_by_count) OVER g AS mean, stddev_pop(cited_by_count) OVER g AS sd, percent_rank() OVER (PARTITION BY field, publication_year ORDER BY cited_by_count, paper_id) AS pr
    FROM (SELECT * REPLACE (coalesce(field, 'Unknown') AS field) FROM papers LEFT JOIN (SELECT paper_id, topic_field AS field, topic_name AS primary_topic FROM topics QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY topic_field NULLS LAST, topic_name NULLS LAST) = 1) USING (paper_id))
    WINDOW g AS (PARTITION BY field, publication_year)))"""


def _scaled(name: str, weight: float) -> str:
    total = sum(temporal.WEIGHTS[c] for c in COMPONENTS)
    return f"CASE WHEN max({name}) OVER () > min({name}) OVER () THEN ({name} - min({name}) OVER ())::DOUBLE / (max({name}) OVER () - min({name}) OVER ()) ELSE 0 END * {weight / total!r}"


RANKED = (
    """features AS (
  SELECT paper_id, publication_year, cited_by_count, coalesce(author_count, 0) AS author_count, coalesce(topic_count, 0) AS topic_count, coalesce(reference_count, 0) AS reference_count
  FROM papers LEFT JOIN (SELECT paper_id, count(*) AS author_count FROM authorships GROUP BY 1) USING (paper_id)
  LEFT JOIN (SELECT paper_id, count(DISTINCT topic_name) AS topic_count FROM topics GROUP BY 1) USING (paper_id)
  LEFT JOIN (SELECT l_orderkey AS paper_id, count(DISTINCT l_partkey) AS reference_count FROM lineitem GROUP BY 1) USING (paper_id)),
ranked AS (SELECT *, round("""
    + " + ".join(_scaled(name, temporal.WEIGHTS[c]) for c, name in COMPONENTS.items())
    + ", 6) AS score FROM features)"
)
EDGES = "edges AS (SELECT paper_id AS a, referenced_paper_id AS b FROM citations WHERE paper_id <> referenced_paper_id)"
NODES = """nodes AS (SELECT id AS paper_id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree
  FROM (SELECT a AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT b, 0, 1 FROM edges) GROUP BY 1)"""


def _ranks() -> str:
    n = "(SELECT count(*) FROM nodes)"
    steps = [f"r0 AS MATERIALIZED (SELECT paper_id, out_degree, in_degree, 1.0::DOUBLE / {n} AS pr FROM nodes)"]
    for i in range(1, ITERATIONS + 1):
        p = f"r{i - 1}"
        steps.append(
            f"r{i} AS MATERIALIZED (SELECT r.paper_id, out_degree, in_degree, 0.15::DOUBLE / {n} + 0.85::DOUBLE * (coalesce(gain, 0) + (SELECT coalesce(sum(pr), 0) FROM {p} WHERE out_degree = 0) / {n}) AS pr "
            f"FROM {p} r LEFT JOIN (SELECT b, sum(pr / out_degree) AS gain FROM edges JOIN {p} ON a = paper_id GROUP BY b) ON b = r.paper_id)"
        )
    return ", ".join(steps)


PAIRS = "pairs AS (SELECT l.author_id AS author_a, r.author_id AS author_b, count(*) AS shared_count FROM authorships l JOIN authorships r USING (paper_id) WHERE l.author_id < r.author_id GROUP BY 1, 2)"

SAMPLE = f"""{EDGES}, ids AS (SELECT DISTINCT id FROM (SELECT paper_id AS id FROM citations UNION SELECT referenced_paper_id FROM citations) WHERE id % 4 <> 0), f AS (SELECT * FROM edges WHERE a % 4 <> 0),
sd AS (SELECT id AS paper_id, coalesce(x, 0) AS out_degree_full, coalesce(y, 0) AS out_degree_in_sample, coalesce(z, 0) AS in_degree_in_sample, id % 4 <> 0 AS in_sample FROM (SELECT id FROM ids UNION SELECT b FROM f)
  LEFT JOIN (SELECT a AS id, count(*) AS x, count(*) FILTER (b % 4 <> 0) AS y FROM f GROUP BY 1) USING (id) LEFT JOIN (SELECT b AS id, count(*) AS z FROM f WHERE b % 4 <> 0 GROUP BY 1) USING (id))"""
_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
_TOKENS = "list_filter(string_split(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 3 AND w NOT IN (" + _STOP + ") AND NOT regexp_matches(w, '^[0-9]+$'))"

ORACLE_SQL = {
    "yearly_trends": with_views("papers", f", {YEARLY} SELECT * FROM yearly"),
    "topic_trends": with_views("papers topics", f", {TRENDS} SELECT * FROM trends"),
    "emerging_topics": with_views("papers topics", f""", {TRENDS} SELECT *, latest_count - previous_count AS absolute_growth,
  round((latest_count - previous_count)::DOUBLE / nullif(previous_count, 0), 6) AS growth_ratio FROM (
  SELECT topic_name, min(publication_year) AS first_year, max(publication_year) AS last_year, count(DISTINCT publication_year) AS active_years, sum(publication_count)::BIGINT AS total_count,
    sum(CASE WHEN publication_year = latest THEN publication_count ELSE 0 END)::BIGINT AS latest_count,
    sum(CASE WHEN publication_year = latest - 1 THEN publication_count ELSE 0 END)::BIGINT AS previous_count
  FROM trends, (SELECT max(publication_year) AS latest FROM trends) GROUP BY 1) WHERE latest_count > 0"""),
    "field_normalized": with_views("papers topics", f", {NORMALIZED} SELECT * FROM normalized"),
    "composite_rank": with_views("papers authorships topics", f", {RANKED} SELECT * FROM ranked"),
    "author_rows": with_views("authorships", "SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY author_id) - 1 AS author_position, author_id FROM authorships"),
    "degrees": with_views("citations", f", {EDGES}, {NODES} SELECT * FROM nodes"),
    "pagerank": with_views("citations", f", {EDGES}, {NODES}, {_ranks()} SELECT paper_id, in_degree, round(pr, 9) AS pagerank FROM r{ITERATIONS}"),
    "unusual_pagerank": with_views("citations", f", {EDGES}, {NODES}, {_ranks()} SELECT paper_id, in_degree, round(pr, 9) AS pagerank, round(pr / (in_degree + 1), 9) AS ratio FROM r{ITERATIONS} ORDER BY round(pr / (in_degree + 1), 12) DESC, paper_id LIMIT 25"),
    "coauthor_edges": with_views("authorships", f", {PAIRS} SELECT * FROM pairs"),
    "author_metrics": with_views("authorships", f""", {PAIRS}, sizes AS (SELECT paper_id, count(*) AS n FROM authorships GROUP BY 1),
links AS (SELECT author_id, count(*) AS collaborators, sum(shared_count)::BIGINT AS weighted_degree, max(shared_count) AS strongest
  FROM (SELECT author_a AS author_id, shared_count FROM pairs UNION ALL SELECT author_b, shared_count FROM pairs) GROUP BY 1)
SELECT author_id, publications, solo, round(avg_position, 6) AS avg_position, coalesce(collaborators, 0) AS collaborators, coalesce(weighted_degree, 0) AS weighted_degree, coalesce(strongest, 0) AS strongest,
  round(coalesce(weighted_degree, 0) / publications::DOUBLE, 6) AS collaborations_per_publication
FROM (SELECT author_id, count(*) AS publications, count(*) FILTER (n = 1) AS solo, avg(place) AS avg_position
  FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY author_id) - 1 AS place FROM authorships) JOIN sizes USING (paper_id) GROUP BY 1) LEFT JOIN links USING (author_id)"""),
    "sample_degrees": with_views("citations", f", {SAMPLE} SELECT * FROM sd"),
    "graph_summary": with_views("citations", f", {SAMPLE} SELECT count(*) AS vertices, count(*) FILTER (in_sample) AS sampled, sum(out_degree_full)::BIGINT AS edges, sum(out_degree_in_sample)::BIGINT AS edges_in_sample, (sum(out_degree_full) - sum(out_degree_in_sample))::BIGINT AS external_edges FROM sd"),
    "collaborations": with_views("authorships", """, s AS (SELECT paper_id, author_id, s_name AS author_name FROM authorships JOIN supplier ON s_suppkey = author_id)
SELECT l.author_id AS author_id_a, l.author_name AS author_name_a, r.author_id AS author_id_b, r.author_name AS author_name_b, count(DISTINCT paper_id) AS shared_publication_count, string_agg(paper_id, ',' ORDER BY paper_id) AS shared_publication_ids
FROM s l JOIN s r USING (paper_id) WHERE l.author_id < r.author_id GROUP BY 1, 2, 3, 4"""),
    "topic_terms": f"SELECT topic_name, token, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOKENS.format(text='text')}) AS token FROM documents) JOIN (SELECT DISTINCT doc_id, unnest([lang, source]) AS topic_name FROM documents) USING (doc_id) WHERE topic_name IS NOT NULL GROUP BY 1, 2",
    "year_terms": f"SELECT publication_year, token, count(*) AS tf, count(DISTINCT k) AS df FROM (SELECT o_orderkey AS k, year(o_orderdate)::INT AS publication_year, unnest({_TOKENS.format(text="o_orderpriority || ' ' || o_orderstatus")}) AS token FROM orders) GROUP BY 1, 2",
    "cluster_terms": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY tf DESC, token) AS rank FROM (SELECT (length(text) % 3)::INT AS cluster, token, count(*) AS tf FROM (SELECT text, unnest({_TOKENS.format(text='text')}) AS token FROM documents) GROUP BY 1, 2)) WHERE rank <= 10",
    "cluster_sizes": "SELECT (length(text) % 3)::INT AS cluster, count(*) AS size FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "cluster_representatives": with_views("papers", " SELECT * FROM (SELECT paper_id, publication_year, 't' || (paper_id % 5) AS title, paper_id % 3 AS cluster, row_number() OVER (PARTITION BY paper_id % 3 ORDER BY publication_year, 't' || (paper_id % 5), paper_id) AS rank FROM papers) WHERE rank <= 5"),
    "text_documents": """SELECT doc_id AS paper_id, split_part(text, chr(10), 1) AS title, length(text)::INT AS publication_year, lang AS language, CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) END AS abstract_text,
  trim(concat_ws(' ', split_part(text, chr(10), 1), CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) END), ' ') AS document_text FROM documents WHERE lang = 'en'""",
    "graph_density": with_views("authorships", f", {PAIRS} SELECT authors, edges, round(CASE WHEN authors > 1 THEN edges / (authors * (authors - 1) / 2) ELSE 0 END, 6) AS density FROM (SELECT count(DISTINCT author_id) AS authors FROM authorships), (SELECT count(*) AS edges FROM pairs)"),
}
