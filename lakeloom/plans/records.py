"""Queries over raw records: the medallion tables, quality checks, profiles and statistics; each with its SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from lakeloom.operators import medallion, profiling, record_checks
from lakeloom.sources.records import BASE, DUCK_LIST, EXPECTED, record_lines, records_sql

TODAY = date(2030, 1, 1)
ID_PATTERN = r"^https://records\.example/W[0-9]+$"
PROFILED = ["id", "title", "publication_year", "cited_by_count", "referenced_works", "open_access", "primary_location.source.id", "grants"]


def lines(spark, d):
    return record_lines(spark, d).select("value")


def silver_rows(spark, d, *fields):
    """Silver of the records; with fields, of only these fields of the raw records, for queries that need no other."""
    return medallion.silver(medallion.bronze(medallion.typed(lines(spark, d), *fields), "records", "CC0"), BASE)


def flat(df):
    """Lists as comma-joined text."""
    return df.withColumn("quality_flags", F.array_join("quality_flags", ","))


def silver_records(spark, d):
    return flat(silver_rows(spark, d)).withColumn("referenced_works", F.array_join("referenced_works", ",")).drop("authorships", "concepts", "topics")


def gold_publications(spark, d):
    return flat(medallion.gold(silver_rows(spark, d))["publications"])


def gold_author_publications(spark, d):
    return medallion.gold(silver_rows(spark, d, "id", "authorships"))["author_publications"]


def gold_authors(spark, d):
    return medallion.gold(silver_rows(spark, d, "id", "authorships"))["authors"]


def gold_citation_edges(spark, d):
    return medallion.gold(silver_rows(spark, d, "id", "referenced_works"))["citation_edges"]


def gold_topics(spark, d):
    return medallion.gold(silver_rows(spark, d, "id", "topics"))["topics"]


def silver_accounting(spark, d):
    return medallion.accounting(silver_rows(spark, d))


def silver_flags(spark, d):
    return medallion.flag_counts(silver_rows(spark, d, "id", "title", "display_name", "publication_date", "publication_year", "abstract_inverted_index", "authorships"))


def record_quality(spark, d):
    found = record_checks.record_checks(lines(spark, d), EXPECTED, ID_PATTERN, TODAY)
    return found.withColumn("examples", F.array_join("examples", "|"))


def field_profile(spark, d):
    return profiling.field_profile(lines(spark, d), PROFILED, ["id", "title"])


def dataset_statistics(spark, d):
    return profiling.dataset_statistics(lines(spark, d))


def top_concepts(spark, d):
    return profiling.most_common(lines(spark, d), "concepts")


def documents_per_year(spark, d):
    return silver_rows(spark, d, "publication_year").where("publication_year is not null").groupBy("publication_year").agg(F.count("*").alias("records"))


QUERIES = {
    f.__name__: f
    for f in (
        silver_records, gold_publications, gold_author_publications, gold_authors, gold_citation_edges, gold_topics, silver_accounting, silver_flags,
        record_quality, field_profile, dataset_statistics, top_concepts, documents_per_year,
    )
}

LINES = f"raw AS ({records_sql(DUCK_LIST)})"


def _s(path: str) -> str:
    return f"json_extract_string(value, '$.{path}')"


def _t(path: str) -> str:
    return f"coalesce(json_type(value, '$.{path}'), 'NULL')"


def _list(path: str) -> str:
    """The elements of a JSON list as JSON; [] where it is no list."""
    return f"CASE WHEN {_t(path)} = 'ARRAY' THEN json_extract(value, '$.{path}[*]') ELSE [] END"


_DATE = f"try_strptime({_s('publication_date')}, '%Y-%m-%d')::DATE"
_YEAR = f"CASE WHEN {_t('publication_year')} IN ('BIGINT', 'UBIGINT') THEN {_s('publication_year')}::BIGINT END"
_TITLE = f"trim(coalesce({_s('title')}, {_s('display_name')}), ' ')"
_BAD = {
    "missing_id": f"coalesce(trim({_s('id')}) = '', true)",
    "missing_title": "coalesce(title = '', true)",
    "missing_abstract": f"{_t('abstract_inverted_index')} <> 'OBJECT'",
    "missing_authorships": "author_count = 0",
    "malformed_publication_date": f"{_DATE} IS NULL",
    "publication_year_mismatch": f"year({_DATE}) <> {_YEAR}",
}
SILVER = f"""{LINES}, base AS (
  SELECT value, {_s('id')} AS paper_id, CASE WHEN starts_with({_s('id')}, '{BASE}') THEN substr({_s('id')}, {len(BASE) + 1}) ELSE {_s('id')} END AS paper_openalex_id,
    CASE WHEN starts_with({_s('doi')}, '10.') THEN 'https://doi.org/' ELSE '' END || lower({_s('doi')}) AS doi, {_TITLE} AS title,
    regexp_replace(trim(regexp_replace(lower({_TITLE}), '[^a-z0-9_\\s]', ' ', 'g'), ' '), '\\s+', ' ', 'g') AS title_normalized,
    {_t('abstract_inverted_index')} = 'OBJECT' AS abstract_available, {_s('publication_date')} AS publication_date, ({_YEAR})::INT AS publication_year, {_s('type')} AS document_type,
    {_s('language')} AS language, {_s('cited_by_count')}::INT AS cited_by_count, {_s('primary_location.source.id')} AS source_id, {_s('primary_location.source.display_name')} AS source_name,
    len({_list('referenced_works')})::INT AS reference_count, len({_list('authorships')})::INT AS author_count, len({_list('concepts')})::INT AS concept_count, len({_list('topics')})::INT AS topic_count,
    array_to_string(list_transform({_list('referenced_works')}, lambda x: x->>'$'), ',') AS referenced_works FROM raw),
silver AS (SELECT *, array_to_string(list_filter([{', '.join(f"CASE WHEN {sql} THEN '{name}' END" for name, sql in _BAD.items())}], lambda x: x IS NOT NULL), ',') AS quality_flags FROM base)"""
SIGNED = f"""signed AS (SELECT paper_id, (place - 1)::INT AS author_position, x->>'$.author.id' AS author_id, x->>'$.author.display_name' AS author_name
  FROM (SELECT paper_id, unnest({_list('authorships')}) AS x, generate_subscripts({_list('authorships')}, 1) AS place FROM silver) WHERE (x->>'$.author.id') IS NOT NULL)"""
CITED = f"cited AS (SELECT * FROM (SELECT paper_id, unnest({_list('referenced_works')})->>'$' AS referenced_paper_id FROM silver) WHERE paper_id <> referenced_paper_id)"


def _blank(path: str) -> str:
    return f"coalesce(trim({_s(path)}) = '', true)"


def _empty(path: str) -> str:
    return f"({_t(path)} = 'NULL' OR CAST(value->'$.{path}' AS STRING) IN ('{{}}', '[]', '\"\"', '0', 'false'))"


def _not_a(kind: str, path: str) -> str:
    return f"{_t(path)} NOT IN ('NULL', '{kind}')"


_IDS = f"list_transform({_list('authorships')}, lambda x: x->>'$.author.id')"
_FULL_IDS = f"list_filter({_IDS}, lambda x: x IS NOT NULL AND x <> '')"
_REFS = f"list_transform({_list('referenced_works')}, lambda x: x->>'$')"
_FAILS = {
    "missing_ids": _blank("id"),
    "malformed_openalex_ids": f"NOT {_blank('id')} AND NOT regexp_matches({_s('id')}, '{ID_PATTERN}')",
    "missing_titles": f"{_blank('title')} AND {_blank('display_name')}",
    "missing_or_empty_abstract_index": _empty("abstract_inverted_index"),
    "malformed_abstract_index": f"NOT {_empty('abstract_inverted_index')} AND regexp_matches(CAST(value->'$.abstract_inverted_index' AS STRING), '-[0-9]')",
    "missing_publication_dates": _blank("publication_date"),
    "malformed_publication_dates": f"NOT {_blank('publication_date')} AND {_DATE} IS NULL",
    "future_publication_dates": f"{_DATE} > DATE '{TODAY}'",
    "publication_year_mismatch": f"year({_DATE}) <> {_YEAR}",
    "invalid_publication_year": f"coalesce({_YEAR} < 1800 OR {_YEAR} > {TODAY.year + 1}, true)",
    "missing_authorships": _empty("authorships"),
    "malformed_authorships": _not_a("ARRAY", "authorships"),
    "duplicate_author_ids_within_paper": f"len({_FULL_IDS}) <> len(list_distinct({_FULL_IDS}))",
    "malformed_referenced_works": _not_a("ARRAY", "referenced_works"),
    "invalid_cited_by_count": f"{_t('cited_by_count')} NOT IN ('BIGINT', 'UBIGINT') OR {_s('cited_by_count')}::BIGINT < 0",
    "empty_referenced_works": _empty("referenced_works"),
    "duplicate_references_within_paper": f"len({_REFS}) <> len(list_distinct({_REFS}))",
    "self_references": f"list_contains({_REFS}, {_s('id')})",
    "missing_doi": _blank("doi"),
    "malformed_doi": f"NOT {_blank('doi')} AND NOT regexp_matches({_s('doi')}, '(?i)^(https://doi\\.org/)?10\\.\\S+/\\S+$')",
    "missing_language": _blank("language"),
    "malformed_primary_location": _not_a("OBJECT", "primary_location"),
    "malformed_locations": _not_a("ARRAY", "locations"),
    "missing_primary_source": f"coalesce({_s('primary_location.source.id')} = '', true)",
    "malformed_open_access": _not_a("OBJECT", "open_access"),
    "malformed_concepts": _not_a("ARRAY", "concepts"),
    "malformed_topics": _not_a("ARRAY", "topics"),
}
_LISTED = "coalesce(array_to_string({x}, '|'), '')"


def _checks() -> str:
    kinds = ", ".join(f"('{n}', '{c}', '{s}')" for n, c, s in record_checks.CHECKS)
    parts = [f"SELECT '{n}' AS name, count(*) FILTER ({p}) AS count, count(*) AS denominator, list(coalesce({_s('id')}, 'no id') ORDER BY coalesce({_s('id')}, 'no id')) FILTER ({p}) AS x FROM raw" for n, p in _FAILS.items()]
    parts.append(f"SELECT 'authorship_entries_missing_author_id', coalesce(sum(len(list_filter({_IDS}, lambda x: coalesce(trim(x) = '', true)))), 0)::BIGINT, coalesce(sum(len({_IDS})), 0)::BIGINT, NULL FROM raw")
    parts.append(f"SELECT 'duplicate_ids', coalesce(sum(n), 0)::BIGINT, (SELECT count(*) FROM raw), list(id ORDER BY id) FROM (SELECT {_s('id')} AS id, count(*) AS n FROM raw WHERE NOT {_blank('id')} GROUP BY 1 HAVING n > 1)")
    wanted = ", ".join(f"'{f}'" for f in EXPECTED)
    parts.append(f"SELECT 'missing_expected_fields', len(y), {len(EXPECTED)}, y FROM (SELECT coalesce(list(f ORDER BY f), []) AS y FROM (SELECT unnest([{wanted}]) AS f) WHERE f NOT IN (SELECT f FROM seen))")
    parts.append(f"SELECT 'unexpected_fields', len(y), (SELECT count(*) FROM seen), y FROM (SELECT coalesce(list(f ORDER BY f), []) AS y FROM seen WHERE f NOT IN ({wanted}))")
    return f"""WITH {LINES}, seen AS (SELECT DISTINCT unnest(json_keys(value)) AS f FROM raw), kinds(name, category, severity) AS (VALUES {kinds}), found AS ({' UNION ALL '.join(parts)})
SELECT name, category, severity, CASE WHEN count = 0 THEN 'pass' ELSE severity END AS status, count, denominator, CASE WHEN denominator > 0 THEN round(100 * count / denominator, 2) ELSE 0 END AS percentage,
  coalesce(array_to_string(x[1:5], '|'), '') AS examples FROM found JOIN kinds USING (name)"""


_KIND = {"NULL": "null", "VARCHAR": "text", "BIGINT": "int", "UBIGINT": "int", "ARRAY": "list", "OBJECT": "object", "BOOLEAN": "bool", "DOUBLE": "number"}


def _profile() -> str:
    kind = lambda f: "CASE " + " ".join(f"WHEN {_t(f)} = '{k}' THEN '{v}'" for k, v in _KIND.items()) + " END"
    cut = lambda r: f"CASE WHEN length({r}) > 140 THEN substr({r}, 1, 137) || '...' ELSE {r} END"
    parts = [f"SELECT '{f}' AS field, {kind(f)} AS t, CASE WHEN r NOT IN ('null', '{{}}', '[]', '\"\"') THEN '`' || replace({cut('r')}, '|', '\\|') || '`' END AS x FROM (SELECT value, CAST(value->'$.{f}' AS STRING) AS r FROM raw)" for f in PROFILED]
    return f"""WITH {LINES}, each AS ({' UNION ALL '.join(parts)}) SELECT field, array_to_string(list_sort(list(DISTINCT t)), ',') AS types, count(*) AS records, count(*) FILTER (t = 'null') AS null_count,
  min(x) AS example, round(100 * count(*) FILTER (t = 'null') / count(*), 2) AS null_percentage, field IN ('id', 'title') AS used FROM each GROUP BY field"""


ORACLE_SQL = {
    "silver_records": f"WITH {SILVER} SELECT * EXCLUDE (value) FROM silver",
    "gold_publications": f"WITH {SILVER} SELECT * EXCLUDE (value, referenced_works) FROM silver",
    "gold_author_publications": f"WITH {SILVER}, {SIGNED} SELECT * FROM signed",
    "gold_authors": f"WITH {SILVER}, {SIGNED} SELECT author_id, min(author_name) AS author_name FROM signed GROUP BY 1",
    "gold_citation_edges": f"WITH {SILVER}, {CITED} SELECT * FROM cited",
    "gold_topics": f"""WITH {SILVER} SELECT paper_id, x->>'$.id' AS topic_id, x->>'$.display_name' AS topic_name, x->>'$.domain.display_name' AS topic_domain, x->>'$.field.display_name' AS topic_field,
  x->>'$.subfield.display_name' AS topic_subfield FROM (SELECT paper_id, unnest({_list('topics')}) AS x FROM silver) WHERE (x->>'$.id') IS NOT NULL""",
    "silver_accounting": f"WITH {SILVER} SELECT count(*) AS records, count(*) FILTER (quality_flags <> '') AS flagged_records, coalesce(sum(len(list_filter({_REFS}, lambda x: x = paper_id))), 0)::BIGINT AS self_citations_removed FROM silver",
    "silver_flags": f"WITH {SILVER} SELECT flag, count(*) AS records FROM (SELECT unnest(string_split(quality_flags, ',')) AS flag FROM silver) WHERE flag <> '' GROUP BY 1",
    "record_quality": _checks(),
    "field_profile": _profile(),
    "dataset_statistics": f"""WITH {LINES} SELECT count(*) AS record_count, sum(len({_REFS}))::BIGINT AS reference_count, min({_YEAR}) AS first_year, max({_YEAR}) AS last_year, count(*) FILTER ({_FAILS['missing_titles']}) AS missing_titles,
  count(*) FILTER ({_empty('abstract_inverted_index')}) AS missing_abstracts, count(*) FILTER (len({_IDS}) = 0) AS missing_authors, count(DISTINCT {_s('id')}) AS unique_publications, count({_s('id')}) - count(DISTINCT {_s('id')}) AS duplicate_identifiers,
  (SELECT count(DISTINCT a) FROM (SELECT unnest({_FULL_IDS}) AS a FROM raw)) AS unique_authors FROM raw""",
    "top_concepts": f"WITH {LINES} SELECT value, count(*) AS records FROM (SELECT unnest({_list('concepts')})->>'$.display_name' AS value FROM raw) WHERE value <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "documents_per_year": f"WITH {SILVER} SELECT publication_year, count(*) AS records FROM silver WHERE publication_year IS NOT NULL GROUP BY 1",
}
