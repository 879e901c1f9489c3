"""The quality checks of raw records, over JSON texts: their shapes are read before any type is forced on them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.sources.tables import checkpointed

#: Name, category and severity of the checks, in their order.
CHECKS = [
    tuple(line.split())
    for line in """
missing_expected_fields schema error
unexpected_fields schema warn
missing_ids identity error
malformed_openalex_ids identity error
duplicate_ids identity error
missing_titles text warn
missing_or_empty_abstract_index text warn
malformed_abstract_index text error
missing_publication_dates temporal warn
malformed_publication_dates temporal error
future_publication_dates temporal warn
publication_year_mismatch temporal error
invalid_publication_year temporal error
missing_authorships authors warn
malformed_authorships authors error
authorship_entries_missing_author_id authors warn
duplicate_author_ids_within_paper authors warn
malformed_referenced_works references error
invalid_cited_by_count references error
empty_referenced_works references warn
duplicate_references_within_paper references warn
self_references references warn
missing_doi identifiers warn
malformed_doi identifiers warn
missing_language metadata warn
malformed_primary_location metadata warn
malformed_locations metadata warn
missing_primary_source metadata warn
malformed_open_access metadata warn
malformed_concepts topics warn
malformed_topics topics warn
""".strip().splitlines()
]
DOI = r"(?i)^(https://doi\.org/)?10\.\S+/\S+$"


def got(path: str, kind: str) -> Column:
    return F.try_variant_get("v", f"$.{path}", kind)


def shape(field: str) -> Column:
    """null (absent or null), list, object, int, number, text or bool.

    The schema is asked of values without parts only: that of a list or an object is made of all that it holds."""
    value = got(field, "variant")
    kind = F.schema_of_variant(value)
    found = [("BIGINT", "int"), ("STRING", "text"), ("BOOLEAN", "bool"), ("DECIMAL", "number"), ("DOUBLE", "number"), ("FLOAT", "number")]
    out = F.when(value.isNull() | F.is_variant_null(value), "null").when(got(field, "array<variant>").isNotNull(), "list").when(got(field, "map<string,variant>").isNotNull(), "object")
    for start, name in found:
        out = out.when(kind.startswith(start), name)
    return out.otherwise("other")


def text(path: str) -> Column:
    return got(path, "string")


def blank(value: Column) -> Column:
    return F.coalesce(F.trim(value) == "", F.lit(True))


#: What the checks read: the shape of these fields, the texts of those.
SHAPED = [
    "abstract_inverted_index", "authorships", "cited_by_count", "concepts", "locations", "open_access", "primary_location", "publication_date", "publication_year", "referenced_works", "topics",
]
SAID = ["display_name", "doi", "id", "language", "primary_location.source.id", "publication_date", "title"]


def prepared(lines: DataFrame) -> DataFrame:
    """Of JSON texts (value): v, keys, entries, references, shape_<field> and text_<path>, each read once for all checks."""
    parsed = lines.select(F.try_parse_json("value").alias("v"), F.json_object_keys("value").alias("keys"))
    shapes = parsed.select("v", "keys", *[shape(f).alias(f"shape_{f}") for f in SHAPED], *[text(p).alias(f"text_{p.replace('.', '_')}") for p in SAID])
    references = F.coalesce(F.when(F.col("shape_referenced_works") == "list", got("referenced_works", "array<string>")), F.array().cast("array<string>"))
    return shapes.withColumns({"entries": entries(F.col("shape_authorships")), "references": references})


def predicates(id_pattern: str, today: date) -> dict[str, Column]:
    """For each check of single records, whether a record fails it; a null counts as kept.  They read what `prepared` gives."""
    def kind_of(field: str) -> Column:
        return F.col(f"shape_{field}")

    def said(path: str) -> Column:
        return F.col(f"text_{path.replace('.', '_')}")

    def not_a(kind: str, field: str) -> Column:
        return ~kind_of(field).isin("null", kind)

    def empty(field: str) -> Column:
        parts = F.when(kind_of(field) == "list", F.size(got(field, "array<variant>"))).when(kind_of(field) == "object", F.size(got(field, "map<string,variant>")))
        raw = F.to_json(F.when(~kind_of(field).isin("list", "object"), got(field, "variant")))
        return (kind_of(field) == "null") | F.coalesce(parts == 0, raw.isin('""', "0", "false"))

    index = F.try_variant_get("v", "$.abstract_inverted_index", "map<string,array<variant>>")
    places = F.flatten(F.map_values(index))
    bad_place = F.exists(places, lambda p: ~F.coalesce(F.schema_of_variant(p) == "BIGINT", F.lit(False)) | (F.try_variant_get(p, "$", "bigint") < 0))
    day = F.when(kind_of("publication_date") == "text", F.try_to_date(said("publication_date"), "yyyy-MM-dd"))
    year = F.when(kind_of("publication_year") == "int", F.try_variant_get("v", "$.publication_year", "bigint"))
    authors = F.array_compact(F.transform("entries", lambda e: F.nullif(e, F.lit(""))))
    has_doi, has_id = ~blank(said("doi")), ~blank(said("id"))
    out = {
        "missing_ids": blank(said("id")),
        "malformed_openalex_ids": has_id & ~said("id").rlike(id_pattern),
        "missing_titles": blank(said("title")) & blank(said("display_name")),
        "missing_or_empty_abstract_index": empty("abstract_inverted_index"),
        "malformed_abstract_index": ~empty("abstract_inverted_index") & F.coalesce(bad_place, F.lit(True)),
        "missing_publication_dates": blank(said("publication_date")),
        "malformed_publication_dates": ~blank(said("publication_date")) & day.isNull(),
        "future_publication_dates": day > F.lit(today),
        "publication_year_mismatch": F.year(day) != year,
        "invalid_publication_year": F.coalesce((year < 1800) | (year > today.year + 1), F.lit(True)),
        "missing_authorships": empty("authorships"),
        "duplicate_author_ids_within_paper": F.size(authors) != F.size(F.array_distinct(authors)),
        "invalid_cited_by_count": F.coalesce((kind_of("cited_by_count") != "int") | (F.try_variant_get("v", "$.cited_by_count", "bigint") < 0), F.lit(True)),
        "empty_referenced_works": empty("referenced_works"),
        "duplicate_references_within_paper": F.size(F.col("references")) != F.size(F.array_distinct(F.col("references"))),
        "self_references": F.array_contains(F.col("references"), said("id")),
        "missing_doi": blank(said("doi")),
        "malformed_doi": has_doi & ~said("doi").rlike(DOI),
        "missing_language": blank(said("language")),
        "missing_primary_source": F.coalesce(said("primary_location.source.id") == "", F.lit(True)),
    }
    for kind, names in (("list", ("authorships", "referenced_works", "locations", "concepts", "topics")), ("object", ("primary_location", "open_access"))):
        out |= {f"malformed_{name}": not_a(kind, name) for name in names}
    return out


def entries(found: Column | None = None) -> Column:
    """The author id of each authorship, null where it has none; no entries where authorships is no list, its shape if it
    was found before."""
    listed = F.when((shape("authorships") if found is None else found) == "list", got("authorships", "array<variant>"))
    return F.coalesce(F.transform(listed, lambda e: F.try_variant_get(e, "$.author.id", "string")), F.array().cast("array<string>"))


def record_checks(lines: DataFrame, expected: list[str], id_pattern: str, today: date, examples: int = 5) -> DataFrame:
    """name, category, severity, status, count, denominator, percentage, examples of each check over JSON texts (value).

    status is `pass` with a count of 0, else the severity.  Examples are the smallest ids, or texts that name what is
    missing, at most `examples`.  A null, blank or unreadable text is a record without fields.  All checks of single
    records are one scan and one aggregate; ids are counted by id, fields by name.  An empty table passes every check
    but that of the expected fields.
    """
    checks = predicates(id_pattern, today)
    named = prepared(lines).select(F.coalesce("text_id", F.lit("no id")).alias("id"), F.col("text_id").alias("own"), "entries", "keys", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])

    sizes = F.size("entries").alias("signed"), F.size(F.filter("entries", blank)).alias("unsigned")
    named = checkpointed(named.select("id", "own", *sizes, "keys", *checks))  # the texts are made and parsed once for all counts below
    counts = [F.count_if(F.col(n)).alias(f"{n}__n") for n in checks]
    totals = named.agg(F.count("*").alias("records"), F.sum("signed").alias("signed"), F.sum("unsigned").alias("unsigned"), *counts)

    def line(n: str, count: Column, denominator: Column, example: Column) -> Column:
        return F.struct(F.lit(n).alias("name"), count.cast("bigint").alias("count"), denominator.cast("bigint").alias("denominator"), example.alias("examples"))

    none = F.array().cast("array<string>")
    rows = [line(n, F.col(f"{n}__n"), F.col("records"), none) for n in checks]
    rows.append(line("authorship_entries_missing_author_id", F.coalesce("unsigned", F.lit(0)), F.coalesce("signed", F.lit(0)), none))
    single = totals.select(F.explode(F.array(*rows)).alias("c")).select("c.*")

    ids = named.select(F.col("own").alias("id")).where(~blank(F.col("id"))).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    repeated = ids.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count")).crossJoin(F.broadcast(totals.select("records")))
    repeated = repeated.select(F.lit("duplicate_ids").alias("name"), F.col("count").cast("bigint"), F.col("records").alias("denominator"), none.alias("examples"))

    seen = named.select("keys").distinct().select(F.explode("keys").alias("field")).distinct()
    both = seen.withColumn("seen", F.lit(1)).join(F.broadcast(lines.sparkSession.createDataFrame([(f, 1) for f in expected], "field string, wanted int")), "field", "full")
    fields = both.agg(*[F.array_sort(F.collect_set(F.when(F.col(c).isNull(), F.col("field")))).alias(c) for c in ("seen", "wanted")], F.count("seen").alias("n"))
    about = [line("missing_expected_fields", F.size("seen"), F.lit(max(1, len(expected))), F.slice("seen", 1, examples)), line("unexpected_fields", F.size("wanted"), F.greatest(F.col("n"), F.lit(1)), F.slice("wanted", 1, examples))]
    fields = fields.select(F.explode(F.array(*about)).alias("c")).select("c.*")

    # each task keeps the `examples` smallest ids of a check, so that no check's failures are brought together
    failing = named.select("id", F.explode(F.array_compact(F.array(*[F.when(F.col(n), n) for n in checks]))).alias("name"))
    failing = failing.union(ids.select("id", F.lit("duplicate_ids")))
    first = failing.withColumn("at", F.row_number().over(Window.partitionBy("name").orderBy("id"))).where(F.col("at") <= examples)
    first = first.groupBy("name").agg(F.array_sort(F.collect_list("id")).alias("ids"))

    known = F.create_map(*[F.lit(x) for n, c, s in CHECKS for x in (n, f"{c} {s}")])
    kind = F.split(known[F.col("name")], " ")
    out = single.unionByName(repeated).unionByName(fields).withColumns({"category": kind[0], "severity": kind[1]})
    out = out.join(F.broadcast(first), "name", "left").withColumn("examples", F.coalesce("ids", "examples"))  # a row a check
    share = F.when(F.col("denominator") > 0, F.round(100 * F.col("count") / F.col("denominator"), 2)).otherwise(0.0)
    return out.select("name", "category", "severity", F.when(F.col("count") == 0, "pass").otherwise(F.col("severity")).alias("status"), "count", "denominator", share.alias("percentage"), "examples")
