"""Profiles of untyped JSON records: types, nulls and an example of each field, and statistics of a whole set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.record_checks import blank, entries, shape, text


def example(value: Column, longest: int = 140) -> Column:
    """A value as JSON for a Markdown cell: one line, at most `longest` characters, | escaped, in backticks."""
    one = F.regexp_replace(value, r"\n", " ")
    cut = F.when(F.length(one) > longest, F.concat(F.substring(one, 1, longest - 3), F.lit("..."))).otherwise(one)
    return F.concat(F.lit("`"), F.replace(cut, F.lit("|"), F.lit("\\|")), F.lit("`"))


def field_profile(lines: DataFrame, fields: list[str], used: list[str]) -> DataFrame:
    """field, types (sorted, comma-joined), records, null_count (absent ones too), null_percentage, example (the smallest
    that is not empty) and used, for each of the fields, which may be dotted paths, over JSON texts (value)."""
    parsed = lines.select(F.try_parse_json("value").alias("v"))

    def of(f: str) -> Column:
        raw = F.to_json(F.try_variant_get("v", f"$.{f}", "variant"))
        full = ~raw.isin("null", "{}", "[]", '""')
        return F.struct(F.lit(f).alias("field"), shape(f).alias("type"), F.when(full, example(raw)).alias("x"))

    each = parsed.select(F.explode_outer(F.array(*map(of, fields))).alias("f")).select("f.*")
    kinds = each.groupBy("field", "type").agg(F.count("*").alias("n"), F.min("x").alias("x"))
    out = kinds.groupBy("field").agg(
        F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"), F.sum("n").alias("records"),
        F.coalesce(F.sum(F.when(F.col("type") == "null", F.col("n"))), F.lit(0)).alias("null_count"), F.min("x").alias("example"),
    )
    return out.withColumns({"null_percentage": F.round(100 * F.col("null_count") / F.col("records"), 2), "used": F.col("field").isin(used)})


def dataset_statistics(lines: DataFrame) -> DataFrame:
    """One row of counts over JSON texts (value); ids and authors are counted by groups, not in one task.

    The texts are read and parsed once: each gives a row for itself, one for its id and one for each author, which meet in
    one shuffle.  `outer` keeps the optimizer from asking below the parsing whether there are any, parsing for each field."""
    parsed = lines.select(F.try_parse_json("value").alias("v"))
    year = F.when(shape("publication_year") == "int", F.try_variant_get("v", "$.publication_year", "bigint"))
    references = F.when(shape("referenced_works") == "list", F.size(F.try_variant_get("v", "$.referenced_works", "array<variant>")))
    index = F.to_json(F.try_variant_get("v", "$.abstract_inverted_index", "variant"))
    facts = parsed.select(
        text("id").alias("id"), entries().alias("authors"), references.alias("refs"), year.alias("year"),
        (blank(text("title")) & blank(text("display_name"))).alias("untitled"), F.coalesce(index.isin("null", "{}", "[]"), F.lit(True)).alias("bare"),
    )
    # 'r' is the record, 'i' its id, 'a' an author
    none = F.array().cast("array<struct<kind:string,key:string>>")

    def part(kind: str, keys: Column) -> Column:
        return F.transform(F.filter(keys, lambda k: ~blank(k)), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    own = F.array(F.struct(F.lit("r").alias("kind"), F.lit(None).cast("string").alias("key")))
    each = facts.withColumn("part", F.explode_outer(F.concat(own, F.coalesce(part("i", F.array("id")), none), part("a", F.col("authors")))))
    record = F.col("part.kind") == "r"
    groups = each.groupBy("part.kind", "part.key").agg(
        F.count("*").alias("n"), F.sum(F.when(record, F.col("refs"))).alias("refs"), F.min(F.when(record, F.col("year"))).alias("first"), F.max(F.when(record, F.col("year"))).alias("last"),
        F.count_if(record & F.col("untitled")).alias("untitled"), F.count_if(record & F.col("bare")).alias("bare"), F.count_if(record & (F.size("authors") == 0)).alias("unsigned"),
    )
    is_id = F.col("kind") == "i"
    return groups.agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "r", F.col("n"))), F.lit(0)).alias("record_count"), F.coalesce(F.sum("refs"), F.lit(0)).alias("reference_count"),
        F.min("first").alias("first_year"), F.max("last").alias("last_year"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"missing_{name}") for name, c in (("titles", "untitled"), ("abstracts", "bare"), ("authors", "unsigned"))],
        F.count_if(is_id).alias("unique_publications"), F.coalesce(F.sum(F.when(is_id, F.col("n") - 1)), F.lit(0)).alias("duplicate_identifiers"),
        F.count_if(F.col("kind") == "a").alias("unique_authors"),
    )


def most_common(lines: DataFrame, field: str, top: int = 20) -> DataFrame:
    """value, records: the `top` display names of a list of objects, ties by name."""
    listed = F.when(shape(field) == "list", F.try_variant_get("v", f"$.{field}", "array<variant>"))
    names = lines.select(F.try_parse_json("value").alias("v")).select(F.explode_outer(F.transform(listed, lambda x: F.try_variant_get(x, "$.display_name", "string"))).alias("value"))
    return names.where(F.col("value") != "").groupBy("value").agg(F.count("*").alias("records")).orderBy(F.desc("records"), "value").limit(top)
