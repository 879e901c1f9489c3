"""Licence scanning, in DataFrame expressions only.

Three fixed phrases give the base places, counted in words.  Beyond them several hundred ordered rules are tried: one
pattern finds the texts that can hold any keyword, each rule's keyword gates its regex, and a detection that lies
within one of a rule of higher priority is suppressed.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let
from .license_rules import rules

#: Characters of words once A-Z is lower-cased, and the base phrases with their labels.
IN_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII that stands between words, but for NUL, which F.translate takes for "no character".
SIGNS = "".join(chr(c) for c in range(1, 128) if not chr(c).isalnum())
BASE_SURENESS = 0.5
EMPTY = "array<struct<label:string,sure:double,priority:int,start:int,end:int>>"


def any_keyword() -> str:
    """A pattern that each text with a match of some rule matches.  It has `licen` in place of the keywords of those
    rules whose regex has `licen` outside its groups, and leaves out keywords that hold another."""
    words = set()
    for _, _, _, keyword, pattern, _ in rules():
        always = pattern[pattern.index("(?:") + 3 : pattern.rindex(")(?!")]
        while "(" in always:
            always = re.sub(r"\([^()]*\)", "", always)
        words.add("licen" if "licen" in always and "|" not in always else keyword)
    least: list[str] = []
    for w in sorted(words, key=len):
        if not any(k in w for k in least):
            least.append(w)
    return "(?i)" + "|".join(map(re.escape, sorted(least)))


def word_count(text: Column) -> Column:
    """Number of words; all signs become spaces first, so that the regex tells only two characters apart."""
    return F.regexp_count(F.translate(text, SIGNS, " " * len(SIGNS)), F.lit(r"[^ \x00]+"))


def base_places(text: Column) -> Column:
    """array<struct<label, start>>: word numbers at which the words of a phrase stand one after another."""
    def of(phrase: str, label: str) -> Column:
        words = phrase.split(" ")
        body = (BETWEEN + "+").join("".join(f"[{c.upper()}{c}]" for c in w) for w in words)
        pattern = f"(?<!{IN_WORD}){body}(?!{IN_WORD})"
        kind = "struct<words:int,out:array<struct<label:string,start:int>>>"

        def step(acc: Column, gap: Column) -> Column:
            start = acc["words"] + word_count(gap)
            return F.struct((start + len(words)).alias("words"), F.concat(acc["out"], F.array(F.struct(F.lit(label).alias("label"), start.alias("start")))).alias("out")).cast(kind)

        gaps = let(F.split(text, pattern, -1), lambda g: F.slice(g, 1, F.size(g) - 1))
        walked = F.aggregate(gaps, F.struct(F.lit(0), F.array()).cast(kind), step, lambda acc: acc["out"])
        lower = F.translate(text, UPPER, LOWER)
        holds = reduce(and_, [F.contains(lower, F.lit(w)) for w in words])
        return F.when(holds & text.rlike(pattern), walked).otherwise(F.array().cast("array<struct<label:string,start:int>>"))

    return F.concat(*[of(*p) for p in PHRASES])


def detections(text: Column) -> Column:
    """array<struct<label, sure, priority, start, end>> of the rules' matches that no higher rule's match contains."""
    table = F.array(*[F.struct(F.lit(n).alias("priority"), F.lit(label).alias("label"), F.lit(k).alias("keyword"), F.lit(p).alias("pattern"), F.lit(sure).alias("sure")) for n, _, label, k, p, sure in rules()])

    def matches(lower: Column, rule: Column) -> Column:
        found = F.regexp_extract_all(lower, rule["pattern"], F.lit(0))
        state = f"struct<at:int,out:{EMPTY}>"

        def walk(found: Column, gaps: Column) -> Column:
            def step(acc: Column, i: Column) -> Column:
                start = acc["at"] + F.length(F.get(gaps, i))
                end = start + F.length(F.get(found, i))
                one = F.array(F.struct(rule["label"].alias("label"), rule["sure"].alias("sure"), rule["priority"].alias("priority"), start.alias("start"), end.alias("end")))
                return F.struct(end.alias("at"), F.concat(acc["out"], one.cast(EMPTY)).alias("out")).cast(state)

            return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), F.struct(F.lit(0), F.array()).cast(state), step, lambda acc: acc["out"])

        none = F.array().cast(EMPTY)
        return let(found, lambda f: F.when(F.size(f) > 0, let(F.split(lower, rule["pattern"], -1), lambda g: walk(f, g))).otherwise(none))

    def kept(found: Column) -> Column:
        def higher(d: Column) -> Column:
            return F.exists(found, lambda e: (e["priority"] < d["priority"]) & (e["start"] <= d["start"]) & (d["end"] <= e["end"]))

        return F.filter(found, lambda d: ~higher(d))

    def scan(lower: Column) -> Column:
        gated = F.filter(table, lambda r: F.contains(lower, r["keyword"]))
        return let(F.flatten(F.transform(gated, lambda r: matches(lower, r))), kept)

    lower = F.translate(text, UPPER, LOWER)
    return F.when(text.rlike(any_keyword()), let(lower, scan)).otherwise(F.array().cast(EMPTY))


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places (base) and found (detections) of each row.

    A null text counts as empty.  Every row comes out, repeated ones and null ids too; extra columns are ignored; no
    row is shuffled.  Positions of detections are code points of the text, the end exclusive.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    return base.select("doc_id", word_count(text).cast("bigint").alias("n_words"), base_places(text).alias("places"), detections(text).alias("found"))


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    found = find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    starts = F.transform("places", lambda p: p["start"].cast("bigint"))
    base = F.transform("places", lambda p: p["label"])
    more = F.transform("found", lambda d: d["label"])
    sure = F.greatest(F.coalesce(F.array_max(F.transform("found", lambda d: d["sure"])), F.lit(0.0)), F.when(F.size("places") > 0, BASE_SURENESS).otherwise(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"), sure.alias("score"),
    )
