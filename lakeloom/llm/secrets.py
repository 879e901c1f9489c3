"""Secret scanning, in DataFrame expressions only.

Three fixed patterns give the base spans.  Beyond them, candidate strings are cut from the text, each is split into the
runs of one character class that it holds, and over each run a window slides whose character counts are kept
incrementally: a step adds one character and takes one away.  The run is a secret if some window's Shannon entropy
reaches its class's threshold and no allow-list entry explains it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: The base patterns.  (kind, pattern, group whose length counts, least length)
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 and more: a shorter run holds no longer one
HEX = r"[0-9a-f]{24,}"
BASE = [("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24)]
KINDS = ["assign", "access", "hex", "entropy"]

#: A candidate has no white space or quotes, is as long as a window at least, and has a digit or a sign beside letters.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}"
WINDOW = 20
#: (class, characters, bits that a window of WINDOW characters must reach)
CLASSES = [("hexadecimal", "0123456789abcdefABCDEF", 3.0), ("alphanumeric", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 3.6),
           ("base64", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/=_-", 3.8)]
#: What looks random and is no secret: placeholders, alphabets and counting, UUIDs, words joined by signs, paths.
ALLOWED = (
    r"(?i)example|sample|placeholder|changeme|redacted|dummy|xxxx|0000000|1234567|abcdef0|abcdefgh|deadbeef"
    r"|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    r"|^[a-z]+([-_/+=]+[a-z]+)*[-_/+=]*[0-9]{0,4}$|^[-_/+=0-9]+$|^/?[a-z0-9_-]{1,16}(/[a-z0-9_-]{1,16}){2,}/?$"
)


def places(text: Column, pattern: str, kind: str, group: int, least: int) -> Column:
    """array<struct<start, end, kind, value>> of the leftmost non-overlapping matches, positions in code points, end
    exclusive.  What lies between matches and the matches themselves come in turn, so lengths add up to positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def walk(found: Column, gaps: Column, kept: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>").alias("out"))

        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(gaps, i))
            end = start + F.length(F.get(found, i))
            span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), F.get(found, i).alias("value"))
            out = F.when(F.length(F.get(kept, i)) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
            return F.struct(end.alias("at"), out.alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, step, lambda acc: acc["out"])

    walked = let(found, lambda f: let(gaps, lambda g: let(kept, lambda k: walk(f, g, k))))
    none = F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")
    return F.when(text.rlike(pattern), walked).otherwise(none)


def entropy_reached(run: Column, bits: float, window: int = WINDOW) -> Column:
    """Whether the Shannon entropy of some `window` consecutive characters of run is at least bits.

    With counts c the entropy is log2(w) - sum(c log2 c) / w; the state is the counts by ASCII code and that sum, and
    one character in and one out changes two counts.  A run shorter than the window has none.
    """
    terms = F.lit([0.0] + [c * math.log2(c) for c in range(1, window + 1)])
    most = window * (math.log2(window) - bits) + 1e-9

    def moved(state: Column, entering: Column, leaving: Column | None) -> Column:
        counts, total = state["counts"], state["total"]
        if leaving is None:
            delta = F.get(terms, F.get(counts, entering) + 1) - F.get(terms, F.get(counts, entering))
            changed = F.transform(counts, lambda c, i: F.when(i == entering, c + 1).otherwise(c))
        else:
            up = F.get(terms, F.get(counts, entering) + 1) - F.get(terms, F.get(counts, entering))
            down = F.get(terms, F.get(counts, leaving) - 1) - F.get(terms, F.get(counts, leaving))
            delta = F.when(entering == leaving, 0.0).otherwise(up + down)
            changed = F.when(entering == leaving, counts).otherwise(
                F.transform(counts, lambda c, i: F.when(i == entering, c + 1).when(i == leaving, c - 1).otherwise(c))
            )
        now = total + delta
        return F.struct(changed.alias("counts"), now.alias("total"), F.least(state["best"], now).alias("best"))

    def code(at: Column) -> Column:
        return F.ascii(F.substring(run, at, F.lit(1)))

    start = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("total"), F.lit(1e9).alias("best"))
    filled = F.aggregate(F.sequence(F.lit(1), F.lit(window)), start, lambda s, i: moved(s, code(i), None))
    first = let(filled, lambda s: F.struct(s["counts"].alias("counts"), s["total"].alias("total"), s["total"].alias("best")))
    slid = F.aggregate(
        F.filter(F.sequence(F.lit(window), F.length(run)), lambda i: i > window), first, lambda s, i: moved(s, code(i), code(i - window)), lambda s: s["best"]
    )
    return F.when(F.length(run) >= window, slid <= most).otherwise(F.lit(False))


def looks_random(candidate: Column) -> Column:
    """Whether a run of some character class in candidate is random enough and no allow-list entry explains it."""
    def of_class(chars: str, bits: float) -> Column:
        inside = "".join("\\" + c if c in "+/=_-" else c for c in chars)
        runs = F.regexp_extract_all(candidate, F.lit(f"[{inside}]{{{WINDOW},}}"), F.lit(0))
        return F.exists(runs, lambda run: entropy_reached(run, bits) & run.rlike("[0-9]") & run.rlike("[A-Za-z]"))

    random = None
    for _, chars, bits in CLASSES:
        random = of_class(chars, bits) if random is None else random | of_class(chars, bits)
    return ~candidate.rlike(ALLOWED) & random


def spans(text: Column) -> tuple[Column, Column]:
    """(base spans, spans by entropy) of a text, each an array in order of start."""
    base = F.concat(*[places(text, pattern, kind, group, least) for kind, pattern, group, least in BASE])
    rank = {k: i for i, k in enumerate(KINDS)}
    key = F.transform(base, lambda s: F.struct(s["start"], F.array_position(F.lit(list(rank)), s["kind"]).alias("rank"), s["end"], s["kind"], s["value"]))
    more = F.filter(places(text, CANDIDATE, "entropy", 0, WINDOW), lambda s: looks_random(s["value"]))
    more = F.transform(more, lambda s: F.struct(s["start"], F.lit(len(KINDS)).cast("bigint").alias("rank"), s["end"], s["kind"], s["value"]))
    return F.array_sort(key), more


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, base and found: array<struct<start, rank, end, kind, value>> of the base spans and of all spans,
    by start and then kind.  A null text counts as empty; every row comes out, repeated ones and null ids too; extra
    columns are ignored.  An entropy span that a base span covers is not told again.  No row is shuffled.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    first, more = spans(F.col("text"))
    new = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"])))
    return base.withColumns({"base": first, "more": more}).withColumn("found", F.array_sort(F.concat("base", new))).drop("more")


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
