"""URL filtering by empirical-Bayes host reputation, in DataFrame expressions only.

Labelled pages give each host a number of outcomes and of bad ones.  Their rates are shrunk through three beta-binomial
levels: suffixes towards the overall rate, registered domains towards their suffix, hosts towards their domain.  The
strength of each prior, in pseudo-outcomes, is estimated from the spread of the rates at that level.  A host is blocked
if the lower bound of its posterior is over the limit.  Explicit rules come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Fixed values: (verdict, host, start of path); the longest that fits wins.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for a null url or one without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for a null url or one without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label of the host; of a country's second-level suffix (as in co.uk) the last two."""
    return F.regexp_extract(host, r"(?:^|\.)((?:(?:co|com|org|net|ac|gov|edu)\.[a-z]{2})|[^.]*)$", 1)


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and the label before it."""
    return F.regexp_extract(host, r"(?:^|\.)([^.]*\.?(?:(?:(?:co|com|org|net|ac|gov|edu)\.[a-z]{2})|[^.]*))$", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, ties going to the first listed; null if none does."""
    def fits(name: str, start: str) -> Column:
        return ((host == name) | host.endswith("." + name)) & path.startswith(start)

    out = None
    for verdict, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        found = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits(name, start), found) if out is None else out.when(fits(name, start), found)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def strength(counts: DataFrame, n: str, bad: str, prior: str) -> DataFrame:
    """One row (strength): pseudo-outcomes of the prior that makes the spread of bad/n around prior what it is.

    By moments: outcomes of a group with n of them vary around its prior p by p(1-p)(1 + (n-1) rho) / n, and the
    strength is 1/rho - 1.  Without spread beyond chance, or without groups of two outcomes, it is MOST_STRENGTH.
    """
    p, k, m = F.col(prior), F.col(bad).cast("double"), F.col(n).cast("double")
    seen = counts.where(m >= 2).agg(
        F.sum((k - m * p) * (k - m * p) - m * p * (1 - p)).alias("excess"), F.sum(m * (m - 1) * p * (1 - p)).alias("room")
    )
    rho = F.when((F.col("excess") > 0) & (F.col("room") > 0), F.col("excess") / F.col("room"))
    return seen.select(F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), F.coalesce(1 / rho - 1, F.lit(MOST_STRENGTH)))).alias("strength"))


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """host, n, bad, rate, low, high for each host of outcomes (host, bad 0/1); rows with a null in either are ignored.

    rate is the posterior mean, low and high bound it by z standard deviations of the posterior beta distribution.
    Outcomes are first summed by host, so a host with a third of all rows is one row from then on.
    """
    hosts = outcomes.where("host is not null and bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("bigint")).alias("bad"))
    hosts = cut(hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}))  # and each level: the next ones read it twice
    totals = F.sum("n").alias("n"), F.sum("bad").alias("bad")
    domains = cut(hosts.groupBy("domain", "suffix").agg(*totals))
    suffixes = domains.groupBy("suffix").agg(*totals)
    overall = suffixes.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("prior"))

    def shrunk(level: DataFrame, by: DataFrame) -> DataFrame:
        """level with its posterior mean, by being the one row that holds the strength."""
        s = F.col("strength")
        return level.crossJoin(F.broadcast(by)).withColumn("rate", (F.col("bad") + s * F.col("prior")) / (F.col("n") + s))

    top = cut(suffixes.crossJoin(F.broadcast(overall)))
    top = shrunk(top, strength(top, "n", "bad", "prior"))
    mid = cut(domains.join(top.select("suffix", F.col("rate").alias("prior")), "suffix"))
    mid = shrunk(mid, strength(mid, "n", "bad", "prior"))
    low = cut(hosts.join(mid.select("domain", "suffix", F.col("rate").alias("prior")), ["domain", "suffix"]))
    low = shrunk(low, strength(low, "n", "bad", "prior"))
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("strength") + 1))
    return low.select("host", "n", "bad", "rate", F.greatest(F.lit(0.0), F.col("rate") - z * sd).alias("low"), F.least(F.lit(1.0), F.col("rate") + z * sd).alias("high"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES, limit: float = 0.5, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and bad_low, replacing columns of these names: a rule's verdict, else `block`
    if the lower posterior bound of the host's bad rate is over limit, else `allow`; bad_low is null for a host without
    outcomes.  A null url has an empty host and path.  Every row of pages comes out once.
    """
    new = ("host", "path", "rule", "verdict", "bad_low", "found")
    base = pages.select(*[c for c in pages.columns if c not in new])
    base = base.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    base = base.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    known = host_reputation(outcomes).select("host", F.col("low").alias("bad_low"))
    verdict = F.coalesce("found.verdict", F.when(F.col("bad_low") > limit, "block").otherwise("allow"))
    return base.join(known, "host", "left").withColumns({"rule": F.col("found.rule"), "verdict": verdict}).drop("found")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of pages whose path ends in the number of a labelled document: bad if it is toxic or of low quality."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.html?)?/?$", 1)
    seen = pages.select(host_of(F.col("url")).alias("host"), F.when(number != "", number).cast("bigint").alias("doc_id"))
    bad = labels.groupBy("doc_id").agg(F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("bad"))
    return seen.where("doc_id is not null").join(bad, "doc_id").select("host", "bad")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    outcomes = page_outcomes(pages, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


#: The same in DuckDB's SQL.
ORACLE_SQL = r"""
WITH pg AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(verdict, name, start) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
ruled AS (
  SELECT page_id, host, path, (SELECT name || start || ' ' || verdict FROM rules
    WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) ORDER BY length(name || start) DESC LIMIT 1) AS hit
  FROM pg),
lab AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
seen AS (
  SELECT host, bad FROM (SELECT host, try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})(?:\.html?)?/?$', 1), '') AS BIGINT) AS doc_id FROM pg) p
  JOIN lab USING (doc_id) WHERE bad IS NOT NULL),
hosts AS (
  SELECT host, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad,
    regexp_extract(host, '(?:^|\.)([^.]*\.?(?:(?:(?:co|com|org|net|ac|gov|edu)\.[a-z]{2})|[^.]*))$', 1) AS domain,
    regexp_extract(host, '(?:^|\.)((?:(?:co|com|org|net|ac|gov|edu)\.[a-z]{2})|[^.]*)$', 1) AS suffix
  FROM seen GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
top0 AS (SELECT *, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM suffixes) AS prior FROM suffixes),
s1 AS (SELECT sum((bad - n * prior) ^ 2 - n * prior * (1 - prior)) AS e, sum(n * (n - 1) * prior * (1 - prior)) AS r FROM top0 WHERE n >= 2),
k1 AS (SELECT greatest(1.0, least(1000.0, coalesce(CASE WHEN e > 0 AND r > 0 THEN r / e - 1 END, 1000.0))) AS s FROM s1),
top1 AS (SELECT suffix, (bad + s * prior) / (n + s) AS rate FROM top0, k1),
mid0 AS (SELECT d.*, rate AS prior FROM domains d JOIN top1 USING (suffix)),
s2 AS (SELECT sum((bad - n * prior) ^ 2 - n * prior * (1 - prior)) AS e, sum(n * (n - 1) * prior * (1 - prior)) AS r FROM mid0 WHERE n >= 2),
k2 AS (SELECT greatest(1.0, least(1000.0, coalesce(CASE WHEN e > 0 AND r > 0 THEN r / e - 1 END, 1000.0))) AS s FROM s2),
mid1 AS (SELECT domain, suffix, (bad + s * prior) / (n + s) AS rate FROM mid0, k2),
low0 AS (SELECT h.*, rate AS prior FROM hosts h JOIN mid1 USING (domain, suffix)),
s3 AS (SELECT sum((bad - n * prior) ^ 2 - n * prior * (1 - prior)) AS e, sum(n * (n - 1) * prior * (1 - prior)) AS r FROM low0 WHERE n >= 2),
k3 AS (SELECT greatest(1.0, least(1000.0, coalesce(CASE WHEN e > 0 AND r > 0 THEN r / e - 1 END, 1000.0))) AS s FROM s3),
low1 AS (SELECT host, n, s, (bad + s * prior) / (n + s) AS rate FROM low0, k3),
bound AS (SELECT host, greatest(0, rate - 1.645 * sqrt(rate * (1 - rate) / (n + s + 1))) AS bad_low FROM low1)
SELECT page_id, host, path, split_part(hit, ' ', 1) AS rule,
  coalesce(split_part(hit, ' ', 2), CASE WHEN bad_low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN bound USING (host)
"""
