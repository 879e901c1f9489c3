import duckdb
import pytest

from lakeloom.llm import reputation as R

URLS = [None, "", "no scheme", "http://EXAMPLE.com/en/71?x#y", "https://a.example.com/en/6", "https://www.example.net/de/81#z", "ftp://x.net/de/", "http://net/de/1",
        "http://example.org", "http://bad.org/es/1", "http://badorg/es/1", "http://h?/en/", "a://b://c/d", "http://Ünï.COM/EN/1", "http://x.com/en/" + "9" * 50000,
        "http://u.co.uk/1", "http://v.u.co.uk/2.html"]


def run_both(spark, pages, labels):
    p = spark.createDataFrame(pages, "page_id bigint, url string")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = R.judge(p, R.page_outcomes(p, lab)).select("page_id", "host", "path", "rule", "verdict")
    c = duckdb.connect()
    pages, labels = p.toPandas(), lab.toPandas()  # noqa: F841
    return sorted(map(tuple, found.collect()), key=str), sorted(c.sql(R.ORACLE_SQL).fetchall(), key=str)


def test_rules_and_reputation(spark):
    pages = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3]), (None, URLS[4])]
    pages += [(100 + i, f"http://{'good' if i % 3 else 'spam'}{i % 2}.site.org/x/{i}") for i in range(120)]
    pages += [(500 + i, f"http://{i}.thin.net/x/{900 + i}") for i in range(5)]
    labels = [(i, 0 if i % 3 == 0 else 1, 0) for i in range(120)] + [(5, None, None), (None, 0, 1), (900, 0, 1), (900, 1, 0)]
    ours, sql = run_both(spark, pages, labels)
    assert ours == sql
    by = {r[0]: r for r in ours}
    assert by[4][3:] == ("com/en/", "block") and by[3][3:] == ("example.com/en/7", "allow")
    assert by[5][3:] == ("example.net/de/8", "block") and by[0][1:] == ("", "", None, "allow") and by[10][3] is None
    assert by[100][3:] == (None, "block") and by[101][3:] == (None, "allow")
    assert by[500][4] == "allow"  # one bad page does not condemn a host


def test_empty(spark):
    assert run_both(spark, [], []) == ([], [])
    assert [r[4] for r in run_both(spark, [(1, "http://a.b/c/1")], [])[0]] == ["allow"]


def test_prior_strength(spark):
    even = spark.createDataFrame([(10, 5, 0.5)] * 20, "n bigint, bad bigint, prior double")
    apart = spark.createDataFrame([(10, 10 * (i % 2), 0.5) for i in range(20)], "n bigint, bad bigint, prior double")
    assert R.strength(even, "n", "bad", "prior").first()[0] == R.MOST_STRENGTH
    assert R.strength(apart, "n", "bad", "prior").first()[0] == pytest.approx(R.LEAST_STRENGTH)


def test_rules_are_the_contracts(spark):
    assert {f"{host}{start}": word for word, host, start in R.RULES} == {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    spam = [(i, f"http://spam.net/de/{i}") for i in range(60)]
    p = spark.createDataFrame([*spam, (100, "http://spam.net/x/1"), (101, "http://example.net/de/8")], "page_id bigint, url string")
    lab = spark.createDataFrame([(i, 0, 1) for i in range(60)], "doc_id bigint, quality int, toxic int")
    by = {r["page_id"]: (r["rule"], r["verdict"]) for r in R.judge(p, R.page_outcomes(p, lab)).collect()}
    assert by[7] == ("net/de/", "allow") and by[100] == (None, "block") and by[101] == ("example.net/de/8", "block")
