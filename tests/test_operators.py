"""Operators on small hand-written records."""

import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from lakeloom.functions.text import corpus_tokens, inverted, normalize, normalize_doi, query_tokens, rebuild, short_id
from lakeloom.operators import dense, graph, learning, medallion, profiling, quality, record_checks, retrieval, temporal, terms
from lakeloom.streaming import monitor


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "doi, want",
    [("10.1/AB", "https://doi.org/10.1/ab"), ("doi:10.1/a", "https://doi.org/10.1/a"), ("https://doi.org/10.1/A", "https://doi.org/10.1/a"), (" ", None), (None, None)],
)
def test_doi(spark, doi, want):
    assert one(spark, normalize_doi(F.lit(doi).cast("string"))) == want


def test_text_functions(spark):
    assert one(spark, normalize(F.lit("  Café,  at SCALE! "))) == "café at scale"
    assert one(spark, normalize(F.lit(" ! "))) is None
    assert one(spark, short_id(F.lit("https://x.example/W12"))) == "W12"
    assert one(spark, corpus_tokens(F.lit("The spark at 123 clusters2 naïve"))) == ["spark", "clusters2"]
    assert one(spark, query_tokens(F.lit("AI in healthcare, and education! café"))) == ["healthcare", "education", "café"]
    index = F.create_map(F.lit("at"), F.array(F.lit(1)), F.lit("Data"), F.array(F.lit(0), F.lit(2)))
    assert one(spark, rebuild(index)) == "Data at Data"
    assert one(spark, rebuild(F.lit(None).cast("map<string,array<int>>"))) is None


RECORDS = [
    {
        "id": "https://x.example/W1", "doi": "10.1/A", "title": " Data at Scale ", "publication_date": "2024-02-03", "publication_year": 2024,
        "abstract_inverted_index": {"Data": [0]}, "referenced_works": ["https://x.example/W1", "https://x.example/W2"],
        "authorships": [{"author": {"id": "https://x.example/A1", "display_name": "B"}}, {"author": {"id": None}}],
        "topics": [{"id": "https://x.example/T1", "display_name": "t", "field": {"display_name": "f"}}],
    },
    {"id": "https://x.example/W2", "title": " ", "publication_date": "2024-13-01", "publication_year": 2023, "authorships": [], "referenced_works": {}},
    {"title": None, "publication_date": "2022-01-01", "publication_year": 2023},
]


def records(spark, tmp_path):
    path = tmp_path / "raw.jsonl"
    path.write_text("\n".join(map(json.dumps, RECORDS)))
    return medallion.read_raw(spark, str(path))


def test_medallion(spark, tmp_path):
    base = "https://x.example/"
    tables = medallion.medallion(spark, records(spark, tmp_path), str(tmp_path / "out"), base)
    found = {r["paper_openalex_id"]: r for r in tables["silver"].collect()}
    assert len(found) == 3 and {r["paper_id"] for r in found.values()} == {base + "W1", base + "W2", None}
    assert found["W1"]["title"] == "Data at Scale" and found["W1"]["quality_flags"] == [] and found["W1"]["doi"] == "https://doi.org/10.1/a"
    assert found["W2"]["quality_flags"] == ["missing_title", "missing_abstract", "missing_authorships", "malformed_publication_date"]
    assert found[None]["quality_flags"] == ["missing_id", "missing_title", "missing_abstract", "missing_authorships", "publication_year_mismatch"]
    assert [tuple(r) for r in tables["author_publications"].collect()] == [(base + "W1", 0, base + "A1", "B")]
    assert [tuple(r) for r in tables["citation_edges"].collect()] == [(base + "W1", base + "W2")]
    assert [tuple(r) for r in tables["topics"].collect()] == [(base + "W1", base + "T1", "t", None, "f", None)]
    assert tables["publications"].count() == 3 and "authorships" not in tables["publications"].columns
    assert medallion.accounting(tables["silver"]).first() == (3, 2, 1)
    assert set(tables["bronze"].columns) >= {"_bronze_ingested_at_utc", "_source_dataset", "_source_license"}


def test_record_checks(spark):
    good = {"id": "https://x.example/W1", "doi": "10.1/a", "title": "t", "publication_date": "2024-02-03", "publication_year": 2024, "cited_by_count": 1, "language": "en",
            "abstract_inverted_index": {"a": [0]}, "referenced_works": ["r"], "authorships": [{"author": {"id": "a"}}, {"author": None}], "primary_location": {"source": {"id": "s"}},
            "locations": [], "concepts": [], "topics": [], "open_access": {}}
    bad = {"id": "W", "doi": "x", "title": " ", "publication_date": "2024-13-03", "publication_year": "2024", "cited_by_count": -1, "abstract_inverted_index": {"a": ["0"]},
           "referenced_works": {"a": 1}, "authorships": {"b": 1}, "primary_location": [], "locations": {}, "concepts": {}, "topics": {}, "open_access": [], "extra": 1}
    twice = {**good, "referenced_works": ["r", "r", "https://x.example/W1"], "authorships": [{"author": {"id": "a"}}, {"author": {"id": "a"}}], "publication_year": 2023, "publication_date": "2025-01-01"}
    lines = spark.createDataFrame([(json.dumps(r),) for r in (good, bad, twice)], "value string")
    found = {r["name"]: r for r in record_checks.record_checks(lines, [*good, "grants"], r"^https://x\.example/W\d+$", date(2024, 6, 1)).collect()}
    assert len(found) == 31 == len(record_checks.CHECKS)
    ones = {n for n, r in found.items() if r["count"] == 1}
    assert {n for n in found if n.startswith("malformed_")} <= ones and {"duplicate_references_within_paper", "duplicate_author_ids_within_paper", "self_references", "future_publication_dates",
            "publication_year_mismatch", "invalid_publication_year", "invalid_cited_by_count", "missing_titles", "missing_language", "missing_primary_source", "authorship_entries_missing_author_id"} <= ones
    assert found["duplicate_ids"]["count"] == 2 and found["authorship_entries_missing_author_id"]["denominator"] == 4
    assert found["missing_expected_fields"]["examples"] == ["grants"] and found["unexpected_fields"]["examples"] == ["extra"]
    assert found["missing_titles"]["examples"] == ["W"] and found["missing_ids"]["status"] == "pass" and found["missing_titles"]["percentage"] == 33.33
    none = record_checks.record_checks(lines.where("false"), ["id"], "x", date(2024, 6, 1)).where("status <> 'pass'").collect()
    assert [r["name"] for r in none] == ["missing_expected_fields"]


def test_file_monitor_reads_each_file_once(spark, tmp_path):
    inbox, seen = tmp_path / "in", []
    inbox.mkdir()

    def sink(rows, batch):
        seen.extend(tuple(r) for r in monitor.file_metrics(rows).collect())

    for name in ("b", "a"):
        (inbox / f"{name}.json").write_text("\n".join(map(json.dumps, RECORDS)))
        monitor.watch_files(spark, str(inbox), medallion.RAW, str(tmp_path / "ck"), sink)
    assert seen == [("b.json", 3, 2, 2, 2023, 2024), ("a.json", 3, 2, 2, 2023, 2024)]


def test_arrivals(spark, tmp_path):
    inbox, check = tmp_path / "inbox", str(tmp_path / "check")
    assert monitor.arrivals(spark, str(inbox), medallion.RAW, check, ready=False)["status"] == "blocked"
    assert monitor.arrivals(spark, str(inbox), medallion.RAW, check)["status"] == "empty"
    inbox.mkdir()
    (inbox / "a.jsonl").write_text("\n".join(map(json.dumps, RECORDS)))
    got = monitor.arrivals(spark, str(inbox), medallion.RAW, check)
    assert got["status"] == "success" and got["record_count"] == 3 and got["missing_title_rate"] == pytest.approx(2 / 3)
    assert monitor.arrivals(spark, str(inbox), medallion.RAW, check)["file_count"] == 0


def test_numbering_and_alerts(spark):
    rows = monitor.numbered(spark.range(1000).withColumn("k", F.col("id") % 7), "k", "id")
    got = [(r.k, r.id) for r in rows.orderBy("position").collect()]
    assert got == sorted(got) and rows.agg(F.min("position"), F.max("position"), F.countDistinct("position")).first() == (1, 1000, 1000)
    metrics = monitor.batch_metrics(rows, 100, {"k": F.col("k") == 0})
    found = monitor.alerts(metrics, {"k": (0.43, "critical")}).collect()
    assert [(r.batch_id, r.observed_value) for r in found] == [(0, 1.0)]
    with pytest.raises(ValueError):
        monitor.batch_metrics(rows, 0, {})


def test_quality_rules_and_profile(spark):
    df = spark.createDataFrame([(1, "a"), (None, " "), (1, None)], "id int, t string")
    rules = [quality.Rule("id", "identity", "error", F.col("id").isNull()), quality.Rule("t", "text", "warn", quality.blank("t"), F.col("id").isNotNull())]
    assert [(r.name, r.failures, r.denominator, r.status, r.percentage) for r in quality.run_rules(df, rules).collect()] == [("id", 1, 3, "error", 33.33), ("t", 1, 2, "warn", 50.0)]
    assert [r.status for r in quality.run_rules(df.where("false"), rules).collect()] == ["pass", "pass"]
    assert quality.duplicates(df, "id").first()["records"] == 2
    assert [(r.column, r.nulls, r.distinct) for r in quality.profile(df).collect()] == [("id", 1, 1), ("t", 1, 2)]


def test_graph(spark):
    edges = graph.clean_edges(spark.createDataFrame([(1, 2), (1, 2), (2, 2), (3, 2), (None, 1)], "paper_id int, referenced_paper_id int"))
    ranks = {r.paper_id: r.pagerank for r in graph.pagerank(edges, 30).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks[2] > ranks[1] == pytest.approx(ranks[3])
    signed = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)], "paper_id int, author_id int")
    pairs = graph.coauthor_edges(signed)
    assert [tuple(r) for r in pairs.collect()] == [(1, 2, 2)]
    placed = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 1, 1), (2, 2, 0), (3, 3, 0)], "paper_id int, author_id int, author_position int")
    assert sorted(tuple(r) for r in graph.author_metrics(placed, pairs).collect()) == [(1, 2, 0, 0.5, 1, 2, 2, 1.0), (2, 2, 0, 0.5, 1, 2, 2, 1.0), (3, 1, 1, 0.0, 0, 0, 0, 0.0)]
    named = signed.withColumn("author_name", F.concat(F.lit("n"), F.col("author_id")))
    assert [tuple(r) for r in graph.collaborations(named).collect()] == [(1, "n1", 2, "n2", 2, [1, 2])]
    sampled = spark.createDataFrame([(1,), (3,), (9,)], "paper_id int")
    found = {r.paper_id: tuple(r)[1:] for r in graph.sample_degrees(edges.where("paper_id in (1, 3)"), sampled).collect()}
    assert found == {1: (1, 0, 0, True), 2: (0, 0, 0, False), 3: (1, 0, 0, True), 9: (0, 0, 0, True)}
    assert graph.graph_summary(edges.where("paper_id in (1, 3)"), sampled).first() == (4, 3, 2, 0, 2)
    assert graph.density(signed, pairs).first()["density"] == pytest.approx(1 / 3)


def test_evaluation(spark):
    ranking = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "query_id int, doc_id int, rank int")
    relevant = spark.createDataFrame([(1, 10), (1, 12)], "query_id int, doc_id int")
    first, second = sorted(retrieval.evaluate(ranking, relevant).collect())
    assert first["ap"] == pytest.approx(5 / 6) and first["mrr"] == 1 and first["recall"] == 1
    assert list(second)[1:] == [0, 0, 0, 0, 0]
    assert retrieval.fuse([ranking]).where("doc_id = 10 and query_id = 1").first()["score"] == pytest.approx(1 / 61)


def test_composite_constant_range(spark):
    df = spark.createDataFrame([(1, 5, 3), (2, 10, 3), (3, None, 3)], "paper_id int, c int, y int")
    got = {r.paper_id: r.score for r in temporal.composite(df, {"citation_count": "c", "recency": "y"}).collect()}
    assert got == {1: pytest.approx(0.375), 2: pytest.approx(0.75), 3: 0}
    with pytest.raises(ValueError):
        temporal.composite(df, {"other": "c"})


def odd_vectors(spark, seed=5):
    """(doc_id, v, label) with ties, copies, zero vectors, nulls, NaN, other lengths and a null id, and the first as queries."""
    r = random.Random(seed)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(4)], i % 3) for i in range(300)] + [(1000 + i, [1.0, 2.0, 0.0, 1.0], None) for i in range(40)]
    odd = [(2000, [0.0] * 4, 1), (2001, None, 1), (2002, [1.0, None, 1.0, 0.0], 1), (2003, [float("nan"), 1.0, 0.0, 0.0], 1), (2004, [1.0, 2.0], 1), (2005, [1e200, 0.0, 0.0, 0.0], 2), (None, [1.0, 1.0, 0.0, 0.0], 2)]
    schema = "doc_id bigint, v array<double>, label int"
    usual, all_of = spark.createDataFrame(rows, schema), spark.createDataFrame(rows + odd, schema)
    return usual, all_of, usual.where("doc_id < 9").selectExpr("doc_id AS query_id", "v AS q", "label")


def test_dense_against_all_pairs(spark, monkeypatch):
    usual, all_of, queries = odd_vectors(spark)
    left, right = (df.withColumn(n, dense.norm(c)).where(f"{n} > 0") for df, c, n in ((all_of, "v", "nv"), (queries, "q", "nq")))
    pairs = retrieval.ranked(dense.by_expression(left, right.drop("label")))
    want = {(r.query_id, r.rank): (r.doc_id, repr(r.score)) for r in pairs.collect()}
    for size in (dense.BLOCK_BYTES, 200):  # one block of queries, and several
        monkeypatch.setattr(dense, "BLOCK_BYTES", size)
        assert {(r.query_id, r.rank): (r.doc_id, repr(r.score)) for r in retrieval.ranked(dense.cosine(all_of, queries)).collect()} == want
        found = dense.best(all_of, queries, 5)
        assert {(r.query_id, r.rank): (r.doc_id, repr(r.score)) for r in retrieval.ranked(found).where("rank <= 5").collect()} == {k: v for k, v in want.items() if k[1] <= 5}


def test_evaluation_by_label_without_rankings(spark):
    usual, all_of, queries = odd_vectors(spark)
    apart = queries.selectExpr("query_id", "q", "IF(query_id = 4, 7, label) AS label")  # none of its label: no hit
    rare = usual.selectExpr("doc_id", "v", "IF(doc_id % 50 = 11, label, 5) AS label")  # first hits far down
    for vectors, asked in ((usual, queries), (usual, apart), (rare, queries), (all_of, queries)):
        relevant = vectors.join(asked.select("query_id", "label"), "label").select("query_id", "doc_id")
        want = retrieval.evaluate(retrieval.ranked(dense.cosine(vectors, asked)), relevant)
        got = retrieval.evaluate_by_label(vectors, asked)
        assert {r.query_id: pytest.approx(tuple(r)) for r in want.collect()} == {r.query_id: tuple(r) for r in got.collect()}
    assert dense.hits_by_label(all_of, queries, 10) is None and dense.hits_by_label(usual.union(usual), queries, 10) is None
    top, facts = dense.hits_by_label(rare, queries, 10)
    assert top.count() == 90 and facts.where("before >= 10").count() > 0  # ten places a query, whatever the vectors


def test_records_are_parsed_once(spark):
    lines = spark.createDataFrame([(None,), ("[1]",), ('{"id":"a","authorships":[{"author":{"id":"x"}}]}',), ('{"id":"a","authorships":[]}',)], "value string")
    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    flags = medallion.flag_counts(medallion.silver(medallion.typed(lines), "https://records.example/"))
    assert plan(flags).count("from_json") == 1
    found = profiling.dataset_statistics(lines)
    assert plan(found).count("LogicalRDD") + plan(found).count("LocalRelation") == 1  # one reading of the texts
    assert found.first().asDict() == {
        "record_count": 4, "reference_count": 0, "first_year": None, "last_year": None, "missing_titles": 4, "missing_abstracts": 4, "missing_authors": 3,
        "unique_publications": 1, "duplicate_identifiers": 1, "unique_authors": 1,
    }


def test_pagerank_of_uncited_sources(spark):
    edges = spark.createDataFrame([(1, 9), (2, 9), (2, 8), (9, 8), (3, 2)], "paper_id long, referenced_paper_id long")
    nodes, out = {1, 2, 3, 8, 9}, {1: [9], 2: [9, 8], 9: [8], 3: [2]}
    want = dict.fromkeys(nodes, 1 / 5)
    for _ in range(7):
        lost = want[8]
        want = {n: 0.03 + 0.85 * (sum(want[a] / len(b) for a, b in out.items() if n in b) + lost / 5) for n in nodes}
    assert {r.paper_id: pytest.approx(r.pagerank, abs=1e-12) for r in graph.pagerank(edges, 7).collect()} == want
    assert graph.pagerank(edges.where("false"), 3).collect() == []


def test_texts_are_cut_once_and_within_their_row(spark):
    docs = spark.createDataFrame([(1, "b a b  c a"), (1, "z"), (2, None), (3, "  "), (None, "é é")], "doc_id long, text string")
    index = docs.select("doc_id", inverted(F.split(F.col("text"), r"\s+")).alias("m"))
    assert [r.m for r in index.collect()] == [{"a": [1, 4], "b": [0, 2], "c": [3]}, {"z": [0]}, None, {"": [0, 1]}, {"é": [0, 1]}]
    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    assert "Aggregate" not in plan(index) and plan(terms.term_counts(docs)).count("regexp_replace") == 1


def test_named_collaborations(spark):
    signed = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 2), (2, 1), (2, 1), (None, 1)], "paper_id long, author_id long")
    names = spark.createDataFrame([(1, "n1"), (2, "n2"), (2, "n2b")], "author_id long, author_name string")
    want = graph.collaborations(signed.join(names, "author_id"))
    for n in (3, graph.MOST_NAMES + 1):
        found = graph.named_collaborations(signed, names, n)
        assert found.columns == want.columns and sorted(found.collect()) == sorted(want.collect())
        lists = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_list" in x]
        assert lists and not any("author_name" in x for x in lists)  # no name is shuffled with the pairs


def test_word_vectors_in_several_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha beta{i % 3} gamma delta{i % 2}") for i in range(40)] + [(99, None)], "doc_id long, text string")
    monkeypatch.setattr(learning, "WORDS_A_TASK", 50)
    found = learning.word_vectors(docs).collect()
    assert len(found) == 40 and all(len(r.v) == 32 for r in found)


def test_measures_by_system(spark):
    ranking = spark.createDataFrame([(s, q, d, 1 + (d * s) % 15) for s in (1, 2) for q in (1, 2) for d in range(15)], "system int, query_id int, doc_id int, rank int")
    relevant = spark.createDataFrame([(1, 2), (1, 7), (1, 14), (1, 99)], "query_id int, doc_id int")
    marked = ranking.join(relevant.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left").fillna(0, ["hit"])
    got = retrieval.measures(marked, relevant.groupBy("query_id").agg(F.count("*").alias("wanted")), 10, "system")
    for s in (1, 2):
        assert sorted(got.where(f"system = {s}").drop("system").collect()) == sorted(retrieval.evaluate(ranking.where(f"system = {s}"), relevant).collect())
