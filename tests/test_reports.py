"""Writers and the text index on small tables."""

import math
import re
from collections import Counter
from datetime import date

import pytest

from lakeloom.functions.text import STOP_WORDS
from lakeloom.operators import text_index
from lakeloom.sources.reports import markdown, write_csv, write_json, write_markdown, write_parquet


def text_of(spark, path):
    return spark.read.text(path, wholetext=True).first()["value"].rstrip("\n")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "id int, name string")
    assert spark.read.csv(write_csv(df, f"{tmp_path}/c"), header=True).count() == 2
    write_parquet(df, f"{tmp_path}/p")
    assert spark.read.parquet(write_parquet(df.where("id = 1"), f"{tmp_path}/p")).count() == 1
    assert text_of(spark, write_json(spark, {"b": date(2024, 1, 2), "a": None}, f"{tmp_path}/j")) == '{\n  "a": null,\n  "b": "2024-01-02"\n}'
    text = markdown("T", {"Summary": {"rows": 2}, "Rows": df.orderBy("id"), "Notes": "none"}, date(2024, 1, 2))
    assert "- rows: 2" in text and "| 1 | a\\|b |\n| 2 |  |" in text and "Generated on 2024-01-02." in text
    assert text_of(spark, write_markdown(spark, "T", {"Notes": "none"}, f"{tmp_path}/m")).startswith("# T\n")
    with pytest.raises(ValueError):
        markdown("T", {"Rows": spark.range(1001)})


def plain_search(docs, queries, features):
    def words(t):
        return [w for w in re.findall(r"\w{2,}", t.lower()) if w not in STOP_WORDS]

    given = {d: Counter(words(t)) for d, t in docs if d is not None and t and t.strip()}
    total, df = Counter(), Counter()
    for c in given.values():
        total.update(c)
        df.update(list(c))
    idf = {w: math.log((1 + len(given)) / (1 + df[w])) + 1 for w in sorted(total, key=lambda w: (-total[w], w))[:features]}

    def unit(c):
        v = {w: n * idf[w] for w, n in c.items() if w in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors = {d: unit(c) for d, c in given.items()}
    out = {}
    for q, t in queries:
        v = unit(Counter(words(t or "")))
        scores = {d: sum(x * u.get(w, 0) for w, x in v.items()) for d, u in vectors.items()}
        out |= {(q, d): round(s, 9) for d, s in scores.items() if s > 0}
    return out


def test_index(spark, tmp_path):
    docs = [(1, "graph neural graph"), (2, "neural text"), (3, " "), (4, None), (5, "été text_one the"), (6, "neural text"), (None, "graph"), (7, "!!")]
    queries = [(1, "Neural  graph"), (2, "été"), (3, None), (4, "nothing here"), (5, "")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' as weight", "'y' as token")
    asked = spark.createDataFrame(queries, "query_id bigint, text string")
    for features in (100, 2):
        folder = f"{tmp_path}/i{features}"
        meta = text_index.build(table, folder, features)
        assert meta["document_count"] == 5 and text_index.metadata(spark, folder) == meta
        found = text_index.search(spark, folder, asked, None).collect()
        assert {(r["query_id"], r["doc_id"]): round(r["score"], 9) for r in found} == plain_search(docs, queries, features)
    assert [r["doc_id"] for r in text_index.search(spark, f"{tmp_path}/i100", asked, 2).where("query_id = 1").orderBy("rank").collect()] == [1, 2]
    assert text_index.build(table.limit(0), f"{tmp_path}/e")["status"] == "empty"
    assert text_index.search(spark, f"{tmp_path}/e", asked).count() == 0


def test_backend():
    assert text_index.backend(" Auto ") == text_index.backend("faiss") == "postings"
    with pytest.raises(ValueError):
        text_index.backend("other")
