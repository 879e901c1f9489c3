"""The text index as a query: built over all documents, searched for every benchmark item."""

from __future__ import annotations

import tempfile
import uuid

from lakeloom.functions.text import STOP_WORDS
from lakeloom.operators import text_index
from lakeloom.plans.corpus import benchmark
from lakeloom.plans.publications import rounded
from lakeloom.sources.tables import table


def folder_for(spark) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='lakeloom-')}"
    return f"{shared.rstrip('/')}/index-{uuid.uuid4().hex}"


def index_search(spark, d):
    folder = folder_for(spark)
    text_index.build(table(spark, d, "documents").select("doc_id", "source", "lang", "text"), folder)
    return rounded(text_index.search(spark, folder, benchmark(spark, d)), "score")


def index_vocabulary(spark, d):
    folder = folder_for(spark)
    text_index.build(table(spark, d, "documents").select("doc_id", "text"), folder)
    return rounded(spark.read.parquet(f"{folder}/vocabulary"), "idf")


QUERIES = {"index_search": index_search, "index_vocabulary": index_vocabulary}

_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
_TOKENS = f"unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP})))"
_VOCABULARY = f"""given AS (SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND trim(text) <> ''),
tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, {_TOKENS} AS token FROM given) GROUP BY ALL),
vocabulary AS (SELECT token, ln((1 + (SELECT count(*) FROM given)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY token ORDER BY sum(tf) DESC, token LIMIT {text_index.MAX_FEATURES})"""

ORACLE_SQL = {
    "index_vocabulary": f"WITH {_VOCABULARY} SELECT token, round(idf, 6) AS idf FROM vocabulary",
    "index_search": f"""WITH {_VOCABULARY}, w AS (SELECT doc_id, token, tf * idf AS w FROM tf JOIN vocabulary USING (token)),
q AS (SELECT query_id, token, count(*) * any_value(idf) AS w FROM (SELECT item_id AS query_id, {_TOKENS} AS token FROM benchmark) JOIN vocabulary USING (token) GROUP BY ALL),
found AS (SELECT query_id, doc_id, sum(w.w * q.w) AS dot FROM w JOIN q USING (token) GROUP BY ALL),
scored AS (SELECT query_id, doc_id, dot / (SELECT sqrt(sum(x.w * x.w)) FROM w x WHERE x.doc_id = found.doc_id) / (SELECT sqrt(sum(y.w * y.w)) FROM q y WHERE y.query_id = found.query_id) AS score FROM found)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored QUALIFY rank <= 10""",
}
