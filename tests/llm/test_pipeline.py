"""corpus_pipeline.run on a small table against the five stages done one after the other by brute force."""

import random
import re
import zlib
from array import array

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontamination import ITEM, brute_force
from tests.llm.test_line_dedup import plain_dropped
from tests.llm.test_near_dedup import plain_kept


def table():
    rng = random.Random(17)
    rows = []
    for lang, chars in (("en", "abcdefgh"), ("de", "ijklmnop")):
        vocab = ["".join(rng.choice(chars) for _ in range(rng.randrange(3, 8))) for _ in range(300)]
        line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
        shared = line(30)
        for i in range(40):
            rows.append([len(rows), "\n".join([line(rng.randrange(20, 60)) for _ in range(3)] + [shared] * (i % 4 == 0)), lang, "web"])
        copy = rows[-2][1].replace("\n", " ").split()
        copy[5] = "changed"
        rows.append([len(rows), " ".join(copy), lang, "web"])  # near copy of a document in other lines
    rows += [[len(rows), line(30) + ". " + ITEM, None, "web"], [len(rows) + 1, None, "en", "web"], [len(rows) + 2, "", None, None], [len(rows) + 3, "12 34 !!", "en", "web"], [None, line(40), "de", "web"]]
    return rows


def test_run_equals_brute_force(spark, tmp_path):
    rows = table()
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [(r[0], r[1]) for r in rows if r[1] and re.search("[a-z]", r[1])]  # all with letters read as a learned language here
    dropped = plain_dropped(kept)
    kept = [(k, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in dropped.get((k, t), ()))) for k, t in kept]
    kept = [(k, t) for k, t in kept if t.strip()]
    ids = plain_kept(kept)
    assert len(ids) == len(kept) - 2 and sum(map(len, dropped.values())) > 10
    kept = [(k, t) for k, t in kept if k in ids]
    leaking = {k for k, _ in brute_force(kept, [(1, ITEM)])}
    assert len(leaking) == 1
    kept = {k: t for k, t in kept if k not in leaking}
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = {k: array("I", [*tokenizer.encode(t, add_special_tokens=False).ids, 0]) for k, t in kept.items()}
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in found} == set(want)
    for k, ids in want.items():
        at = 0
        for r in sorted((r for r in found if r["doc_id"] == k), key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    for s in {r["sequence_id"] for r in found}:
        at = 0
        for r in sorted((r for r in found if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024


def test_empty_table(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
