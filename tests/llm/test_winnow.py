import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from lakeloom.llm.winnow import as_text, fingerprints, hash_part, position_part, range_of, winnow

M = 2**64 - 1


def rot(x, k):
    k %= 64
    return (x << k | x >> (64 - k)) & M if k else x


def plain(text, gram=5, window=16):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower()) if w]
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    def roll(hs):
        out = 0
        for h in hs:
            out = rot(out, 1) ^ h
        return out
    grams = [roll(hashes[i : i + gram]) >> 32 for i in range(max(1, len(hashes) - gram + 1))] if hashes else []
    chosen = []
    for i in range(max(1, len(grams) - window + 1) if grams else 0):
        part = range(i, min(i + window, len(grams)))
        best = min(part, key=lambda j: (grams[j], -j))
        if best not in chosen:
            chosen.append(best)
    return [(j, grams[j]) for j in chosen]


def jaccard(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus():
    rng = random.Random(4)
    vocab = ["w%d" % i for i in range(50)] + ["été", "MIXED", "x\U0001f600y"]
    rows = [(3 * i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 4, 5, 20, 21, 90, 400])))) for i in range(300)]
    rows += [(5000, None), (5001, ""), (5002, "... !"), (-7, "first of all words here"), (5003, "same same " * 400), (5004, "long " * 30000)]
    return rows


def expected(rows):
    ids = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    out = []
    for (k, t), (_, u) in zip(ids, ids[1:] + ids[:1]):
        t, u = t or "", u or ""
        q = len(t) // 4
        e = t[: len(t) - q] + u[:q]
        out.append((k, len(t), e, plain(t), plain(e), jaccard(plain(t), plain(e)), jaccard(plain(t), plain(u))))
    return out


@pytest.mark.parametrize("per_range", [7, 500])
def test_equals_brute_force(spark, monkeypatch, per_range):
    from lakeloom.llm import winnow as module

    original = module.with_next
    monkeypatch.setattr(module, "with_next", lambda d, c: original(d, c, per_range))
    rows = corpus()
    rows += [rows[4], rows[4]]
    df = spark.createDataFrame([(k, t, [1], 2) for k, t in rows], "doc_id bigint, text string, codes array<int>, part int").repartition(3)
    found = fingerprints(df).withColumn("a", F.transform("codes", lambda c: F.struct(position_part(c), hash_part(c)))).withColumn(
        "b", F.transform("edited_codes", lambda c: F.struct(position_part(c), hash_part(c)))
    )
    got = [(r["doc_id"], r["n_chars"], r["edited"], [tuple(x) for x in r["a"]], [tuple(x) for x in r["b"]], r["near_edited"], r["near_next"]) for r in found.collect()]
    assert sorted(got) == sorted(expected(rows))


def test_other_widths(spark):
    df = spark.createDataFrame([(t,) for _, t in corpus()[:60]], "text string")
    for gram, window in ((1, 1), (3, 4), (7, 5), (8, 11)):
        for r in df.select("text", F.transform(winnow(F.col("text"), gram, window), lambda c: F.struct(position_part(c), hash_part(c))).alias("c")).collect():
            assert [tuple(x) for x in r["c"]] == plain(r["text"], gram, window)


def test_shared_run_shares_a_hash(spark):
    rng = random.Random(9)
    shared = ["s%d" % rng.randrange(10**6) for _ in range(20)]
    texts = [" ".join([*("a%d" % rng.randrange(10**6) for _ in range(rng.randrange(50))), *shared, *("b%d" % rng.randrange(10**6) for _ in range(50))]) for _ in range(20)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(F.transform(winnow(F.col("text")), hash_part).alias("h")).collect()
    assert all(set(a["h"]) & set(b["h"]) for a in rows for b in rows)


def test_null_ids_and_empty(spark):
    rows = [(None, "abcd efgh"), (None, "abcd efgh"), (4, "one two three"), (1, None)]
    got = {(r["doc_id"], r["edited"], r["near_next"]) for r in fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(None, "abcd ef", None), (4, "one two th", 0.0), (1, "", 0.0)}
    assert fingerprints(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    assert fingerprints(spark.createDataFrame([(None, None)], "doc_id bigint, text string")).count() == 1
    assert spark.range(1).select(as_text(winnow(F.lit("Hello"))).alias("x")).first()["x"].startswith("0:")


def test_range_of(spark):
    starts = [2, 5, 9, 100]
    rows = spark.range(-3, 120).select("id", range_of(F.col("id"), starts).alias("r")).collect()
    assert all(r["r"] == max(0, sum(s <= r["id"] for s in starts) - 1) for r in rows)
