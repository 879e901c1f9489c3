import random
import re

import numpy as np
import xxhash

from lakeloom.llm import near_dedup
from lakeloom.llm.near_dedup import drop_near_duplicates, first_shared, near_duplicates, segments

SCHEMA = "doc_id bigint, text string"


def plain_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(rows):
    prints = [plain_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        ids = [x for x in (least.get(find(i)), k) if x is not None]
        least[find(i)] = min(ids, default=None)
    return sorted(((k, p, least[find(i)]) for i, ((k, _), p) in enumerate(zip(rows, prints))), key=str)


def corpus(seed=3, n=160):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["été", "ÄPFEL", "Mixed"]
    base = [[rng.choice(vocab) for _ in range(rng.choice([1, 3, 4, 30, 200, 400]))] for _ in range(30)]
    rows = [(None, "no id"), (900, None), (901, ""), (902, " \t\n"), (903, "\x00 odd"), (904, "x " * 60000)]
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    return [*rows, rows[10], rows[10], (None, "no id")]


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], SCHEMA + ", fp string, component int")
    found = [(r[0], r[1] % 2**64, r[2]) for r in near_duplicates(df).collect()]
    assert sorted(found, key=str) == plain_components(rows)


def test_large_bucket_and_chain(spark):
    """Hundreds of variants of one text, and links that only hold in a chain."""
    rng = random.Random(5)
    words = ["v%d" % rng.randrange(300) for _ in range(300)]
    rows = []
    for i in range(150):
        words[rng.randrange(300)] = "n%d" % i
        rows.append((i, " ".join(words)))
    found = [(r[0], r[1] % 2**64, r[2]) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(found, key=str) == plain_components(rows)


def test_every_close_pair_shares_a_signature():
    rng = np.random.default_rng(1)
    for distance in (2, 4, 7):
        for n in range(distance + 1):
            x = np.array([sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for _ in range(300)], np.uint64)
            assert (first_shared(x, segments(distance)) < 64).all()


def test_keeps_one_of_each_group(spark):
    rows = [(5, "a b c d e"), (2, "A B c d e"), (9, "something else altogether here now"), (None, "q w e r t y")]
    df = spark.createDataFrame([(k, t, "en") for k, t in rows], SCHEMA + ", lang string")
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r[0] for r in kept.collect()), key=str) == [2, 9, None]


def plain_kept(rows, least=0.8):
    """Ids that stay, by comparing the 5-word shingles of all pairs."""
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    first = {}
    for i, (k, _) in enumerate(rows):
        first[find(i)] = min(first.get(find(i), (True, 0)), (k is None, k or 0))
    return sorted(((None if x[0] else x[1]) for x in first.values()), key=str)


def near_corpus(edits):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    rows = [(None, "no id at all here"), (900, None), (901, ""), (902, " \n"), (903, "No id at all here")]
    for g in range(40):
        base = [word() for _ in range(rng.choice([3, 60, 200, 500]))]
        for c in range(rng.choice([1, 2, 5])):
            words = list(base)
            for at in rng.sample(range(len(base)), int(edits * len(base)) if c else 0):
                words[at] = word()
            rows.append((g * 10 + c, " ".join(words)))
    return rows


def test_stage_equals_brute_force(spark):
    """Copies with 1 % of their words replaced, and with 10 %, which 5-word shingles tell apart."""
    for edits in (0.01, 0.1):
        rows = near_corpus(edits)
        df = spark.createDataFrame([(k, t, 1, 2, "m") for k, t in rows], SCHEMA + ", fp int, component int, mark string")
        kept = drop_near_duplicates(df.repartition(3))
        assert kept.columns == df.columns
        assert sorted((r[0] for r in kept.collect()), key=str) == plain_kept(rows)


def test_recall_of_near_copies(spark):
    """At least 0.9 of the copies with 2 % of their words replaced, similarity about 0.82, go if the shingles say so."""
    rows = near_corpus(0.02)
    want = {k for k, _ in rows} - set(plain_kept(rows))
    got = {k for k, _ in rows} - {r[0] for r in drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_stage_finds_copies_far_apart_in_bits(spark):
    """Short texts with a word or two more, many of whose SimHashes are over 7 bits apart, go exactly as all pairs of shingles say."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    rows = []
    for g in range(150):
        base = [word() for _ in range(rng.randrange(8, 25))]
        rows += [(g * 3, " ".join(base)), (g * 3 + 1, " ".join([*base, word()])), (g * 3 + 2, " ".join([word(), *base, word()]))]
    kept = sorted((r[0] for r in drop_near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str)
    assert kept == plain_kept(rows) and len(kept) < 300


def test_stage_finds_chains_in_large_buckets(spark, monkeypatch):
    """Texts that slide over one long text by a few words share shingles in buckets of many, and a passage stands in all."""
    rng = random.Random(32)
    words = ["v%d" % i for i in range(400)]
    passage = " ".join("p%d" % i for i in range(12))
    rows = [(i, " ".join(words[s : s + 60])) for i, s in enumerate(range(0, 340, 4))] + [(500, " ".join(words[:30] + ["z"] + words[31:60]))]
    rows += [(1000 + i, passage + " " + " ".join("q%d" % rng.randrange(9000) for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 30, 31] * 15)]
    want = plain_kept(rows)
    for large in (4, 256):
        monkeypatch.setattr(near_dedup, "LARGE_BUCKET", large)
        assert sorted((r[0] for r in drop_near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str) == want
    assert 40 < len(want) < len(rows) - 50


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(df).collect() == [] and drop_near_duplicates(df).collect() == []
