import math
import random
import zlib

from lakeloom.llm.language import PIECE, automaton, drop_unintelligible, identify, learned_languages, letters, parser

SYLLABLES = {"aa": "the of and ing er re on ti st".split(), "bb": "der und sch ein keit ung ge be".split(), "cc": "é la que les aux ment eau oi".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def plain_phrases(learned, text):
    """Longest matches found by substring search, in pieces as the operator's."""
    n = 0
    for lo in range(0, len(text), PIECE):
        piece, at = text[lo : lo + PIECE], 0
        while at < len(piece):
            end = at + 1
            while end <= len(piece) and piece[at:end] in learned:
                end += 1
            at = max(at + 1, end - 1)
            n += 1
    return n


def rows(seed=1):
    rng = random.Random(seed)
    langs = sorted(SYLLABLES)
    out = [(i, prose(rng, langs[i % 3], rng.choice([2, 8, 40, 400])), langs[i % 3]) for i in range(240)]
    return [*out, (500, None, "aa"), (501, "", "aa"), (502, "123 !? €", "bb"), (503, "the " * 60000, None), (None, "der und sch", "bb"), out[4], out[4]]


def test_automaton_holds_every_substring():
    text = b"abcbcabbca"
    to = automaton(text)
    for i in range(len(text)):
        state = 0
        for c in text[i:]:
            state = to[state][c]
    assert all(t != 0 for edges in to for t in edges.values())


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(k, t, g, 0.5) for k, t, g in rows()], "doc_id bigint, text string, lang string, score double")
    sample = learned_languages(df, chars=3000)
    assert [g for g, _ in sample] == sorted(SYLLABLES) and all(0 < len(t) <= 3000 for _, t in sample)
    for r in identify(df, sample).collect():
        text = letters(r["text"])
        if not text:
            assert (r["lang_pred"], r["score"], r["bits"]) == ("und", 0.0, None)
            continue
        if len(text) < 5000:
            cost = {g: plain_phrases(t, text) * math.log2(len(t)) for g, t in sample}
            best, second = sorted(cost.values())[:2]
            assert r["lang_pred"] == min(sorted(cost), key=cost.get)
            assert abs(r["score"] - (1 - best / second)) < 1e-9 and abs(r["bits"] - best / len(text)) < 1e-9


def test_held_out_accuracy(spark):
    data = [x for x in rows(7) if x[0] is not None and x[2] and letters(x[1])]
    sample = learned_languages(spark.createDataFrame(data, "doc_id bigint, text string, lang string"))
    held = [x for x in data if zlib.crc32(str(x[0]).encode()) % 3 == 1 and len(x[1]) > 20]
    found = identify(spark.createDataFrame(held, "doc_id bigint, text string, lang string"), sample).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(held)


def test_does_not_learn_from_held_out(spark):
    df = spark.createDataFrame([(i, "x%d" % i, "aa") for i in range(60)], "doc_id bigint, text string, lang string")
    (_, learned), = learned_languages(df)
    assert learned and parser((("aa", learned),)).langs == ["aa"]
    one = [(i, "uniqueword", "aa") for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert learned_languages(spark.createDataFrame(one, "doc_id bigint, text string, lang string")) == ()


def test_filter_and_empty(spark):
    df = spark.createDataFrame(rows(), "doc_id bigint, text string, lang string")
    kept = drop_unintelligible(df)
    assert kept.columns == df.columns
    gone = {r[0] for r in df.collect()} - {r[0] for r in kept.collect()}
    assert gone == {500, 501, 502}
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert drop_unintelligible(none).collect() == []
    assert [r["lang_pred"] for r in identify(df.limit(1), ()).collect()] == ["und"]
