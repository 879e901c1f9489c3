import random

from pyspark.sql import functions as F

from lakeloom.llm.decontamination import NAMES, NUMBERS, drop_leaking, leaks, template, windows

ITEM = "A train leaves Boston at 9 hours and travels 60 miles to meet Alice, who waits for the train in Boston while Alice reads 3 books. How far is it?"


def corpus():
    rng = random.Random(3)
    vocab = ["word%c%c" % (97 + i % 26, 97 + i // 26) for i in range(200)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + ". "
    items = [(1, ITEM), (2, prose(30)), (3, None), (4, "too short"), (5, "1 2 3 4 5 6 7 8 9 10"), (6, prose(25)), (6, prose(25)), (None, prose(20))]
    moved = ITEM.replace("Boston", "Paris").replace("Alice", "Mary Ann").replace("60", "75").replace("9 hours", "10 hours")
    mixed = ITEM.replace("leaves Boston", "leaves Paris").replace("meet Alice", "meet Bob").replace("while Alice", "while Carol").replace("9", "9").replace("in Boston", "in Rome")
    docs = [(1, prose(40) + ITEM + " " + prose(40)), (2, moved), (3, prose(100)), (4, mixed), (5, prose(5) + items[1][1].upper() + prose(5)), (6, None), (7, ""),
            (8, items[1][1][: len(items[1][1]) // 2]), (None, ITEM), (9, "1 2 3 4 5 6 7 8 9 10 11 12"), (10, prose(30000) + items[5][1]), (2, moved), (11, items[7][1]),
            (12, " ".join(w if i != 15 else "extra " + w for i, w in enumerate(items[1][1].split())))]
    return docs, items


def test_template():
    out, slot, _, _ = template("The cost is 5 kg for John Smith. Next m is 3.5 m")
    assert list(slot) == [False, False, False, True, True, False, True, False, False, False, True, True]
    assert out[3] == out[10] == NUMBERS and out[6] == NAMES
    assert len(windows("one two three four", 5)[0]) == 0


def brute_force(docs, items):
    out = set()
    for k, t in docs:
        for i, u in items:
            a, at, *_ = windows(t or "", 5)
            b, bt, *_ = windows(u or "", 5)
            for g in (0, 8):
                rows = {}
                for x, p in zip(a.tolist(), at.tolist()):
                    for y, q in zip(b.tolist(), bt.tolist()):
                        if x == y:
                            rows.setdefault((p - q + g) // 16, set()).add(q)
                if any(len(r) >= 0.8 * len(b) for r in rows.values()):
                    out.add((k, i))
    return out


def test_leaks(spark):
    docs, items = corpus()
    items = [x for x in items if x[0] != 6] + [x for x in items if x[0] == 6][:1]
    d = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id bigint, text string, item_id string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in leaks(d, b).collect()}
    want = brute_force([x for x in docs if x[0] != 10], items) | {(10, 6)}
    assert (4, 1) in want  # the same template, but the slots contradict each other
    assert set(found) == want - {(4, 1)}
    assert {(1, 1), (2, 1), (5, 2), (None, 1), (10, 6), (11, None), (12, 2)} <= set(found)
    assert found[2, 1]["replaced"] and not found[1, 1]["replaced"]
    kept = drop_leaking(d, b)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 6, 7, 8, 9]


def test_empty(spark):
    d = spark.createDataFrame([(1, ITEM)], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    assert leaks(d.where("false"), b).collect() == [] and leaks(d, b.where("false")).collect() == []
    assert drop_leaking(d, b.where("false")).count() == 1 and drop_leaking(d, b).select(F.count("*")).first()[0] == 0


def found_in(spark, docs, items):
    d, b = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return sorted((r["doc_id"], r["item_id"]) for r in leaks(d, b).collect())


def test_values_stand_for_each_other_one_to_one(spark):
    item = "the letter that John Smith wrote to John Brown about the sale of 3 horses was read by John Smith before John Brown came home"
    docs = [
        item.replace("John Smith", "Ann Lee").replace("John Brown", "Bob Ray"),
        "the letter that Ann Lee wrote to Bob Ray about the sale of 3 horses was read by Bob Ray before Ann Lee came home",  # slots contradict
        item.replace("John Smith", "Ann Lee").replace("John Brown", "Ann Lee"),  # two values became one
    ]
    assert found_in(spark, docs, [item]) == [(0, 0)]


def test_short_items_are_found_as_they_are(spark):
    docs = ["we ask you: what is 7 times? yes", "we ask you: what is 8 times? yes", "what was it", "WHAT IS 7 TIMES"]
    assert found_in(spark, docs, ["What is 7 times?", "alone", ""]) == [(0, 0), (3, 0)]


def test_drift_within_slack_at_any_place(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    item = [word() for _ in range(40)]
    docs = []
    for n in range(0, 9, 2):
        for before in range(0, 17, 3):
            docs.append(" ".join([word() for _ in range(before)] + item[:20] + [word() for _ in range(n)] + item[20:]))
    assert found_in(spark, docs, [" ".join(item)]) == [(i, 0) for i in range(len(docs))]


def test_recall_of_reparameterised_items(spark):
    """Questions with all numbers and names replaced, in the midst of other text: at least 0.95 are found."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8)))
    items, docs = [], []
    for _ in range(60):
        shape = [rng.choice(["w", "w", "w", "w", "n", "N"]) for _ in range(rng.randrange(16, 40))]
        words = [word() for _ in shape]

        def ask():
            names = [word().capitalize() for _ in range(2)]
            return "so " + " ".join(str(rng.randrange(2, 900)) if s == "n" else names[i % 2] if s == "N" else w for i, (s, w) in enumerate(zip(shape, words)))

        items.append(ask())
        docs.append(" ".join(word() for _ in range(20)) + ". " + ask() + ". " + " ".join(word() for _ in range(20)))
    hits = found_in(spark, docs, items)
    assert sum((i, i) in hits for i in range(60)) >= 57 and all(a == b for a, b in hits)


def test_clashing_columns_stay(spark):
    d = spark.createDataFrame([(1, ITEM, 5, "p"), (2, "clean words", 6, "q"), (2, "clean words", 6, "q")], "doc_id bigint, text string, _id int, _print string")
    kept = drop_leaking(d, spark.createDataFrame([(1, ITEM)], "item_id bigint, text string"))
    assert kept.columns == d.columns and [tuple(r) for r in kept.collect()] == [(2, "clean words", 6, "q")] * 2
