import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lakeloom.llm.common import whole_groups
from lakeloom.llm import line_dedup
from lakeloom.llm.line_dedup import dedup_lines, drop_repeated_lines, edit_distance, features, fuzzy, normalised, op3_line_dedup, similar, text_lines

SCHEMA = "doc_id bigint, text string, dropped string"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_line(line):
    """The words of a line, lower-cased: runs of ASCII letters and digits and of all that is not ASCII."""
    return " ".join(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", line.lower()))


def plain_dropped(rows):
    """{(doc_id, text): dropped line numbers} by comparing all pairs of lines."""
    lines = [(k is None, k or 0, i, j, plain_line(x) or x.strip()) for i, (k, t) in enumerate(rows) if t for j, x in enumerate(t.split("\n")) if x.strip()]
    texts = [x[4] for x in lines]
    near = [fuzzy(x.encode(), 4) for x in texts]
    prints = features([x.encode() for x in texts])[0].view(np.uint64)
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            if texts[i] == texts[j] or near[i] and near[j] and int(prints[i] ^ prints[j]).bit_count() <= 16 and similar(texts[i], texts[j], 0.8):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(lines)):
        groups.setdefault(find(i), []).append(i)
    out = {}
    for members in groups.values():
        first = min(members, key=lambda i: (lines[i][0], lines[i][1], rows[lines[i][2]][1], lines[i][3]))
        stays = (lines[first][0], lines[first][1], rows[lines[first][2]][1], lines[first][3])
        for i in members:
            if (lines[i][0], lines[i][1], rows[lines[i][2]][1], lines[i][3]) != stays:
                out.setdefault(rows[lines[i][2]], set()).add(lines[i][3])
    return {k: sorted(v) for k, v in out.items()}


def corpus():
    rng = random.Random(12)
    vocab = ["w%c%c" % (97 + i % 26, 97 + i // 26) for i in range(300)] + ["été"]
    pool = [" ".join(rng.choice(vocab) for _ in range(rng.choice([2, 4, 9, 40, 80, 120]))) for _ in range(60)]
    rows = []
    for i in range(90):
        lines = []
        for _ in range(rng.randrange(1, 7)):
            words = rng.choice(pool).split()
            if rng.random() < 0.4 and len(words) > 8:  # blocks find shorter ones less surely: test_recall_of_short_lines
                words[rng.randrange(len(words))] = rng.choice(vocab)
            lines.append(" ".join(words).upper() + "!" * rng.randrange(3) if rng.random() < 0.2 else " ".join(words))
        rows.append((i, "\n".join(lines)))
    hot = [rng.choice(vocab) for _ in range(150)]
    for i in range(60):
        hot[rng.randrange(150)] = rng.choice(vocab)
        rows.append((200 + i, "Posted on 2024-01-%02d by user %d\n" % (i % 28, i) + " ".join(hot)))
    return rows + [(300, None), (301, ""), (302, "\n\n"), (None, rows[0][1]), (303, "very long line " * 8000), rows[5], rows[5]]


def test_equals_brute_force(spark):
    rows = corpus()
    want = plain_dropped(rows)
    found = dedup_lines(spark.createDataFrame([(k, t, "x") for k, t in rows], SCHEMA).repartition(3)).collect()
    assert len(found) == len(rows) and sum(map(len, want.values())) > 100
    before = sorted(rows, key=str)
    after = []
    for k, t in before:
        gone = want.get((k, t), [])
        after.append((k, None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone), gone, len((t or "").split("\n"))))
    assert sorted(((r["doc_id"], r["text"], r["dropped"], r["n_lines"]) for r in found), key=str) == sorted(after, key=str)


def test_stage_drops_emptied_documents(spark):
    rows = [(1, "en", "one two three four\nfive six seven eight nine", 45), (2, "en", "One two, three four!", 20), (3, None, None, None), (4, "en", "short", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string, n_chars bigint")
    kept = drop_repeated_lines(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2], rows[3]], key=str)
    assert drop_repeated_lines(df.where("false")).collect() == []


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randrange(0, 14))) for _ in range(2))
        d = plain_distance(a, b)
        for most in (0, 2, 5, 20):
            assert edit_distance(a, b, most) == min(d, most + 1)


def test_whole_groups():
    rng = random.Random(3)
    keys = sorted(rng.choice(range(40)) for _ in range(300))
    for size in (1, 2, 7, 50, 300):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size], pa.int64())], ["k"]) for i in range(0, 300, size)]
        tables = [t.column(0).to_pylist() for t in whole_groups(iter(batches))]
        assert sum(tables, []) == keys
        assert sum(len(set(t)) for t in tables) == len(set(keys))


def plain_groups(lines, least=0.8):
    """{line: smallest line of its group} by edit similarity of all pairs alone."""
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            most = int(max(len(a), len(b)) * (1 - least) + 1e-9)
            if abs(len(a) - len(b)) <= most and find(a) != find(b) and edit_distance(a, b, most) <= most:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in lines}


def test_query_joins_by_edit_similarity_alone(spark, tmp_path):
    """One to three replaced words in lines of 12 to 80, most of them many SimHash bits apart."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 10)))
    lines = []
    for n in [12, 16, 25, 50, 80] * 12:
        base = [word() for _ in range(n)]
        lines.append(" ".join(base))
        for _ in range(3):
            other = list(base)
            for at in rng.sample(range(n), 1 if n < 25 else 3):
                other[at] = word()
            lines.append(" ".join(other))
    lines = list(dict.fromkeys(lines))
    groups = plain_groups(lines)
    spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    dropped = {r["doc_id"] for r in op3_line_dedup(spark, str(tmp_path)).collect() if r["n_dropped"]}
    first = {}
    for i, x in enumerate(lines):
        first.setdefault(groups[x], i)
    want = set(range(len(lines))) - set(first.values())
    assert len(want) > 150 and dropped == want


def test_recall_of_replaced_words():
    """At least 0.9 of the pairs of edit similarity 0.8 with one or two words replaced share a block within the distance."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 10)))
    for replaced in (1, 2):
        pairs = []
        while len(pairs) < 600:
            base = [word() for _ in range(rng.choice([8, 12, 20, 40, 80]))]
            other = list(base)
            for at in rng.sample(range(len(base)), replaced):
                other[at] = word()
            if similar(" ".join(base), " ".join(other), 0.8):
                pairs.append((" ".join(base).encode(), " ".join(other).encode()))
        (s, k), (t, m) = features([p[0] for p in pairs]), features([p[1] for p in pairs])
        met = (k == m).any(axis=1) & (np.bitwise_count(s.view(np.uint64) ^ t.view(np.uint64)) <= 16)
        assert met.mean() > 0.9


def test_recall_of_short_lines():
    """Lines of 4 to 8 words with one replaced: at least 0.8 of those of edit similarity 0.8 meet."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 10)))
    pairs = []
    while len(pairs) < 600:
        base = [word() for _ in range(rng.randrange(4, 9))]
        other = list(base)
        other[rng.randrange(len(base))] = word()
        if similar(" ".join(base), " ".join(other), 0.8):
            pairs.append((" ".join(base).encode(), " ".join(other).encode()))
    (s, k), (t, m) = features([p[0] for p in pairs]), features([p[1] for p in pairs])
    assert ((k == m).any(axis=1) & (np.bitwise_count(s.view(np.uint64) ^ t.view(np.uint64)) <= 16)).mean() > 0.8


def test_features_do_not_depend_on_their_batch(monkeypatch):
    lines = [b"a", b"of the", b"one two three four five six seven eight nine ten eleven twelve", "\u65e5\u672c\u8a9e".encode() * 900, b"longerword", b"many words " * 500]
    sims, keys = features(lines)
    alone = [features([x]) for x in lines]
    assert (sims == [s[0] for s, _ in alone]).all() and (keys == np.concatenate([k for _, k in alone])).all()
    monkeypatch.setattr(line_dedup, "SEGMENT", 1000)  # a long line in segments: pairs of units at the cuts are all that is lost
    cut_sims, cut_keys = features(lines)
    assert (cut_sims[[0, 1, 2, 4]] == sims[[0, 1, 2, 4]]).all() and (np.bitwise_count(cut_sims.view(np.uint64) ^ sims.view(np.uint64)) <= 12).all()
    assert (cut_keys == keys).any(axis=1).all()


def test_normalised_lines():
    rng = random.Random(4)
    texts = [None, "", "\n", " a\t b!\n\nC-3 \n", "***\n * \n***"] + ["".join(rng.choice("aB\u00e91 .\n\u65e5") for _ in range(rng.randrange(40))) for _ in range(200)]
    lines, rows, numbers = normalised(texts)
    want = [(plain_line(x), i, j) for i, t in enumerate(texts) if t for j, x in enumerate(t.split("\n"))]
    assert [(x.decode(), int(i), int(j)) for x, i, j in zip(lines, rows, numbers)] == want
    _, hashes, rows, numbers = text_lines(texts[4:5])
    assert numbers.tolist() == [0, 1, 2] and hashes[0] == hashes[2] != hashes[1]


def test_clashing_columns_stay(spark):
    rows = [(1, "one two three four five", 7, 9, 3, "p"), (2, "one two three four five\nother words stand on here", 8, 1, 4, "q")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_lines int, dropped int, _id int, _print string")
    kept = drop_repeated_lines(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == [rows[0], (2, "other words stand on here", *rows[1][2:])]
    assert sorted((r["_id"], r["dropped"]) for r in dedup_lines(df).collect()) == [(3, []), (4, [0])]


def test_most_lines_of_a_long_text_repeat(spark):
    text = "\n".join(["the same line again and again"] * 30_000 + ["one line of its own"])
    assert drop_repeated_lines(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()["text"] == "the same line again and again\none line of its own"


def test_query_joins_short_lines_and_scripts_without_spaces(spark, tmp_path):
    chinese = "数据去重是训练语料处理中非常重要的一个步骤因为重复的内容会影响模型的质量"
    texts = ["All rights reserved\nhouse\n\n" + chinese, "all rights reserved.\nmouse\n\n***", "HOUSE!\n  ***\n---\n" + chinese.replace("非常", "十分") + "\nPage 12", "page 34\n \n" + chinese]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["dropped"] for r in op3_line_dedup(spark, str(tmp_path)).collect()}
    assert found == {0: "", 1: "0", 2: "0,1,3", 3: "2"}  # "Page 12" is not "page 34"


def test_blocks_bring_every_close_pair_together(spark, tmp_path, monkeypatch):
    """Lines whose SimHashes differ in at most 3 bits meet though no band of minima does."""
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 10)))
    lines = []
    while len(lines) < 80:
        base = [word() for _ in range(90)]
        other = [word() if i % 18 == 9 else x for i, x in enumerate(base)]
        sims = features([" ".join(x).encode() for x in (base, other)])[0].view(np.uint64)
        if int(sims[0] ^ sims[1]).bit_count() <= 3:
            lines += [" ".join(base), " ".join(other)]
    plain = features

    def apart(some):
        sims, keys = plain(some)
        return sims, (np.arange(keys.size) + hash(some[0] if some else b"") % 2**30).astype(np.int32).reshape(keys.shape)

    monkeypatch.setattr(line_dedup, "features", apart)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string").coalesce(1)
    assert sorted(r["doc_id"] for r in dedup_lines(docs).collect() if r["dropped"]) == list(range(1, 80, 2))


def test_block_keys_are_pieces_of_the_simhash(spark):
    sims = [0, -1, 0x1234_5678_9ABC_DEF0, -(1 << 63)]
    rows = spark.createDataFrame([(x,) for x in sims], "sim bigint").select("sim", line_dedup.block_keys(F.col("sim")).alias("keys")).collect()
    assert {r["sim"]: r["keys"] for r in rows} == {x: [(x >> 16 * i & 0xFFFF) + (line_dedup.BANDS + 1 + i << 32) for i in range(4)] for x in sims}


def test_sets_within_another_are_verified_once(spark):
    sets = {1: [10, 11, 12], 2: [10, 11], 3: [12], 4: [12, 13], 5: [20]}
    df = spark.createDataFrame([(k, s, len(x)) for k, x in sets.items() for s in x], "key bigint, sim bigint, size bigint")
    assert sorted(map(tuple, line_dedup.widest(df).collect())) == sorted((k, s) for k in (1, 4, 5) for s in sets[k])


def test_close_rows_of_blocks_are_all_found():
    """Pairs of at most 3 differing bits, among others, in the buckets of each block, against all comparisons."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, np.uint64) * np.uint64(2)
    near = [x ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, n, replace=False))) for x in base for n in (1, 3, 4)]
    sims = np.unique(np.r_[base, np.array(near, np.uint64)])
    rows = sorted(((line_dedup.BANDS + 1 + i << 32) + (int(x) >> 16 * i & 0xFFFF), int(x)) for x in sims for i in range(4))
    key, s = np.array([k for k, _ in rows]), np.array([x for _, x in rows], np.uint64)
    want = [any(k == m and x != y and (x ^ y).bit_count() <= 3 for m, y in rows) for k, x in rows]
    assert line_dedup.close_in_blocks(s, key).tolist() == want and 100 < sum(want) < len(want)


def test_overlapping_sets_have_one_place(spark, monkeypatch):
    sets = {1: [10, 11, 12], 2: [12, 13], 3: [13, 14], 4: [20, 21], 5: [30, 31]}
    df = spark.createDataFrame([(k, s, len(x)) for k, x in sets.items() for s in x], "key bigint, sim bigint, size bigint")
    places = {(r["key"], r["place"]) for r in line_dedup.dealt(df).collect()}
    assert places == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)}
    monkeypatch.setattr(line_dedup, "MOST_TOGETHER", 4)
    assert {(r["key"], r["place"]) for r in line_dedup.dealt(df).collect()} == {(k, k) for k in sets}


def test_pairs_of_overlapping_sets_are_compared_once(monkeypatch):
    """Each pair once, however many sets of a place hold it, and the lines joined as by comparing all of each set's pairs."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    lines = [" ".join(word() for _ in range(14)) for _ in range(6)]
    for _ in range(34):
        words = rng.choice(lines).split()
        for at in rng.sample(range(14), 2):
            words[at] = word()
        lines.append(" ".join(words))
    sets = {(place, key): rng.sample(range(40), rng.choice([2, 2, 5, 20])) for place in (1, 2) for key in range(10)}
    rows = [(place, i, i % 3, sorted(k for p, k in sets if p == place and i in sets[p, k]), lines[i]) for place in (1, 2) for i in range(40)]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]
    batch = pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[j]) for j in range(5)], ["place", "h", "sim", "keys", "line"])
    compared, plain = [], line_dedup.alike

    def counted(one, other, least):
        compared.append(frozenset((one[0], other[0])))
        return plain(one, other, least)

    monkeypatch.setattr(line_dedup, "alike", counted)
    found = list(line_dedup.verified_links(iter([batch.slice(0, 50), batch.slice(50)]), 16, 0.8))
    assert max(compared.count(x) for x in set(compared)) <= 2  # places

    def closed(pairs):
        label = list(range(40))
        for a, b in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        return {frozenset(i for i in range(40) if label[i] == x) for x in label}

    want = closed((a, b) for x in sets.values() for a in x for b in x if a < b and similar(lines[a], lines[b], 0.8))
    assert closed((a, b) for t in found for a, b in zip(*(c.to_pylist() for c in t.columns))) == want and 6 < len(want) < 35


def test_marks_rule_out_only_lines_that_are_not_similar(monkeypatch):
    """Large sets, whose lines' words are marked, with marks for many words each, give the links of plain comparisons."""
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6)))
    lines = [" ".join(word() for _ in range(rng.choice([5, 14, 40, 200]))) for _ in range(12)]
    for _ in range(108):
        words = rng.choice(lines).split()
        for at in rng.sample(range(len(words)), rng.randrange(1, 1 + len(words) // 3)):
            words[at] = word()
        lines.append(" ".join(words))
    marks = line_dedup.Marks(lines)
    marks.read(np.arange(120))
    pairs = [(a, b) for a in range(120) for b in range(120) if a != b]
    possible = {a: marks.may_share(a, np.arange(120), 0.8) for a in range(120)}
    alike = [(a, b) for a, b in pairs if similar(lines[a], lines[b], 0.8)]
    assert all(possible[a][b] for a, b in alike) and len(alike) > 200
    assert sum(not possible[a][b] for a, b in pairs) > 3000
    monkeypatch.setattr(line_dedup, "MOST_APART", 5)
    n = len(lines)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]
    columns = [[1] * n, list(range(n)), [0] * n, [[7]] * n, lines]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["place", "h", "sim", "keys", "line"])
    label = [list(range(n)), list(range(n))]
    found = [(a, b) for t in line_dedup.verified_links(iter([batch]), 16, 0.8) for a, b in zip(*(c.to_pylist() for c in t.columns))]
    for which, links in enumerate((found, alike)):
        for a, b in links:
            label[which] = [label[which][a] if x == label[which][b] else x for x in label[which]]
    assert [[x == y for y in label[0]] for x in label[0]] == [[x == y for y in label[1]] for x in label[1]]
