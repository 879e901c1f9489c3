import random
import re

from lakeloom.llm.license_rules import rules
from lakeloom.llm.licenses import PHRASES, any_keyword, find_licenses

LINES = ["Licensed under the Apache License, Version 2.0.", "All rights reserved.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.",
         "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-2.0-or-later", "cc by", "CC-BY cc\nby", "éall rights reserved",
         "all rights  reserved all rights reserved", "Copyright (c) 2020 Someone", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_places(text):
    w = words(text)
    return sorted((label, i) for phrase, label in PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())


def plain_found(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    hits = [(n, label, sure, m.start(), m.end()) for n, _, label, k, p, sure in rules() if k in low for m in re.finditer(p, low)]
    return sorted((a[1], a[2], a[0], a[3], a[4]) for a in hits if not any(b[0] < a[0] and b[3] <= a[3] and a[4] <= b[4] for b in hits))


def test_equals_brute_force(spark):
    rng = random.Random(6)
    filler = "the of x1 été cc by general public rights ALL \U0001f600 12".split()
    texts = [None, "", "\x00", "all rights " * 3000, "a " * 50000 + LINES[0], *LINES]
    for _ in range(120):
        parts = [rng.choice(LINES) if rng.random() < 0.1 else rng.choice(filler) for _ in range(rng.choice([3, 20, 80]))]
        texts.append(rng.choice([" ", "\n", ", "]).join(parts))
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, LINES[1], "x"), (7, texts[7], "x")]
    got = find_licenses(spark.createDataFrame(rows, "doc_id bigint, text string, labels string")).collect()
    assert len(got) == len(rows)
    want = {t: (len(words(t)), plain_places(t), plain_found(t)) for t in texts}
    for r in got:
        text = LINES[1] if r["doc_id"] is None else texts[r["doc_id"]]
        assert (r["n_words"], sorted(map(tuple, r["places"])), sorted(map(tuple, r["found"]))) == want[text]


def test_rules():
    assert len(rules()) >= 300
    gate = re.compile(any_keyword())
    for text, label in ((LINES[0], "apache-2.0"), (LINES[2], "mit"), (LINES[3], "cc-by-nc"), (LINES[4], "gpl-3.0"), (LINES[5], "gpl-2.0")):
        assert gate.search(text) and label in {x[0] for x in plain_found(text)}
        assert all(x[0] == label for x in plain_found(text))


def test_empty(spark):
    assert find_licenses(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
