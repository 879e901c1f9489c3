import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lakeloom.llm.packing import encoder, pack, pack_histogram, slots

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
PLAIN = Tokenizer.from_file(PATH)
ODD = ["", " ", "  a  b\n\n c \t d ", "x <|endoftext|> y", "a b  c", "I'm don't we'll 12 3a4", "\n\nA\n b", "é" * 3000, " lead", "trail ",
       "a \x1cb \x85 c\xa0 d", "日本 語 x", "\U0001f600 smile   b", "they'LL  \r\n ok", "tab\t x"]


def plain(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers_ids():
    for text in ODD:
        assert np.frombuffer(encoder(PATH)(text), "<u4").tolist() == plain(text), text


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab 's\n\t.,!0é日\x85\xa0\x1c _"), max_size=40))
def test_ids_of_any_text(text):
    assert np.frombuffer(encoder(PATH)(text), "<u4").tolist() == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=40))
def test_every_piece_has_one_slot(counts):
    patterns = pack_histogram(counts, 64)
    assert all(sum(s * n for s, n in p) <= 64 and packs > 0 for packs, p in patterns)
    ranks = {}
    for size, low, high, _, _ in slots(patterns):
        ranks.setdefault(size, []).extend(range(low, high + 1))
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in counts.items()}


def test_one_length_fills_packs():
    assert sum(n for n, _ in pack_histogram({10: 1003}, 100)) == 101


def test_round_trip(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w%d" % rng.randrange(900) for _ in range(rng.choice([1, 5, 60, 900, 3000])))) for i in range(80)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(300, None), (None, "no id"), rows[3], rows[3], (301, "word " * 20000)]
    df = spark.createDataFrame([(k, t, 5, "z") for k, t in rows], "doc_id bigint, text string, length int, part string").repartition(5)
    found = pack(df, PATH).collect()
    want = []
    for k, t in rows:
        ids = [*plain(t), 0]
        assert len(ids) > 0
        want += [(k, s, len(x := ids[s : s + 1024]), zlib.crc32(np.array(x, "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 1024)]
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(want, key=str)
    at = {}
    for r in found:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(at) == list(range(len(at)))
    for seq in at.values():
        end = 0
        for offset, length in sorted(seq):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(at) <= 1.1 * sum(r["length"] for r in found) / 1024 + 1


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id bigint, text string"), PATH).collect() == []
