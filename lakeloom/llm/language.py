"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built.  A text is parsed against each of them into the
longest matches that it has: the fewer phrases, the closer the language.  Phrase counts are normalised by the length
of what was learned, log2(learned) bits a phrase, and the language that needs fewest bits wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, map_batches, pieces

UNKNOWN = "und"
PIECE = 512  # bytes that are parsed in lock step; a longer text is parsed in as many pieces as it needs
LANES = 40_000
CLASSES = 32
#: ASCII but for lower-case letters becomes white space.
LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def letters(text: str | None) -> bytes:
    """Lower-cased UTF-8 with one space for each run that is not letters, one before and one after; b'' without letters."""
    if not text:
        return b""
    words = text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split()
    if not words or not any(w[0] < 0x80 for w in words) and not any(map(str.isalpha, text)):
        return b""
    return b" %b " % b" ".join(words)


def automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of text; state 0 is the start and no transition leads back to it."""
    to: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in text:
        new = len(to)
        to.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(to)
                to.append(dict(to[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return to


class Parser:
    """Phrase counts of many texts at once, against every language of the sample."""

    def __init__(self, sample: tuple[tuple[str, bytes], ...]):
        self.langs = [lang for lang, _ in sample]
        self.bits = np.array([math.log2(max(2, len(text))) for _, text in sample])
        self.codes, self.tables = [], []  # of a language; code 0: a byte that it has not
        for _, text in sample:
            known = sorted(set(text))  # UTF-8 has at most 243 bytes
            code = np.zeros(256, np.uint8)
            code[known] = np.arange(1, len(known) + 1)
            width = len(known) + 1
            to = automaton(text)
            table = np.zeros((len(to), width), np.int32)
            for state, edges in enumerate(to):
                for c, target in edges.items():
                    table[state, code[c]] = target * width
                edges.clear()
            self.codes.append(code)
            self.tables.append(table.ravel())

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Number of phrases by text and language."""
        sizes = np.array([len(t) for t in texts], np.int64)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        first = np.r_[0, np.cumsum(sizes)[:-1]]
        per = -(-sizes // PIECE)
        doc = np.repeat(np.arange(len(texts)), per)
        at = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * PIECE
        start, length = first[doc] + at, np.minimum(PIECE, sizes[doc] - at)
        order = np.argsort(-length, kind="stable")
        out = np.zeros((len(texts), len(self.langs)))
        for lo in range(0, len(order), LANES):
            lanes = order[lo : lo + LANES]
            found = self._lanes(raw, start[lanes], length[lanes])
            for g in range(len(self.langs)):
                out[:, g] += np.bincount(doc[lanes], found[g], len(texts))
        return out

    def _lanes(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Phrases of each lane by language; lanes come longest first."""
        counts = np.zeros((len(self.langs), len(start)), np.int32)
        states = np.zeros_like(counts)
        active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right") if len(length) else []
        for t, m in enumerate(active):
            read = raw[start[:m] + t]
            for g, (code, table) in enumerate(zip(self.codes, self.tables)):
                c = code[read]
                went = table[states[g, :m] + c]
                ends = np.flatnonzero(went == 0)
                again = table[c[ends]]  # 0: a byte that was never learned, a phrase by itself
                counts[g, ends] += 1 + ((again == 0) & (states[g, ends] > 0))
                went[ends] = again
                states[g, :m] = went
        return counts + (states > 0)


def parser(sample: tuple[tuple[str, bytes], ...]) -> Parser:
    return held(("parser", sample), lambda: Parser(sample))


def training_sample(labelled: DataFrame, chars: int, docs: int) -> tuple[tuple[str, bytes], ...]:
    """(language, text) from labelled rows (doc_id, text, lang): of each language and each of CLASSES classes of
    doc_ids by hash, the docs / CLASSES documents with the smallest hash are candidates; of these, by hash, those are
    learned whose whole text still fits into `chars`; if none does, the start of the first."""
    known = labelled.where("lang is not null and text is not null and doc_id is not null")
    order = Window.partitionBy("lang", "class").orderBy("h", "doc_id")
    hashed = known.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).withColumn("class", F.pmod("h", F.lit(CLASSES)))
    picked = hashed.withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= -(-docs // CLASSES)).select("lang", "doc_id", "h").distinct().collect()
    wanted = {(r["lang"], r["doc_id"]): r["h"] for r in picked}
    rows = known.where(F.col("doc_id").isin(sorted({d for _, d in wanted}))).groupBy("lang", "doc_id").agg(F.max(F.substring("text", 1, chars + 1)).alias("text"))
    texts: dict[str, list] = {}
    for r in rows.collect():
        if (r["lang"], r["doc_id"]) in wanted:
            texts.setdefault(r["lang"], []).append((wanted[r["lang"], r["doc_id"]], r["doc_id"], letters(r["text"])))
    out = []
    for lang in sorted(texts):
        ready = sorted(x for x in texts[lang] if x[2])
        took = b""
        for _, _, text in ready:
            if len(took) + len(text) <= chars:
                took += text
        if took or ready:
            out.append((lang, took or ready[0][2][:chars]))
    return tuple(out)


def crc_third(doc_id: Column | str) -> Column:
    """crc32 of doc_id as text, modulo 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % 3


def judge(column: pa.Array, sample: tuple[tuple[str, bytes], ...]) -> tuple[list[str], list[float], list[float | None]]:
    """lang_pred, score and bits of each text of an Arrow column."""
    texts = [letters(t) for t in column.cast(pa.string()).to_pylist()]
    langs, scores, bits = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
    some = [i for i, t in enumerate(texts) if t] if sample else []
    if some:
        parse = parser(sample)
        cost = parse.phrases([texts[i] for i in some]) * parse.bits
        best = cost.argmin(axis=1)
        ranked = np.sort(cost, axis=1)
        margin = 1 - ranked[:, 0] / ranked[:, 1] if cost.shape[1] > 1 else np.ones(len(some))
        for i, b, m, low in zip(some, best, margin, ranked[:, 0]):
            langs[i], scores[i], bits[i] = parse.langs[b], float(m), float(low) / len(texts[i])
    return langs, scores, bits


def identify(docs: DataFrame, sample: tuple[tuple[str, bytes], ...], text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and bits: the best language, 1 - its bits / the next best's, and its bits a byte.

    A null text and one without letters are `und` with score 0 and null bits; so is every text if the sample is empty.
    Ties go to the language that sorts first.  Texts are parsed whole, in pieces of 512 bytes; each row is kept.  The
    columns lang_pred, score and bits of docs, if it has them, are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "bits")]
    docs = docs.select(*kept)
    at = kept.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            langs, scores, bits = judge(batch.column(at), sample)
            found = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names)

    names = [*kept, "lang_pred", "score", "bits"]
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("lang_pred string, score double, bits double").fields])
    return map_batches(docs, scan, schema)


def learned_languages(docs: DataFrame, chars: int = 32_000, docs_per_language: int = 96) -> tuple[tuple[str, bytes], ...]:
    """A sample of the documents that are not held out, at most `chars` bytes of each language."""
    base = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return training_sample(base.where(crc_third("doc_id") != 1), chars, docs_per_language)


def drop_unintelligible(docs: DataFrame, most_bits: float = 12.0) -> DataFrame:
    """The rows of docs, columns unchanged, whose text reads as one of the languages learned from docs: it has letters,
    and takes at most `most_bits` a byte (over 12 hardly two letters in a row were ever seen)."""
    sample, at = learned_languages(docs), docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            langs, _, bits = judge(batch.column(at), sample)
            yield batch.filter(pa.array([lang != UNKNOWN and b <= most_bits for lang, b in zip(langs, bits)], pa.bool_()))

    return map_batches(docs, scan, docs.schema)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), learned_languages(docs))
    held_out = F.coalesce(crc_third("doc_id") == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits")
