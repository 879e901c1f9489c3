"""Packing token sequences by shortest-pack-first over the histogram of lengths.

Documents are tokenised and cut into pieces of at most `length` tokens.  The histogram of piece lengths, at most
`length` numbers whatever the corpus, is packed on the driver: lengths are placed longest first, always into the
packs that are shortest so far, and what is kept is not packs but patterns and how many packs follow each.  Every
slot of a pattern then claims a range of ranks among the pieces of its length, and pieces find their slot by rank.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, held, map_batches

CACHED_CHUNKS = 250_000  # chunks that a worker remembers; it forgets all of them beyond that
CACHED_CHARS = 48  # longer chunks are not remembered
MOST_BROADCAST_SLOTS = 100_000
#: Fixed value: how byte-level BPE of this kind splits a text before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SIMPLE = re.compile("[\n -~\u00a1-\u052f]*").fullmatch
SPACE_BY_SPACE = re.compile(r" \s|\s ")
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class Chunks(dict):
    """Token ids, as little-endian 32-bit bytes, of chunks that pre-tokenisation never looks beyond."""

    def __init__(self, ids, lead: str):
        self.ids, self.lead = ids, lead

    def __missing__(self, chunk: str) -> bytes:
        out = self.ids(self.lead + chunk)
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHED_CHUNKS:
                self.clear()
            self[chunk] = out
        return out


def merges_by_rank(model: str):
    """A tiktoken encoding with the vocabulary and the merges of a byte-level BPE file, or None if it is not one whose
    merges are numbered in the order in which they apply."""
    import tiktoken

    spec = json.loads(model)
    bpe, pre = spec["model"], spec["pre_tokenizer"] or {}
    if bpe.get("type", "BPE") != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
        return None
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes spelled as themselves
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in bpe["vocab"].items() if token not in special}
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in bpe["merges"]]
    if [bpe["vocab"][m] for m in merges] != list(range(256, 256 + len(merges))):
        return None
    return tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of whole texts as bytes, those that the tokenizer file gives.

    A space between two characters that are not white space always starts a token of its own, so a text may be cut
    before each such space and the parts encoded apart; that lets repeated words be encoded once.  Texts in which a
    special token is spelled out are encoded whole.  A part of Latin, Greek or Cyrillic letters is encoded by the same
    merges in tiktoken, which takes a few microseconds less; all other parts by the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        by_rank = merges_by_rank(self.tokenizer.to_str())
        self.by_rank = by_rank.encode_ordinary if by_rank else None
        self.heads, self.rest = Chunks(self.ids, ""), Chunks(self.ids, " ")

    def ids(self, text: str) -> bytes:
        if self.by_rank and SIMPLE(text):
            return array("I", self.by_rank(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        chunks = LONE_SPACE.split(text) if SPACE_BY_SPACE.search(text) or text[0] == " " or text[-1] == " " else text.split(" ")
        return self.heads[chunks[0]] + b"".join(map(self.rest.__getitem__, chunks[1:]))


def encoder(path: str) -> Encoder:
    return held(("encoder", path), lambda: Encoder(path))


def pack_histogram(counts: dict[int, int], length: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(packs, [(piece length, copies), ...])]: patterns and how many packs follow each; packs sum to `length` at most.

    Lengths are placed longest first into the packs with the most room.  Pieces that fit no open pack open new ones,
    as many copies to a pack as it takes.
    """
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    most: list[int] = []

    def put(left: int, packs: int, pattern: list[tuple[int, int]]) -> None:
        if packs:
            if left not in room:
                room[left] = []
                heapq.heappush(most, -left)
            room[left].append((packs, pattern))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        placed: list[tuple[int, int, list[tuple[int, int]]]] = []
        while n and most and -most[0] >= size:
            left = -most[0]
            packs, pattern = room[left].pop()
            if not room[left]:
                del room[left]
                heapq.heappop(most)
            copies = max(1, min(left // size, n // packs))
            filled = min(packs, n // copies)
            placed.append((left - size * copies, filled, [*pattern, (size, copies)]))
            if filled < packs:
                put(left, packs - filled, pattern)
            n -= filled * copies
        if n:
            copies = length // size
            placed.append((length - size * copies, n // copies, [(size, copies)]))
            if n % copies:
                placed.append((length - size * (n % copies), 1, [(size, n % copies)]))
        for x in placed:
            put(*x)
    return [x for left in sorted(room) for x in room[left]]


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int]]:
    """(piece length, first rank, last rank, first sequence less first rank, offset) for each slot of each pattern."""
    out, next_rank, sequence = [], {}, 0
    for packs, pattern in patterns:
        offset = 0
        for size, copies in pattern:
            for _ in range(copies):
                rank = next_rank.get(size, 0)
                out.append((size, rank, rank + packs - 1, sequence - rank, offset))
                next_rank[size] = rank + packs
                offset += size
        sequence += packs
    return out


def pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece, with the partition and the rank in it among equal lengths."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), array("I", [end_id]).tobytes()
        part, ranks = TaskContext.get().partitionId(), [0] * (length + 1)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                total = len(ids) // 4
                for start in range(0, total, length):
                    size = min(length, total - start)
                    out.append((doc, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), total, part, ranks[size]))
                    ranks[size] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 7, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "part_rank"]
    return map_batches(docs, scan, ", ".join(f"{n} bigint" for n in names))


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids followed by end_id; a null or empty text is end_id alone.  Each id is in exactly one piece,
    pieces lie in their sequence without gaps from offset 0, no sequence is over `length`, sequence ids run from 0
    without gaps.  Which of several equally long pieces takes a slot follows the order of the input.  Null doc_ids and
    repeated rows are packed like any other; extra columns are ignored; an empty table gives an empty result.

    Scale: texts are read once and never shuffled; pieces (56 bytes for 1024 tokens) go to the shared folder.  To the
    driver comes the histogram, `length` numbers.  Ranks are counts by length and partition, so a length that half of
    all pieces have is not brought together.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut_up = cut(pieces(base, tokenizer, length, end_id))
    counts = cut_up.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select("length", "part", F.coalesce(before, F.lit(0)).cast("bigint").alias("first"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = slots(pack_histogram(histogram, length))
    table = spark.createDataFrame(rows, "length bigint, low bigint, high bigint, shift bigint, offset bigint")
    if len(rows) <= MOST_BROADCAST_SLOTS:
        table = F.broadcast(table)
    ranked = cut_up.join(firsts, ["length", "part"]).withColumn("rank", F.col("first") + F.col("part_rank"))
    return ranked.join(table, (ranked["length"] == table["length"]) & ranked["rank"].between(table["low"], table["high"])).select(
        "doc_id", "start", ranked["length"], "ids_crc32", "doc_tokens", (F.col("rank") + F.col("shift")).alias("sequence_id"), "offset"
    )


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("byte_bpe_50k.json")))
