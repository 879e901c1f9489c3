"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text become typed placeholders; what is left is its template.  Windows of template
tokens of documents and benchmark items are joined by hash.  A document leaks an item if, in some stretch of it, most
of the item's windows stand in the item's order and the placeholders agree: one value of the item is always the same
value in the document, as it is in a copy and in a question whose parameters were replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, map_batches

TOKEN = re.compile(r"[.!?\n]+|\d[\d.,:/]*|[^\W\d_]+(?:['’-][^\W\d_]+)*|[%€$£°]")
UNITS = frozenset(
    "% € $ £ ° mm cm dm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces oz pound "
    "pounds lb lbs ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours h hr hrs day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur gbp percent degree degrees celsius fahrenheit kelvin meter meters metre metres kilometer kilometers kilometre "
    "kilometres kph kmh mph hz khz mhz ghz watt watts kw volt volts joule joules newton newtons byte bytes kb mb gb tb".split()
)
WORD, NUMBER, UNIT, NAME, STOP = range(5)
NUMBERS, UNITS_, NAMES = (np.uint64(xxhash.xxh64_intdigest(x, 1) & ~7) for x in (b"<number>", b"<unit>", b"<name>"))
FACTOR = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 24  # of the bitmap of window hashes: 2 MB however large the benchmark is
BROADCAST_WINDOWS = 200_000  # of items, some 100 bytes each; more are joined by shuffle
SLACK = 8  # tokens by which the alignment of one copy may shift


class Codes(dict):
    """Hash of a token's lower-case form, its kind in the lowest three bits."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        low = token.lower()
        if token[0] in ".!?\n":
            kind = STOP
        elif token[0].isdigit():
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        elif token[0].isupper() and token[1:].islower():
            kind = NAME
        else:
            kind = WORD
        out = self[token] = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"), 5) & ~7 | kind
        return out


CODES = Codes()


def template(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(template tokens, whether each is a placeholder, index of each among the tokens, tokens).

    A capitalised word is a name unless a sentence or line begins there; adjoining names are one.  A unit is one only
    after a number.
    """
    tokens = TOKEN.findall(text)
    codes = np.fromiter(map(CODES.__getitem__, tokens), np.uint64, len(tokens))
    kinds = (codes & np.uint64(7)).astype(np.int8)
    before = np.r_[np.int8(STOP), kinds[:-1]]
    out = codes & ~np.uint64(7)
    number = kinds == NUMBER
    unit = (kinds == UNIT) & (before == NUMBER)
    name = (kinds == NAME) & (before != STOP)
    out[number], out[unit], out[name] = NUMBERS, UNITS_, NAMES
    stays = (kinds != STOP) & ~(name & np.r_[False, name[:-1]])
    return out[stays], (number | unit | name)[stays], np.flatnonzero(stays), tokens


def windows(text: str, width: int, all_kinds: bool = False) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(hash, position) of the windows that have two words at least, or with all_kinds of all windows, and what their
    slots are looked up in."""
    out, slot, index, tokens = template(text)
    n = len(out) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), tokens, slot, index
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = h * FACTOR + out[j : j + n]
    h = (h + np.uint64(width)) * FACTOR if all_kinds else h
    h ^= h >> np.uint64(29)
    if all_kinds:
        return h, np.arange(n), tokens, slot, index
    held = np.r_[0, np.cumsum(slot)]
    at = np.flatnonzero(held[width:] - held[:-width] <= width - 2)
    return h[at], at, tokens, slot, index


def slots(at: int, width: int, tokens: list[str], slot: np.ndarray, index: np.ndarray) -> list[str]:
    """The value of each placeholder of a window: a number, a unit, or all words of a name."""
    def value(i: int) -> str:
        end = index[i + 1] if i + 1 < len(index) else len(tokens)
        return " ".join(t for t in tokens[index[i] : end] if t[0] not in ".!?\n")

    return [value(i) for i in range(at, at + width) if slot[i]]


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(item_id, n_windows, size, h, item_at, item_slots) of benchmark (item_id, text).  size is width, but for an item of
    fewer tokens, from two on: it is one window of all it has."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size = min(width, len(template(text or "")[0]))
                h, at, *rest = windows(text or "", size, size < width) if size > 1 else windows("", width)
                rows += [(item, len(h), size, x, a, slots(a, size, *rest)) for x, a in zip(h.view(np.int64).tolist(), at.tolist())]
            yield batch_of(rows, kinds, names)

    names, kinds = ["item_id", "n_windows", "size", "h", "item_at", "item_slots"], [pa.int64()] * 5 + [pa.list_(pa.string())]
    return map_batches(benchmark, scan, "item_id bigint, n_windows bigint, size bigint, h bigint, item_at bigint, item_slots array<string>")


def batch_of(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def bitmap(items: DataFrame) -> np.ndarray:
    """2^FILTER_BITS bits, set where the top bits of an item's window hash point."""
    slot = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    rows = items.select(F.shiftright(slot, 15).alias("part"), slot.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in rows.collect():
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def document_windows(docs: DataFrame, bits: np.ndarray, width: int, short: list[int]) -> DataFrame:
    """(doc_id, print, h, at, doc_slots) of those windows of docs (doc_id, text, print) whose bit is set, of `width` tokens
    and of the sizes of short items."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                for size in (width, *short):
                    h, at, *rest = windows(text, size, size < width)
                    bit = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                    for i in np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1):
                        a = int(at[i])
                        rows.append((doc, mark, int(h.view(np.int64)[i]), a, slots(a, size, *rest)))
            yield batch_of(rows, kinds, names)

    names, kinds = ["doc_id", "print", "h", "at", "doc_slots"], [pa.int64()] * 4 + [pa.list_(pa.string())]
    return map_batches(docs, scan, "doc_id bigint, print bigint, h bigint, at bigint, doc_slots array<string>")


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """One row for each document and benchmark item that it leaks: doc_id, print (hash of the text), item_id, coverage
    (share of the item's windows found in the best stretch), consistency (share of slot values of the item that stand
    for one value of the document), replaced (whether some value differs).

    Both shares are at least `least`; values stand for each other one to one, a name with all its words.  A stretch is
    where windows keep their distance from the item's within SLACK tokens.  An item of fewer than `width` template
    tokens, but two at least, is found as it is, with equal values.  Repeated rows, equal in doc_id and text, give one
    row.  Null texts and items, items of one token or none, and longer ones with no window of two words leak nothing; a null doc_id is kept and tells documents
    apart by text only.  Extra columns are ignored; empty tables give an empty result.

    Scale: documents are scanned once and not shuffled; a bitmap of fixed size lets through the windows that may be an
    item's, and these are joined by hash with those of the items, however many there are.  What a stretch sums up is
    bounded by one document and one item.
    """
    items = cut(item_windows(benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string").alias("text")), width))
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("print"))
    facts = items.agg(F.count("*"), F.collect_set(F.when(F.col("size") < width, F.col("size")))).first()  # of sizes, width - 2 at most
    found = document_windows(plain, bitmap(items), width, sorted(facts[1]))
    met = found.join(F.broadcast(items) if facts[0] <= BROADCAST_WINDOWS else items, "h")
    shift = F.col("at") - F.col("item_at")
    grids = F.array(*[F.struct(F.lit(g).alias("grid"), F.floor((shift + g * SLACK) / (2 * SLACK)).alias("row")) for g in (0, 1)])
    pair = F.transform(F.arrays_zip("item_slots", "doc_slots"), lambda z: F.struct(F.lower(z["item_slots"]).alias("a"), F.lower(z["doc_slots"]).alias("b")))
    met = met.select("doc_id", "print", "item_id", "n_windows", "size", "item_at", F.explode(grids).alias("place"), pair.alias("pairs"))
    stretch = met.groupBy("doc_id", "print", "item_id", "n_windows", "size", "place").agg(
        F.count_distinct("item_at").alias("n"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")
    )
    values = F.least(*[F.size(F.array_distinct(F.transform("pairs", lambda p: p[end]))) for end in ("a", "b")])
    agree = F.when(F.size("pairs") > 0, values / F.size("pairs")).otherwise(F.lit(1.0))
    replaced = F.exists("pairs", lambda p: p["a"] != p["b"])
    scored = stretch.select(
        "doc_id", "print", "item_id", (F.col("n") / F.col("n_windows")).alias("coverage"), agree.alias("consistency"), replaced.alias("replaced"), "size"
    ).where((F.col("coverage") >= least) & (F.col("consistency") >= least) & ((F.col("size") == width) | ~F.col("replaced")))
    best = F.max(F.struct("coverage", "consistency", ~F.col("replaced"))).alias("best")
    told = scored.groupBy("doc_id", "print", "item_id").agg(best)
    return told.select("doc_id", "print", "item_id", "best.coverage", "best.consistency", (~F.col("best.col3")).alias("replaced"))


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, columns of any name unchanged, that leak no item of benchmark; null texts and ids stay by the same
    rule, repeated rows stay or go together, and an empty table gives an empty result."""
    own, mark = fresh(docs.columns, "own", "mark")
    found = leaks(docs, benchmark).select(F.col("doc_id").alias(own), F.col("print").alias(mark)).distinct()
    same = (F.xxhash64("text") == F.col(mark)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(own))
    return docs.join(found, same, "left_anti")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("print")
