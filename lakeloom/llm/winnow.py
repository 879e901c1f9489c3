"""Document fingerprints by winnowing, in DataFrame expressions only.

The grams are runs of `gram` words.  Each has a rolling (cyclic polynomial) hash of its words' hashes; of every
`window` consecutive hashes the smallest is chosen, the rightmost of equal ones, and kept with its position.  Two texts
that share gram + window - 1 consecutive words therefore share a chosen hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

#: Words are runs of letters and digits; anything beyond ASCII counts as a letter.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BETWEEN_WORDS), "")


def rotate(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by else x


def roll(hashes: Column, gram: int) -> Column:
    """Cyclic polynomial hash of every `gram` consecutive word hashes, doubling the width of what is joined; of all of
    them if there are fewer.  h(i..i+a+b) = rotate(h(i..i+a), b) xor h(i+a..i+a+b)."""
    def joined(parts: Column, more: Column, a: int, b: int, total: int) -> Column:
        return F.transform(
            F.slice(parts, 1, F.size(hashes) - (total - 1)), lambda x, i: rotate(x, b).bitwiseXOR(F.get(more, i + a))
        )

    def widen(parts: Column, width: int) -> Column:
        if width == gram:
            return parts
        step = min(width, gram - width)
        if step == width:
            return let(joined(parts, parts, width, width, 2 * width), lambda p: widen(p, 2 * width))
        return let(roll(hashes, step), lambda more: joined(parts, more, width, step, gram))

    short = F.array(F.aggregate(hashes, F.lit(0).cast("bigint"), lambda acc, x: rotate(acc, 1).bitwiseXOR(x)))
    return F.when(F.size(hashes) >= gram, widen(hashes, 1)).when(F.size(hashes) > 0, short).otherwise(hashes)


def slide(codes: Column, window: int) -> Column:
    """Minimum of every `window` consecutive codes (of all of them if there are fewer), by doubling."""
    def widen(least: Column, width: int) -> Column:
        if width == window:
            return least
        step = min(width, window - width)
        kept = F.slice(least, 1, F.size(least) - step)
        return let(F.transform(kept, lambda x, i: F.least(x, F.get(least, i + step))), lambda m: widen(m, width + step))

    return F.when(F.size(codes) > window, widen(codes, 1)).when(F.size(codes) > 0, F.array(F.array_min(codes))).otherwise(codes)


def winnow(text: Column, gram: int = 5, window: int = 16) -> Column:
    """array<bigint>: chosen grams in order of position, each as 32 bits of hash and 31 bits of 2^31 - 1 - position.

    One number orders by hash and then by rightmost position, which is how the minimum is chosen.  A null or empty
    text, or one without words, gives an empty array; a text of fewer words than a gram has one gram.
    """
    def code(h: Column, i: Column) -> Column:
        return F.shiftleft(F.shiftrightunsigned(h, 32), 31).bitwiseOR(F.lit(2**31 - 1).cast("bigint") - i).bitwiseAND(F.lit(2**63 - 1))

    return let(
        F.transform(words_of(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w)),
        lambda hashes: let(
            F.transform(roll(hashes, gram), code), lambda codes: let(slide(codes, window), lambda chosen: F.array_distinct(chosen))
        ),
    )


def hash_part(code: Column) -> Column:
    return F.shiftright(code, 31)


def position_part(code: Column) -> Column:
    return F.lit(2**31 - 1).cast("bigint") - code.bitwiseAND(F.lit(2**31 - 1))


def as_text(codes: Column) -> Column:
    """position:hash of each chosen gram, comma-joined; the hash as hexadecimal digits."""
    return F.array_join(F.transform(codes, lambda c: F.concat_ws(":", position_part(c).cast("string"), F.lower(F.hex(hash_part(c))))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the chosen hashes, positions aside; 1 for two empty fingerprints, null if one is null."""
    def hashes(x: Column) -> Column:
        return F.array_distinct(F.transform(x, hash_part))

    def jaccard(p: Column, q: Column) -> Column:
        both = F.size(F.array_intersect(p, q))
        either = F.size(p) + F.size(q) - both
        return F.when(either == 0, F.lit(1.0)).otherwise(both / either)

    return F.when(a.isNotNull() & b.isNotNull(), let(hashes(a), lambda p: let(hashes(b), lambda q: jaccard(p, q))))


def range_starts(docs: DataFrame, id_col: str, per_range: int, most: int = 20_000) -> list[int]:
    """Ids that cut the ids of docs into ranges of about `per_range` rows, each the smallest id of its range."""
    n, low = docs.agg(F.count(id_col), F.min(id_col)).first()
    parts = min(most, n // per_range)
    if parts < 2:
        return [low] if n else []
    cuts = docs.agg(F.percentile_approx(id_col, [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
    return sorted({low, *cuts})


def range_of(value: Column, starts: list[int]) -> Column:
    """Number of the range that value falls into, by binary search; 0 for a null."""
    limits = F.lit(starts) if starts else F.array(F.lit(0).cast("bigint"))
    steps = F.lit([1 << b for b in reversed(range(max(1, len(starts).bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(limits, at + step).cast("bigint") <= value, at + step).otherwise(at))


def with_next(docs: DataFrame, derive: dict[str, Column], per_range: int = 500) -> DataFrame:
    """docs (doc_id, text) with the columns that derive makes of text, and next_<name> of text and of each of these:
    the value of the next document by ascending doc_id, after the last that of the first.

    Rows of one doc_id follow each other in order of text.  A row with a null doc_id has no next document and is none.
    Ids are cut into ranges whose limits are ids that occur, and rows of a range's smallest id also visit the range
    before it.  So each text is shuffled once, and no task holds more than a range, which may spill.
    """
    starts = range_starts(docs, "doc_id", per_range)
    part = range_of(F.col("doc_id"), starts)
    host = F.struct(part.alias("part"), F.when(F.col("doc_id").isNull(), 2).otherwise(0).alias("guest"))
    visit = F.struct(F.pmod(part - 1, F.lit(max(1, len(starts)))).alias("part"), F.lit(1).alias("guest"))
    begins = F.coalesce(F.get(F.lit(starts).cast("array<bigint>"), part) == F.col("doc_id"), F.lit(False)) if starts else F.lit(False)
    dealt = docs.withColumn("seat", F.explode(F.when(begins, F.array(host, visit)).otherwise(F.array(host))))
    dealt = dealt.select("doc_id", "text", "seat.part", "seat.guest").repartition("part").withColumns(derive)
    order = Window.partitionBy("part").orderBy("guest", "doc_id", "text")
    ahead = {f"next_{c}": F.when(F.col("doc_id").isNotNull(), F.lead(c).over(order)) for c in ("text", *derive)}
    return dealt.withColumns(ahead).where("guest <> 1").drop("part", "guest")


def fingerprints(docs: DataFrame, gram: int = 5, window: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited (text with its last quarter replaced by the start of the next document), codes,
    edited_codes, near_edited and near_next, one row for each row of docs.

    A null text counts as empty, and of two empty fingerprints the likeness is 1.  A row with a null doc_id has no next
    document: its last quarter is dropped and near_next is null.  Extra columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    both = with_next(base, {"codes": winnow(F.col("text"), gram, window)}).withColumn("n_chars", F.length("text").cast("bigint"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - quarter),
        F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), quarter),
    )
    both = both.withColumn("edited", edited).withColumn("edited_codes", winnow(F.col("edited"), gram, window))
    return both.select(
        "doc_id", "n_chars", "edited", "codes", "edited_codes",
        likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"),
        likeness(F.col("codes"), F.col("next_codes")).alias("near_next"),
    )


def op8_winnowing(spark, sf_dir: str) -> DataFrame:
    found = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("codes")).alias("fingerprint"),
        as_text(F.col("edited_codes")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
