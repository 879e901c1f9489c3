"""SimHash near-duplicates by deletion-variant signatures.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles.  Two fingerprints that
differ in at most `distance` bits have, when cut into distance // 2 + 1 segments, one segment with at most one
differing bit.  Each distinct fingerprint is therefore indexed under 64 signatures: for every bit, the bit's segment
with this bit left out.  Equal signatures are brought together, linked when the whole fingerprints are close enough,
and the links are closed to components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, fresh, map_batches, pieces, whole_groups

MARK_BITS = 24  # of the bitmap of texts to be compared: 2 MB whatever the corpus
SAMPLE, IN_SAMPLE, MOST_COMMON = 2000, 4, 50_000  # texts read for common shingles; how many of them a common one is in; the most kept
BATCH_BYTES = 1 << 20
BINS, IN_BIN = 128, 8  # the least bins into which a text's shingles are counted, a byte each; how many a bin of a long text has
LARGE_BUCKET = 256  # up to here all pairs of a bucket of shingles are looked at together
SMALL_GROUP = 24  # up to here all pairs of a bucket are compared; beyond it links are found by searching outwards


def simhash(text: str | None, words: int = 4) -> int:
    """Signed 64-bit fingerprint of one text; 0 if it has no word."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    stops = ends[len(tokens) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts, stops)], dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment: as few as leave one with at most one differing bit."""
    n = distance // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def first_shared(x: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
    """The lowest wildcard bit whose signature two fingerprints with the xor x share; 64 if there is none."""
    out = np.full(x.shape, 64, np.int64)
    for at, width in reversed(cuts):
        part = (x >> np.uint64(at)) & np.uint64((1 << width) - 1)
        ones = np.bitwise_count(part)
        bit = np.bitwise_count((part - (ones > 0).astype(np.uint64))).astype(np.int64)  # trailing zeros of a lone bit
        out = np.where(ones == 0, at, np.where(ones == 1, at + bit, out))
    return out


def _search(prints: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join the members of one large bucket as all close pairs would, at most one for each member."""
    rest, found = prints, []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            here = queue.pop()
            near = np.bitwise_count(rest ^ here) <= distance
            if near.any():
                new = rest[near]
                found.append((np.full(len(new), here), new))
                queue.extend(new)
                rest = rest[~near]
    return found


def link_buckets(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links among rows (key, fp) that come sorted by key; only the bucket at hand is held, 8 bytes a fingerprint."""
    cuts = segments(distance)

    def links(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        sizes = np.diff(np.r_[starts, len(k)])
        pairs = []
        size_of = np.repeat(sizes, sizes)
        small = (size_of > 1) & (size_of <= SMALL_GROUP)
        ks, fs = k[small], f[small]
        for d in range(1, min(SMALL_GROUP, len(ks))):
            same = ks[:-d] == ks[d:]
            if not same.any():
                break
            a, b, key = fs[:-d][same], fs[d:][same], ks[:-d][same]
            x = a ^ b
            near = np.bitwise_count(x) <= distance
            a, b, key, x = a[near], b[near], key[near], x[near]
            once = first_shared(x, cuts) == key >> 32  # of the buckets that a pair shares, one reports it
            pairs.append((a[once], b[once]))
        for s, n in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP]):
            pairs += _search(f[s : s + n], distance)
        a = np.concatenate([p[0] for p in pairs]) if pairs else np.empty(0, np.uint64)
        b = np.concatenate([p[1] for p in pairs]) if pairs else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(0).to_numpy(zero_copy_only=False)
        f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if k[0] == k[-1] and held and held[-1][0][-1] == k[0]:
            held.append((k.copy(), f.copy()))
            continue
        last = int(np.searchsorted(k, k[-1]))
        if held and held[0][0][0] != k[0]:
            yield from links(*map(np.concatenate, zip(*held)))
            held = []
        if last:
            yield from links(*map(np.concatenate, zip(*held, (k[:last], f[:last]))))
            held = []
        held.append((k[last:].copy(), f[last:].copy()))
    if held:
        yield from links(*map(np.concatenate, zip(*held)))


def signatures(prints: DataFrame, distance: int) -> DataFrame:
    """(key, fp): each fingerprint under its 64 one-wildcard signatures; a key holds the bit and the segment without it."""
    def key(i):
        out = None
        for at, width in segments(distance):
            part = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))
            without = part.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("bigint"), i - at)))
            out = F.when(i < at + width, without) if out is None else out.when(i < at + width, without)
        return F.shiftleft(i.cast("bigint"), 32).bitwiseOR(out)

    return prints.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(63)), key)).alias("key"), "fp")


def near_duplicates(docs: DataFrame, distance: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, fp (signed 64-bit fingerprint) and component_id, the smallest doc_id that
    links of at most `distance` differing bits reach.

    Lower-cases A-Z, takes runs without ASCII white space as words and `words`-word shingles, repeats included; with
    fewer words the whole sequence is the one shingle.  A null or empty text has fingerprint 0 and links like any
    other.  Repeated rows each come out.  A null doc_id is kept and never chosen as component_id while its component
    has another; extra columns are ignored; an empty table gives an empty result.

    Scale: one pass over the texts; then 64 keys of 16 bytes for each *distinct* fingerprint, so exact copies cost
    nothing, and a bucket of near copies is searched outwards, giving links in proportion to its members.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    signed = cut(map_batches(base, scan, "doc_id bigint, fp bigint"))
    prints = signed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    keyed = signatures(prints.select("fp"), distance).repartition("key").sortWithinPartitions("key", "fp")
    links = map_batches(keyed, lambda batches: link_buckets(batches, distance), "a bigint, b bigint")
    parts = connected_components(links).withColumnRenamed("node", "fp")
    linked = cut(parts.join(prints, "fp"))
    lowest = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = linked.join(lowest, "component").select("fp", "component_id")
    by_print = cut(prints.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return signed.join(by_print, "fp").select("doc_id", "fp", "component_id")


class Digests(dict):
    """XXH64 of words, forgotten all together when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word, 42)
        return out


DIGESTS = Digests()


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(DIGESTS.__getitem__, tokens), "<u8", len(tokens))


def word_set_print(hashes: np.ndarray) -> int:
    """Signed SimHash of the distinct words by their hashes; 0 without words.  An edit changes one or two of them, but `words` shingles."""
    some = np.unique(hashes)
    if not len(some):
        return 0
    ones = np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(some), bitorder="little").view("<i8")[0])


def shingles(hashes: np.ndarray, words: int) -> np.ndarray:
    """Hashes, ascending, of the distinct runs of `words` words by the words' hashes; of the whole sequence if it is shorter."""
    n = max(1, len(hashes) - words + 1)
    out = np.full(n, min(len(hashes), words), np.uint64)
    for i in range(min(len(hashes), words)):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n + i]
    out = (out ^ out >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ out >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return np.unique(out ^ out >> np.uint64(31))


def prefix(some: np.ndarray, least: float, common: np.ndarray) -> np.ndarray:
    """The first of a text's shingles, in an order that puts those of `common` (ascending) last and is the same for all
    texts: as many as any text of Jaccard similarity `least` or more must share one of with its own first ones."""
    if len(common):
        last = common[np.minimum(np.searchsorted(common, some), len(common) - 1)] == some
        some = np.concatenate([some[~last], some[last]])
    return some[: len(some) - math.ceil(least * len(some) - 1e-9) + 1]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def bins(some: np.ndarray) -> bytes:
    """How many of the shingles fall into each bin by their low bits; nothing if a byte cannot count them."""
    n = max(BINS, 1 << (len(some) // IN_BIN).bit_length())
    counts = np.bincount((some & np.uint64(n - 1)).astype(np.int64), minlength=n)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def most_shared(m: int, n: int, p: bytes, q: bytes) -> int:
    """How many shingles two texts of m and n shingles share at most: the lesser count of each of their bins p and q."""
    if not p or not q:
        return min(m, n)
    a, b = (np.frombuffer(x, np.uint8) for x in (p, q))
    if len(a) != len(b):
        to = min(len(a), len(b))
        a, b = (x.reshape(-1, to).sum(axis=0, dtype=np.int64) for x in (a, b))
    return int(np.minimum(a, b).sum(dtype=np.int64))


def can_overlap(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Those (x, y, g, h) of rows (x, y, g, h, size of x, of y, bins of x, of y) that can have the similarity `least`, with
    the most that they can share, as a part of what they need."""
    for batch in batches:
        m, n = (batch.column(i).to_numpy() for i in (4, 5))
        most = np.array([most_shared(*x) for x in zip(m.tolist(), n.tolist(), batch.column(6).to_pylist(), batch.column(7).to_pylist())], np.float64)
        need = least / (1 + least) * (m.astype(np.int64) + n)
        out = batch.select(["x", "y", "g", "h"]).append_column("bound", pa.array(most / need))
        yield out.filter(pa.array(most >= need - 1e-6))


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles, ascending, that are in IN_SAMPLE or more of about SAMPLE texts of docs (text, mark), at most MOST_COMMON.
    They only decide which shingles come last in prefix(): any list gives the same links."""
    every = max(1, docs.count() // SAMPLE)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, BATCH_BYTES):
            found = [shingles(word_hashes(words_of(t)), words) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["shingle"])

    some = docs.where(F.pmod(F.xxhash64("mark"), F.lit(every)) == 0).dropDuplicates(["mark"]).select("text")
    counts = map_batches(some, scan, "shingle bigint").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= IN_SAMPLE)
    return np.sort(np.array([r["shingle"] for r in counts.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).collect()], np.int64).view(np.uint64))


def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, class, size, at) that come sorted by key and class, each once, those whose key has two classes or more."""
    for table in whole_groups(batches):
        key, kind = (table.column(i).to_numpy() for i in range(2))
        new = np.r_[True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])]
        key = key[new]
        same = key[1:] == key[:-1]
        take = np.flatnonzero(new)[np.r_[False, same] | np.r_[same, False]]
        yield from table.take(pa.array(take)).combine_chunks().to_batches()


def cross_pairs(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs (x, y) of classes of different groups (g, h) that can have the similarity `least`, among rows (key, class, group, size,
    at) that come sorted by key and size: the sizes, and what is left of both from the shared shingle on, allow it."""
    for table in whole_groups(batches):
        key, kind, group, size, at = (table.column(i).to_numpy() for i in range(5))
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        counts = np.diff(np.r_[starts, len(key)])
        mixed = np.minimum.reduceat(group, starts) != np.maximum.reduceat(group, starts)

        def kept(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            need = least / (1 + least) * (size[i] + size[j]) - 1e-6
            return (group[i] != group[j]) & (np.minimum(size[i] - at[i], size[j] - at[j]) >= need)

        found = []
        small = mixed & (counts <= LARGE_BUCKET)
        i, ends = np.flatnonzero(np.repeat(small, counts)), np.repeat(starts + counts, counts)
        for d in range(1, LARGE_BUCKET):
            i = i[i + d < ends[i]]
            i = i[size[i] >= least * size[i + d] - 1e-6]  # sizes ascend: one that is too small for this one is so for all that follow
            if not len(i):
                break
            some = i[kept(i, i + d)]
            found.append((some, some + d))
        for s, n in zip(starts[mixed & ~small], counts[mixed & ~small]):  # what is within the largest group is not looked at
            names, count = np.unique(group[s : s + n], return_counts=True)
            here = np.arange(s, s + n)
            for i in here[group[here] != names[count.argmax()]]:
                near = here[np.searchsorted(size[here], least * size[i] - 1e-6) : np.searchsorted(size[here], size[i] / least + 1e-6, side="right")]
                near = near[kept(np.full(len(near), i), near)]
                found.append((np.full(len(near), i), near))
        a, b = (np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in (0, 1))
        a, b = np.where(kind[a] < kind[b], a, b), np.where(kind[a] < kind[b], b, a)
        pair = np.unique(np.stack([kind[a], kind[b], group[a], group[b]], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, k])) for k in range(4)], ["x", "y", "g", "h"])


def similar_pairs(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, least: float) -> DataFrame:
    """Those (a, b) of the pairs (x, y) of classes whose shingles, counted exactly, have a Jaccard similarity of `least` or more."""
    ends = pairs.select(F.col("x").alias("class")).union(pairs.select("y")).distinct()
    wanted = cut(classes.join(ends, "class").select("class", "first.mark"))
    bits = mark_bitmap(wanted.select("mark"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            slot = batch.column(1).to_numpy() & ((1 << MARK_BITS) - 1)
            at = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            some = batch.take(pa.array(at))
            rows = [shingles(word_hashes(words_of(t)), words).view(np.int64) for t in some.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(1), pa.array(rows, pa.list_(pa.int64()))], ["mark", "shingles"])

    found = map_batches(docs.select("text", "mark"), fetch, "mark bigint, shingles array<bigint>").dropDuplicates(["mark"])
    sets = cut(found.join(wanted, "mark").select("class", "shingles"))
    both = pairs.join(sets.toDF("x", "p"), "x").join(sets.toDF("y", "q"), "y").withColumn("n", F.size(F.array_intersect("p", "q")))
    return both.where(F.col("n") >= least * (F.size("p") + F.size("q") - F.col("n")) - 1e-9).select(F.col("x").alias("a"), F.col("y").alias("b"))


def copy_groups(docs: DataFrame, words: int = 5, least: float = 0.8, distance: int = 7) -> DataFrame:
    """(group, stays, classes) for each group of near copies of docs (doc_id, text, mark): the document that stays, the
    smallest (null ids last, doc_id, mark), and the number of its different texts.

    Texts with the same words in the same order are one class.  Classes are linked if the Jaccard similarity of their
    `words`-word shingles, counted exactly, is at least `least`.  Those whose distinct words have SimHashes at most
    `distance` bits apart, found by deletion-variant signatures, are compared first.  All others that can be so similar
    share one of their first shingles (prefix), and are compared unless links already join them or the sizes, the places
    of that shingle or the counts of all shingles by bins rule the similarity out: no link is lost.
    """
    common = common_shingles(docs, words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()  # classes whose prefix this worker has given
        for batch in pieces(batches, BATCH_BYTES):
            prints, classes, sizes, firsts, counts = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                tokens = words_of(text)
                hashes = word_hashes(tokens)
                kind = xxhash.xxh64_intdigest(b" ".join(tokens), 44) - (1 << 63)
                some = np.empty(0, np.uint64) if kind in met else shingles(hashes, words)
                met.add(kind)
                prints.append(word_set_print(hashes))
                classes.append(kind)
                sizes.append(len(some))
                counts.append(bins(some) if len(some) else b"")
                firsts.append(prefix(some, least, common).view(np.int64) if len(some) else [])
            if len(met) > 200_000:
                met.clear()
            columns = [batch.column(0), batch.column(2), pa.array(prints, pa.int64()), pa.array(classes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(counts, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "fp", "class", "size", "bins", "prefix"])

    scanned = cut(map_batches(docs.select("doc_id", "text", "mark"), scan, "doc_id bigint, mark bigint, fp bigint, class bigint, size int, bins binary, prefix array<bigint>"))
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark")
    classes = cut(scanned.groupBy("class").agg(F.min("fp").alias("fp"), F.min(place).alias("first")))
    leads = classes.groupBy("fp").agg(F.min("class").alias("lead"))
    keyed = signatures(leads.select("fp"), distance).repartition("key").sortWithinPartitions("key", "fp")
    close = map_batches(keyed, lambda batches: link_buckets(batches, distance), "a bigint, b bigint").distinct()
    between = close.join(leads.toDF("a", "x"), "a").join(leads.toDF("b", "y"), "b").select("x", "y")
    within = classes.join(leads, "fp").where("class <> lead").select(F.col("lead").alias("x"), F.col("class").alias("y"))
    parts = cut(connected_components(similar_pairs(docs, classes, cut(between.union(within)), words, least)).withColumnRenamed("node", "class"))
    first = scanned.where("size > 0").select("class", "size", F.posexplode("prefix").alias("at", "key")).select("key", "class", "size", "at")
    shared = cut(map_batches(first.repartition("key").sortWithinPartitions("key", "class"), shared_only, "key bigint, class bigint, size int, at int"))
    placed = shared.join(parts, "class", "left").select("key", "class", F.coalesce("component", "class").alias("group"), "size", "at")
    crossing = map_batches(placed.repartition("key").sortWithinPartitions("key", "size"), lambda batches: cross_pairs(batches, least), "x bigint, y bigint, g bigint, h bigint")
    known = scanned.where("size > 0").groupBy("class").agg(F.max("size").alias("size"), F.max("bins").alias("bins"))
    known = cut(known.join(shared.select("class").distinct(), "class", "left_semi"))
    crossing = crossing.distinct().join(known.toDF("x", "m", "p"), "x").join(known.toDF("y", "n", "q"), "y").select("x", "y", "g", "h", "m", "n", "p", "q")
    crossing = cut(map_batches(crossing, lambda batches: can_overlap(batches, least), "x bigint, y bigint, g bigint, h bigint, bound double"))
    # of the pairs between two groups the likeliest comes first; then all whose groups it has not joined
    likeliest = crossing.groupBy(F.least("g", "h"), F.greatest("g", "h")).agg(F.max(F.struct("bound", "x", "y")).alias("best")).select("best.x", "best.y")
    likeliest, rest = cut(likeliest), crossing.select("x", "y")
    for pairs in (likeliest, rest):
        if pairs is rest:
            now = parts.toDF("class", "now")
            sides = [now.toDF(side, f"{side}_now") for side in ("x", "y")]
            apart = F.coalesce("x_now", "x") != F.coalesce("y_now", "y")
            pairs = cut(rest.join(likeliest, ["x", "y"], "left_anti").join(sides[0], "x", "left").join(sides[1], "y", "left").where(apart).select("x", "y"))
        if not pairs.isEmpty():
            more = similar_pairs(docs, classes, pairs, words, least)
            parts = cut(connected_components(more.union(parts.select("class", "component"))).withColumnRenamed("node", "class"))
    grouped = classes.join(parts, "class", "left").select("class", F.coalesce("component", "class").alias("group"), "first")
    return grouped.groupBy("group").agg(F.min("first").alias("stays"), F.count("*").alias("classes"))


def mark_bitmap(marks: DataFrame) -> np.ndarray:
    """2^MARK_BITS bits, set where the low bits of a mark point."""
    slot = F.col("mark").bitwiseAND(F.lit((1 << MARK_BITS) - 1))
    rows = marks.select(F.shiftright(slot, 15).alias("part"), slot.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(1 << (MARK_BITS - 3), np.uint8)
    for r in rows.collect():
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def drop_near_duplicates(docs: DataFrame, words: int = 5, least: float = 0.8, distance: int = 7) -> DataFrame:
    """docs, columns unchanged, with one document of each group that links of shingle similarity `least` join: the one
    with the smallest doc_id, ties by the hash of the text; a null doc_id only stays where its group has no other.

    Rows equal in doc_id and text are one document and stay or go together.  Null and empty texts, and texts without
    words, are copies of each other; an empty table gives an empty result; columns of any name stay as they are.

    Scale: texts are scanned twice or three times and shuffled once; a distinct text costs 64 keys of 16 bytes and, for
    a fifth of its shingles, 24 bytes each, of which those that another text shares are written.
    """
    mark, own, seen = fresh(docs.columns, "mark", "own", "seen")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    stays = copy_groups(plain, words, least, distance).select(F.col("stays.doc_id").alias(own), F.col("stays.mark").alias(seen))
    same = (F.col(mark) == F.col(seen)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(own))
    return docs.withColumn(mark, F.xxhash64(text)).join(stays, same, "left_semi").drop(mark)


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
