"""Fuzzy line deduplication: SimHash of normalised lines, joined on blocks, verified by edit similarity, one line of each group.

Lines are lower-cased and all ASCII but letters and digits becomes white space.  A line's units are its words; in a
short line, and in one of a script without spaces, its runs of CHARS characters.  Lines meet in a block, are taken
further if their 64-bit SimHashes differ in at most `distance` bits, and are linked if their edit similarity is high
enough.  Links are closed to groups and the first occurrence of a group stays.

The SimHash is cut into BLOCKS blocks: of two that differ in fewer than BLOCKS bits, one block is sure to agree, so all
such lines are compared.  Lines of edit similarity 0.8 differ in up to 16 bits and more, which no block wide enough to
tell lines apart outlasts, so lines also meet in BANDS bands of ROWS minima of hashed pairs of units.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, fresh, let, map_batches, pieces, whole_groups

#: ASCII: letters lower-cased, digits and line feeds as they are, all else white space; other bytes stay.
PLAIN = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A or 0x30 <= b <= 0x39 or b == 0x0A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
FILTER_BITS = 25  # of the bitmap that says which lines' texts are wanted: 4 MB whatever the corpus
BLOCKS = 4  # of the SimHash; lines that meet in one are taken further if fewer bits than that differ
BANDS, ROWS = 16, 3
MOST_MARKED = 4096  # lines of a bucket up to which close ones are told from the rest before they are searched
MOST_TOGETHER = 20_000  # SimHashes in sets that overlap one set, up to which these are searched together
MARK_BITS = 1024  # that say which words a line has
FEW_ROWS = 16  # in a set up to which its lines' words are not marked
MOST_APART = 200_000  # pairs that are remembered not to be similar
CHARS = 4
FEW_WORDS, LONG_WORD = 12, 12  # a line of fewer words, or of longer ones on average, is read by characters
SEGMENT = 1 << 18  # bytes of lines whose units are hashed at once
RUN = 255  # units whose bits a byte can count
#: For each byte, its bits as the bytes of a little-endian word, so that adding words counts eight bits at once.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
ODD = np.random.default_rng(21).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
with np.errstate(over="ignore"):
    POWERS = np.cumprod(np.r_[np.uint64(1), np.full(SEGMENT + 4 * CHARS, np.uint64(BASE))], dtype=np.uint64)
    INVERSES = np.cumprod(np.r_[np.uint64(1), np.full(SEGMENT + 4 * CHARS, np.uint64(pow(BASE, -1, 1 << 64)))], dtype=np.uint64)
LEAST_CHARS = 12  # of a line of few words that is compared with others that are not equal
LOOK = 5  # words that an alignment looks ahead
STEPS = [(p, shift - p) for shift in range(1, LOOK + 1) for p in range(shift + 1)]
WORDS_LESS = 0.1  # by which the share of words that stay may be less than that of characters
BATCH_BYTES = 1 << 20
SALTS, MOST_HOT = 8, 1000
DISTANCE, LEAST = 16, 0.8


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def normalised(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(normalised line, number of its text, number in its text) of every line of the texts; null and empty ones have none."""
    rows = [i for i, t in enumerate(texts) if t]
    if not rows:
        return [], np.empty(0, np.int64), np.empty(0, np.int64)
    plain = "\n".join([texts[i] for i in rows]).lower().encode("utf-8", "surrogatepass").translate(PLAIN)
    raw = np.frombuffer(plain, np.uint8)
    word = raw > 32
    first = np.flatnonzero(word & ~np.r_[False, word[:-1]])
    feeds = np.flatnonzero(raw == 10)
    line = np.searchsorted(feeds, first)
    keep = word
    keep[feeds] = True
    keep[first[1:][line[1:] == line[:-1]] - 1] = True  # one space between two words of a line
    counts = np.array([texts[i].count("\n") + 1 for i in rows])
    numbers = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return raw[keep].tobytes().split(b"\n"), np.repeat(rows, counts), numbers


def tokens(line: str) -> list[bytes]:
    return normalised([line])[0][0].split() if line else []


def line_hashes(lines: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x, 7) for x in lines), np.uint64, len(lines)).view(np.int64)


def text_lines(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """normalised and line_hashes of the lines that are not blank.  A line that normalises to nothing is told by its own
    characters, less the white space around them."""
    lines, rows, numbers = normalised(texts)
    hashes, blank = line_hashes(lines), []
    for i in [i for i, x in enumerate(lines) if not x]:
        own = texts[rows[i]].split("\n", numbers[i] + 1)[numbers[i]].strip()
        blank += [] if own else [i]
        hashes[i] = signed(xxhash.xxh64_intdigest(own.encode("utf-8", "surrogatepass"), 13))
    stays = np.ones(len(lines), bool)
    stays[blank] = False
    return ([x for x, s in zip(lines, stays.tolist()) if s] if blank else lines), hashes[stays], rows[stays], numbers[stays]


def chars_of(line: bytes) -> int:
    return len(line) if line.isascii() else len(line.decode("utf-8", "replace"))


def fuzzy(line: bytes, least_words: int) -> bool:
    """Whether a line is compared with others that are not equal: not if it is short in words and in characters."""
    return len(line) > LEAST_CHARS and chars_of(line) >= LEAST_CHARS or line.count(b" ") + 1 >= least_words and line != b""


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def by_chars(line: bytes) -> bool:
    words = line.count(b" ") + 1
    return words < FEW_WORDS or len(line) > LONG_WORD * words and chars_of(line) > LONG_WORD * words


def segments(line: bytes) -> Iterator[bytes]:
    """A long line in parts of at most SEGMENT bytes, cut at a space where there is one, else between characters."""
    while len(line) > SEGMENT:
        at = line.rfind(b" ", SEGMENT // 2, SEGMENT)
        if at < 0:
            at = SEGMENT
            while line[at] & 0xC0 == 0x80:
                at -= 1
        yield line[:at]
        line = line[at:].lstrip(b" ")
    yield line


def units(lines: list[bytes], chars: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all units in order, number of units of each line) of lines of SEGMENT bytes in all, or one line."""
    raw = np.frombuffer(b"\n".join(lines) + b"\n" * (CHARS + 1), np.uint8)
    sums = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * POWERS[: len(raw)], dtype=np.uint64)]
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    if chars:
        at = np.flatnonzero((raw[: ends[-1]] & 0xC0 != 0x80) & (raw[: ends[-1]] != 10))
        line = np.searchsorted(ends, at, side="right")
        counts = np.bincount(line, minlength=len(lines))
        last = np.cumsum(counts)
        to = np.r_[at, np.full(CHARS, ends[-1])][np.minimum(np.arange(len(at)) + CHARS, len(at))]
        inside = np.arange(len(at)) + CHARS < last[line]
        to = np.where(inside, to, ends[line])
        keep = (np.arange(len(at)) + CHARS <= last[line]) | (np.arange(len(at)) == (last - counts)[line])
        start, stop, line = at[keep], to[keep], line[keep]
    else:
        word = raw[: ends[-1]] > 32
        start = np.flatnonzero(word & ~np.r_[False, word[:-1]])
        stop = np.flatnonzero(word & ~np.r_[word[1:], False]) + 1
        line = np.searchsorted(begins, start, side="right") - 1
    return mixed((sums[stop] - sums[start]) * INVERSES[start]), np.bincount(line, minlength=len(lines))


def ones(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many units of each line have each of the 64 bits set."""
    runs = -(-sizes // RUN)
    first = np.r_[0, np.cumsum(runs)[:-1]]
    starts = np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], runs) + RUN * (np.arange(runs.sum()) - np.repeat(first, runs))
    counts = np.add.reduceat(SPREAD[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)], starts, axis=0).view(np.uint8)
    return counts.astype(np.int32) if len(counts) == len(sizes) else np.add.reduceat(counts, first, axis=0, dtype=np.int32)


def minima(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The least hash by each of BANDS * ROWS functions of the pairs of neighbouring units of each line."""
    ends = np.cumsum(sizes)
    pairs = mixed(hashes * np.uint64(0xD6E8FEB86659FD93) + np.r_[hashes[1:], np.uint64(0)])
    pairs[ends - 1] = hashes[ends - 1]
    out = np.empty((len(sizes), len(ODD)), np.uint32)
    for i, odd in enumerate(ODD):
        out[:, i] = np.minimum.reduceat((pairs * odd >> np.uint64(32)).astype(np.uint32), ends - sizes)
    return out


def summary(some: list[bytes], chars: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set bits, units, minima) of each of some lines."""
    hashes, sizes = units(some, chars)
    return ones(hashes, sizes), sizes, minima(hashes, sizes)


def prints(bits: np.ndarray, sizes: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(SimHash, keys of the bands) of lines by their summary."""
    key = np.zeros((len(sizes), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mixed(key * np.uint64(31) + least[:, r::ROWS])
    return np.packbits(bits * 2 > sizes[:, None], axis=1, bitorder="little").view("<i8")[:, 0], (key >> np.uint64(32)).astype(np.uint32).view(np.int32)


def features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(SimHash, keys of the bands) of lines that are not empty, about SEGMENT bytes of them at a time."""
    sims, keys = np.empty(len(lines), np.int64), np.empty((len(lines), BANDS), np.int32)
    for chars in (False, True):
        some: list[int] = []
        size = 0
        for i in [i for i, line in enumerate(lines) if by_chars(line) == chars] + [-1]:
            if some and (i < 0 or size + len(lines[i]) > SEGMENT):
                sims[some], keys[some] = prints(*summary([lines[j] for j in some], chars))
                some, size = [], 0
            if i >= 0 and len(lines[i]) >= SEGMENT:
                bits, sizes, least = zip(*(summary([x], chars) for x in segments(lines[i])))
                sims[i], keys[i] = (x[0] for x in prints(sum(bits), sum(sizes), np.minimum.reduce(least)))
            elif i >= 0:
                some.append(i)
                size += len(lines[i]) + 1
    return sims, keys


def block_keys(sim: Column) -> Column:
    """The keys of the blocks of a SimHash, which are above those of the bands."""
    width = 64 // BLOCKS
    parts = [F.shiftrightunsigned(sim, width * i).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(BANDS + 1 + i << 32) for i in range(BLOCKS)]
    return F.array(*parts)


def close_rows(s: np.ndarray, run: np.ndarray, most: int) -> np.ndarray:
    """Which SimHashes have another one in their run, equal numbers that follow each other, at most so many bits apart; all
    of a run over MOST_MARKED."""
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]][: len(run)])
    sizes = np.diff(np.r_[starts, len(run)])
    ends, out = np.repeat(starts + sizes, sizes), np.repeat(sizes > MOST_MARKED, sizes)
    i = np.flatnonzero(~out)
    for d in range(1, MOST_MARKED):
        i = i[i + d < ends[i]]
        if not len(i):
            break
        near = i[np.bitwise_count(s[i] ^ s[i + d]) <= most]
        out[near] = out[near + d] = True
    return out


def close_in_blocks(s: np.ndarray, key: np.ndarray) -> np.ndarray:
    """close_rows of fewer than BLOCKS bits in the buckets of blocks, whose other bits are cut into BLOCKS parts in turn: only
    SimHashes that agree in one of these too are compared, so that a large bucket is not compared with itself."""
    out, width = np.zeros(len(s), bool), 64 // BLOCKS
    part = (64 - width) // BLOCKS
    turn = ((key >> 32) - BANDS).astype(np.uint64) * np.uint64(width)  # after the block, around to it
    rest = np.where(turn < 64, s >> (turn & np.uint64(63)) | s << (np.uint64(64) - turn & np.uint64(63)), s)
    bucket = np.cumsum(np.r_[True, key[1:] != key[:-1]][: len(key)])
    for i in range(BLOCKS):
        run = bucket << part | (rest >> np.uint64(part * i) & np.uint64((1 << part) - 1)).astype(np.int64)
        order = np.argsort(run, kind="stable")
        out[order] |= close_rows(s[order], run[order], BLOCKS - 1)
    return out


def close_sets(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, sim, size) of the SimHashes that chains of at most `distance` bits, or fewer than BLOCKS in a block, join in a
    bucket of rows (key, sim), which come sorted.  The new key stands for the set of them, so that a set that meets in
    several buckets is verified once."""
    for table in whole_groups(batches):
        key, sim = (table.column(i).to_numpy() for i in range(2))
        new = np.r_[True, (key[1:] != key[:-1]) | (sim[1:] != sim[:-1])]
        key, s = key[new], sim[new].view(np.uint64)
        block = key >= BANDS + 1 << 32
        close = np.empty(len(key), bool)
        close[~block], close[block] = close_rows(s[~block], key[~block], distance), close_in_blocks(s[block], key[block])
        key, s, most = key[close], s[close], np.where(block[close], min(BLOCKS - 1, distance), distance)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        sizes = np.diff(np.r_[starts, len(key)])
        sets: list[list[int]] = [[i, i + 1] for i in starts[sizes == 2].tolist() if (int(s[i]) ^ int(s[i + 1])).bit_count() <= most[i]]
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            rest = np.arange(start, start + size)
            while len(rest) > 1:
                members, queue, rest = [rest[0]], [rest[0]], rest[1:]
                while queue and len(rest):
                    near = np.bitwise_count(s[rest] ^ s[queue.pop()]) <= most[start]
                    if near.any():
                        found = rest[near].tolist()
                        members += found
                        queue += found
                        rest = rest[~near]
                if len(members) > 1:
                    sets.append(members)
        at = [np.sort(s[x]) for x in sets]
        keys = [signed(xxhash.xxh64_intdigest(x.tobytes(), 5)) for x in at]
        flat = np.concatenate(at) if at else np.empty(0, np.uint64)
        many = np.array([len(x) for x in at], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(keys, np.int64), many)), pa.array(flat.view(np.int64)), pa.array(np.repeat(many, many))], ["key", "sim", "size"])


def widest(sets: DataFrame) -> DataFrame:
    """Rows (key, sim) of the sets (key, sim, size) less those within another: all of whose members have it as their largest."""
    return dealt(sets).select("key", "sim")


def dealt(sets: DataFrame) -> DataFrame:
    """Rows (key, sim, place) of the widest of the sets (key, sim, size).  Sets that overlap the same large set have it as
    their place, where their common pairs are compared once; sets of a place with too many rows have one each."""
    home = sets.groupBy("sim").agg(F.max(F.struct("size", "key")).alias("home"))
    homes = sets.join(home, "sim").groupBy("key").agg(F.min("home").alias("low"), F.max("home").alias("high"), F.count("*").alias("n"))
    wide = cut(homes.where("low <> high or high.key = key").select("key", F.col("high.key").alias("place"), "n"))
    full = wide.groupBy("place").agg(F.sum("n").alias("n")).where(F.col("n") > MOST_TOGETHER).select("place", F.lit(True).alias("full"))
    places = wide.join(full, "place", "left").select("key", F.when(F.col("full"), F.col("key")).otherwise(F.col("place")).alias("place"))
    return sets.join(places, "key").select("key", "sim", "place")


def verified_links(batches: Iterator[pa.RecordBatch], distance: int, least: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of line hashes among rows (place, h, sim, keys, text) sorted by place; keys names the sets that a line is
    in.  What comes out joins the same lines as all similar pairs within the sets do."""
    for table in whole_groups(batches):
        place, h, sim = (table.column(i).to_numpy() for i in range(3))
        texts, keys = table.column(4).to_pylist(), table.column(3).combine_chunks()
        s, marks = sim.view(np.uint64), Marks(texts)
        rows, key = np.repeat(np.arange(len(h)), pc.list_value_length(keys).to_numpy()), keys.flatten().to_numpy()
        order = np.lexsort((key, place[rows]))
        rows, key = rows[order], key[order]
        new = np.r_[True, place[rows[1:]] != place[rows[:-1]]]
        starts = np.flatnonzero(new | np.r_[True, key[1:] != key[:-1]])
        links: list[tuple[int, int]] = []
        label, groups = np.arange(len(h)), {}
        apart: set[int] = set()
        for start, end in zip(starts.tolist(), np.r_[starts[1:], len(rows)].tolist()):
            if new[start]:
                apart.clear()
            links += [(h[a], h[b]) for a, b in search(rows[start:end], s, marks, label, groups, apart, distance, least)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])


class Marks:
    """Lines and what rules out, for many at once, that they are similar to another; never lines that `alike` takes."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.words, self.distinct = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        self.bits = np.zeros((len(texts), MARK_BITS // 8), np.uint8)

    def read(self, rows: np.ndarray) -> None:
        """Marks the words of rows for may_share; those that are marked already stay."""
        for i in rows[self.words[rows] == 0].tolist():
            _, words, distinct = parted(self.texts[i])
            self.words[i], self.distinct[i] = len(words), len(distinct)
            at = np.fromiter(map(hash, distinct), np.int64, len(distinct)) & (MARK_BITS - 1)
            set_bits = np.zeros(MARK_BITS, bool)
            set_bits[at] = True
            self.bits[i] = np.packbits(set_bits)

    def may_share(self, here: int, rows: np.ndarray, least: float) -> np.ndarray:
        """Which of rows may have enough distinct words of row `here`: a mark that a row lacks is at least one word less."""
        words = np.maximum(self.words[rows], self.words[here])
        few = (np.minimum(self.words[rows], self.words[here]) < FEW_WORDS) | (np.maximum(self.sizes[rows], self.sizes[here]) > LONG_WORD * words)
        marks = self.bits.view(np.uint64)
        most = self.distinct[here] - np.bitwise_count(marks[here] & ~marks[rows]).sum(axis=1, dtype=np.int64)
        return few | (most >= (least - WORDS_LESS) * self.distinct[here] * self.words[rows] / words - 1)


def search(rest: np.ndarray, s: np.ndarray, marks: Marks, label: np.ndarray, groups: dict[int, list[int]], apart: set[int], distance: int, least: float) -> Iterator[tuple[int, int]]:
    """Pairs that join rows `rest` as all their similar pairs do.  The set is searched outwards.  Rows of equal label, which
    groups lists where there are more than one, are joined already; of the rows in apart (a * number of rows + b, a < b), in
    another set of the place, it is known that they are not similar."""
    texts, sizes, large = marks.texts, marks.sizes, len(rest) > FEW_ROWS
    if large:
        marks.read(rest)
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            here = queue.pop()
            most = (np.maximum(sizes[rest], sizes[here]) * (1 - least) + 1e-9).astype(np.int64)
            near = (np.bitwise_count(s[rest] ^ s[here]) <= distance) & (abs(sizes[rest] - sizes[here]) <= most) & (label[rest] != label[here])
            parts, others = parted(texts[here]), rest[near]
            for i in (others[marks.may_share(here, others, least)] if large else others).tolist():
                pair = min(here, i) * len(texts) + max(here, i)
                if label[i] == label[here] or pair in apart:
                    continue
                if not alike(parts, parted(texts[i]), least):
                    if len(apart) >= MOST_APART:
                        apart.clear()
                    apart.add(pair)
                    continue
                yield here, i
                less, more = sorted((groups.pop(int(label[x]), [x]) for x in (here, i)), key=len)
                label[less] = label[more[0]]
                groups[int(label[more[0]])] = more
                more += less
            joined = label[rest] == label[here]
            queue += rest[joined].tolist()
            rest = rest[~joined]


def edit_distance(a: str | list[str], b: str | list[str], most: int) -> int:
    """Levenshtein distance in characters, or of lists in words, or most + 1 if it is larger; bit-parallel, common ends cut off first."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    start, end = 0, 0
    short = min(len(a), len(b))
    while start < short and a[start] == b[start]:
        start += 1
    while end < short - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return min(most + 1, len(a) + len(b))
    full = (1 << len(a)) - 1
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    up, down = full, 0  # the rises and falls down a column
    for i, match in enumerate(map(at.get, b, repeat(0))):
        diagonal = (((match & up) + up) ^ up) | match | down
        plus = down | ~(diagonal | up) & full
        plus = (plus << 1 | 1) & full
        up, down = (diagonal & up) << 1 & full | ~(diagonal | plus) & full, plus & diagonal
        if i % 32 == 31 and 2 * (i + 1) + up.bit_count() - down.bit_count() - len(b) > most:
            return most + 1
    return min(most + 1, len(b) + up.bit_count() - down.bit_count())


def aligned_cost(a: list[str], b: list[str], most: int) -> int:
    """An upper bound of the edit distance of two lines of words, from one alignment of them; over `most`, any number
    over it.  Where words differ, the nearest equal pair among the next LOOK words on both sides goes on."""
    i = j = cost = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        for p, q in STEPS:
            if i + p < len(a) and j + q < len(b) and a[i + p] == b[j + q]:
                break
        else:
            p = q = 1
        cost += max(p + sum(map(len, a[i : i + p])), q + sum(map(len, b[j : j + q])))
        if cost > most:
            return cost
        i, j = i + p, j + q
    rest = a[i:] or b[j:]
    return cost + len(rest) + sum(map(len, rest))


def parted(line: str) -> tuple[str, list[str], set[str]]:
    words = line.split(" ")
    return line, words, set(words)


def similar(a: str, b: str, least: float) -> bool:
    return alike(parted(a), parted(b), least)


def alike(one: tuple[str, list[str], set[str]], other: tuple[str, list[str], set[str]], least: float) -> bool:
    """Whether 1 - edit distance / length of the longer is at least `least`.  An alignment that costs no more decides
    first; where it costs more, the edit distance does.  Lines of FEW_WORDS and more ordinary words have no such
    similarity if by words, distinct or in order, they are less than `least` - WORDS_LESS alike."""
    (a, p, distinct), (b, q, _) = one, other
    longer = max(len(a), len(b))
    most = int(longer * (1 - least) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    words = max(len(p), len(q))
    few = min(len(p), len(q)) < FEW_WORDS or longer > LONG_WORD * words
    if not few and len(distinct.intersection(q)) < (least - WORDS_LESS) * len(distinct) * len(q) / words - 1:
        return False
    if aligned_cost(p, q, most) <= most:
        return True
    apart = int(words * (1 - least + WORDS_LESS) + 1e-9)
    if not few and edit_distance(p, q, apart) > apart:
        return False
    return edit_distance(a, b, most) <= most


def bitmap(hashes: DataFrame) -> bytes:
    """A bitmap of 2^FILTER_BITS bits with those set that the low bits of a hash in column h name."""
    slot = F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    rows = hashes.select(F.shiftright(slot, 15).alias("part"), slot.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = bytearray(1 << (FILTER_BITS - 3))
    for r in rows.collect():
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = r["bits"]
    return bytes(out)


def line_groups(docs: DataFrame, distance: int = DISTANCE, least: float = LEAST, least_words: int = 4) -> tuple[DataFrame, DataFrame]:
    """(lines, kept) of docs (doc_id, text, print): lines has h, doc_id, print and line_no of every line that is not
    blank; kept has, for each h, the occurrence that stays of its group, as a struct, the group, and n, the lines of h."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches, BATCH_BYTES):
            lines, hashes, rows, numbers = text_lines(batch.column(1).to_pylist())
            new = []
            for i, (h, line) in enumerate(zip(hashes.tolist(), lines)):
                if h not in seen and fuzzy(line, least_words):  # features of the lines that this worker meets first
                    seen.add(h)
                    new.append(i)
            if len(seen) > 200_000:
                seen.clear()
            sims, bands = features([lines[i] for i in new])
            at = np.full(len(lines), -1)
            at[new] = np.arange(len(new))
            take, rows = pa.array(at, pa.int64(), mask=at < 0), pa.array(rows, pa.int64())
            bands = pa.FixedSizeListArray.from_arrays(pa.array(bands.reshape(-1)), BANDS).cast(pa.list_(pa.int32()))
            columns = [pa.array(hashes, pa.int64()), pa.array(sims).take(take), bands.take(take), batch.column(0).take(rows), batch.column(2).take(rows), pa.array(numbers, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["h", "sim", "bands", "doc_id", "print", "line_no"])

    lines = cut(map_batches(docs.select("doc_id", "text", "print"), scan, "h bigint, sim bigint, bands array<int>, doc_id bigint, print bigint, line_no int"))
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "print", "line_no")
    distinct = cut(lines.groupBy("h").agg(F.min(place).alias("first"), F.max("sim").alias("sim"), F.count("*").alias("n")))
    banded = lines.where("bands is not null").select("sim", F.posexplode("bands").alias("band", "key"))
    keyed = banded.select((F.col("band") * F.lit(1 << 32) + F.col("key")).alias("key"), "sim")
    blocked = distinct.where("sim is not null").select("sim").distinct().select(F.explode(block_keys(F.col("sim"))).alias("key"), "sim")
    keyed = keyed.union(blocked).repartition("key").sortWithinPartitions("key", "sim")
    shared = distinct.where("sim is not null").groupBy("sim").agg(F.count("*").alias("m")).where("m > 1").select(F.xxhash64("sim").alias("key"), "sim", F.lit(1).cast("bigint").alias("size"))
    meet = dealt(cut(map_batches(keyed, lambda b: close_sets(b, distance), "key bigint, sim bigint, size bigint").union(shared).distinct()))
    active = cut(distinct.join(meet, "sim").groupBy("place", "h", "sim").agg(F.collect_list("key").alias("keys")))
    wanted = np.frombuffer(bitmap(active), np.uint8)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches, BATCH_BYTES):
            found: dict[int, str] = {}
            lines = [x for x in normalised(batch.column(0).to_pylist())[0] if x]
            hashes = line_hashes(lines)
            slot = hashes & ((1 << FILTER_BITS) - 1)
            for i in np.flatnonzero(wanted[slot >> 3] >> (slot & 7) & 1).tolist():
                h = int(hashes[i])
                if h not in seen and fuzzy(lines[i], least_words):
                    found[h] = lines[i].decode("utf-8", "replace")
                    seen.add(h)
            if len(seen) > 200_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], ["h", "line"])

    texts = map_batches(docs.select("text"), fetch, "h bigint, line string")
    texts = texts.join(active.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.first("line").alias("line"))
    meeting = active.join(texts, "h").select("place", "h", "sim", "keys", "line").repartition("place").sortWithinPartitions("place")
    links = map_batches(meeting, lambda b: verified_links(b, distance, least), "a bigint, b bigint")
    parts = connected_components(links).withColumnRenamed("node", "h")
    salt = F.pmod("h", F.lit(SALTS)).alias("salt")  # a group of very many lines is dealt to SALTS tasks
    grouped = cut(distinct.join(parts, "h").select("h", "component", salt, "first"))
    firsts = grouped.groupBy("component", "salt").agg(F.min("first").alias("first")).groupBy("component").agg(F.min("first").alias("stays"))
    moved = grouped.join(firsts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))), ["component", "salt"]).select("h", "component", "stays")
    kept = distinct.join(moved, "h", "left").select("h", F.coalesce("component", "h").alias("group"), F.coalesce("stays", "first").alias("stays"), "n")
    return lines.drop("sim", "bands"), cut(kept)


def spread_join(lines: DataFrame, kept: DataFrame) -> DataFrame:
    """lines joined with kept by h; the lines of an h with more than a MOST_HOT-th of all meet it by broadcast, not in one task."""
    total = kept.agg(F.sum("n")).first()[0] or 0
    hot = kept.where(F.col("n") * MOST_HOT > total)  # fewer than MOST_HOT rows, whatever the corpus
    is_hot = F.col("h").isin([r["h"] for r in hot.select("h").collect()])
    return lines.where(is_hot).join(F.broadcast(hot), "h").unionByName(lines.where(~is_hot).join(kept, "h"))


def dedup_lines(docs: DataFrame, distance: int = DISTANCE, least: float = LEAST, least_words: int = 4) -> DataFrame:
    """docs with text less the lines that repeat, and n_lines and dropped (numbers of the dropped lines, ascending).

    Lines are parted by \\n.  Of each group of lines that links of at least `least` edit similarity and at most `distance`
    SimHash bits join, the occurrence with the smallest (doc_id, hash of the text, line number) stays.  Every line that
    is not blank takes part; one of fewer than `least_words` words and LEAST_CHARS characters is joined only with its
    equals after normalisation, or as it is if that leaves nothing.  Rows with equal doc_id and text count as one
    document and keep the same lines; a null doc_id comes after all others; a null text stays null.  The columns
    n_lines and dropped of docs, if it has them, are replaced; an empty table gives an empty result.

    Scale: texts are scanned twice without a shuffle and shuffled once, to meet their dropped lines; a line costs 36
    bytes, a distinct line BANDS + BLOCKS keys of 16 bytes.  What is broadcast is a bitmap of fixed size and MOST_HOT rows.
    """
    return without_lines(docs.select(*[c for c in docs.columns if c not in ("n_lines", "dropped")]), "n_lines", "dropped", distance, least, least_words)


def without_lines(docs: DataFrame, n_lines: str, dropped: str, distance: int, least: float, least_words: int) -> DataFrame:
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("print"))
    lines, kept = line_groups(plain, distance, least, least_words)
    own, mark = fresh([*docs.columns, n_lines, dropped], "id", "print")
    here = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "print", "line_no")
    gone = spread_join(lines, kept).where(here != F.col("stays")).groupBy(F.col("doc_id").alias(own), F.col("print").alias(mark)).agg(F.array_sort(F.collect_set("line_no")).alias(dropped))
    same = (F.xxhash64("text") == F.col(mark)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(own))
    out = docs.join(gone, same, "left").drop(own, mark)
    out = out.withColumns({n_lines: F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)), dropped: F.coalesce(dropped, F.array().cast("array<int>"))})
    # the lines between two dropped ones, slice by slice: linear in the lines however many are dropped
    given = F.split("text", "\n", -1)

    def between(x: Column, edges: Column) -> Column:
        def gap(i: Column) -> Column:
            return F.slice(x, F.get(edges, i) + 2, F.get(edges, i + 1) - F.get(edges, i) - 1)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(edges) - 2), gap))

    kept_lines = let(given, lambda x: let(F.concat(F.array(F.lit(-1)), F.col(dropped), F.array(F.size(x))), lambda edges: between(x, edges)))
    return out.withColumn("text", F.when(F.size(dropped) > 0, F.array_join(kept_lines, "\n")).otherwise(F.col("text")))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs, columns unchanged, without repeated lines and with n_chars counted anew; a document all of whose lines
    repeat others goes.  Null and empty texts, and rows with a null doc_id, stay; columns of any name are kept as they are."""
    n_lines, dropped = fresh(docs.columns, "n_lines", "dropped")
    found = without_lines(docs, n_lines, dropped, DISTANCE, LEAST, 4)
    lost = (F.size(dropped) > 0) & (F.length(F.trim("text")) == 0)
    out = found.where(~F.coalesce(lost, F.lit(False)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size(dropped) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", F.col("n_lines").cast("bigint").alias("n_lines"), F.size("dropped").cast("bigint").alias("n_dropped"), F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"))
