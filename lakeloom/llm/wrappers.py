"""HTML main-text extraction with wrappers: union-free regular expressions inferred from the pages of a host.

A page is read as a stream of tags and texts, balanced into nested groups.  Runs of like siblings fold into repeated
groups (+); aligning the streams of two pages turns what only one of them has into optional groups (?) and texts into
slots (#), so that all the pages of a host end up as one expression, its wrapper.  The wrapper tells template text (a
slot that every page has exactly once, with the same text) and the group that carries what varies of the host's text.
The main text of a page is what that group holds besides template text and what HTML itself marks as menus, forms,
adverts and so on; where the host has too few pages for a wrapper, what its article holds.

Pages are reduced to distinct streams of a host before anything is gathered, and streams are aligned one after the
other from sorted rows, so a task holds one wrapper at a time whatever the size of the host.
"""

from __future__ import annotations

import html as html_refs
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_batches
from .reputation import host_of

#: Elements that start and end a block of text; all others are part of the text around them.
BLOCKS = frozenset(
    "address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup label li main menu nav ol option p pre section select summary table tbody td tfoot th "
    "thead tr ul".split()
)
BREAKS = frozenset(["br", "hr"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open one of these ends where any block starts.
SHORT = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: An open element that the start of another one of its kind ends, up to the list or table around both.
SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}
LISTS = frozenset("ul ol menu dl table select".split())
#: Elements, roles and words of class or id that are not main text.
CHROME = frozenset("nav header footer aside form button select dialog menu label fieldset".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended share sharing social comment "
    "comments reply replies respond disqus cookie cookies consent gdpr notice alert popup modal overlay newsletter "
    "subscribe signup login search pagination pager toolbar".split()
)
#: Elements whose content is no markup and no text.
RAW = "script|style|noscript|template|textarea|title|svg|iframe|object|math|canvas|audio|video"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:{RAW})\b[^>]*+(?:/>|>.*?(?:</(?:{RAW})\s*>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD = re.compile(r"[a-z]+")
DIGITS = re.compile(r"[0-9]+")
DEEPEST = 100  # levels of a page that streams and paths tell apart; what lies deeper belongs to the group at that level
LONGEST_UNIT = 24  # siblings in the unit of a repeated group; a longer unit stays as it is

Node = tuple  # (signature, least, most, children): least 0 or 1, most 1 or 2 for any number; "#" is a text slot, "" a group


class Page:
    """Blocks (path, text, in_article, in_main) of a page in order and, where asked for, its folded stream of tags."""

    def __init__(self, source: str | None, stream: bool = False):
        self.blocks: list[tuple[str, str, bool, bool]] = []
        self.stack: list[tuple[str, str, bool, list]] = [("", "", False, [])]  # name, path, dropped, children
        self.kept: list[str] = []
        self.open: Counter[str] = Counter()
        self.stream = stream
        source, at = source or "", 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            name = m.group(2) or m.group(5)
            if name:
                self._tag(name.lower(), m.group(1) or m.group(4), m.group(3) or m.group(6) or "")
        self._text(source[at:])
        while len(self.stack) > 1:
            self._pop()
        self._flush()
        self.tree = fold(self.stack[0][3]) if stream else ()

    def _text(self, data: str) -> None:
        if not self.stack[-1][2]:
            self.kept.append(data)

    def _flush(self) -> None:
        if not self.kept:
            return
        text = " ".join(html_refs.unescape("".join(self.kept)).split())
        self.kept = []
        if text:
            self.blocks.append((self.stack[-1][1], text, self.open["article"] > 0, self.open["main"] > 0))
            if self.stream:
                self.stack[-1][3].append(("#", 1, 1, ()))

    def _pop(self) -> None:
        name, path, dropped, children = self.stack[-1]
        if name in BLOCKS or name == "head":
            self._flush()
        self.stack.pop()
        self.open[name] -= 1
        if self.stream and not dropped and name in BLOCKS and len(self.stack) > DEEPEST:
            self.stack[-1][3].extend(children)
        elif self.stream and not dropped and name in BLOCKS:
            self.stack[-1][3].append((path.rsplit("/", 1)[-1], 1, 1, fold(children)))

    def _tag(self, name: str, end: str, attributes: str) -> None:
        stack = self.stack
        if name in BREAKS:
            self.kept.append(" ")
        if name in ("html", "body"):
            if not end and name == "body" and len(stack) > 1:
                while len(stack) > 1:
                    self._pop()
            return
        if end:
            if self.open[name] > 0:
                while stack[-1][0] != name:
                    self._pop()
                self._pop()
            elif name in BLOCKS:
                self._flush()
            return
        block = name in BLOCKS
        if block:
            while stack[-1][0] in SHORT or len(stack) > 1 and stack[-1][0] not in BLOCKS and stack[-1][0] != "head":
                self._pop()
            if name in SIBLINGS:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in SIBLINGS[name]:
                        while len(stack) > i:
                            self._pop()
                        break
                    if stack[i][0] in LISTS:
                        break
            self._flush()
        if name in VOID or attributes.endswith("/") and not block:
            return
        signature, chrome = describe(name, attributes)
        parent = stack[-1]
        if block or name == "head":
            path = f"{parent[1]}/{signature}" if len(stack) <= DEEPEST else parent[1]
            stack.append((name, path, parent[2] or chrome or name == "head", []))
            self.open[name] += 1
        elif chrome and not parent[2]:
            stack.append((name, parent[1], True, parent[3]))
            self.open[name] += 1


def describe(name: str, attributes: str) -> tuple[str, bool]:
    """Signature of a tag (name, class and id, numbers as 0) and whether it is chrome by itself."""
    if not attributes or attributes.isspace():
        return name, name in CHROME
    marks, chrome = [name], name in CHROME
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            if value:
                marks.append(("." if key == "class" else "#") + ".".join(DIGITS.sub("0", value).replace("/", "").split()))
                chrome = chrome or name not in ("article", "main") and not CHROME_WORDS.isdisjoint(WORD.findall(value))
                chrome = chrome or name == "article" and not {"comment", "ad", "related"}.isdisjoint(WORD.findall(value))
        elif key == "role":
            chrome = chrome or value in CHROME_ROLES
        elif key == "style":
            chrome = chrome or "display:none" in value.replace(" ", "")
        elif key == "hidden":
            chrome = chrome or value != "until-found"
        else:
            chrome = chrome or value == "true"
    return "".join(marks), chrome


def sign(node: Node) -> str:
    return node[0] or "(%s)" % " ".join(map(sign, node[3]))


def merge(a: Node, b: Node) -> Node:
    """The expression of both of two nodes with the same signature."""
    return a if a == b else (a[0], min(a[1], b[1]), max(a[2], b[2]), align(a[3], b[3]))


def fold(nodes) -> tuple:
    """Siblings with runs of like ones folded into repeated groups."""
    out: list[Node] = []
    for node in nodes:
        out.append(node)
        settled = False
        while not settled:
            settled = True
            if len(out) > 1 and sign(out[-2]) == sign(out[-1]):
                b, a = out.pop(), out.pop()
                both = merge(a, b)
                out.append((both[0], both[1], 1 if both[0] == "#" else 2, both[3]))
                break
            if len(out) > 1 and not out[-2][0] and sign(out[-2][3][-1]) == sign(out[-1]):
                b, group = out.pop(), out.pop()
                last = merge(group[3][-1], b)
                out.append((*group[:3], (*group[3][:-1], (*last[:2], 2, last[3]))))
                break
            for n in range(2, min(LONGEST_UNIT, len(out) - 1) + 1):
                if sign(out[-1]) not in (sign(out[-1 - n]), sign(out[-1 - n][3][-1]) if not out[-1 - n][0] else None):
                    continue
                unit = tuple(out[-n:])
                before = out[-n - 1]
                if not before[0] and list(map(sign, before[3])) == list(map(sign, unit)):
                    out[-n - 1 :] = [("", before[1], 2, tuple(map(merge, before[3], unit)))]
                elif len(out) >= 2 * n and list(map(sign, out[-2 * n : -n])) == list(map(sign, unit)):
                    out[-2 * n :] = [("", 1, 2, tuple(map(merge, out[-2 * n : -n], unit)))]
                else:
                    continue
                settled = False
                break
    return tuple(out)


def align(a: tuple, b: tuple) -> tuple:
    """One expression for two lists of siblings: what both have in order is merged, the rest becomes optional."""
    if a == b:
        return a
    out: list[Node] = []
    for op, i, j, k, m in SequenceMatcher(None, list(map(sign, a)), list(map(sign, b)), autojunk=False).get_opcodes():
        if op == "equal":
            out += map(merge, a[i:j], b[k:m])
        else:
            out += [(n[0], 0, *n[2:]) for n in (*a[i:j], *b[k:m])]
    return fold(out)


def expression(nodes: tuple) -> str:
    """A wrapper as text: tags with their content in braces, groups in parentheses, ? + * as usual, # for a text slot."""
    out = []
    for name, least, most, children in nodes:
        inner = expression(children)
        body = "#" if name == "#" else f"<{name}>{{{inner}}}" if name else f"({inner})"
        out.append(body + {(1, 1): "", (0, 1): "?", (1, 2): "+", (0, 2): "*"}[least, most])
    return "".join(out)


def frozen(nodes) -> tuple:
    return tuple((n[0], n[1], n[2], frozen(n[3])) for n in nodes)


def fixed_paths(nodes: tuple, prefix: str = "") -> Iterator[str]:
    """Paths of the slots that every page has exactly once."""
    seen = [n[0] for n in nodes]
    for name, least, most, children in nodes:
        if name == "#":
            if least and most == 1 and seen.count("#") == 1:
                yield prefix
        elif name and least and most == 1 and seen.count(name) == 1:
            yield from fixed_paths(children, f"{prefix}/{name}")


STREAM, SLOT, BRANCH = 0, 1, 2
EVIDENCE = "host string, kind int, key string, n bigint, mass bigint, low bigint, high bigint"
EVIDENCE_ARROW = pa.schema(
    [("host", pa.string()), ("kind", pa.int32()), ("key", pa.string()), ("n", pa.int64()), ("mass", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]
)
NAMES = ["host", "kind", "key", "n", "mass", "low", "high"]


def rows_of(found: list[tuple]) -> pa.RecordBatch:
    columns = zip(*found) if found else [[] for _ in NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, EVIDENCE_ARROW)], schema=EVIDENCE_ARROW)


def branches_of(path: str) -> list[str]:
    """The branches that hold a text: from the page to the group around its block, not the block itself."""
    parts = path.split("/")[:-1] if path else [""]
    return ["/".join(parts[:i]) for i in range(1, len(parts) + 1)]


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Evidence of pages (host, html): streams, texts of slots, and how much text each branch holds; summed by batch."""
    for batch in batches:
        seen: dict[tuple, list[int]] = {}

        def add(host: str, kind: int, key: str, mass: int, h: int) -> None:
            held = seen.get((host, kind, key))
            if held is None:
                seen[host, kind, key] = [1, mass, h, h]
            else:
                held[0] += 1
                held[1] += mass
                held[2], held[3] = min(held[2], h), max(held[3], h)

        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.string()).to_pylist()):
            page = Page(source, stream=True)
            if not page.blocks:
                continue
            add(host, STREAM, json.dumps(page.tree, ensure_ascii=False, separators=(",", ":")), 0, 0)
            slots: dict[str, list[str]] = {}
            for path, text, _, _ in page.blocks:
                slots.setdefault(path, []).append(text)
            branches: dict[str, int] = {}
            for path, texts in slots.items():
                mass = sum(map(len, texts))
                add(host, SLOT, path, mass, xxhash.xxh64_intdigest("\0".join(texts)) >> 1)
                for branch in branches_of(path):
                    branches[branch] = branches.get(branch, 0) + mass
            for branch, mass in branches.items():
                add(host, BRANCH, branch, mass, 0)
        yield rows_of([(*key, *held) for key, held in seen.items()])


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Align the streams of each run of rows with one (host, salt); rows come sorted by host, salt, kind, key."""
    now, tree, n = None, (), 0
    for batch in batches:
        out = []
        for host, salt, kind, key, count, mass, low, high in zip(*(c.to_pylist() for c in batch.columns)):
            if kind != STREAM:
                out.append((host, kind, key, count, mass, low, high))
                continue
            if (host, salt) != now:
                if now:
                    out.append((now[0], STREAM, json.dumps(tree, ensure_ascii=False, separators=(",", ":")), n, 0, 0, 0))
                now, tree, n = (host, salt), frozen(json.loads(key)), count
            else:
                tree, n = align(tree, frozen(json.loads(key))), n + count
        if out:
            yield rows_of(out)
    if now:
        yield rows_of([(now[0], STREAM, json.dumps(tree, ensure_ascii=False, separators=(",", ":")), n, 0, 0, 0)])


WRAPPER = "host string, wrapper string, root string, template array<string>"
WRAPPER_ARROW = pa.schema([("host", pa.string()), ("wrapper", pa.string()), ("root", pa.string()), ("template", pa.list_(pa.string()))])


def conclude(least_pages: int, share: float):
    """Function from rows sorted by host, kind, key to one row of WRAPPER for each host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, tree, n, total, root, template, fixed, varies, same = None, (), 0, 0, None, [], frozenset(), False, Counter()

        def result() -> tuple:
            return host, expression(tree), root, template if varies else []

        for batch in batches:
            out = []
            for h, kind, key, count, mass, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                if h != host:
                    if host is not None:
                        out.append(result())
                    host, tree, n, total, root, template, fixed, varies, same = h, (), 0, 0, None, [], None, False, Counter()
                if kind == STREAM:
                    new = frozen(json.loads(key))
                    tree, n = (align(tree, new) if n else new), n + count
                elif kind == SLOT:
                    if fixed is None:
                        fixed = frozenset(fixed_paths(tree))
                    varies = varies or low != high
                    if n >= least_pages and count == n and low == high and key in fixed:
                        template.append(key)
                        same.update({branch: mass for branch in branches_of(key)})
                elif n < least_pages:
                    continue
                elif not key:
                    total = mass - same[key]  # the empty path sorts first
                elif mass - same[key] >= max(1, share * total) and (root is None or key.count("/") > root.count("/")):
                    root = key
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), WRAPPER_ARROW)], schema=WRAPPER_ARROW)
        if host is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(result(), WRAPPER_ARROW)], schema=WRAPPER_ARROW)

    return run


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_pages: int = 3, share: float = 0.6, salts: int = 16) -> DataFrame:
    """host, wrapper, root and template for each host of pages: the wrapper as text, the deepest branch with at least
    `share` of the host's text less its template (null for a host of fewer than `least_pages` pages), and the paths of template text (the same in all of at least `least_pages` pages).

    Pages without a host (null url, or one without ://) and without text give nothing; an empty table gives no rows.
    Repeated rows count as pages of their own.  Distinct streams of one host are aligned in `salts` parts first, in the
    order of their text, so the result does not depend on how the pages are partitioned.
    """
    hosts = host_of(F.col(url_col))
    seen = map_batches(pages.select(hosts.alias("host"), F.col(html_col).alias("html")).where("host <> ''"), gather, EVIDENCE)
    total = seen.groupBy("host", "kind", "key").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"), F.min("low").alias("low"), F.max("high").alias("high"))
    salted = total.select("host", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int").alias("salt"), "kind", "key", "n", "mass", "low", "high")
    parts = map_batches(salted.repartition("host", "salt").sortWithinPartitions("host", "salt", "kind", "key"), combine, EVIDENCE)
    return map_batches(parts.repartition("host").sortWithinPartitions("host", "kind", "key"), conclude(least_pages, share), WRAPPER)


def main_text(source: str | None, root: str | None, template) -> str:
    """The main text of one page: what its host's wrapper has below root, less template text.  Where the wrapper says
    nothing of the page (a host of few pages, or none of its blocks below root), the blocks of its <article>, else of
    <main>, else all."""
    fixed = set(template or ())
    blocks = Page(source).blocks
    rest = [b for b in blocks if b[0] not in fixed]
    below = [b for b in rest if root and (b[0] == root or b[0].startswith(root + "/"))]
    marked = [b for b in blocks if b[2]] or [b for b in blocks if b[3]]
    return " ".join(b[1] for b in below or marked or rest)


BROADCAST_BYTES = 32 << 20


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with text and n_chars (code points), replacing columns of these names; every row comes out once.

    A null or empty html, or one without text, gives an empty text.  Character references are decoded; white space within
    a block becomes one space; blocks are joined by one space, and none is cut or left out for its length.  A page
    without a host is read by its own markup only.  Wrappers go to the pages by broadcast where they measure at most
    32 MB, else by a join on the host that AQE splits where it is skewed.
    """
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    roles = cut(infer_wrappers(pages, url_col, html_col).drop("wrapper"))
    roles = roles.where("root is not null or size(template) > 0").toDF("__host", "__root", "__template")
    size = roles.agg(F.sum(F.length("__host") + F.length(F.coalesce("__root", F.lit(""))) + F.length(F.concat_ws("", "__template")) + 64)).first()[0] or 0
    given = pages.select(*kept, host_of(F.col(url_col)).alias("__host"))
    given = given.join(F.broadcast(roles) if size <= BROADCAST_BYTES else roles, "__host", "left").select(*kept, "__root", "__template")
    at, width = kept.index(html_col), len(kept)
    names = [*kept, "text", "n_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, roots, templates = (batch.column(i) for i in (at, width, width + 1))
            texts = [main_text(*row) for row in zip(sources.cast(pa.string()).to_pylist(), roots.to_pylist(), templates.to_pylist())]
            new = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *new], names)

    schema = T.StructType([*given.schema.fields[:width], *T.StructType.fromDDL("text string, n_chars bigint").fields])
    return map_batches(given, read, schema)


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
