"""HTML extraction: page parsing, wrapper inference, and main text against pages whose text is known."""

import random

import pytest

from lakeloom.llm.wrappers import Page, align, expression, extract, fold, infer_wrappers, main_text, sign

SCHEMA = "page_id bigint, url string, html string"


def stream(source):
    return Page(source, stream=True).tree


def test_repeats_fold_and_mismatches_become_optional():
    a = stream("<div class=x><h2>a</h2><p>b<p>c</div>")
    b = stream("<div class=x><h2>a</h2></div><div class=y>z</div>")
    assert expression(a) == "<div.x>{<h2>{#}<p>{#}+}"
    assert expression(align(a, b)) == "<div.x>{<h2>{#}<p>{#}*}<div.y>{#}?"
    assert align(a, a) == a and align(a, ()) == tuple((n[0], 0, *n[2:]) for n in a)


def test_units_of_several_tags_fold_into_groups():
    t = stream("<dl>" + "<dt>k</dt><dd>v</dd>" * 5 + "</dl>")
    assert expression(t) == "<dl>{(<dt>{#}<dd>{#})+}"
    t = stream("<div>" + "<h2>k</h2><p>v</p><p>w</p>" * 3 + "</div>")
    assert expression(t) == "<div>{(<h2>{#}<p>{#}+)+}"
    assert fold(()) == ()


@pytest.mark.parametrize(
    "source, text",
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<p>a<b>b</b>c<p>d &amp;&lt;p&gt; \n\t e&nbsp;f", "abc d &<p> e f"),
        ("<nav>menu</nav><article><h1>T</h1><p>x<br>y</p></article><footer>f</footer>", "T x y"),
        ("<article><p><b>x<br><p>y</article><div class='ad'>buy</div>", "x y"),
        ("<article><p>x</p><aside>s</aside><form><input>f</form><section id=comments><p>c</p></section></article>", "x"),
        ("<main><div class='cookie-notice'>c</div><p>x</p></main>", "x"),
        ("<style>p{}</style><script>var t='</p><article>no';</script><p>x</p>", "x"),
        ("<article>a < b and 1<2</article>", "a < b and 1<2"),
        ("<article><!-- <p>no</p> --><p title='a>b'>x</p>", "x"),
        ("<article><p>x<p class='", "x"),
        ("<head><title>t</title></head><body><p>x</body>", "x"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "a b c"),
        ("</div></p><p>x</p></article>", "x"),
    ],
)
def test_main_text(source, text):
    assert main_text(source, None, None) == text


def site(seed, n, host):
    """Pages without <article>, and their texts: fixed text and varying links around a group of paragraphs."""
    draw = random.Random(seed)

    def words(k):
        return " ".join(draw.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(draw.randrange(1000)) for _ in range(k))

    out = []
    for i in range(n):
        paragraphs = [words(draw.randrange(20, 60)) for _ in range(draw.randrange(2, 6))]
        note = "<div class='lead'>Published by the staff of this site</div>"
        extra = f"<div class='links'>{words(3)}</div>" if draw.random() < 0.5 else ""
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        out.append((i, f"https://{host}/{i}", f"<html><body>{extra}<div class='page'><div class='post'>{note}{body}</div></div><div class='end'>{words(2)}</div>", " ".join(paragraphs)))
    return out


def test_wrapper_finds_the_text_of_a_host(spark):
    made = site(1, 40, "a.example.org")
    pages = spark.createDataFrame([r[:3] for r in made], SCHEMA)
    wrapper = infer_wrappers(pages).first()
    assert wrapper["root"] == "/div.page/div.post"
    assert wrapper["template"] == ["/div.page/div.post/div.lead"]
    assert wrapper["wrapper"] == "<div.links>{#}?<div.page>{<div.post>{<div.lead>{#}<p>{#}+}}<div.end>{#}"
    assert infer_wrappers(pages.repartition(7)).first() == wrapper
    got = {r.page_id: (r.text, r.n_chars) for r in extract(pages).collect()}
    assert got == {i: (text, len(text)) for i, _, _, text in made}


def test_edge_cases(spark):
    long = "<article>" + "<p>word word</p>" * 50_000 + "</article>"
    rows = [(1, None, None), (2, None, "<p>x"), (None, "https://b.example/1", ""), (3, "https://b.example/2", long), (3, "https://b.example/2", long), (4, "no host", "<p>y</p>")]
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'old' AS text", "1 AS host", "page_id AS kind")
    out = extract(pages)
    assert out.columns == ["page_id", "url", "html", "host", "kind", "text", "n_chars"]
    got = sorted((r.page_id or 0, r.n_chars, r.text[:9]) for r in out.collect())
    assert got == [(0, 0, ""), (1, 0, ""), (2, 1, "x"), (3, 499_999, "word word"), (3, 499_999, "word word"), (4, 1, "y")]
    assert extract(pages.where("false")).count() == 0


def test_deep_nesting(spark):
    deep = "<div>" * 10_000 + "<p>x</p>" + "</div>" * 10_000
    rows = [(i, f"https://d.example/{i}", deep.replace("x", f"text {i}")) for i in range(4)] + [(9, "https://d.example/9", "<div>" * 10_000 + "<b>open")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {**{i: f"text {i}" for i in range(4)}, 9: "open"}


def test_wrapper_goes_before_markup(spark):
    """A host whose pages put a fixed teaser into <article>: what varies is elsewhere, and the wrapper says where."""
    rows = [(i, f"https://e.example/{i}", f"<article><p>Read our teaser</p></article><div class=body><p>{'own words %d ' % i * 20}</p></div>") for i in range(5)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: ("own words %d " % i * 20).strip() for i in range(5)}
    assert extract(spark.createDataFrame(rows[:1], SCHEMA)).first()["text"] == "Read our teaser"


def accepts(nodes, given):
    """Whether the expression accepts a list of plain siblings, tried in every way."""
    if not nodes:
        return not given
    (name, least, most, children), rest = nodes[0], nodes[1:]
    if least == 0 and accepts(rest, given):
        return True
    for n in range(1, len(given) + 1):
        head, tail = given[:n], given[n:]
        if name:
            fits = n == 1 and head[0][0] == name and (name == "#" or accepts(children, head[0][3]))
        else:
            fits = accepts(children, head)
        if fits and (accepts(rest, tail) or most == 2 and accepts(((name, 0, most, children), *rest), tail)):
            return True
        if name:
            break
    return False


def test_aligned_expression_accepts_what_it_came_from():
    draw = random.Random(2)

    def page(depth=0):
        return "".join(f"<{t}>{page(depth + 1) if t != 'p' and depth < 1 and draw.random() < 0.4 else 'x'}</{t}>" for t in draw.choices(["div", "p", "ul"], k=draw.randrange(1, 5)))

    def plain(source):
        """The siblings of a page before runs of them are folded."""
        nodes, stack = [], []
        import re

        for end, tag, text in re.findall(r"<(/?)(\w+)>|(x)", source):
            if text:
                (stack[-1][3] if stack else nodes).append(("#", 1, 1, []))
            elif end:
                node = stack.pop()
                (stack[-1][3] if stack else nodes).append(node)
            else:
                stack.append((tag, 1, 1, []))
        return nodes

    for _ in range(60):
        sources = [page() for _ in range(3)]
        tree = stream(sources[0])
        for s in sources[1:]:
            tree = align(tree, stream(s))
        for s in sources:
            given = [n for n in plain(s)]
            assert accepts(tree, given), (expression(tree), s)
        assert all(sign(n) is not None for n in tree)
