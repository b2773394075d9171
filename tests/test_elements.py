"""Pages' parts against a plain tree walk over well-formed pages, and against stated trees where nesting is broken."""

import random
import re
import xml.etree.ElementTree as ET

import pytest

from loomset.operators import elements
from loomset.plans import catalog, page_parts  # noqa: F401
from tests.oracle import assert_same

UNLIKELY, POSITIVE = re.compile(elements.UNLIKELY), re.compile(elements.POSITIVE)


def frame(spark, pages):
    return spark.createDataFrame(pages, "k long, html string").selectExpr("k", "html", "1 AS place", "2 AS row", "'x' AS tag", "3 AS key")


def grown(rng, depth=0):
    """A random well-formed element whose nesting needs no mending."""
    tag = rng.choice(["div", "section", "article", "main", "nav", "aside", "span", "p", "ul", "table", "b"] if depth < 4 else ["span", "p", "b"])
    names = rng.choice(["", "", ' class="sidebar"', ' class="post-body share"', ' id="main"', ' style="display: none"', ' class="menu"'])
    word = lambda: "".join(rng.choice("abc dé.") for _ in range(rng.randint(0, 60)))
    link = lambda: f'<a href="/{rng.randint(0, 9)}">{word()}</a>'
    if tag in ("p", "span", "b"):
        inner = "".join(rng.choice([word, link, lambda: '<img src="i.png"/>', lambda: f"<i>{word()}</i>"])() for _ in range(rng.randint(0, 4)))
    elif tag == "ul":
        inner = "".join(f"<li>{word()}{link() if rng.random() < 0.5 else ''}</li>" for _ in range(rng.randint(0, 4)))
    elif tag == "table":
        inner = "".join("<tr>" + "".join(f"<td>{word()}</td>" for _ in range(2)) + "</tr>" for _ in range(rng.randint(0, 3)))
    else:
        inner = "".join(grown(rng, depth + 1) for _ in range(rng.randint(0, 5))) + word()
    return f"<{tag}{names}>{inner}</{tag}>"


def clean(node):
    for child in list(node):
        names = f"{child.get('class', '')} {child.get('id', '')}"
        if child.tag in elements.REMOVED or re.search(elements.HIDDEN, child.get("style", "")) or UNLIKELY.search(names) and not POSITIVE.search(names):
            at = list(node).index(child)
            tail = ET.Element("tail")  # a text of its own, as the removed element parted it
            tail.text = child.tail
            node.remove(child)
            node.insert(at, tail)
        else:
            clean(child)


def pieces(node):
    out = [(node.text or "").strip()]
    for child in node:
        out += pieces(child) + [(child.tail or "").strip()]
    return [p for p in out if p]


def score(node):
    n = len("".join(pieces(node)))
    if n < 100:
        return 0
    names = f"{node.get('class', '')} {node.get('id', '')}"
    good = sum(len("".join(pieces(p))) > 25 for p in node.iter("p"))
    density = sum(1 for _ in node.iter("a")) / (n / 100)
    return min(n / 100, 10) + 25 * bool(POSITIVE.search(names)) - 25 * bool(UNLIKELY.search(names)) + elements.TAG_SCORES[node.tag] + 3 * good - (density * 5 if density > 1 else 0) + min(2 * sum(1 for _ in node.iter("img")), 10)


def shown(node):
    out = ["\n"] if node.tag in elements.BLOCK_ELEMENTS and pieces(node) else []
    out += [(node.text or "").strip()]
    for child in node:
        out += shown(child) + [(child.tail or "").strip()]
    return [p for p in out if p]


def content(html):
    body = ET.fromstring(html).find("body")
    clean(body)
    best = max((n for n in body.iter() if n.tag in elements.TAG_SCORES), key=score, default=None)
    root, top = (best, score(best)) if best is not None and score(best) > 0 else (body, None)
    parts = shown(root)
    text = " ".join(parts[1:] if parts and root.tag in elements.BLOCK_ELEMENTS else parts)
    return root.tag, top and round(top, 6), re.sub(" +", " ", re.sub(r"\n\s*\n", "\n\n", text)).strip(), len(text.split())


def test_main_content_equals_a_tree_walk(spark):
    rng = random.Random(7)
    pages = [(k, f"<html><body>{''.join(grown(rng) for _ in range(rng.randint(1, 6)))}</body></html>") for k in range(80)]
    got = {r.k: (r.tag, r.score, r.text, r.n_words) for r in elements.main_content(frame(spark, pages), "k", "html").collect()}
    for k, html in pages:
        assert got[k] == content(html), html
    assert len({v[0] for v in got.values()}) >= 4


def test_main_content_query_passes_over_blocks_beside_articles(spark, tmp_path):
    page = '<!DOCTYPE html><html lang="en"><head><title>t</title></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav><!-- ad --><div class="ad">{}</div><article><h1>{}</h1><p><b>{}<br></article><footer>&copy; f</footer></body></html>'
    texts = [("an ad " * n, "words &am", "more words " * m) for n in (1, 30, 300) for m in (1, 5, 8, 9, 40)]
    pages = [(k, page.format(*t)) for k, t in enumerate(texts)] + [(100, None), (101, ""), (101, "")]
    spark.createDataFrame(pages, "page_id long, html string").toPandas().to_parquet(tmp_path / "pages.parquet")
    assert_same(catalog.QUERIES["main_content"](spark, str(tmp_path)), str(tmp_path), catalog.ORACLE_SQL["main_content"])


def test_odd_pages(spark):
    odd = [(1, None), (2, ""), (3, "no tags, only words"), (4, "<div>" * 3000 + "deep " * 40), (4, "<p>one<p>two"), (None, "<body>x</body>"), (6, "<!-- only --><?pi?><!DOCTYPE html>"), (7, "<" * 2000)]
    got = {(r.k, r.text, r.tag) for r in elements.main_content(frame(spark, odd), "k", "html").collect() if r.k != 7}
    deep = ("deep " * 40).strip()
    assert got == {(3, "no tags, only words", None), (4, deep, "div"), (4, "one \n two", None), (None, "x", "body")}
    assert max(r.depth for r in elements.nodes(frame(spark, odd), "k", "html").select("depth").collect()) == elements.MAX_DEPTH
    for part in (elements.page_tables, elements.page_items, elements.json_ld, elements.social_cards):
        assert part(frame(spark, odd), "k", "html").count() == 0
    assert elements.main_content(frame(spark, odd).limit(0), "k", "html").count() == 0


@pytest.mark.parametrize(
    ("html", "tree"),
    [
        ("<ul><li>a<li>b<ul><li>c</ul></li></ul>", "ul(li('a') li('b' ul(li('c'))))"),
        ("<p>a<div>b</p>c</div>d", "p('a') div('b' 'c') 'd'"),
        ("<p><b>a<p>c", "p(b('a')) p('c')"),
        ("<table><tr><td>1<td>2<tr><th>3</table>x", "table(tr(td('1') td('2')) tr(th('3'))) 'x'"),
        ("<table><caption>t<thead><tr><th>h<tbody><tr><td><table><tr><td>in</table>out", "table(caption('t') thead(tr(th('h'))) tbody(tr(td(table(tr(td('in'))) 'out'))))"),
        ("a<br/>b<img src=x>c</br></i><dl><dt>t<dd>d<dt>u</dl>", "'a' br() 'b' img() 'c' dl(dt('t') dd('d') dt('u'))"),
        ("<div><table><tr><td></div>x</table>y", "div(table(tr(td('x'))) 'y')"),
        ("<script>if (a < b) '<p>'</script><select><option>1<option>2</select>", "script(\"if (a < b) '<p>'\") select(option('1') option('2'))"),
    ],
)
def test_broken_nesting(spark, html, tree):
    found = sorted(elements.nodes(frame(spark, [(1, html)]), "k", "html").collect(), key=lambda r: r.place)

    def told(parent):
        return " ".join(repr(r.text) if not r.tag else f"{r.tag}({told(r.place)})" for r in found if r.parent == parent)

    assert told(-1) == tree and all(r.depth == len(r.path) and (r.path or [-1])[-1] == r.parent for r in found)


def test_tables(spark):
    html = """<table><caption> Two <b>words</b></caption><thead><tr><th>a<th>b</thead><tbody><tr><td>1<td> 2 <i>x</i><td>3</tr><tr></tr><tr><th>4</tbody><tbody><tr><td>no</tbody></table>
    <table></table><table><tr><th>only heads</table><table><tr><td>0<tr><th>p<th>q<tr><th>r<tr><td>5<td>6</table><table><thead><tr><th>h</thead><tr><td>7</table>
    <table><tr><td>out<table><tr><td>in</table></table>"""
    got = sorted((r.table, r.title, r.row, r.column, r.header, r.value) for r in elements.page_tables(frame(spark, [(1, html)]), "k", "html").na.fill("-", ["header"]).collect())
    assert got == sorted([
        (1, "Twowords", 1, 1, "a", "1"), (1, "Twowords", 1, 2, "b", "2x"), (1, "Twowords", 1, 3, "column_2", "3"), (1, "Twowords", 2, 1, "a", "4"),
        (2, "", 1, 1, "p", "0"), (2, "", 2, 1, "p", "r"), (2, "", 3, 1, "p", "5"), (2, "", 3, 2, "q", "6"),
        (3, "", 1, 1, "h", "h"), (3, "", 2, 1, "h", "7"),
        (4, "", 1, 1, "-", "outin"), (4, "", 1, 2, "-", "in"), (4, "", 2, 1, "-", "in"), (5, "", 1, 1, "-", "in"),
    ])


def test_items_linked_data_and_cards(spark):
    html = """<div itemscope itemtype="T"><span itemprop="name"> A <b>b</b></span><meta itemprop=m content=c><link itemprop=l href=h><img itemprop=i src=s><time itemprop=t datetime=2020>x</time>
    <time itemprop=u>y</time><p itemprop="inner" itemscope><i itemprop=name>C</i></p><b itemprop="">no</b><b itemprop=none></b></div><div itemscope itemtype=empty></div><i itemprop=out>o</i>
    <script type="application/ld+json">{"@type": "A", "x": [1, "é"]}</script><script type="application/ld+json">[{"y": 1}, 2]</script><script type="application/ld+json">{broken</script><script>{"z": 1}</script>
    <meta property="og:title" content="one"><meta property="og:title" content="two"><meta name="twitter:card" content="c"><meta property="og:empty" content=""><title>t</title><meta name=author content=" Me ">
    <time datetime="2021-01-02">d</time><html lang="fa">"""
    pages = frame(spark, [(1, html)])
    items = sorted((r.item, r.type, r.property, r.nth, r.value) for r in elements.page_items(pages, "k", "html").collect())
    assert items == sorted([(1, "T", "name", 1, "Ab"), (1, "T", "name", 2, "C"), (1, "T", "m", 1, "c"), (1, "T", "l", 1, "h"), (1, "T", "i", 1, "s"), (1, "T", "t", 1, "2020"), (1, "T", "u", 1, "y"), (1, "T", "inner", 1, "C"), (2, "", "name", 1, "C")])
    data = elements.json_ld(pages, "k", "html").selectExpr("n", "to_json(data) AS j").collect()
    assert sorted((r.n, r.j) for r in data) == [(1, '{"@type":"A","x":[1,"é"]}'), (1, '{"y":1}'), (2, "2")]
    assert {(r.kind, r.name, r.value) for r in elements.social_cards(pages, "k", "html").collect()} == {("og", "title", "two"), ("twitter", "card", "c")}
    assert [tuple(r) for r in elements.page_details(pages, "k", "html").collect()] == [(1, "one", "Me", "2020", "fa")]


def test_excerpt(spark):
    texts = ["", "short\n\nnext", "a" * 400, "word " * 80, "x" * 200 + ". " + "y z " * 60, "x" * 100 + ". " + "y z " * 90]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.e for r in df.select("t", elements.excerpt(df["t"]).alias("e")).collect()}
    for t in texts:
        e = t.split("\n\n")[0]
        if len(e) > 300:
            e = e[:300]
            e = e[: e.rfind(".") + 1] if e.rfind(".") > 150 else e.rsplit(" ", 1)[0] + "..."
        assert got[t] == e


def test_stripped_and_words_know_all_white_space(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    page = "".join(f"<p>{s}a{s}{s}b{s}</p>" for s in spaces if s not in "\r")
    assert [r.n_words for r in elements.main_content(frame(spark, [(1, f"<body>{page}</body>")]), "k", "html").collect()] == [2 * (len(spaces) - 1)]
    df = spark.createDataFrame([(s, f"{s}a {s}b{s}{s}") for s in spaces], "s string, t string")
    assert all(r.x == r.t.strip() for r in df.select("t", elements.stripped(df["t"]).alias("x")).collect())
