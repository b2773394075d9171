from html.parser import HTMLParser
from urllib.parse import urljoin

from loomset.operators import curation, pages

HTML = """<a href="/a.html#part">1</a><a href='/b'>2</a><A HREF = c.html >3</A><a
href="../d/./e?x=../1#f">4</a><a\tclass="x > y" data-href="/no" href="g/">5</a><a href="#top">6</a><a href="javascript:f()">7</a>
<a href="//other.org/h">8</a><a href="?q=1">9</a><a href="mailto:a@b.c">10</a><a href="/i?a=1&amp;b=2">11</a><a href="..">12</a>
<abbr href="/no">13</abbr><a name="no">14</a><a href="https://x.org/../j">15</a><a href="/">16</a><a id=k href=/l>17</a><a class="x"href="/m">18</a>"""


class Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        href = dict(attrs).get("href")
        if tag == "a" and href and not href.startswith(("#", "javascript:")):
            self.found.append(href)


def test_links_equal_the_parsers(spark):
    rows = [(k, u, HTML) for k, u in enumerate(["http://s.org/x/y/z.html?q#f", "http://s.org", "https://s.org:8/x/"])] + [(9, "http://s.org", None)]
    got = {(r.id, r.link) for r in pages.links(spark.createDataFrame(rows, "id int, url string, html string"), "id", "url", "html").collect()}
    parser = Links()
    parser.feed(HTML)
    assert len(parser.found) == 14
    assert got == {(k, urljoin(u, x)) for k, u, h in rows if h for x in parser.found}


def test_anchors_are_counted_and_no_page_takes_long(spark):
    rows = [(1, HTML), (2, "<a data=" + "a/b/" * 5000 + ">"), (3, None)]
    got = {r.id: r.links for r in curation.meta_tags(spark.createDataFrame(rows, "id int, html string"), "id", "html").collect()}
    assert got == {1: 16, 2: 0, 3: 0}
