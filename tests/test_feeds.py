"""Feeds against Python's XML parser; broken, empty and null files."""

import random
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import functions as F

from loomset.operators import landed


def test_content_is_what_a_parser_reads(spark):
    draw = random.Random(2)
    bits = ["a b", "&amp;", "&#65;", "&#x1F600;", "<b>bold</b>", "<![CDATA[<i> &amp; ]]>", "é", "<br/>", "&quot;", "&apos;", "<!-- no > -->", "\n", "&amp;lt;"]
    made = ["".join(draw.choices(bits, k=draw.randint(0, 8))) for _ in range(200)]
    got = spark.createDataFrame(list(enumerate(made)), "i long, x string").select("i", landed.content(F.concat(F.lit("["), F.col("x"), F.lit("]"))).alias("t")).collect()
    assert [r["t"] for r in sorted(got)] == ["".join(ElementTree.fromstring(f"<r>[{x}]</r>").itertext()) for x in made]
    odd = spark.createDataFrame([("&#0; &#xD800; &#1114112; &nbsp; & <",), ("",), (None,)], "x string").select(landed.content(F.col("x"))).collect()
    assert [r[0] for r in odd] == ["&#0; &#xD800; &#1114112; &nbsp; & <", "", None]


def test_records_of_both_kinds(spark):
    title, url = "x & <y> 'z'", 'http://e.example/?a=1&b="2"'
    item = f"<item><title>{escape(title)}</title><link>{escape(url)}</link><dc:creator>me</dc:creator><category/><category domain='d'>c1</category><enclosure url={quoteattr(url)} type='t/u'/></item>"
    entry = f"<entry><title/><link href='http://first.example/'/><link rel='edit' href='no'/><author><name>n</name></author><summary>s</summary></entry><entry><link href='a' rel='self'/><link rel=\"alternate\" href={quoteattr(url)}/><content type='html'>&lt;p&gt;</content><summary>s</summary></entry>"
    rows = [(1, f"<rss><channel><title>T</title>{item}{item}</channel></rss>"), (2, f"<feed xmlns='x'>{entry}</feed>"), (3, ""), (4, None), (5, "<rss><item>never closed"), (None, f"<rss>{item}</rss>")]
    got = landed.feed_records(spark.createDataFrame(rows, "k long, xml string"), "k", "xml").collect()
    by = {(r["k"], r["place"]): r for r in got}
    assert set(by) == {(1, 0), (1, 1), (2, 0), (2, 1), (None, 0)} and len(got) == 5
    r = by[1, 1]
    assert (r["kind"], r["feed_title"], r["title"], r["link"], r["author"], r["categories"], r["media_url"], r["media_type"], r["record_id"], r["updated"]) == ("rss", "T", title, url, "me", ["c1"], url, "t/u", None, None)
    assert by[None, 0]["feed_title"] is None
    a, b = by[2, 0], by[2, 1]
    assert (a["kind"], a["title"], a["link"], a["author"], a["content"], a["categories"], a["feed_title"]) == ("atom", "", "http://first.example/", "n", "s", [], None)
    assert (b["link"], b["content"], b["title"], b["media_url"]) == (url, "<p>", None, None)
