"""Items and links of pages: selectors of sources, cards around links, defaults, broken markup."""

import pytest
from pyspark.sql import functions as F

from pricetide.operators import page_items as P

CARD = '<div class="tile-card"><a class="go" href="/ban/sky-{0}">Bán căn hộ Sky {1}</a> <span>{2}</span></div>'
CARDS = "<html><head><title>Listings</title></head><body>" + CARD.format("a", "A", "2PN, 58m², giá 3.6 tỷ") + CARD.format("b", "B", "3PN, 82m², giá 5.1 tỷ") + "</body></html>"
URL = "https://example.com/search"


def got(html, item=None, link=None, content=None, drop=None, most=None, url=URL):
    return list(P.items(html, url, item, link, content, drop, most))


def test_visible_text():
    html = """<html><head><title>ignore me</title></head><body><script>window.secret = "no";</script><style>.x { display: none; }</style>
      <h1>Căn hộ &amp; nhà phố</h1>
      <p>Giá 5.2 tỷ&nbsp;TL</p>
      <div>Diện tích <strong>72m²</strong></div><div aria-hidden='true'>x</div><p class="share y">z</p></body></html>"""
    assert got(html) == [(1, URL, "Căn hộ & nhà phố\nGiá 5.2 tỷ TL\nDiện tích 72m²")]
    assert got(html, drop="h1, strong")[0][2] == "Giá 5.2 tỷ TL\nDiện tích"


def test_links():
    html = '<a href="/listing/a?b=2&a=1#photos">A</a><a href="https://Example.com/listing/a/?a=1&b=2">again</a><a href="tel:09">t</a><a href="JavaScript:void(0)">j</a><a href="#x">x</a><a>none</a><a href="ftp://x/y">f</a><nav><a href="/n">n</a></nav>'
    assert list(P.links(html, URL, None)) == [(1, "https://example.com/listing/a?a=1&b=2"), (2, "https://example.com/n")]
    assert list(P.links(html, URL, "nav a")) == [(1, "https://example.com/n")]


def test_items_by_selector():
    html = '<body><article class="listing"><a href="/a">A</a><p>Bán căn hộ A giá 5 tỷ</p></article><article class="listing"><a href="/b">B</a><p>Bán căn hộ B</p></article><article class="listing">no link<br>two lines</article></body>'
    assert [(p, r) for p, r, _ in got(html, ".listing")] == [(1, "https://example.com/a"), (2, "https://example.com/b"), (3, URL + "#item-3")]
    assert got(html, ".listing")[2][2] == "no link\ntwo lines"
    assert [t for *_, t in got(html, "article", content="p")] == ["Bán căn hộ A giá 5 tỷ", "Bán căn hộ B"]
    assert got(html, "article", most=3)[2][2] == "no "


def test_a_selected_link_stands_for_its_card():
    found = got(CARDS, "a.go")
    assert [r for _, r, _ in found] == ["https://example.com/ban/sky-a", "https://example.com/ban/sky-b"]
    assert "2PN, 58m², giá 3.6 tỷ" in found[0][2] and "5.1" not in found[0][2]


def test_overlapping_cards_are_one_item():
    html = '<div class="big-card">' + CARD.format("a", "A", "x") + "</div>"
    assert [r for _, r, _ in got(html, ".big-card, .tile-card", "a.go")] == ["https://example.com/ban/sky-a"]


@pytest.mark.parametrize(("selector", "want"), [("p", "ab"), ("div p", "a"), ("div.k > p", ""), ("#i", "b"), ("[data-x*='lo']", "b"), ("[data-x=hello]", "b"), ("[data-y]", ""), ("section, div p", "a")])
def test_selectors(selector, want):
    root = P.tree('<div class="k l"><p>a</p></div><p id="i" data-x="hello">b<p>')
    s = P.Selector(selector.replace(" > ", " q "))
    assert "".join(x.text() for x in root.below() if s.fits(x)) == want


def test_broken_and_deep_markup():
    assert got("<p>a<p>b<li>c<b>d</p></i>e") == [(1, URL, "abcde")]
    assert got(None) == [] and got("") == []
    assert got("<div>" * 20_000 + "deep" + "</div>" * 20_000) == [(1, URL, "deep")]
    assert got('<a href="http://[bad">x</a>', "a")[0][1] == URL + "#item-1"


def test_in_a_lateral_join(spark):
    rows = [(1, URL, CARDS, "a.go", None), (2, URL, CARDS, None, 7), (3, None, CARDS, None, None), (4, URL, None, None, None)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, item_selector string, max_chars int")
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("link_selector", "content_selector", "drop_selectors")})
    assert [(r.page_id, r.place) for r in P.page_items(df).orderBy("page_id", "place").collect()] == [(1, 1), (1, 2), (2, 1)]
    assert P.page_items(df).where("page_id = 2").first().text == "Bán căn"
    assert sorted((r.page_id, r.link[-1]) for r in P.page_links(df).collect()) == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]


def test_references_without_a_semicolon_in_headlines(spark, tmp_path):
    """A page that ends a headline within a reference is read the same by the query and its SQL."""
    import duckdb

    from pricetide.plans import catalog

    head = "a &lt b &amp;lt c &gt; d &quot e &#x27;f&#x27; g &amp"
    rows = [(i, f"https://h.example.com/{lang}/{i}", f"<html><body><article><h1>{head}</h1></article></body></html>") for i, lang in enumerate(("en", "de", "fr"))]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = catalog.queries["E1_E3_items_by_source"](spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.ref, r.text) for r in got) == sorted(con.execute(f"SELECT page_id, ref, text FROM ({catalog.oracle['E1_E3_items_by_source']})").fetchall())
    assert {r.page_id: r.text for r in got}[0] == "a < b &lt c > d \" e 'f' g &"
