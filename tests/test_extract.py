from __future__ import annotations


from scribemill.operators import extract
from scribemill.operators.markup import parse

TABLE = extract.TableListing("https://a.example", "table.views-table tbody tr")
CARD = extract.CardListing("https://a.example/x/", "div.views-row", "h3 a, .field-title a", ".date-display-single, time")


def rows(spark, html, form):
    pages = spark.createDataFrame([("s", 0, html)], "source string, page_no long, html string")
    return [tuple(r)[2:] for r in extract.listing_rows(extract.parse_listings(pages, form)).orderBy("row_no").collect()]


def test_table_listing(spark):
    html = """<table class="views-table cols-3"><thead><tr><td>h</td><td>h</td><td><a href="/no">h</a></td></tr></thead><tbody>
      <tr><td> March 3, 2031 </td><td><a href="/p">P</a></td><td><a href="/d/1"><b>Harbour</b> opening</a></td></tr>
      <tr><td>x</td><td>y</td></tr>
      <tr><td>Feb</td><td>y</td><td><a href="">none</a></td></tr>
      <tr><td>Mar<td>y<td><a href="https://b.example/2">Two &amp; more</a>
      </tbody></table>"""
    assert rows(spark, html, TABLE) == [
        (0, "https://a.example/d/1", "Harbouropening", "March 3, 2031"),
        (3, "https://b.example/2", "Two & more", "Mar"),
    ]


def test_table_rows_need_a_written_tbody(spark):
    assert rows(spark, "<table class='views-table'><tr><td>1</td><td>2</td><td><a href='/a'>t</a></td></tr></table>", TABLE) == []


def test_card_listing(spark):
    html = """<div class="views-row odd"><h3><a href="/one">One</a></h3><span class="date-display-single">May 1</span></div>
      <div class="views-row"><div class="field-title"><a href="two?x=1&amp;y=2">Two</a></div><time>May 2</time></div>
      <div class="views-row"><h3><a href="#f">Three</a></h3></div>
      <div class="views-row"><a href="/no">not in a title</a></div>"""
    assert rows(spark, html, CARD) == [
        (0, "https://a.example/one", "One", "May 1"),
        (1, "https://a.example/x/two?x=1&y=2", "Two", "May 2"),
        (2, "https://a.example/x/#f", "Three", ""),
    ]


def test_pages_count_up_to_the_first_gap(spark):
    full, empty = [("u", "t", "d")], []
    pages = spark.createDataFrame(
        [("a", 0, full), ("a", 1, full), ("a", 2, empty), ("a", 3, full), ("b", 0, full), ("b", 2, full), ("c", 1, full),
         ("d", 0, None), ("d", 1, full), ("e", 0, full), ("e", 1, [(None, None, None)])],
        "source string, page_no long, items array<struct<url:string,title:string,date:string>>",
    )
    kept = {(r.source, r.page_no) for r in extract.until_first_gap(pages).collect()}
    assert kept == {("a", 0), ("a", 1), ("b", 0), ("e", 0), ("e", 1)}


def body(spark, html, selector="div.body", min_chars=0):
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    return [r.text for r in extract.body_text(pages, selector, min_chars=min_chars).collect()]


def test_body_text_pieces(spark):
    html = ("<div class='x body'> <p><b>a</b> c<br>d &amp; e<!-- no -->f</p><script>var x='</p>'</script><style>q</style>"
            "<p> </p><ul><li>one<li>two</ul></div><div class='body'>later</div>")
    assert body(spark, html) == ["a\nc\nd & e\nf\none\ntwo"]


def test_body_takes_document_order_not_selector_order(spark):
    html = "<article><p class='w'>no</p><div class='second'>2</div></article><div class='first'>1</div>"
    assert body(spark, html, "div.first, article .second") == ["2"]
    assert body(spark, html, "div.none") == []
    assert body(spark, None) == []


def test_text_of_exactly_the_minimum_stays(spark):
    assert body(spark, f"<div class='body'>{'é' * 200}</div>", min_chars=200) == ["é" * 200]
    assert body(spark, f"<div class='body'>{'é' * 199}</div>", min_chars=200) == []
    assert body(spark, "<div class='body'>Far too brief.</div>", min_chars=200) == []


def test_one_parse_serves_all_selectors(spark):
    pages = spark.createDataFrame([(1, "<p class='a'>A</p><p class='b'>B</p>"), (2, "<p class='b'>C</p>"), (3, None)], "page_id long, html string")
    got = extract.body_texts(pages, {"x": "p.a", "y": "p.b"}, min_chars=0)
    assert {tuple(r) for r in got.collect()} == {(1, "x", "A"), (1, "y", "B"), (2, "y", "C")}


def test_a_page_is_read_only_for_the_sites_that_want_it(spark):
    selectors = {f"s{i}": f"p.c{i}" for i in range(50)}
    html = "".join(f"<p class='c{i}'>t{i}</p>" for i in range(50))
    pages = spark.createDataFrame([(1, html, ["s3", "s40"]), (2, html, ["s7"]), (3, html, [])], "page_id long, html string, wanted array<string>")
    got = extract.body_texts(pages, selectors, min_chars=0, wanted="wanted")
    assert {tuple(r) for r in got.collect()} == {(1, "s3", "t3"), (1, "s40", "t40"), (2, "s7", "t7")}


def test_tree_survives_broken_markup():
    tree = parse("<div><p>a<div class=k>b</b></p>c</span></div></div>d<p>e")
    assert tree.text("|") == "a|b|c|d|e"
    assert tree.first("div.k").text("|") == "b|c"
    assert parse("<table><tr><td>x</div>y</table>z").first("td").text("|") == "x|y"
    assert parse("<div class='k'/>x<br/>y").first("div.k").text() == "" and parse("<p/>x").text() == "x"
    assert parse("<template><p class='k'>x</p></template>").first("p.k").text() == ""
    assert parse("").text() == "" and parse("a < b & c").text() == "a < b & c"
