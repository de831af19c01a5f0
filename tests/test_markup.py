"""Golden pages for the facts of markup and the extraction cascade; null, empty and odd pages."""

import pytest
from pyspark.sql import functions as F

from placelake.functions import dom
from placelake.functions import text as T
from placelake.operators import cascade as X
from placelake.operators import facts as P
from placelake.plans.queries import QUERIES
from placelake.schemas import SCHEMAS

HOME = """<html><head><title>Oak Manor | Corp</title><script>fetch("/api/locations?x=1"); $.get('/other')</script></head><body>
<nav><a href="/locations/">Places</a><a href="/about">About</a></nav>
<div itemscope itemtype="http://schema.org/LocalBusiness"><meta itemprop="telephone" content="+1 555 201 3000"><span itemprop="name">Oak Manor</span></div>
<h1>Oak Manor Care</h1><div class="contact-info">100 Main St<br>Reno, NV 89501<br>(555) 201-3000</div>
<div class="address"><p>12 Elm Road</p><p>Las Vegas Nevada 89101</p></div>
<a href="tel:1-555-201-4000">call</a><a href="mailto:a@b.com">mail</a>
<form action="/find"><label>Find a location</label><input name="q" required><select name="s"></select></form><form><input name="no"></form>
<div class="services"><ul><li>Therapy</li><li>Meals</li><li>ok</li></ul></div><h3>Our amenities</h3><ul><li>Pool</li></ul>
<div class="facility-card"><a href="/about">x</a><a href="/locations/reno/">y</a></div>
<div class="pagination"><a href="?page=2">2</a></div><a class="next" href="?page=3">Next</a>
<p>Administrator: Jane Roe, RN. 120 beds. License # AB-12. Memory care.</p></body></html>"""
CARDS = """<div class="facility-card"><h2>Pine Center</h2><span class="address">1 Pine St</span><span class="city">Reno</span>
<div class="services"><ul><li>A</li><li>B</li></ul></div></div><div class="facility-card"><h2>Facility</h2><span class="city">Reno</span></div>"""
BLOCK = '<div class="my facility box"><h3>Elm Home</h3> 9 Elm Street 89101 a@b.org 555-201-3000 assisted living TX</div>'
TABLE = '<table class="facility-table"><tr><td>Fir Court<td>7 Fir Rd<td>5</tr></table>'
ROWS = [
    (1, "https://x.com/locations/", HOME), (2, "https://x.com/locations/tx", CARDS), (3, "https://x.com/q", BLOCK), (4, "https://x.com/list", TABLE),
    (5, None, None), (6, "https://x.com/z", ""), (6, "https://x.com/z", ""), (7, "https://x.com/w", "<<p><li>" * 300 + "é</html>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id int, url string, html string").withColumn("records", F.lit("clash"))


@pytest.fixture(scope="module")
def facts(pages):
    return P.page_facts(pages).join(pages.select("page_id", "url").distinct(), "page_id").cache()


def test_selectors():
    root = dom.parse('<table><tr><td>a<td class="b c">b</tr></table><a href="/x">Next page</a><p data-k="v w">z')
    texts = lambda s: [x.text() for x in dom.select(root, s)]
    assert texts("td:first-child") == ["a"] and texts("td:nth-child(2)") == ["b"]
    assert texts('a:contains("Next page"), .c') == ["b", "Next page"]
    assert texts("p[data-k='v w']") == ["z"] and texts("table .b.c") == ["b"] and texts("p td") == []
    with pytest.raises(ValueError):
        dom.select(root, "a > b")
    assert dom.parse("<p>one<p>two<br>three").lines() == "one\ntwo\nthree"
    nested = dom.parse("<ul><li>a<ul><li>b<li>c</ul><li>d</ul><table><tr><td><p>e<td>f<tr><td>g</table>")
    assert [x.text() for x in dom.select(nested, "li")] == ["abc", "b", "c", "d"] and [x.index for x in dom.select(nested, "td")] == [1, 2, 1]


def test_assemble(facts):
    got = {r.page_id: r for r in P.assemble(facts).collect()}
    home = got[1]
    assert (home.name, home.phone, home.email) == ("Oak Manor", "+1 555 201 3000", "a@b.com")
    assert (home.address, home.city, home.state, home.zip_code) == ("12 Elm Road", "Las Vegas", "NV", "89101")
    assert (home.facility_type, home.beds, home.administrator, home.license_number) == ("Memory Care", "120", "Jane Roe", "AB-12")
    assert {"Therapy", "Meals"} <= set(home.services_offered) and "ok" not in home.services_offered
    assert (got[5].name, got[5].phone, got[5].services_offered) == ("", "", [])
    assert P.assemble(facts).where("page_id = 6").count() == 2 and got[7].name == ""


def test_json_ld(spark):
    ld = '<script type="application/ld+json">%s</script>'
    full = """[{"@type": "LocalBusiness", "name": "Oak", "description": "D", "telephone": "1", "email": "a@b.co",
      "address": {"streetAddress": "1 Oak St", "addressLocality": "Reno", "addressRegion": "NV", "postalCode": "89501"}}, 3]"""
    micro = '<div itemscope itemtype="https://schema.org/LocalBusiness"><span itemprop="name">Elm</span></div>'
    pages = [(1, ld % full), (2, micro + ld % full), (3, ld % '{"@type": ["LocalBusiness"], "name": "No"}' + ld % "{bad"), (4, None)]
    out = P.assemble(P.page_facts(spark.createDataFrame(pages, "page_id int, html string")))
    got = {r.page_id: (r.name, r.description, r.phone, r.email, r.address, r.city, r.state, r.zip_code) for r in out.collect()}
    oak = ("Oak", "D", "1", "a@b.co", "1 Oak St", "Reno", "NV", "89501")
    assert got == {1: oak, 2: ("Elm", *oak[1:]), 3: ("",) * 8, 4: ("",) * 8}


def test_navigation(pages, facts):
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(P.search_forms(facts)) == [(1, "https://x.com/find", "get", "q", "text", True), (1, "https://x.com/find", "get", "s", "text", False)]
    assert rows(P.ajax_endpoints(pages)) == [(1, "https://x.com/api/locations?x=1")]
    assert rows(P.page_links(facts.where("page_id = 1"))) == [(1, f"https://x.com/locations/{q}") for q in ("", "?page=2", "?page=3")]
    assert rows(P.nav_targets(facts)) == [(1, "https://x.com/locations/", "listing")]
    assert [r.target for r in P.card_targets(facts).collect()] == ["https://x.com/locations/reno/"]


def test_cascade(spark, pages):
    found = X.extract(pages)
    got = {r.page_id: r for r in found.collect()}
    assert {k: (r.method, r.schema_name) for k, r in got.items()} == {
        1: ("none", "standard_facility_listing"), 2: ("predefined_schema", "standard_facility_listing"), 3: ("regex_extraction", None),
        4: ("predefined_schema", "table_facility_listing"), 5: ("none", None), 6: ("none", None), 7: ("none", None),
    }
    assert [(r.name, r.address, r.city, r.services) for r in got[2].records] == [("Pine Center", "1 Pine St", "Reno", ["A", "B"])]
    elm = got[3].records[0]
    assert (elm.name, elm.address, elm.zip_code, elm.state, elm.facility_type) == ("Elm Home", "9 Elm Street", "89101", "TX", "Assisted Living")
    links = spark.createDataFrame([(7, "https://x.com/q"), (7, "https://x.com/list"), (3, "https://x.com/list")], "page_id int, url string")
    linked = {r.page_id: (r.method, [x.name for x in r.records]) for r in X.with_links(found, links).collect()}
    assert linked[7] == ("internal_links", ["Elm Home", "Fir Court"]) and linked[3] == ("regex_extraction", ["Elm Home"]) and linked[5] == ("none", [])
    replies = spark.createDataFrame([(5, '```json\n{"facilities":[{"name":"Ash Place","city":"Reno","phone":"5552013000"}]}\n```'), (7, "no JSON")], "page_id int, reply string")
    last = {r.page_id: (r.method, [x.name for x in r.records]) for r in X.with_replies(found, replies).collect()}
    assert last[5] == ("llm_fallback", ["Ash Place"]) and last[7] == ("llm_fallback_failed", []) and last[4][0] == "predefined_schema"
    assert X.flat(found).where("page_id = 6").count() == 0 and X.extract(pages.limit(0)).count() == 0


def test_schema_choice(spark):
    urls = ["https://x.com/location/a", "https://sunriseseniorliving.com/center/a", "https://x.com/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(X.schema_by_url(F.col("url"))).collect()] == ["standard_facility_listing", "standard_facility_listing", None]
    assert [r[0] for r in df.select(X.schema_by_url(F.col("url"), most_specific=True)).collect()] == ["individual_facility_detail", "sunrise_senior_living", None]
    assert all(dom.compile_selector(s) for schema in SCHEMAS for s in (schema.base, *schema.fields.values()))


def test_replies(spark):
    cases = ['{"facilities": []}', 'x {"facilities": [{"name": "Yew Hall", "state": "TX"}]} y {"facilities": [{"name": "Bay Hall", "city": "A"}]}', "", None, '{"facilities": [{"name": "Home"}]}']
    df = spark.createDataFrame([(c,) for c in cases], "reply string")
    assert [[r.name for r in row[0]] for row in df.select(X.reply_records(F.col("reply"))).collect()] == [[], ["Yew Hall", "Bay Hall"], [], [], []]


def test_all_blocks(spark, tmp_path):
    html = "".join(f"<section><h2>Bay Center {i}</h2> 555-201-3000</section>" for i in range(60))
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert QUERIES["keyed_block_records"](spark, str(tmp_path)).count() == 60


def test_wide_blocks(spark):
    html = '<section><h2>Bay Center</h2> 555-201-3000</section><article><h2>No</h2></article><li class="location"><h4>Elm home</h4> a@b.co</li>'
    df = spark.createDataFrame([(html,), ("x" * 99,), (None,)], "html string")
    assert [[r.name for r in row[0]] for row in df.select(X.keyed_records(F.col("html"))).collect()] == [["Bay Center", "Elm home"], [], []]
    assert df.select(F.size(X.wide_blocks(F.col("html"), most=1))).first()[0] == 1


@pytest.mark.parametrize(
    ("text", "want"),
    [("A\n1 Oak St\nReno, nevada 89501", ("1 Oak St", "Reno", "NV", "89501")), ("Las Vegas NV 89101", (None, "Las Vegas", "NV", "89101")), ("89501", ("89501", None, None, "89501")), (None, (None, None, None, None)), ("", (None, None, None, None))],
)
def test_parse_address(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(T.parse_address(F.col("t")).alias("a")).first().a) == want
