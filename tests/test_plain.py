"""The plain path over pages against golden pages and the pattern itself; files, comparisons and answers told twice."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placelake import constants as K
from placelake.operators import cascade as X
from placelake.operators import outcomes as O
from placelake.operators import plain as P
from placelake.operators import summaries as S
from placelake.plans.queries import QUERIES
from placelake.sources import tables

HOME = """<html><head><title>Oak Home | Site</title><script>skilled nursing</script></head><body><h1>Oak</h1><h2 class="facility-name">Oak</h2><span class="my-name">Oak Home</span>
<div class="address"></div><div class="location">9 Elm St</div><p>Visit us at 12 Long
Pine Court, Reno, NV 89501. Call 702.555.1234 or 800-555-0000, a@b.org c@d.org</p><p>License # X9, 40 beds, 50 beds</p>
<div class="services amenities"><p>Care <ul><li>Therapy</li><li>spa</li></ul></div><div class="our-service"><div class="service-list"><p>Meals</p></div></div></body></html>"""


def test_records(spark):
    pages = spark.createDataFrame([(1, HOME), (2, None), (3, ""), (4, "<title>Hi</title>"), (5, "<h1>Pine</h1><p>assisted living or snf</p><div class='contact-info'>1 A St\n\nReno, NV 89501</div>")], "page_id long, html string")
    facts = P.facts(pages)
    assert facts.count() == 5
    got = {r.page_id: r for r in P.records(facts).collect()}
    # no name of more than three characters: the title as it is; no name at all: no record
    assert set(got) == {1, 4, 5} and got[4].name == "Hi"
    home = got[1]
    # the first element of each selector alone counts: the title is the first of more than three characters, and the first
    # address is empty, so that it is looked for in the text, where it begins at the first number and ends with its line
    assert (home.name, home.facility_type, home.address, home.phone, home.email, home.beds, home.license_number) == ("Oak Home | Site", K.OTHER_TYPE, "9 Elm St", "702.555.1234", "a@b.org", "40", "X9")
    # reached by .services, .amenities and [class*=service]; the list within [class*=service] twice
    assert home.services == ["Care", "Therapy"] * 3 + ["Meals", "Meals"]
    assert (got[5].facility_type, got[5].address, got[5].city, got[5].state, got[5].zip_code, got[5].services) == ("Skilled Nursing", "1 A St", "Reno", "NV", "89501", [])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["12", "7", " ", "\n", "St", "Street", "Ave", "Avenue", "Dr", "Main", "é", "!", ",", ".", "-", "Way", "a"]), max_size=14).map("".join))
def test_wide_address(text):
    want = re.search(K.WIDE_STREET, text, re.ASCII)
    assert P.wide_address(text) == (want[1] if want else "")


def test_wide_address_is_linear():
    assert P.wide_address("12 a " * 200_000) == ""
    assert len(P.wide_address("12 a " * 200_000 + "St")) == 1_000_002


def test_further_pages(spark):
    html = '<a href="/list?page=2">2</a><div class="pager"><a href="/PAGE/3">3</a><a href="/other">4</a></div><a href="/Page/4">Load more</a><a href="/Page/5">five</a><a href="http://b.com/page/6">6</a><a href="/list?page=2">again</a><a>none</a>'
    pages = spark.createDataFrame([(1, "http://a.com/list", html), (2, None, html), (3, "http://a.com", None)], "page_id long, url string, html string")
    visited = spark.createDataFrame([("http://a.com/Page/4",)], "url string")
    got = P.further_pages(P.facts(pages).join(pages.select("page_id", "url"), "page_id"), visited)
    assert sorted(map(tuple, got.collect())) == [(1, "http://a.com/PAGE/3"), (1, "http://a.com/list?page=2")]
    assert P.further_pages(P.facts(pages).join(pages.select("page_id", "url"), "page_id"), visited.limit(0)).count() == 3


def test_place_anchors(spark):
    html = "<a href='/Locations/1'>a</a><a href=facility/2>b</a><a href=\"https://a.com/find-a-location\">c</a><a href=http://b.com/locations>d</a><a href=/about>e</a><a href='/locations/1'></a><a href='/Locations/1'>f</a>"
    pages = spark.createDataFrame([(1, "https://a.com/x/", html), (2, "https://a.com", None)], "page_id long, url string, html string")
    assert sorted(r.url for r in P.place_anchors(pages).collect()) == ["https://a.com/Locations/1", "https://a.com/find-a-location", "https://a.com/locations/1", "https://a.com/x/facility/2"]


def test_files(spark, tmp_path):
    assert tables.file_name("individual_facility", "csv", corporation_name="Oak & Sons/West", timestamp="2024-01-02") == "Oak___Sons_West_2024-01-02_facilities.csv"
    with pytest.raises(KeyError):
        tables.file_name("individual_facility", "csv", timestamp="x")
    (tmp_path / "u.txt").write_text(" # kept\n#gone\n\n a.com \n")
    assert [r.url for r in tables.read_urls(spark, str(tmp_path / "u.txt"), prefix=False).collect()] == ["# kept", "a.com"]
    assert [r.url for r in tables.read_urls(spark, str(tmp_path / "u.txt")).collect()] == ["https://a.com"]


def test_comparison(spark, tmp_path):
    runs = spark.createDataFrame([("b", "x", 3), ("a|c\nd", "x", 1), ("a|c\nd", "y", 2), ("b", "x", 4)], "approach string, company string, facilities long")
    table = S.pivot(runs, "approach", "company", ["x", "y"])
    want = ["| approach | x | y |", "|---|---|---|", r"| a\|c d | 1 | 2 |", "| b | 7 | 0 |"]
    assert [r.value for r in tables.markdown(table, "approach").orderBy("line").collect()] == want
    assert [r.value for r in tables.markdown(table.limit(0), "approach").orderBy("line").collect()] == want[:2]
    tables.write_comparison(table.where("approach = 'b'"), str(tmp_path / "c"), "approach")
    assert [r.value for r in spark.read.text(str(tmp_path / "c" / "markdown")).collect()] == [*want[:2], want[3]]
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "c" / "csv")).collect()] == [("b", "7", "0")]


def test_plan_chains(spark):
    chains = spark.createDataFrame([(f"c{i}", f"u{i}", i % 2) for i in range(5)], "corporation_name string, primary_url string, priority int")
    got = S.plan_chains(chains, "priority", "corporation_name", batch_size=2).orderBy("batch", "priority", "name").collect()
    assert [(r.batch, r.name) for r in got] == [(1, "c0"), (1, "c2"), (2, "c4"), (2, "c1"), (3, "c3")]
    assert S.plan_chains(chains.limit(0), "priority").count() == 0


def test_default_type(spark):
    items = spark.createDataFrame([(None, "a"), (" ", "b"), (" Home ", "c")], "facility_type string, name string").select(F.struct("*").alias("i"))
    for default, want in (("", ["", "", "Home"]), (K.OTHER_TYPE, [K.OTHER_TYPE, "", "Home"])):
        got = items.select(X.normalise(F.col("i"), ("facility_type", "name"), default).alias("r")).orderBy("r.name").collect()
        assert [r.r.facility_type for r in got] == want


def test_answers_told_twice(spark):
    """A second answer for an address or a URL doesn't double the record; the better one counts, whatever its place."""
    records = spark.createDataFrame([(1, "1 Main St", "https://a.com"), (2, "2 Oak St", "https://b.com")], "n int, address string, website string")
    places = [("1 Main St", "missing", None), ("1 Main St", "found", "z"), ("1 Main St", "found", "y"), ("2 Oak St", "odd", None), ("2 Oak St", "service_error", None)]
    fetches = [("https://a.com", 404, None, None, None), ("https://a.com", 200, None, "https://a.com/", "<title>A</title>"), ("https://a.com", None, "timeout", None, None), ("https://b.com", None, "other", None, None), ("https://b.com", None, "timeout", None, None)]
    for turn in (1, -1):
        found = O.with_geocodes(records, spark.createDataFrame(places[::turn], "address string, status string, formatted string"))
        assert {r.n: (r.corrected_address, round(r.address_check.confidence, 6)) for r in found.collect()} == {1: ("y", 0.85), 2: (None, 0.65)} and found.count() == 2
        seen = O.with_fetches(records, spark.createDataFrame(fetches[::turn], "url string, status_code int, error string, final_url string, html string"))
        assert {r.n: (r.title, r.website_check.is_valid) for r in seen.collect()} == {1: ("A", True), 2: (None, False)} and seen.count() == 2


def test_pages_are_spread(spark, tmp_path):
    """A table in one small file is worked on by more than one task."""
    spark.range(100).selectExpr("id AS c_custkey", "'Home ' || id AS c_name", "'none' AS c_mktsegment").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    df = QUERIES["plain_records"](spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 1 and df.count() == 90
