"""Services' answers, repeated and broken records, URLs with dots and chunks; nulls, blanks and empty tables included."""

import re
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from placelake.functions import text as T
from placelake.functions import urls as U
from placelake.operators import catalog as C
from placelake.operators import outcomes as O
from placelake.sources import tables


def test_geocodes(spark):
    records = spark.createDataFrame([(1, "1 Main St"), (2, "1 Main St"), (3, "2 Oak Ave"), (4, ""), (5, None)], "n int, address string")
    places = spark.createDataFrame([("1 Main St", "found", "1 Main Street"), ("2 Oak Ave", None, None), ("", "found", "x"), (None, "found", "x")], "address string, status string, formatted string")
    # St counts as a state's code, as letters of either case do
    got = {r.n: (r.address_check.is_valid, round(r.address_check.confidence, 6)) for r in O.with_geocodes(records, places).collect()}
    assert got == {1: (True, 0.85), 2: (True, 0.85), 3: (False, 0.35), 4: (False, 0.0), 5: (False, 0.0)}
    assert {round(r.address_check.confidence, 6) for r in O.with_geocodes(records.where("n < 3"), places.limit(0)).collect()} == {0.65}


def test_fetches(spark):
    records = spark.createDataFrame([(1, "https://a.com"), (2, "https://b.com"), (3, "https://c.com"), (4, "https://d.com"), (5, "nothing"), (6, None)], "n int, website string")
    fetches = spark.createDataFrame([("https://a.com", 200, None, "https://a.com/", "<TITLE> A </TITLE>"), ("https://b.com", 404, None, None, None), ("https://c.com", None, "timeout", None, None)], "url string, status_code int, error string, final_url string, html string")
    got = {r.n: (r.website_check.is_valid, round(r.website_check.confidence, 6), r.title) for r in O.with_fetches(records, fetches).collect()}
    assert got == {1: (True, 0.925, "A"), 2: (False, 0.625, None), 3: (False, 0.575, None), 4: (False, 0.525, None), 5: (False, 0.1, None), 6: (False, 0.0, None)}


def test_repeats(spark):
    rows = [(1, "5", "7"), (2, "5", "7"), (3, "5", ""), (4, "5", ""), (5, None, "7"), (6, "5", "7"), (7, "6", "7")]
    df = spark.createDataFrame(rows, "n long, phone string, zip string")
    assert {r.n: r.duplicate_of for r in O.mark_repeats(df, "n", "phone", "zip").collect()} == {1: None, 2: 1, 3: None, 4: None, 5: None, 6: 1, 7: None}
    assert O.mark_repeats(df.limit(0), "n", "phone", "zip").count() == 0


def test_broken_records(spark):
    df = spark.createDataFrame([(1, '{"k": 1}'), (2, '{"k": 1'), (3, None), (4, '{"k": "x"}'), (5, "{}")], "n int, t string")
    x = O.read_records(df, "t", "k long")
    assert {r.n: r.broken for r in x.collect()} == {1: False, 2: True, 3: True, 4: True, 5: False}
    assert {r.n: (r.overall_confidence, r.flags) for r in O.error_report(x).collect()} == {n: (0.0, ["validation_error"]) for n in (2, 3, 4)}


@pytest.mark.parametrize("href", ["../x", "../../../x", "./x", ".", "..", "x/../y/", "x/./y", "/a/../b", "a..b/..c", "?q=../x", "x#../y", "https://z.org/a/../b", "../", "x//y/../z"])
def test_join(spark, href):
    base = "https://a.com/p/q/r.html"
    assert spark.range(1).select(U.resolve(F.lit(base), F.lit(href)).alias("x")).first().x == urljoin(base, href)


def test_chunks(spark):
    df = spark.createDataFrame([(1, " a b\tc\nd e "), (2, ""), (3, None), (4, "a b"), (5, "a b c d")], "n int, t string")
    got = {r.n: r.c for r in df.select("n", O.word_chunks(F.col("t"), 3, 1).alias("c")).collect()}
    assert got == {1: ["a b c", "c d e"], 2: [], 3: [], 4: ["a b"], 5: ["a b c", "c d"]}
    with pytest.raises(ValueError):
        O.word_chunks(F.col("t"), 2, 2)


def test_run_summary(spark, tmp_path):
    df = spark.createDataFrame([("A", None, None, None, None, None, None, ["x", "y"])], "corporation_name string, url string, facilities_count int, success boolean, scraping_date string, processing_time_minutes double, error string, files array<string>")
    tables.write_summary(O.run_summary(df), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().asDict() == {"corporation_name": "A", "url_scraped": "", "facilities_found": 0, "scraping_success": False, "scraping_date": "", "processing_time_minutes": 0.0, "error_message": "", "output_files": "x|y"}
    assert O.rates(spark.createDataFrame([], "overall_confidence double, flags array<string>")).first().flagged_rate == 0.0


def test_sizes(spark):
    assert C.sizes(spark.range(1000)).first() == (1000, False, False, False)
    assert C.sizes(spark.range(1001), 50.1).first() == (1001, True, False, True)
    assert C.sizes(spark.range(10001).limit(0), 50.0).first() == (0, False, False, False)


def test_batch_summary(spark):
    chains = spark.createDataFrame([("a", 1), ("b", 1), (None, 1), ("c", 2)], "k string, batch int")
    found = spark.createDataFrame([("a",), ("a",), (None,), ("z",)], "k string")
    got = C.results(chains, found, "k")
    assert {r.k: (r.facilities_count, r.success) for r in got.collect()} == {"a": (2, True), "b": (0, False), None: (0, False), "c": (0, False)}
    assert sorted(map(tuple, C.batch_summary(got).collect())) == [(1, 3, 1, 2, 2), (2, 1, 0, 1, 0)]
    assert C.batch_summary(C.results(chains.limit(0), found, "k")).count() == 0


def test_confident(spark):
    rows = [(1, "a", 0.9), (2, "a", 0.8), (3, "", 0.9), (4, None, 0.9), (5, "a", None), (6, " ", 0.81)]
    assert sorted(r.n for r in O.confident(spark.createDataFrame(rows, "n int, name string, confidence double")).collect()) == [1, 6]


def test_keyword_score(spark):
    rows = [("The other, the THEME",), ("a+b a+b",), ("none",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in df.select(T.keyword_score(F.col("t"), "the")).collect()] == [8, 0, 0, 0, 0]
    assert [r[0] for r in df.select(T.keyword_score(F.col("t"), "a+b")).collect()] == [0, 6, 0, 0, 0]


def test_best_type_in_one_pass(spark):
    """As the sum of its keywords' scores; the first of equal types, '' without any."""
    lexicon = {"a": ("the", "the end", "+x"), "b": ("end", "é"), "c": ()}
    texts = ["The end. then +x y+x", "end end", "é bé éé", "nothing", "", None, "lend the-end", "the " * 5 + "end " * 15]

    def score(low, w):
        return low.count(w) + 2 * len(re.findall(rf"\b{re.escape(w)}\b", low))

    def want(t):
        scores = [sum(score((t or "").lower(), w) for w in ws) for ws in lexicon.values()]
        return list(lexicon)[scores.index(max(scores))] if max(scores) else ""

    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert [r[0] for r in df.select(T.best_type(F.col("t"), lexicon)).collect()] == [want(t) for t in texts]
