"""Golden cases of the column builders, SQL parity of the queries and a sequential model of the greedy scan."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from placelake.functions import text as T
from placelake.functions import urls as U
from placelake.functions import dom
from placelake.operators import catalog as C
from placelake.operators import dedup as D
from placelake.operators import links as L
from placelake.plans.queries import ORACLE_SQL, QUERIES
from placelake.sources import sitemaps, tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("555.123.4567", "(555) 123-4567"), ("1-555-123-4567", "(555) 123-4567"), ("+1 555 123 4567", "+15551234567"), ("12345", "12345"), ("", "")])
def test_clean_phone(spark, raw, want):
    assert one(spark, T.clean_phone(F.lit(raw))) == want


@pytest.mark.parametrize(("raw", "want"), [("Texas", "TX"), (" tx ", "TX"), ("Puerto Rico", "PUERTO RICO")])
def test_state(spark, raw, want):
    assert one(spark, T.state(F.lit(raw))) == want


@pytest.mark.parametrize(("path", "want"), [("/locations/tx/austin/", 24), ("/careers/", -62), ("/our-communities/?page=2", 29), ("/a.pdf", -82), ("/a/b/c/d", -100), ("/contact-us/", -7), ("/find-a-location", 23), ("/tours", 1)])
def test_score(spark, path, want):
    assert one(spark, U.score(F.lit(f"https://x.com{path}"), F.lit("https://x.com"))) == want


def test_text(spark):
    assert one(spark, T.title(F.lit("Oak Manor | Corp - X"))) == "Oak Manor"
    assert one(spark, T.keyword_score(F.lit("sunny memory care offers memory care and memory cares"), "memory care")) == 7
    assert [one(spark, T.first_integer(F.lit(x))) for x in ("200+", "100-150", "n/a")] == [200, 100, None]
    assert tuple(one(spark, T.city_state_zip(F.lit("Reno, NV 89501-1234")))) == ("Reno", "NV", "89501-1234")
    assert one(spark, U.maps_address(F.lit("https://maps.google.com/?q=1+Main+St&z=3"))) == "1 Main St"
    assert round(one(spark, T.positional_match(F.lit("100 main st"), F.lit("100 main st."))), 6) == 0.916667
    assert one(spark, T.positional_match(F.lit(""), F.lit("x"))) == 0.0


def test_pieces(spark):
    assert one(spark, C.pieces(F.lit(" 0a | b1 |  | 2"))) == ["0a", "b1", "2"]


def test_css():
    root = dom.parse('<div class="facility-card a"><h2>Oak</h2><a href="tel:1">x</a><ul><li>one<li>two</ul></div><p>no')
    assert [x.text() for x in dom.select(root, ".facility-card li")] == ["one", "two"]
    assert [x.attrs["href"] for x in dom.select(root, 'a[href^="tel:"], h9')] == ["tel:1"]


def test_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_text("corporation_name,primary_url,priority\nA, a.com ,1\nB,b.com,\n,c.com,1\n")
    assert [r.primary_url for r in tables.read_catalog(spark, str(tmp_path / "c.csv")).collect()] == ["a.com"]
    assert tables.read_catalog(spark, str(tmp_path / "c.csv"), strict=False).count() == 2
    (tmp_path / "u.txt").write_text("# no\n\n a.com \nhttp://b.com\n")
    assert [r.url for r in tables.read_urls(spark, str(tmp_path / "u.txt")).collect()] == ["https://a.com", "http://b.com"]
    robots = spark.createDataFrame([("User-agent: *\nSITEMAP: https://x.com/s.xml\n",)], "robots string")
    assert [r.url for r in sitemaps.robots_sitemaps(robots).collect()] == ["https://x.com/s.xml"]


def test_greedy(spark):
    rows = [(1, "Sunny Acres", "100 Main St", "5551234567", "62701"), (2, "Sunny Acres", "100 Main St.", "555-123-4567", "62701"), (3, "Sunny Acre", "100 Main St.", "5551234567", "62701"), (4, None, None, None, None), (5, None, None, None, None)]
    df = spark.createDataFrame(rows, "ord int, name string, address string, phone string, zip_code string").withColumn("city", F.lit(None).cast("string"))
    got = {r.ord: r.is_duplicate for r in D.greedy(df, "ord").collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: True}
    assert D.greedy(df.limit(0), "ord").count() == 0


def test_key_dedup_first(spark, tmp_path):
    opening = "The same opening of more than forty characters, "
    rows = [(1, opening + "then one"), (2, opening + "then two"), (3, opening.upper() + "THEN ONE"), (4, None), (5, None), (6, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r.doc_id for r in QUERIES["key_dedup_first"](spark, str(tmp_path)).collect()) == [1, 2, 4, 6]


def test_similarity_links(spark, tmp_path):
    ids = [1, 3, 41, 201, 281, 1401, 2001, 14001]  # of one phone but for 3, most of them 200 and more apart
    rows = [(i, f"Customer#{i:09d}", "BUILDING") for i in ids]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))

    def likeness(a, b):
        x, y = (f"{k % 50} main st" for k in (a, b))
        p, q = (f"customer{k:09d}" for k in (a, b))
        s = 0.4 + (0.3 if x == y else 0.21 if D._match(x, y) >= 0.8 else 0) + (0.1 if D._match(p, q) >= 0.7 else 0)
        return round(s + (0.1 if a % 7 == b % 7 else 0), 6)

    alike = {a: [b for b in ids if a != b and a % 40 == b % 40 and likeness(a, b) >= 0.85] for a in ids}
    got = {r.ord: (r.n_links, r.first_link) for r in QUERIES["similarity_links"](spark, str(tmp_path)).collect()}
    assert got == {a: (len(x), min(x, default=None)) for a, x in alike.items()} and sum(n for n, _ in got.values()) >= 4


def test_links_between_copies(spark):
    rows = [(1, "A", "1 Main St", "75001", "555-1"), (2, "A", "1 main st", "75001", "5551"), (3, "B", "1 Main St", "75001", "555-1"), (4, "A", "1 Main St", "75001", ""), (5, None, None, None, None), (6, None, None, None, "555-9"), (7, None, None, None, "555-9")]
    df = spark.createDataFrame(rows, "ord long, name string, address string, zip_code string, phone string").withColumn("city", F.lit("x"))
    got = {r.ord: (r.n_links, r.first_link) for r in D.links(df, "ord", 0.85).collect()}
    assert got == {1: (1, 2), 2: (1, 1), 3: (0, None), 4: (0, None), 5: (0, None), 6: (0, None), 7: (0, None)}
    assert D.links(df.limit(0), "ord").count() == 0


def test_reach(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src int, dst int")
    got = {r.url: r.depth for r in L.reach(edges, spark.createDataFrame([(1,)], "url int"), 3).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    show = lambda row: tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in row)
    assert sorted(map(show, got.select(columns).collect())) == sorted(map(show, want.project(", ".join(f'"{c}"' for c in columns)).fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
