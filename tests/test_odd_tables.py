"""Queries against their SQL over small tables with what the test tables of small sizes lack."""

import duckdb
from placelake.plans.queries import ORACLE_SQL, QUERIES


def both(spark, folder, name, table, rows, schema):
    """The rows of a query and those of its SQL over a table of ``rows``."""
    path = f"{folder}/{table}.parquet"
    spark.createDataFrame(rows, schema).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got, want = (sorted(map(repr, map(tuple, r))) for r in (QUERIES[name](spark, str(folder)).collect(), con.execute(ORACLE_SQL[name]).fetchall()))
    return got, want


def test_capitals(spark, tmp_path):
    """Letters whose capitals are several characters keep one each, all letters there are among them."""
    letters = [chr(i) for i in range(0xA1, 0x2100) if chr(i).isalpha() and chr(i) not in "ƛɤ"]  # whose capitals are newer than DuckDB's tables
    texts = [f"1 Weg\nim, Stra{c}e 12345" for c in (*letters, "ß", "ﬁ", "ẞ", "ᾳ", "ﬀß")] + ["x, ßß 12345", None]
    got, want = both(spark, tmp_path, "address_parse", "documents", list(enumerate(texts)), "doc_id long, text string")
    assert [x for x in zip(got, want) if x[0] != x[1]] == [] and any("STRAẞE" in x for x in got)


def test_words_after_accents(spark, tmp_path):
    """Words end at letters with accents."""
    texts = ["éle", "éle éle the", "leé the", "the of", "İNG", "theé le die", "", "ging", "xle le_ le1"]
    got, want = both(spark, tmp_path, "keyword_classify", "documents", list(enumerate(texts)), "doc_id long, text string")
    assert [x for x in zip(got, want) if x[0] != x[1]] == [] and "(1, 'other')" in got


def test_pages_of_one_address(spark, tmp_path):
    """Of pages with one URL each has its own response."""
    rows = [(1, "http://a.org/1", "<title>one</title>"), (2, "http://a.org/1", "<title>other</title>"), (3, "http://a.org/en/1", "x"), (4, "http://a.org/en/1", "yy"), (5, "http://a.org/de/1", "x"), (6, "http://B.org/2", "ß")]
    got, want = both(spark, tmp_path, "fetched_pages", "pages", rows, "page_id long, url string, html string")
    assert got == want and len(got) == 5


def test_checks_of_one_address(spark, tmp_path):
    """Of pages with one URL each is judged by its own fetch."""
    rows = [(i, f"http://a.org/{i // 4}", f"<title> no {i} </title>") for i in range(20)] + [(20, "no url", "<title>x</title>"), (21, "no url", None), (25, "", "<title>x</title>")]
    rows = [r for r in rows if r[1]]
    got, want = both(spark, tmp_path, "website_reachability", "pages", rows, "page_id long, url string, html string")
    assert got == want and len(got) == 22
