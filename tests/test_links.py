"""Links between alike records against a comparison of all pairs, over crowded blocks and small ones."""

import random

import pytest
from pyspark.sql import functions as F

from placelake.functions import urls as U
from placelake.operators import dedup as D


def some(seed: int, n: int):
    rng = random.Random(seed)
    street, name = ["1 Main Street", "1 Main Streets", "2 Main Street", "9 Oak Ave", "", None], ["Oak Home", "Oak Homes", "Oak House", "Elm Court Center", "Elm Court Centre", "", None]
    noise = lambda s: s and "".join(c if rng.random() < 0.9 else rng.choice("abZ") for c in s) + rng.choice(["", "", "x", "xyz"])
    rows = [(i, noise(rng.choice(name)) if rng.random() < 0.5 else rng.choice(name), noise(rng.choice(street)) if rng.random() < 0.3 else rng.choice(street), "Reno", "NV", rng.choice(["89501", "89501", "89502-1111", "", None]), rng.choice(["555-1", "555-1", "555-2", "", None])) for i in range(n)]
    return rows + [(n + i, *rows[i][1:]) for i in range(0, n, 7)]


@pytest.mark.parametrize("crowd", [0, 5, 64, 10**9])
def test_links(spark, crowd):
    rows = some(3, 240)
    digits = lambda s: "".join(c for c in s or "" if c.isdigit())
    plain = lambda s: "".join(c for c in (s or "").strip().lower() if c.isalnum() or c in "_ ")
    parts = [(digits(r[6]), (r[2] or "").lower(), plain(r[1]), (r[5] or "")[:5], None) for r in rows]

    def alike(a, b):
        s = (0.4 if a[0] and a[0] == b[0] else 0) + (0.1 if a[3] and a[3] == b[3] else 0)
        s += 0.3 if a[1] and a[1] == b[1] else 0.21 if D._match(a[1], b[1]) >= 0.8 else 0
        s += 0.2 if a[2] and a[2] == b[2] else 0.1 if D._match(a[2], b[2]) >= 0.7 else 0
        return round(s, 6) >= D.THRESHOLD

    want = {}
    for i, a in enumerate(parts):
        mates = [rows[j][0] for j, b in enumerate(parts) if j != i and alike(a, b)]
        want[rows[i][0]] = (len(mates), min(mates, default=None))
    df = spark.createDataFrame(rows, "ord long, name string, address string, city string, state string, zip_code string, phone string").repartition(3)
    got = {r.ord: (r.n_links, r.first_link) for r in D.links(df, "ord", crowd=crowd).collect()}
    assert got == want and sum(n > 0 for n, _ in want.values()) > 30
    assert D.links(df.limit(0), "ord", crowd=crowd).count() == 0


def test_one_phone_and_street(spark):
    """6,000 different names of one phone, street and postal code: 18 million pairs, of which few are compared."""
    df = spark.range(6_000).select(F.col("id").alias("ord"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 20).alias("name"), F.lit("1 Main").alias("address"), F.lit("x").alias("city"), F.lit("89501").alias("zip_code"), F.lit("555").alias("phone"))
    twin = df.where("ord < 10").withColumns({"ord": F.col("ord") + 6_000, "name": F.concat("name", F.lit("x"))})
    got = D.links(df.unionByName(twin), "ord")
    assert {(r.ord, r.n_links, r.first_link) for r in got.where("n_links > 0").collect()} == {(i, 1, i + 6_000) for i in range(10)} | {(i + 6_000, 1, i) for i in range(10)}


def test_resolve_without_base(spark):
    df = spark.createDataFrame([(None, "/a"), (None, "a"), (None, ""), (None, "?a"), (None, "http://b.org/a"), ("http://a.org", "/a")], "base string, href string")
    assert [r[0] for r in df.select(U.resolve(F.col("base"), F.col("href"))).collect()] == [None, None, None, None, "http://b.org/a", "http://a.org/a"]


@pytest.mark.parametrize("dense,tile", [(0, 10), (10**9, 7), (12, 5)])
def test_crowds_in_tiles(spark, dense, tile):
    """Crowded blocks give the same by tiles, by rare keys, and by both, as by all pairs."""
    df = spark.createDataFrame(some(4, 300), "ord long, name string, address string, city string, state string, zip_code string, phone string")
    got, want = (sorted(map(tuple, D.links(df, "ord", **how).collect())) for how in ({"crowd": 3, "dense": dense, "tile": tile}, {"crowd": 10**9}))
    assert got == want and sum(n > 0 for _, n, _ in want) > 30


def test_a_crowd_that_is_all_alike(spark):
    """12,000 records that are all alike, 144 million pairs: none of them becomes a row."""
    df = spark.range(12_000).select(F.col("id").alias("ord"), F.concat(F.lit("Customer of the house "), F.lpad(F.col("id").cast("string"), 5, "0")).alias("name"), F.lit("1 Main").alias("address"), F.lit("x").alias("city"), F.lit("89501").alias("zip_code"), F.lit("555").alias("phone"))
    got = D.links(df, "ord")
    assert got.groupBy("n_links").count().collect() == [(11_999, 12_000)] and got.where("first_link <> case when ord = 0 then 1 else 0 end").count() == 0
