"""Sinks, workbooks, streams and summaries on small inputs, empty ones included."""

import json
import os
import xml.etree.ElementTree as ET
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from placelake.operators import dedup as D
from placelake.operators import links as L
from placelake.operators import summaries as S
from placelake.sources import tables
from placelake.sources.workbook import write_workbook
from placelake.streaming.dedup import drop_alike, drop_repeats, drop_visited


def test_write_run(spark, tmp_path):
    a, b = spark.createDataFrame([(1, ["x", "y"])], "n int, l array<string>"), spark.range(0)
    tables.write_run(str(tmp_path / "run"), "2026-01-01", facilities=a, validation_reports=b)
    rows = spark.read.json(str(tmp_path / "run" / "summary")).collect()
    assert {r.table: (r.n, r.generation_date) for r in rows} == {"facilities": (1, "2026-01-01"), "validation_reports": (0, "2026-01-01")}
    assert spark.read.json(str(tmp_path / "run" / "facilities")).first().l == ["x", "y"]


def test_consolidate(spark):
    a, b = spark.createDataFrame([(1, "x")], "n int, s string"), spark.createDataFrame([(2, (3, ["q"]))], "n int, t struct<u: int, v: array<string>>")
    flat = tables.nested_flat(tables.consolidate([a, b]))
    assert flat.columns == ["n", "s", "t.u", "t.v"]
    assert sorted(tuple(r) for r in flat.fillna({"s": "", "`t.u`": 0}).collect() if r.n == 2) == [(2, "", 3, '["q"]')]


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "w.xlsx")
    df = spark.createDataFrame([("a<b>&\x01", 1.5, True, ["p", "", "q"]), (None, None, None, None)], "s string, d double, b boolean, l array<string>")
    write_workbook(path, {"Facilities": df, 'Sum "x"': df.limit(0)})
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            ET.fromstring(z.read(name))
        ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
        cells = [["".join(c.itertext()) for c in row] for row in ET.fromstring(z.read("xl/worksheets/sheet1.xml")).iterfind(".//m:row", ns)]
        assert cells == [["s", "d", "b", "l"], ["a<b>&", "1.5", "1", "p | q"], ["", "", "", ""]]
        assert len(ET.fromstring(z.read("xl/worksheets/sheet2.xml")).findall(".//m:row", ns)) == 1
    with pytest.raises(ValueError):
        write_workbook(path, {"x": spark.range(1).select(F.repeat(F.lit("x"), 40000).alias("s"))})


def test_write(spark, tmp_path):
    tables.write(spark.createDataFrame([(1, ["x", "", "y"])], "k int, l array<string>"), str(tmp_path / "c"), "csv", partition_by=("k",))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().l == "x | y"
    with pytest.raises(ValueError):
        tables.write(spark.range(1), str(tmp_path / "d"), "xml")


RECORDS = [
    {"ord": 1, "name": "Sunny Acres", "address": "100 Main St", "city": None, "phone": "5551234567", "zip_code": "62701"},
    {"ord": 2, "name": "Sunny Acre", "address": "100 Main St", "city": None, "phone": "555-123-4567", "zip_code": "62701"},
    {"ord": 3, "name": "Other Place", "address": "9 Elm Rd", "city": None, "phone": "5551234567", "zip_code": "62701"},
    {"ord": 4, "name": None, "address": None, "city": None, "phone": None, "zip_code": None},
    {"ord": 5, "name": None, "address": None, "city": None, "phone": None, "zip_code": None},
]
SCHEMA = "ord int, name string, address string, city string, phone string, zip_code string, at timestamp"


def _stream(spark, folder, rows):
    folder.mkdir()
    for i, row in enumerate(rows):
        (folder / f"{i}.json").write_text(json.dumps(row | {"at": "2026-01-01T00:00:00"}))
        os.utime(folder / f"{i}.json", (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).json(str(folder))


def _drain(spark, stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    stream = _stream(spark, tmp_path / "in", RECORDS)
    assert sorted(r.ord for r in _drain(spark, drop_alike(stream, "ord", "at"), "alike")) == [1, 3, 4]
    assert sorted(r.ord for r in _drain(spark, drop_repeats(stream, "at"), "repeats")) == [1, 2, 3, 4]
    assert len(_drain(spark, drop_visited(stream, "at", "zip_code"), "visited")) == 2


def test_greedy_index(spark):
    """Of many records of one phone the indexed scan keeps what a scan over all kept ones keeps."""
    rows = [(i, f"Name {i % 7}{i % 3}", f"{i % 5} Main St", "5552010000", f"{i % 2}1111", None) for i in range(200)]
    df = spark.createDataFrame(rows, "ord int, name string, address string, phone string, zip_code string, city string")
    got = {r.ord: r.is_duplicate for r in D.greedy(df, "ord").collect()}
    kept: list = []
    for i, name, address, phone, zip_code, _ in rows:
        now = (phone, address.lower(), name.lower(), zip_code, f"{address.lower()}|{zip_code}")
        dup = any(D.records_alike(now, k) for k in kept)
        assert got[i] == dup
        kept += [] if dup else [now]


def test_summaries(spark):
    empty = spark.createDataFrame([], "success boolean, facilities long, seconds double, method string, site string")
    assert tuple(S.runs(empty).first()) == (0, 0, 0, 0, 0.0, 0.0, 0.0)
    assert tuple(S.method_rates(empty, {"a": "x"}).first()) == (0, 0, 0.0)
    runs = spark.createDataFrame([(True, 4, 2.0, "a", "s"), (True, 6, 1.0, "b", "s"), (True, 0, 1.0, "a", "t"), (False, 9, 3.0, "b", "t")], empty.schema)
    assert tuple(S.runs(runs).first()) == (4, 3, 1, 10, 0.75, 2.5, 1.75)
    got = {r.site: (r.improvement, r.seconds_more) for r in S.compare(runs, "a", "b", "site").collect()}
    assert got == {"s": (50.0, -1.0), "t": (None, None)}


def test_frontier(spark):
    df = spark.createDataFrame([("a", 1), ("b", 5), ("b", 2), ("c", 5), ("d", 9)], "url string, score int")
    assert [r.url for r in L.next_best(df, df.where("url = 'd'"), 2).collect()] == ["b", "c"]


def test_cache_lookup(spark):
    cache = spark.createDataFrame([("x", "old", datetime(2026, 1, 1)), ("x", "new", datetime(2026, 1, 9)), ("y", "old", datetime(2026, 1, 1))], "domain string, schema string, created timestamp")
    asked = spark.createDataFrame([("x",), ("y",), ("z",)], "domain string")
    assert {r.domain: r.schema for r in S.cached(asked, cache, F.expr("timestamp '2026-01-10'")).collect()} == {"x": "new", "y": None, "z": None}
