"""Numbering plans: the longest prefix wins, and what a report makes of a mobile number."""

from placelake.operators import numbering as N
from placelake.operators import validate as V


def test_longest_prefix(spark):
    plans = spark.createDataFrame([("1", "fixed line", "US", None), ("1415", "fixed line", "California", "a"), ("1415555", "mobile", "San Francisco", "b"), ("44", "fixed line", "UK", None), ("447", "mobile", "UK", "c"), ("447", "pager", "UK", "d"), ("x4", "mobile", "no", "no"), (None, "mobile", "no", "no")], N.PLAN)
    phones = ["(415) 555-2671", "415.444.2671", "1 212 444 2671", "+44 7911 123456", "0044 20 7946 0958", "+33 1 42 68 53 00", "12345", "", None, "(415) 555-2671"]
    df = spark.createDataFrame([(i, p, "r") for i, p in enumerate(phones)], "i int, phone string, row string").repartition(3)
    got = {r.i: (r.number_type, r.location, r.carrier) for r in N.with_plan(df, plans).collect()}
    mobile = ("mobile", "San Francisco", "b")
    assert got == {0: mobile, 1: ("fixed line", "California", "a"), 2: ("fixed line", "US", None), 3: ("mobile", "UK", "c"), 4: ("fixed line", "UK", None), 5: (None,) * 3, 6: (None,) * 3, 7: (None,) * 3, 8: (None,) * 3, 9: mobile}
    assert {r.number_type for r in N.with_plan(df, plans.limit(0)).collect()} == {None} and N.with_plan(df.limit(0), plans).count() == 0


def test_mobile_flag(spark):
    rows = [(1, "(415) 555-2671", "mobile"), (2, "(415) 555-2671", "fixed line"), (3, "", "mobile"), (4, "4155", "mobile"), (5, "(415) 555-2671", None)]
    df = spark.createDataFrame([(i, p, t, "", "", "", "", "", "") for i, p, t in rows], "i int, phone string, number_type string, address string, city string, state string, zip_code string, website string, email string")
    got = {r.i: (list(r.flags), [round(f.confidence, 4) for f in r.field_validations]) for r in V.report(df).collect()}
    assert got == {1: (["mobile_phone_number"], [0.76]), 2: ([], [0.95]), 3: ([], []), 4: (["invalid_phone_format"], [0.24]), 5: ([], [0.95])}
    plain = {r.i: list(r.flags) for r in V.report(df.drop("number_type")).collect()}
    assert plain == {1: [], 2: [], 3: [], 4: ["invalid_phone_format"], 5: []}
