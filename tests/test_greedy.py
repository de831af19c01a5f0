"""The greedy scan by rounds against the scan as it is told, one record after the other."""

import random
import time

import pytest
from placelake.operators import dedup as D

SCHEMA = "ord long, name string, phone string, address string, city string, zip_code string, n int"


def records(seed, n, phones=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        name = "".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) if rng.random() < 0.6 else rng.choice(["Oak House", "Oak Hause", "Elm", ""])
        street = f"{rng.randint(1, 30)} {rng.choice(['Main St', 'Maine St', 'main st', 'Elm Rd'])}" if rng.random() < 0.8 else rng.choice(["", None])
        out.append((i, name, rng.choice([f"555-{rng.randrange(phones):04d}", f"555-{rng.randrange(phones):04d}", "", None]), street, rng.choice(["A", "B", None]), rng.choice(["12345", "12345-1", "9", None]), 1))
    return out


def scan(rows, threshold=D.THRESHOLD, window=None):
    """As the method tells it: exact repeats of anything kept, and likeness to the last ``window`` kept."""
    kept, sigs, dups = [], set(), {}
    for o, name, phone, address, city, zip_code, _ in sorted(rows):
        digits = "".join(c for c in phone or "" if c.isdigit())
        parts = "|".join(p for p in ((x or "").strip().lower() for x in (address, city, zip_code)) if p)
        plain = "".join(c for c in (name or "").strip().lower() if c.isalnum() or c in "_ ")
        now = (digits, (address or "").lower(), plain, (zip_code or "")[:5], parts)
        mine = {("f", digits, parts, plain)} | ({("a", digits, parts)} if digits and parts else set())
        dup = bool(mine & sigs)
        for k in (kept if window is None else kept[-window:]) if not dup else ():
            s = (0.4 if now[0] and now[0] == k[0] else 0) + (0.1 if now[3] and now[3] == k[3] else 0)
            s += 0.3 if now[1] and now[1] == k[1] else 0.21 if D._match(now[1], k[1]) >= 0.8 else 0
            s += 0.2 if now[2] and now[2] == k[2] else 0.1 if D._match(now[2], k[2]) >= 0.7 else 0
            if round(s, 6) >= threshold:
                dup = True
                break
        if not dup:
            kept.append(now)
            sigs |= mine
        dups[o] = dup
    return dups


@pytest.mark.parametrize("small, n", [(0, 400), (50, 400), (10**6, 400)])
def test_rounds(spark, small, n):
    rows = records(small % 7, n)
    got = {r.ord: r.is_duplicate for r in D.greedy(spark.createDataFrame(rows, SCHEMA).repartition(3), "ord", small=small).collect()}
    assert got == scan(rows)


def test_many(spark):
    rows = records(11, 10000, phones=40)
    out = D.greedy(spark.createDataFrame(rows, SCHEMA).repartition(4), "ord", small=500)
    assert {r.ord: r.is_duplicate for r in out.collect()} == scan(rows)


@pytest.mark.parametrize("window", [1, 5])
def test_window(spark, window):
    rows = records(window, 250, phones=2)
    got = {r.ord: r.is_duplicate for r in D.greedy(spark.createDataFrame(rows, SCHEMA), "ord", window=window, small=0).collect()}
    assert got == scan(rows, window=window) != scan(rows)


def test_ties_and_copies(spark):
    rows = [(1, "A", "555", "1 Main St", "X", "12345", i) for i in range(5)] + [(1, "B", "556", "1 Main St", "X", "12345", 9), (None, None, None, None, None, None, 1), (None, None, None, None, None, None, 2)]
    out = D.greedy(spark.createDataFrame(rows, SCHEMA), "ord", small=0).collect()
    assert len(out) == len(rows) and sum(not r.is_duplicate for r in out) == 3
    assert D.greedy(spark.createDataFrame([], SCHEMA), "ord", small=0).count() == 0
    low = records(3, 120)
    assert {r.ord: r.is_duplicate for r in D.greedy(spark.createDataFrame(low, SCHEMA), "ord", threshold=0.75).collect()} == scan(low, 0.75)


def test_one_phone(spark):
    """One phone and name, no street: no pairs are made, and twice the records take about twice the time."""
    took = []
    for n in (20000, 40000):
        df = spark.range(n).selectExpr("id AS ord", "'Oak House' AS name", "'555-0100' AS phone", "'' AS address", f"concat('C', id % {n // 2}) AS city", "'' AS zip_code", "1 AS n")
        began = time.time()
        out = D.greedy(df, "ord")
        assert out.where("not is_duplicate").count() == n // 2
        took.append(time.time() - began)
    assert took[1] < 3 * took[0] + 5
