"""The cache with expiry: in batch against brute force, and as a stream that is stopped and started again."""

import datetime as dt
import random

import pytest
from placelake.streaming import cache as C

SCHEMA = "domain string, request string, at timestamp, schema string"
START = dt.datetime(2024, 1, 1)


def at(hours):
    return START + dt.timedelta(hours=hours)


def test_lookups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "c"]), f"r{i}", at(rng.randint(0, 60)), rng.choice([None, None, "x", "y"])) for i in range(400)]
    rows += [(None, "n", at(1), None), ("a", "n", None, "x"), ("z", "only", at(1), None)]
    want = []
    for d, r, t, s in rows:
        if s is None and d and t:
            e = max(((b, c) for a, _, b, c in rows if a == d and c and b and b <= t), default=None)
            good = e is not None and t - e[0] < dt.timedelta(hours=5)
            want.append((d, r, t, e[1] if good else None, e[0] if good else None, "hit" if good else "miss"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, C.lookups(df, 5).collect()), key=repr) == sorted(want, key=repr)
    assert C.lookups(df.limit(0)).count() == 0


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    C.use_rocks(spark)
    yield
    spark.conf.set(name, old)


def test_stream_restarts_and_expires(spark, rocks, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    n = 0

    def go(*rows):
        nonlocal n
        n += 1
        spark.createDataFrame([(d, r, at(h), s) for d, r, h, s in rows], SCHEMA).coalesce(1).write.parquet(f"{source}/{n:03d}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(source))
        answers = C.serve(stream, hours=10, delay="1 hour")
        q = answers.writeStream.option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(out))
        assert q.awaitTermination(120)
        rows = spark.read.schema(C.ANSWER).parquet(str(out)).collect()
        return sorted((r.domain, r.request or "", r.status, r.schema or "") for r in rows)

    seen = go(("a", "r1", 1, None), ("a", "", 2, "one"), ("a", "r2", 3, None), ("b", "r3", 3, None))
    assert seen == [("a", "r1", "miss", ""), ("a", "r2", "hit", "one"), ("b", "r3", "miss", "")]
    seen = go(("a", "r4", 11, None), ("a", "", 2, "late"), ("b", "", 4, "two"), ("b", "r5", 4, None))  # a new query goes on where the last one stopped
    assert ("a", "r4", "hit", "one") in seen and ("b", "r5", "hit", "two") in seen
    seen = go(("a", "r6", 12.5, None), ("c", "", 40, "three"))  # one is ten hours old; the watermark then passes two's end as well
    assert ("a", "r6", "miss", "") in seen
    seen = go(("c", "r7", 41, None))
    assert ("a", "", "expired", "one") in seen and ("b", "", "expired", "two") in seen and ("c", "r7", "hit", "three") in seen
    assert sum(s[2] == "expired" for s in seen) == 2
