"""The batch driver: runs that are killed, chains that fail, catalogs that change."""

import pytest
from placelake.operators import batches as B
from pyspark.sql import functions as F

CHAIN = "corporation_name string, primary_url string, facility_types string, priority int, estimated_facilities string"
RECORD = "corporation_name string, place string"


def chains(spark, n=11):
    return spark.createDataFrame([(f"c{i:02d}", f"https://c{i}.org", "a | b||", 1 + i % 4, f"{i}+") for i in range(n)], CHAIN)


def extract(calls, killed=None):
    def run(batch):
        names = sorted(r[0] for r in batch.select("corporation_name").collect())
        calls.append(names)
        if killed in names:
            raise KeyboardInterrupt
        place = F.when(F.col("corporation_name") == "c05", F.raise_error(F.lit("no answer"))).otherwise(F.concat("corporation_name", F.lit("-"), "k"))
        return batch.where("corporation_name <> 'c07'").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(2)))).select("corporation_name", place.alias("place"))

    return run


def state(spark, folder):
    rows = {r.corporation_name: r for r in B.results(spark, folder).collect()}
    return rows, sorted(r.place for r in B.records(spark, folder, RECORD).collect())


def test_killed_and_resumed(spark, tmp_path):
    folder, calls = str(tmp_path), []
    with pytest.raises(KeyboardInterrupt):
        B.run(chains(spark), extract(calls, "c06"), folder, 3, order=("corporation_name",))
    assert len(B.results(spark, folder).collect()) == 6
    # what a kill in the middle of a write would leave
    chains(spark).select("corporation_name", F.lit("half").alias("place")).write.parquet(f"{folder}/facilities/batch=3")
    calls.clear()
    assert B.run(chains(spark), extract(calls), folder, 3, order=("corporation_name",)) == [3, 4]
    assert calls == [["c06", "c07", "c08"], ["c09", "c10"]]
    rows, places = state(spark, folder)
    assert len(rows) == 11 and places == sorted(f"c{i:02d}-{k}" for i in range(11) if i not in (5, 7) for k in (1, 2))
    assert {n: r.error is not None for n, r in rows.items() if not r.success} == {"c05": True, "c07": False} and "no answer" in rows["c05"].error
    assert rows["c04"].facility_types == ["a", "b"] and (rows["c04"].priority, rows["c04"].estimated_facilities, rows["c04"].facilities_count, rows["c04"].batch_number) == (1, "4+", 2, 2)
    assert B.run(chains(spark), extract(calls), folder, 3, order=("corporation_name",)) == []
    assert B.run(chains(spark, 12), extract(calls), folder, 3, order=("corporation_name",)) == [4]  # a chain more in the last batch
    assert len(state(spark, folder)[0]) == 12


def test_plan(spark):
    got = sorted((r.batch_number, r.priority, r.corporation_name) for r in B.plan(chains(spark), 4, 2).collect())
    assert [x[0] for x in got] == [1, 1, 1, 1, 2, 2] and got == sorted(got, key=lambda x: (x[1], x[2]))
    assert B.plan(chains(spark).limit(0), 4).count() == 0 and B.run(chains(spark).limit(0), extract([]), "unused") == []


def test_stream(spark, tmp_path):
    folder, source, calls = str(tmp_path / "out"), tmp_path / "in", []

    def go(part):
        part.coalesce(1).write.mode("append").parquet(str(source))
        q = B.stream(spark.readStream.schema(CHAIN).parquet(str(source)), extract(calls), folder, str(tmp_path / "at"))
        assert q.awaitTermination(60)

    first = chains(spark, 4)
    assert B.process(first, 0, extract(calls), folder)  # as if the stream had died before it could note the batch
    go(first)
    assert len(calls) == 1
    go(chains(spark).where("corporation_name >= 'c04' and corporation_name < 'c09'"))
    go(chains(spark).where("corporation_name >= 'c09'"))
    rows, places = state(spark, folder)
    assert len(rows) == 11 and len(places) == len(set(places)) == 18


def test_passes(spark, tmp_path):
    """Few passes do what a pass per batch does, with chains that fail, resumed runs and names that several batches have."""
    def kept(calls):
        run = extract(calls)

        def both(batch):
            out = run(batch.drop("batch_number"))
            return out.join(batch.select("corporation_name", "batch_number").distinct(), "corporation_name") if "batch_number" in batch.columns else out

        return both

    fine = chains(spark).where("corporation_name <> 'c05'")
    for df, most in ((fine, 2), (chains(spark), 100)):
        one, more, calls = str(tmp_path / f"one{most}"), str(tmp_path / f"more{most}"), []
        numbers = B.run(df, extract([]), one, 3, order=("corporation_name",))
        assert B.run(df, kept(calls), more, 3, order=("corporation_name",), passes=2) == numbers and len(calls) <= most
        (a, x), (b, y) = state(spark, one), state(spark, more)
        plain = lambda rows: {n: (r.url, r.facilities_count, r.success, r.error is None, r.batch_number) for n, r in rows.items()}
        assert plain(a) == plain(b) and x == y
        assert B.run(df, kept(calls), more, 3, order=("corporation_name",), passes=2) == []
    assert B.run(chains(spark, 12), kept(calls), more, 3, order=("corporation_name",), passes=2) == [4]
