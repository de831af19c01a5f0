"""What the search for near-duplicates asks of the driver, and the components that it is made of."""

import glob
import random

import corpus_pipeline
from placelake.llm.components import components
from placelake.llm.shared import checkpoint, shared_dir

SF = "/root/testdata/sf0.001"
MOST_JOBS = 105
MOST_TASKS = 620


def test_jobs_and_tables(spark):
    """The driver keeps plans, metrics and threads for every job, so their number is bounded; tables that no later step reads are gone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/placelake-*"))
    spark.sparkContext.setJobGroup("near", "near")
    try:
        corpus_pipeline.near_dedup(spark, docs, SF)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("near"))
    assert 0 < jobs <= MOST_JOBS
    assert {f.rsplit("/placelake-")[1].split("-")[0] for f in set(glob.glob(f"{folder}/placelake-*")) - before} <= {"sketches", "groups"}


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(40)]
    hub = [(100, i) for i in range(101, 130)]
    loose = [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    links = [*chain, *hub, *loose, (7, 7), (500, 500), (41, 40), (40, 41)]
    root = {v: v for link in links for v in link}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = components(checkpoint(spark.createDataFrame(links, "a long, b long"))).collect()
    assert sorted((r.v, r.root) for r in got) == sorted((v, find(v)) for v in root if find(v) != v)
    assert components(checkpoint(spark.createDataFrame([], "a long, b long"))).isEmpty()


def test_few_rows_in_many_partitions(spark):
    """The driver keeps the metrics of every task: what a round leaves is read in few of them, however many partitions it was made in."""
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    links = checkpoint(spark.createDataFrame([(1, 2), (2, 3), (5, 4)], "a long, b long"))
    for k, v in held.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup("stars", "stars")
    try:
        got = components(links)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted((r.v, r.root) for r in got.collect()) == [(2, 1), (3, 1), (5, 4)]
    assert got.rdd.getNumPartitions() < 20
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("stars")]
    stages = {s for j in jobs for s in j.stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))
    print("stars", len(jobs), "jobs", tasks, "tasks")
    assert 0 < tasks <= MOST_TASKS
