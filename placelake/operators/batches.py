"""A run over many organisations in batches: what is done stays done, and what fails becomes a row."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placelake.operators import catalog as C
from placelake.operators.rounds import cut

LEDGER = "batch_number long, fingerprint decimal(38,0), n_chains long, finished_at timestamp"
RESULT = (
    "corporation_name string, url string, facility_types array<string>, priority int, estimated_facilities string, facilities_count long, success boolean, error string, "
    "processing_time_minutes double, scraping_date timestamp, batch_number long"
)
Extract = Callable[[DataFrame], DataFrame]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def plan(chains: DataFrame, size: int, most_priority: int | None = None, *order: str) -> DataFrame:
    """``chains`` with their ``batch_number``, from 1, in the order of ``order``; those of a priority up to ``most_priority``."""
    wanted = chains if most_priority is None else chains.where(F.col("priority") <= most_priority)
    return C.batches(wanted, size, *(order or ("priority", "corporation_name"))).withColumnRenamed("batch", "batch_number")


def _fingerprint(batch: DataFrame) -> list[Column]:
    """How many chains a batch has, and the sum of their hashes: whether it is the batch that was done."""
    keys = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("corporation_name", "primary_url", "secondary_urls") if c in batch.columns))
    return [F.count("*").alias("n"), F.coalesce(F.sum(keys.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("f")]


def _delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _results(rows: DataFrame, number: Column, minutes: float, now: dt.datetime) -> DataFrame:
    """A result row per chain of ``rows``, which have facilities_count and error beside the chain's columns."""
    field = lambda c, kind: (F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c)
    types = C.pieces(F.col("facility_types")) if "facility_types" in rows.columns else F.array().cast("array<string>")
    return rows.select(
        "corporation_name", field("primary_url", "string").alias("url"), types.alias("facility_types"), field("priority", "int"), field("estimated_facilities", "string"),
        F.coalesce("facilities_count", F.lit(0)).cast("long").alias("facilities_count"), (F.coalesce("facilities_count", F.lit(0)) > 0).alias("success"), "error",
        F.round(F.lit(minutes), 2).alias("processing_time_minutes"), F.lit(now).alias("scraping_date"), number.cast("long").alias("batch_number"),
    )


def _attempt(batch: DataFrame, extract: Extract, path: str, errors: list[tuple[str, str]]) -> None:
    """Add the records of a batch to ``path``. Where the extraction fails, the halves are tried apart, down to the chain that fails; its message is kept."""
    try:
        extract(batch).write.mode("append").parquet(path)
    except Exception as e:
        names = sorted(r[0] or "" for r in batch.select("corporation_name").distinct().collect())  # a batch's
        if len(names) <= 1:
            errors += [(n, (str(e).strip() or type(e).__name__)[:1000]) for n in names]
            return
        name = F.coalesce("corporation_name", F.lit(""))
        middle = names[len(names) // 2]
        _attempt(batch.where(name < middle), extract, path, errors)
        _attempt(batch.where(name >= middle), extract, path, errors)


def process(batch: DataFrame, number: int, extract: Extract, folder: str) -> bool:
    """Run one batch, unless the ledger has it: records, then a result row per chain, then the ledger. Whether it was run.

    What an earlier, broken try left is written over, so that nothing is lost or doubled. Of chains with one name, null included, each gets a row.
    """
    spark = batch.sparkSession
    batch = cut(batch)
    n, fingerprint = batch.agg(*_fingerprint(batch)).first()
    ledger = f"{folder}/ledger/batch={number}"
    if exists(spark, ledger) and any(r.fingerprint == fingerprint and r.n_chains == n for r in _read(spark, ledger, LEDGER).collect()):
        return False
    began = dt.datetime.now()
    records, errors = f"{folder}/facilities/batch={number}", []
    _delete(spark, ledger, records)
    _attempt(batch, extract, records, errors)
    name = F.coalesce("corporation_name", F.lit(""))
    count = spark.createDataFrame([], "__name string, facilities_count long")
    if exists(spark, records):
        count = spark.read.parquet(records).groupBy(name.alias("__name")).agg(F.count("*").alias("facilities_count"))
    failed = spark.createDataFrame(errors, "__name string, error string")
    now = dt.datetime.now()
    rows = batch.withColumn("__name", name).join(count, "__name", "left").join(F.broadcast(failed), "__name", "left")
    rows = _results(rows, F.lit(number), (now - began).total_seconds() / 60, now)
    rows.write.mode("overwrite").parquet(f"{folder}/results/batch={number}")
    spark.createDataFrame([(number, fingerprint, n, now)], LEDGER).coalesce(1).write.mode("overwrite").parquet(ledger)
    return True


def _together(chains: DataFrame, pending: dict[int, tuple], extract: Extract, folder: str) -> None:
    """Run the batches ``pending`` of ``chains`` in one pass, which leaves of each what ``process`` leaves. Where the extraction fails, they are run one by one."""
    spark, began = chains.sparkSession, dt.datetime.now()
    _delete(spark, *(f"{folder}/{part}/batch={n}" for n in pending for part in ("ledger", "facilities", "results")))
    batch = F.col("batch_number").alias("batch")
    try:
        found = extract(chains)
        found = found.select(*(c for c in found.columns if c != "batch_number"), batch)
        found.repartition("batch").write.mode("append").partitionBy("batch").parquet(f"{folder}/facilities")
    except Exception:
        for n in pending:
            process(chains.where(F.col("batch_number") == n).drop("batch_number"), n, extract, folder)
        return
    now, name = dt.datetime.now(), F.coalesce("corporation_name", F.lit(""))
    records = f"{folder}/facilities"
    count = spark.createDataFrame([], "__name string, __batch long, facilities_count long")
    if any(exists(spark, f"{records}/batch={n}") for n in pending):
        count = spark.read.schema("corporation_name string, batch long").parquet(records).where(F.col("batch").between(min(pending), max(pending)))
        count = count.groupBy(name.alias("__name"), F.col("batch").alias("__batch")).agg(F.count("*").alias("facilities_count"))
    rows = chains.withColumns({"__name": name, "__batch": F.col("batch_number").cast("long"), "error": F.lit(None).cast("string")}).join(count, ["__name", "__batch"], "left")
    rows = _results(rows, F.col("__batch"), (now - began).total_seconds() / 60 / len(pending), now)
    rows.withColumn("batch", F.col("batch_number")).repartition("batch").write.mode("append").partitionBy("batch").parquet(f"{folder}/results")
    done = spark.createDataFrame([(n, f, k, now, n) for n, (k, f) in pending.items()], f"{LEDGER}, batch long")  # a row per batch
    done.coalesce(1).write.mode("append").partitionBy("batch").parquet(f"{folder}/ledger")


def run(chains: DataFrame, extract: Extract, folder: str, size: int = 5, most_priority: int | None = None, order: tuple[str, ...] = (), passes: int | None = None) -> list[int]:
    """Run ``extract`` over ``chains`` (corporation_name, primary_url, and what ``plan`` orders by) batch after batch; the numbers of those that were run.

    ``extract`` takes the chains of a batch and gives records with corporation_name. A run that was stopped goes on with the
    first batch that the ledger hasn't; a batch whose chains have changed since is run again.

    With ``passes``, at most so many calls of ``extract`` do all batches, however many there are, so that what it reads isn't read
    for each batch again. It then gets batch_number too and must keep it in its records. A run that is stopped loses the pass at
    hand. Where a pass fails, its batches are run one by one.
    """
    planned = cut(plan(chains, size, most_priority, *order))
    if passes is None:
        numbers = sorted(r[0] for r in planned.select("batch_number").distinct().collect())
        return [n for n in numbers if process(planned.where(F.col("batch_number") == n).drop("batch_number"), n, extract, folder)]
    done = {(r.batch_number, r.fingerprint, r.n_chains) for r in _read(planned.sparkSession, f"{folder}/ledger", LEDGER).collect()}
    found = sorted(planned.groupBy("batch_number").agg(*_fingerprint(planned)).collect())  # a row per batch
    left = [(r["batch_number"], (r["n"], r["f"])) for r in found if (r["batch_number"], r["f"], r["n"]) not in done]
    most = max(1, -(-len(left) // passes))
    for i in range(0, len(left), most):
        pending = dict(left[i : i + most])
        wanted = planned.where(F.col("batch_number").between(min(pending), max(pending)))
        _together(wanted if len(pending) == max(pending) - min(pending) + 1 else wanted.where(F.col("batch_number").isin(*pending)), pending, extract, folder)
    return [n for n, _ in left]


def stream(chains: DataFrame, extract: Extract, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """The same over a stream of chains: each micro-batch is a batch of its number, and one that is given again after a failure is done once."""
    return chains.writeStream.foreachBatch(lambda batch, number: process(batch, number, extract, folder) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def results(spark: SparkSession, folder: str) -> DataFrame:
    """A row per chain of all batches that were run."""
    return _read(spark, f"{folder}/results", RESULT)


def records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The records of all batches in the ledger."""
    done = _read(spark, f"{folder}/ledger", LEDGER).select(F.col("batch_number").alias("batch"))
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/facilities") if exists(spark, f"{folder}/facilities") else spark.createDataFrame([], f"{schema}, batch long")
    return rows.join(F.broadcast(done), "batch", "left_semi").drop("batch")
