"""A cache with expiry: what was learned of a domain serves later requests until it is too old."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOURS = 168
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ANSWER = "domain string, request string, at timestamp, schema string, created timestamp, status string"


def lookups(events: DataFrame, hours: float = HOURS) -> DataFrame:
    """The answer to each request among ``events(domain, request, at, schema)``, in batch.

    A row with a schema is an entry, one without a request. A request gets the last entry of its domain at or before it
    that is younger than ``hours``: (domain, request, at, schema, created, status) with status hit or miss. Of entries at one
    time the greatest counts. Domains are cut into spans of time, into which entries reach from the span before, so that
    a busy domain isn't one task. Rows without domain or time are left out; of equal rows each counts.
    """
    span = int(hours * 3600 * 1_000_000)
    micros = F.unix_micros("at")
    events = events.withColumn("at", F.col("at").cast("timestamp"))
    rows = events.where("domain is not null and at is not null").select("domain", "request", "at", "schema", micros.alias("t"), F.floor(micros / span).alias("span"))
    entry = F.col("schema").isNotNull()
    spans = F.when(entry, F.array("span", F.col("span") + 1)).otherwise(F.array("span"))
    rows = rows.withColumn("span", F.explode(spans))
    order = Window.partitionBy("domain", "span").orderBy("t", F.desc(entry), "schema").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(entry, F.struct("schema", "at", "t")), ignorenulls=True).over(order)
    asked = rows.withColumn("e", last).where("schema is null")
    good = F.coalesce(F.col("t") - F.col("e.t") < span, F.lit(False))
    return asked.select("domain", "request", "at", F.when(good, F.col("e.schema")).alias("schema"), F.when(good, F.col("e.at")).alias("created"), F.when(good, "hit").otherwise("miss").alias("status"))


class _Cache(StatefulProcessor):
    """One entry per domain, and a timer that removes it."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "schema string, created long")

    @staticmethod
    def _rows(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["domain", "request", "at", "schema", "created", "status"])
        for c in ("at", "created"):
            out[c] = pd.to_datetime(out[c], unit="us")
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        have = self.entry.get() if self.entry.exists() else None
        schema, created = have if have else (None, None)
        old, out = created, []
        for part in rows:  # a batch of events at a time; what is kept between is one entry
            part = part.sort_values(["t", "request", "schema"], na_position="first", kind="stable")
            for r in part.itertuples(index=False):
                if isinstance(r.schema, str):
                    if created is None or (r.t, r.schema) >= (created, schema):
                        schema, created = r.schema, int(r.t)
                else:
                    good = created is not None and 0 <= r.t - created < self.ttl * 1000
                    out.append((key[0], r.request, r.t, schema if good else None, created if good else None, "hit" if good else "miss"))
        if created is not None and created != old:
            if old is not None:
                self.handle.deleteTimer(old // 1000 + self.ttl)
            self.handle.registerTimer(created // 1000 + self.ttl)
        if created is not None and (schema, created) != have:
            self.entry.update((schema, created))
        if out:
            yield self._rows(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists():
            schema, created = self.entry.get()
            if created // 1000 + self.ttl <= expiredTimerInfo.getExpiryTimeInMs():
                self.entry.clear()
                yield self._rows([(key[0], None, created + self.ttl * 1000, schema, created, "expired")])

    def close(self) -> None:
        """Nothing is held outside the state."""


def serve(stream: DataFrame, hours: float = HOURS, delay: str = "1 hour") -> DataFrame:
    """The answers to a stream of ``events(domain, request, at, schema)``, as ``lookups`` gives them, and a row of status expired when an entry ends.

    The state is one entry per domain; it goes once the watermark, ``delay`` behind the latest event, is ``hours`` past it. What
    comes in one batch is taken in the order of its times, entries first; a request doesn't wait for entries of later batches.
    Needs the RocksDB state store (``use_rocks``); after a restart the entries and their timers go on.
    """
    keyed = stream.withColumn("at", F.col("at").cast("timestamp")).where("domain is not null and at is not null").withWatermark("at", delay)
    keyed = keyed.select(F.col("domain").cast("string").alias("domain"), F.col("request").cast("string").alias("request"), "at", "schema", F.unix_micros("at").alias("t"))
    # entries before requests of one time: their request counts as the least
    keyed = keyed.withColumn("request", F.when(F.col("schema").isNull(), F.coalesce("request", F.lit(""))))
    return keyed.groupBy("domain").transformWithStateInPandas(_Cache(int(hours * 3_600_000)), ANSWER, "Append", "EventTime")


def use_rocks(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
