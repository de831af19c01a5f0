"""Streams of facility records and URLs without repeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from placelake.operators.dedup import THRESHOLD, records_alike, signature

WINDOW = 100
_STATE = "phone_key array<string>, street array<string>, name_key array<string>, zip5 array<string>, address_key array<string>"
_KEYS = ("phone_key", "street", "name_key", "zip5", "address_key")


def drop_repeats(stream: DataFrame, event_time: str, delay: str = "7 days") -> DataFrame:
    """The first record of each signature within the watermark; state is bounded by ``delay``."""
    return signature(stream).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["full_hash"])


def drop_visited(stream: DataFrame, event_time: str, url: str = "url", delay: str = "7 days") -> DataFrame:
    """The first visit of each URL within the watermark."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([url])


def drop_alike(stream: DataFrame, order: str, event_time: str, threshold: float = THRESHOLD, window: int = WINDOW, delay: str = "7 days") -> DataFrame:
    """Records that are like none of the last ``window`` kept of their phone, or of their signature where they have none.

    Equal phones are necessary for likeness above 0.6, so the state is kept by phone. The window bounds
    it, as the method defines; state of a phone is dropped once the watermark is ``delay`` past its last record.
    """
    keyed = signature(stream.withWatermark(event_time, delay)).withColumn("block", F.when(F.col("phone_key") != "", F.col("phone_key")).otherwise(F.col("full_hash")))
    keyed = keyed.withColumn("street", F.lower(F.coalesce("address", F.lit("")))).withColumn("zip5", F.substring(F.coalesce("zip_code", F.lit("")), 1, 5))
    keyed = keyed.withColumn("_ms", F.unix_millis(event_time))
    wait = pd.Timedelta(delay) // pd.Timedelta("1ms")
    columns = stream.columns

    def scan(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(zip(*state.get, strict=True)) if state.exists else []
        out = []
        latest = max(0, state.getCurrentWatermarkMs())
        for frame in frames:
            latest = max(latest, int(frame["_ms"].max()))
            for row in frame.sort_values(order).to_dict("records"):
                now = tuple(row[k] for k in _KEYS)
                if not any(records_alike(now, old, threshold) for old in kept):
                    kept = [*kept, now][-window:]
                    out.append({c: row[c] for c in columns})
        state.update(tuple(list(c) for c in zip(*kept, strict=True)))
        state.setTimeoutTimestamp(latest + wait)
        yield pd.DataFrame(out, columns=columns)

    return keyed.groupBy("block").applyInPandasWithState(scan, stream.schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
