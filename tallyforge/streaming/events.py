"""Event-time windows, deduplication, corrections and per-key limits, in streams and batches alike.

Each `*_frame` function takes a batch or a streaming DataFrame; `drain` runs a stream over what is
there (`availableNow`) into a Parquet or memory sink.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 day"


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over Parquet files as they come; times without a zone become UTC timestamps."""
    frame = spark.readStream.schema(schema).parquet(path)
    for field in schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            frame = frame.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return frame


def tumbling_frame(events: DataFrame, width: str, keys: list[str], slide: str | None = None, late: str = LATE) -> DataFrame:
    """Counts and exact sums by window (sliding if `slide` is given) and keys; later rows than `late` are dropped by a stream."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    found = rows.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(38,2)").alias("total"))
    return found.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "events", "total")


def session_frame(events: DataFrame, gap: str, keys: list[str], late: str = LATE) -> DataFrame:
    """Sessions of a key: events less than `gap` apart."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    found = rows.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("events"))
    return found.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "events")


def once_frame(events: DataFrame, key: str, late: str = LATE) -> DataFrame:
    """Each id once: within the watermark in a stream, overall in a batch."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def drain(frame: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there now, to Parquet; run again, it goes on where it stopped."""
    frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()


def apply_corrections(current: DataFrame, corrections: DataFrame, key: str = "event_id") -> DataFrame:
    """Closes the events that corrections (old_id, and a new event's columns with valid_from) supersede, and adds the new ones.

    Correcting twice with the same rows changes nothing, so a stream's repeated batch is harmless.
    """
    closed = corrections.groupBy("old_id").agg(F.min("valid_from").alias("closed_at"))
    kept = current.join(closed, F.col(key) == F.col("old_id"), "left").withColumn("valid_to", F.coalesce("valid_to", "closed_at")).select(*current.columns)
    fresh = corrections.join(current.select(key), key, "left_anti").select(*[F.col(c) if c in corrections.columns else F.lit(None).cast(current.schema[c].dataType).alias(c) for c in current.columns])
    return kept.unionByName(fresh.dropDuplicates([key]))


class SlidingLog:
    """Admits at most `limit` requests within `window` seconds; refused ones aren't logged."""

    def __init__(self, limit: int, window: float, log: tuple[float, ...] = ()):
        if limit < 1 or not 0 < window <= 3600:
            raise ValueError("a limit of 1 or more and a window of up to an hour are needed")
        self.limit, self.window, self.log = limit, window, list(log)

    def ask(self, now: float) -> tuple[bool, int]:
        """Whether a request is admitted, and after how many seconds it may be tried again if not."""
        self.log = [x for x in self.log if x > now - self.window]
        if len(self.log) >= self.limit:
            return False, max(1, math.ceil(self.log[0] + self.window - now))
        self.log.append(now)
        return True, 0


DECISIONS = "event_id bigint, user_id bigint, allowed boolean, retry_after bigint"


def limited(events: DataFrame, limit: int, window: float) -> DataFrame:
    """Admission of each event (event_id, user_id, ts): its user's events in order of time, then id.

    Whether one is admitted depends on which earlier ones were, so each user's events are walked in
    order; rows arrive sorted and in batches, and a user's state is `limit` times, however many
    events there are.
    """
    rows = events.select("event_id", "user_id", F.col("ts").cast("double").alias("at")).repartition("user_id").sortWithinPartitions("user_id", "at", "event_id")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, log = object(), None
        for batch in batches:
            out = []
            for event_id, user_id, at in zip(batch.event_id, batch.user_id, batch["at"], strict=True):
                if user_id != user:
                    user, log = user_id, SlidingLog(limit, window)
                out.append((event_id, user_id, *log.ask(at)))
            yield pd.DataFrame(out, columns=["event_id", "user_id", "allowed", "retry_after"])

    return rows.mapInPandas(work, DECISIONS)


def limited_stream(events: DataFrame, limit: int, window: float) -> DataFrame:
    """The same for a stream: the log of a user is kept between batches and forgotten when the watermark has passed its window."""

    def work(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = SlidingLog(limit, window, state.get[0] if state.exists else ())
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = [(e, key[0], *log.ask(at)) for e, at in zip(rows.event_id, rows["at"], strict=True)]
        state.update((log.log,))
        state.setTimeoutTimestamp(max(int(rows["at"].max() * 1000), state.getCurrentWatermarkMs()) + int(window * 1000) + 1)
        yield pd.DataFrame(out, columns=["event_id", "user_id", "allowed", "retry_after"])

    rows = events.withWatermark("ts", LATE).select("event_id", "user_id", "ts", F.col("ts").cast("double").alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(work, DECISIONS, "log array<double>", "append", GroupStateTimeout.EventTimeTimeout)
