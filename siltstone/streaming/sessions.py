"""Structured Streaming over events. Timestamps of the tables have no zone: they are read as UTC."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; late rows beyond the watermark are dropped by a stream."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return timed(events).withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions that end when a user is silent for a gap."""
    s = timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def last_seen(events: DataFrame, every: str = "1 hour") -> DataFrame:
    """One row a user and interval, the first to arrive: throttled updates."""
    return timed(events).withWatermark("ts", every).withColumn("slot", F.window("ts", every)["start"]).dropDuplicatesWithinWatermark(["user_id", "slot"]).drop("slot")


def newest_rows(rows: DataFrame, key: str, by: str) -> DataFrame:
    """Of each key the row that is newest by a column; of equal ones the last in order of its other values."""
    rest = [c for c in rows.columns if c not in (key, by)]
    order = F.struct(by, F.to_json(F.struct(*rest)) if rest else F.lit(0))
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("x")).select(key, "x.*").select(rows.columns)


def upsert(stream: DataFrame, path: str, key: str, checkpoint: str, by: str = "ts"):
    """Idempotent upsert by a stable id: each micro-batch is written to its own version, named by its number, with the row
    of each key that is newest by a column. A batch that runs again replaces its version."""

    def write(batch: DataFrame, number: int) -> None:
        newest_rows(batch, key, by).withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """An append-only log: what has been written is never changed; a batch that runs again is written once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


class Readiness:
    """The result of a check, kept for a time that depends on it: a success longer than a failure."""

    def __init__(self, check: Callable[[], bool], good_for: float = 60.0, bad_for: float = 5.0, clock: Callable[[], float] = time.monotonic):
        self.check, self.good_for, self.bad_for, self.clock = check, good_for, bad_for, clock
        self.until, self.result = float("-inf"), False

    def ready(self) -> bool:
        if self.clock() >= self.until:
            try:
                self.result = bool(self.check())
            except Exception:  # noqa: BLE001 - a check that fails says that nothing is ready
                self.result = False
            self.until = self.clock() + (self.good_for if self.result else self.bad_for)
        return self.result


def newest(versions: DataFrame, key: str) -> DataFrame:
    """Of an upserted table the newest row of each key."""
    rest = [c for c in versions.columns if c not in (key, "version")]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("x")).select(key, "x.*")
