"""Session expiry in a stream: timers of event time in keyed state, that survive a restart with the stream's checkpoint."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltstone.streaming.sessions import timed

TIME_TO_LIVE = timedelta(days=7)
#: State with timers is kept by this provider only.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times are microseconds, which no time zone touches.
STATE = "seen bigint, state string"
CHANGES = "user_id bigint, state string, since bigint"


class Expiry(StatefulProcessor):
    """Of each user when they were last seen and the state that followed; a timer where the session is alive."""

    def __init__(self, live: timedelta, revoking: str):
        self.live, self.revoking = live // timedelta(microseconds=1), revoking

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen, state = self.session.get() if self.session.exists() else (None, None)
        for ts, kind in sorted((r["micros"], r["event_type"]) for r in rows):
            if seen is not None and ts < seen:
                continue  # late, but within the watermark: the session was seen since
            if state == "active" and ts >= seen + self.live:
                state = "expired"
                yield Row(user_id=key[0], state=state, since=seen + self.live)
            seen = ts
            now = "revoked" if kind == self.revoking else "active"
            if now != state:
                state = now
                yield Row(user_id=key[0], state=state, since=ts)
        self.session.update((seen, state))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state == "active":
            self.handle.registerTimer(_millis(seen + self.live))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.session.exists():
            seen, state = self.session.get()
            if state == "active" and _millis(seen + self.live) <= expiredTimerInfo.getExpiryTimeInMs():
                self.session.update((seen, "expired"))
                yield Row(user_id=key[0], state="expired", since=seen + self.live)

    def close(self) -> None:
        pass


def _millis(micros: int) -> int:
    """The first millisecond that isn't before a time."""
    return -(-micros // 1000)


def session_changes(events: DataFrame, live: timedelta = TIME_TO_LIVE, revoking: str = "error", late: str = "0 seconds") -> DataFrame:
    """(user_id, state, since) of every change of a user's session in a stream of events (user_id, ts, event_type): active when
    they come (again), revoked at once by an event of the type `revoking`, expired after a time to live without any, as
    soon as the watermark has passed it. Sets the session's provider of state to the one that keeps timers.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = timed(events).select("user_id", "ts", F.unix_micros("ts").alias("micros"), "event_type").where("user_id is not null and ts is not null").withWatermark("ts", late)
    changes = rows.groupBy("user_id").transformWithState(statefulProcessor=Expiry(live, revoking), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")
    return changes.withColumn("since", F.timestamp_micros("since"))


def record_changes(changes: DataFrame, path: str, checkpoint: str):
    """Append changes to a table, each once, also where the stream dies and starts again from its checkpoint."""
    return changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def current_states(changes: DataFrame) -> DataFrame:
    """(user_id, state) after the last change of each user; one that expires as it is seen again is active."""
    return changes.groupBy("user_id").agg(F.max_by("state", F.struct("since", (F.col("state") != "expired").alias("later"))).alias("state"))
