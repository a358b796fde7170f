"""Batch forms of the streaming operators, to hold against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans.registry import query, table
from siltstone.session import work_dir
from siltstone.streaming import expiry as E
from siltstone.streaming import panel as A
from siltstone.streaming import sessions as S


@query("tumbling_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    return S.windowed_counts(table(spark, sf, "events"))


@query(
    "user_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, no""",
)
def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return S.sessions(table(spark, sf, "events"))


@query(
    "expired_sessions",
    """WITH e AS (SELECT user_id, ts, event_type = 'error' AS revoke, lag(ts) OVER w AS before, coalesce(lag(event_type) OVER w = 'error', true) AS was_revoked, lead(ts) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)), m AS (SELECT max(ts) AS now FROM events),
c AS (SELECT user_id, CASE WHEN revoke THEN 'revoked' ELSE 'active' END AS state, ts AS since FROM e WHERE before IS NULL OR revoke <> was_revoked OR NOT revoke AND NOT was_revoked AND ts >= before + INTERVAL 7 DAY
  UNION ALL SELECT user_id, 'expired', ts + INTERVAL 7 DAY FROM e, m WHERE NOT revoke AND ts + INTERVAL 7 DAY <= coalesce(next, now))
SELECT user_id, state, since FROM c""",
)
def expired_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Every change of a session in a stream of all events: begun, revoked, expired after 7 days."""
    events = table(spark, sf, "events")
    where = work_dir(spark, "sessions")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parque[t]")  # a pattern, for a stream's folder may not be a file
    E.record_changes(E.session_changes(stream), f"{where}/changes", f"{where}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{where}/changes").selectExpr("user_id", "state", "cast(since as timestamp_ntz) as since")


@query(
    "panel_records",
    """SELECT item_id, model, CASE WHEN (item_id + length(model)) % 7 = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN (item_id + length(model)) % 7 <> 0 THEN concat(model, ':', length(text)) END AS answer
FROM benchmark, (VALUES ('small'), ('large-one'), ('other')) AS m(model)""",
)
def panel_records(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark item put to three models by a stand-in that fails for some; the panel is stopped and begun anew, with
    a new checkpoint, and asks nothing again."""
    items = table(spark, sf, "benchmark")
    where = work_dir(spark, "panel")
    leases = A.Leases(spark, f"{where}/leases", "one")
    fails = (F.col("item_id") + F.length("model")) % 7 == 0

    def answer(tasks: DataFrame) -> DataFrame:
        return tasks.select("item_id", "model", F.when(fails, "error").otherwise("success").alias("status"), F.when(~fails, F.concat_ws(":", "model", F.length("text").cast("string"))).alias("answer"))

    for attempt in (1, 2):
        stream = spark.readStream.schema(items.schema).parquet(f"{sf}/benchmark.parque[t]")
        A.panel(stream, ["small", "large-one", "other"], answer, f"{where}/records", f"{where}/checkpoint-{attempt}", leases).awaitTermination()
    return A.read_records(spark, f"{where}/records")
