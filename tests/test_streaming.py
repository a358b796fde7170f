"""Streams that stop and start again."""

from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.plans import registry
from siltstone.streaming import expiry as E
from siltstone.streaming import panel as P


def test_expiry_survives_a_restart(spark, tmp_path, small):
    """The table in three parts, the stream begun anew for each: states are those of all events at once."""
    events = spark.read.parquet(f"{small}/events.parquet")
    bounds = [datetime(2024, 1, 1), datetime(2024, 1, 9), datetime(2024, 1, 21), datetime(2024, 3, 1)]
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for a, z in zip(bounds, bounds[1:], strict=False):
        events.where((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(z))).coalesce(2).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(events.schema).parquet(folder)
        E.record_changes(E.session_changes(stream), out, checkpoint).awaitTermination()
    changes = spark.read.parquet(out)
    assert changes.count() == changes.distinct().count()
    want = {r.user_id: r.state for r in registry.queries()["session_validity"](spark, small).collect()}
    assert {r.user_id: r.state for r in E.current_states(changes).collect()} == want
    whole = {(r.user_id, r.state, r.since) for r in registry.queries()["expired_sessions"](spark, small).collect()}
    assert {(r.user_id, r.state, r.since) for r in changes.selectExpr("user_id", "state", "cast(since as timestamp_ntz) as since").collect()} == whole


def test_sessions_by_hand(spark, tmp_path):
    day = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    rows = [(1, day(0), "view"), (1, day(3), "error"), (1, day(12), "view"), (2, day(0), "view"), (2, day(8), "view"), (None, day(1), "view"), (3, None, "view"), (4, day(30), "view")]
    spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    E.record_changes(E.session_changes(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.user_id, r.state, r.since) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "active", day(0)), (1, "revoked", day(3)), (1, "active", day(12)), (1, "expired", day(19)), (2, "active", day(0)), (2, "expired", day(7)), (2, "active", day(8)), (2, "expired", day(15)), (4, "active", day(30))}


def asked(folder):
    """A stand-in for models that notes each task it gets."""

    def answer(tasks):
        def run(batches):
            import os
            import uuid

            for b in batches:
                for item, model in zip(b.column("item_id").to_pylist(), b.column("model").to_pylist(), strict=True):
                    os.makedirs(f"{folder}/{item}-{model}", exist_ok=True)
                    open(f"{folder}/{item}-{model}/{uuid.uuid4().hex}", "w").close()
                n = len(b)
                yield pa.RecordBatch.from_arrays([b.column("item_id"), b.column("model"), pa.array(["error" if i % 3 == 0 else "success" for i in b.column("item_id").to_pylist()]), pa.array(["x"] * n)], ["item_id", "model", "status", "answer"])

        return tasks.select("item_id", "model").mapInArrow(run, P.RECORD)

    return answer


def counts(folder):
    return {d.name: len(list(d.iterdir())) for d in folder.iterdir()}


def test_panel_is_killed_and_begun_again(spark, tmp_path, monkeypatch):
    """Killed after its records are written and before the stream commits; then begun again with more questions."""
    path = lambda x: str(tmp_path / x)
    spark.range(20).withColumnRenamed("id", "item_id").write.parquet(path("in"))
    stream = lambda: spark.readStream.schema("item_id long").parquet(path("in"))
    run = lambda owner, **more: P.panel(stream(), ["m1", "m2"], asked(path("asked")), path("records"), path("cp"), P.Leases(spark, path("leases"), owner, 2), wait=0.2, **more)
    with monkeypatch.context() as m:
        m.setattr(P.Leases, "release", lambda *_: 1 / 0)
        with pytest.raises(Exception, match="division"):
            run("one").awaitTermination()
    first = P.read_records(spark, path("records"))
    assert first.count() == 40
    spark.range(15, 30).withColumnRenamed("id", "item_id").write.mode("append").parquet(path("in"))
    run("two").awaitTermination()  # another owner: waits until the leases of the dead one end
    done = [tuple(r) for r in P.read_records(spark, path("records")).select("item_id", "model").collect()]
    assert len(done) == len(set(done)) == 60 and set(counts(tmp_path / "asked").values()) == {1}
    P.run_tasks(spark.range(30).withColumnRenamed("id", "item_id"), ["m1", "m2"], asked(path("asked")), path("records"), P.Leases(spark, path("leases"), "two"), retry_errors=True)
    again = counts(tmp_path / "asked")
    assert all(n == (2 if int(k.split("-")[0]) % 3 == 0 else 1) for k, n in again.items())


def test_leases(spark, tmp_path):
    now = [100.0]
    a, b = (P.Leases(spark, str(tmp_path), o, 10, lambda: now[0]) for o in "ab")
    assert a.take("x") and not b.take("x") and b.take("y") and a.take("x")
    b.release("x")  # not theirs
    assert not b.take("x")
    a.release("x")
    assert b.take("x") and not a.take("x")
    now[0] += 11
    assert a.take("x") and not b.take("x")
