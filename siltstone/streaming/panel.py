"""A panel of annotators that can be stopped at any time: questions come as a stream, and every question is put to every
model once.

What is done is what has a record, not what a batch number says: a batch that runs again asks only for what isn't recorded
yet, so a panel killed between its write and the stream's commit asks nothing twice, and one killed before its write loses
nothing. Tasks are dealt into parts by hash, and a part is worked on under a lease, an entry that is put in place once; so
several panels share one table of records, and a dead one's part is free when its lease ends.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.pipelines import pending_tasks
from siltstone.sources.versions import files_of, put_once

#: Parts that tasks are dealt into, each under its own lease.
PARTS = 16
#: A record: what was asked, whether it went well, and the answer.
RECORD = "item_id bigint, model string, status string, answer string"


class Leases:
    """Leases by name below a folder; the last entry of a name counts."""

    def __init__(self, spark: SparkSession, root: str, owner: str, seconds: float = 3600, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.owner, self.seconds, self.clock = spark, root, owner, seconds, clock

    def _last(self, name: str) -> tuple[int, dict]:
        p, fs = files_of(self.spark, f"{self.root}/{name}")
        numbers = sorted(int(n[:-5]) for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.endswith(".json")) if fs.exists(p) else []
        if not numbers:
            return 0, {"owner": None, "until": 0}
        return numbers[-1], json.loads(self.spark.read.text(f"{self.root}/{name}/{numbers[-1]:012d}.json").first()[0])

    def _put(self, name: str, number: int, until: float) -> bool:
        return put_once(self.spark, f"{self.root}/{name}/{number:012d}.json", json.dumps({"owner": self.owner, "until": until}))

    def take(self, name: str) -> bool:
        """Whether the lease is now the owner's: it was free, or ended, or theirs."""
        number, last = self._last(name)
        if last["owner"] not in (None, self.owner) and last["until"] > self.clock():
            return False
        return self._put(name, number + 1, self.clock() + self.seconds)

    def release(self, name: str) -> None:
        number, last = self._last(name)
        if last["owner"] == self.owner:
            self._put(name, number + 1, 0)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records; of a task asked again after an error, each."""
    p, fs = files_of(spark, path)
    return spark.read.schema(RECORD).option("recursiveFileLookup", True).parquet(path) if fs.exists(p) else spark.createDataFrame([], RECORD)


def run_tasks(questions: DataFrame, models: Sequence[str], answer: Callable[[DataFrame], DataFrame], records: str, leases: Leases, retry_errors: bool = False, wait: float = 1.0) -> None:
    """Ask what isn't recorded yet. answer: tasks (item_id, model, and the question's columns) to records. Parts that another
    panel works on are waited for: it records them, or its lease ends."""
    spark = questions.sparkSession
    part = F.pmod(F.xxhash64("item_id", "model"), F.lit(PARTS)).cast("int")

    def pending() -> DataFrame:
        done = read_records(spark, records)
        done = done.where("status = 'success'") if retry_errors else done
        return pending_tasks(questions, models, done).withColumn("_part", part)

    while left := [r[0] for r in pending().select("_part").distinct().collect()]:  # PARTS rows at most
        mine = [p for p in sorted(left) if leases.take(f"part={p}")]
        if mine:
            tasks = pending().where(F.col("_part").isin(mine)).drop("_part").join(questions, "item_id")  # what was recorded until the lease is not asked
            answer(tasks).selectExpr(*(c.split()[0] for c in RECORD.split(", "))).write.mode("errorifexists").parquet(f"{records}/{uuid.uuid4().hex}")
            for p in mine:
                leases.release(f"part={p}")
            if retry_errors:
                return  # errors are asked once more, not until they end
        else:
            time.sleep(wait)


def panel(questions: DataFrame, models: Sequence[str], answer: Callable[[DataFrame], DataFrame], records: str, checkpoint: str, leases: Leases, retry_errors: bool = False, wait: float = 1.0):
    """Put a stream of questions (item_id and further columns) to all models; a restart goes on from the checkpoint."""
    run = lambda batch, _: run_tasks(batch.dropDuplicates(["item_id"]), models, answer, records, leases, retry_errors, wait)
    return questions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
