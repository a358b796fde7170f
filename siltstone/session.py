"""Sessions: settings for local runs, the package's path for Python workers, shared folders, spread input."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_ONLY = "file:///tmp/checkpoints/siltstone"


def local(cpus: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A session on one machine, for tests and the bench."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("siltstone").config("spark.driver.memory", memory)
    b = b.config("spark.sql.shuffle.partitions", str(partitions or cpus)).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> None:
    """Let Python workers of this session find the package."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if top not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (top, known) if x)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than two for each core is dealt out evenly, for a small file is one split however many cores
    there are. Larger scans are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


def shared_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir, as a URI. Where none is named, a local folder does
    for a session of one machine; any other is refused, for executors wouldn't see each other's files."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        named = LOCAL_ONLY
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder (URI) in the shared root; it goes when the process ends, for results are lazy and may still read it."""
    out = f"{shared_root(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    if urlparse(out).scheme in ("", "file"):
        atexit.register(shutil.rmtree, urlparse(out).path, ignore_errors=True)
    return out


def materialize(df: DataFrame, where: str) -> DataFrame:
    """Write df as Parquet into a shared folder and read it back: cuts the lineage, survives lost executors."""
    df.write.mode("overwrite").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
