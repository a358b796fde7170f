"""An index of versions with a commit log: which version counts is the last entry of a log of files, each written once.

A version is a folder that nothing changes after it is whole. An entry is put in place under its number by a step that
fails where the number is taken, so of two writers that saw the same state one wins and the other hears of it. A reader
takes the version of the entry that it saw, and keeps it whatever is committed later. Going back is a new entry, too.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "_commits"


class CommitConflict(RuntimeError):
    """Another writer committed first."""


class VersionError(RuntimeError):
    """A version doesn't hold what it should, or there is none."""


@dataclass(frozen=True)
class Commit:
    number: int
    version: str
    fingerprint: str
    rows: int


def files_of(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _place(root: str, number: int) -> str:
    return f"{root}/{LOG}/{number:012d}.json"


def commits(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the entries, in order."""
    p, fs = files_of(spark, f"{root}/{LOG}")
    if not fs.exists(p):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(p))
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def commit_of(spark: SparkSession, root: str, number: int | None = None) -> Commit | None:
    """An entry, the last one by default; None where there is none."""
    known = commits(spark, root)
    if not known:
        return None
    if number is not None and number not in known:
        raise VersionError(f"there is no commit {number}")
    text = "".join(r[0] for r in spark.read.text(_place(root, known[-1] if number is None else number)).collect())
    return Commit(**json.loads(text))


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Put a whole file in place, unless one is there."""
    parts = urlparse(path)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    if parts.scheme in ("", "file"):
        local, own = unquote(parts.path), unquote(urlparse(own).path)
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(own, "w") as f:
            f.write(text)
        try:
            os.link(own, local)  # fails where the name is taken
        except FileExistsError:
            return False
        finally:
            os.remove(own)
        return True
    p, fs = files_of(spark, own)
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    try:
        none = spark._sc._gateway.new_array(jvm.Options.Rename, 0)
        jvm.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(p, jvm.Path(path), none)  # doesn't overwrite
    except Exception:
        fs.delete(p, False)
        if fs.exists(jvm.Path(path)):
            return False
        raise
    return True


def write_version(df: DataFrame, root: str, version: str, fingerprint: str) -> int:
    """Write a version with its fingerprint in every row. One that is there isn't overwritten. Returns its rows."""
    df.withColumns({"_index_version": F.lit(version), "_index_fingerprint": F.lit(fingerprint)}).write.mode("errorifexists").parquet(f"{root}/{version}")
    return df.sparkSession.read.parquet(f"{root}/{version}").count()


def verify(spark: SparkSession, root: str, version: str, fingerprint: str, expected: int | None = None) -> int:
    """A version's rows, all of which must bear the fingerprint and be as many as expected."""
    n, ours = spark.read.parquet(f"{root}/{version}").agg(F.count(F.lit(1)), F.count_if(F.col("_index_fingerprint") == fingerprint)).first()
    if n != ours or expected is not None and n != expected:
        raise VersionError(f"index {version}: {n} rows, {ours} of the fingerprint, {n if expected is None else expected} expected")
    return n


def commit(spark: SparkSession, root: str, version: str, fingerprint: str, expected: int | None = None, after: int | None = None) -> Commit:
    """Make a version count. `after` is the number of the commit that the writer saw (None: the last one now; 0: none yet);
    where another has come since, CommitConflict. The version that counts already isn't committed again."""
    rows = verify(spark, root, version, fingerprint, expected)
    last = commit_of(spark, root)
    seen = (last.number if last else 0) if after is None else after
    if last and last.number == seen and last.version == version:
        return last
    new = Commit(seen + 1, version, fingerprint, rows)
    if seen != (last.number if last else 0) or not put_once(spark, _place(root, new.number), json.dumps(new.__dict__)):
        raise CommitConflict(f"commit {new.number} of {root} is another writer's")
    return new


def roll_back(spark: SparkSession, root: str) -> Commit:
    """Make the version before the last one count again, as a new commit."""
    known = [commit_of(spark, root, n) for n in commits(spark, root)]
    before = [c for c in known if c.version != known[-1].version]
    if not before:
        raise VersionError("there is no version to go back to")
    return commit(spark, root, before[-1].version, before[-1].fingerprint, before[-1].rows, after=known[-1].number)


def read_index(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The rows of the version that counts now, or did at a commit. The frame keeps to that version."""
    c = commit_of(spark, root, number)
    if c is None:
        raise VersionError(f"nothing is committed in {root}")
    return spark.read.parquet(f"{root}/{c.version}")
