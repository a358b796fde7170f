"""Index versions: one writer wins, readers keep theirs, another session sees the switch."""

import threading

import pytest

from siltstone.sources import files
from siltstone.sources import versions as V


@pytest.fixture
def root(spark, tmp_path):
    root = f"file://{tmp_path}/in dex"
    for v in "abc":
        V.write_version(spark.range(5).selectExpr("id", f"'{v}' as v"), root, v, f"f{v}")
    return root


def test_readers_keep_their_version(spark, root):
    assert V.commit_of(spark, root) is None
    with pytest.raises(V.VersionError, match="nothing"):
        V.read_index(spark, root)
    V.commit(spark, root, "a", "fa", 5)
    pinned = V.read_index(spark, root)
    assert V.commit(spark, root, "a", "fa", 5).number == 1  # counts already
    V.commit(spark, root, "b", "fb", 5)
    assert {r.v for r in pinned.collect()} == {"a"} and {r.v for r in V.read_index(spark.newSession(), root).collect()} == {"b"}
    assert V.roll_back(spark, root).number == 3 and V.commit_of(spark, root).version == "a"
    assert V.roll_back(spark, root).version == "b" and V.commits(spark, root) == [1, 2, 3, 4]
    assert {r.v for r in V.read_index(spark, root, 2).collect()} == {"b"}
    with pytest.raises(V.VersionError, match="no commit 9"):
        V.commit_of(spark, root, 9)


def test_a_version_is_what_it_should_be(spark, root):
    for bad in ({"fingerprint": "other"}, {"expected": 4}):
        with pytest.raises(V.VersionError):
            V.commit(spark, root, **{"version": "a", "fingerprint": "fa", "expected": 5} | bad)
    assert V.commits(spark, root) == []
    V.commit(spark, root, "a", "fa")
    with pytest.raises(V.VersionError, match="go back"):
        V.roll_back(spark, root)


def test_one_of_two_writers_wins(spark, root):
    V.commit(spark, root, "a", "fa", 5, after=0)
    results = []

    def write(version):
        try:
            results.append(V.commit(spark, root, version, f"f{version}", 5, after=1).version)
        except V.CommitConflict:
            results.append("lost")

    threads = [threading.Thread(target=write, args=(v,)) for v in "bc" * 3]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert V.commits(spark, root) == [1, 2]
    won = V.commit_of(spark, root).version
    assert won in "bc" and results.count(won) == 1 and results.count("lost") == 5
    with pytest.raises(V.CommitConflict):
        V.commit(spark, root, "c" if won == "b" else "b", "fc" if won == "b" else "fb", 5, after=1)
    assert V.put_once(spark, f"{root}/once", "x") and not V.put_once(spark, f"{root}/once", "y")


def test_activation_is_seen_by_other_sessions(spark, root):
    assert files.activate(spark, root, "a", "fa", 5, "live", verify_only=True) == "verified" and V.commits(spark, root) == []
    assert [files.activate(spark, root, v, f"f{v}", 5, "live") for v in "aab"] == ["created", "already_active", "switched"]
    assert {r.v for r in spark.table("live").collect()} == {"b"} == {r.v for r in V.read_index(spark.newSession(), root).collect()}
