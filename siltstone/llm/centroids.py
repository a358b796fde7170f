"""Centroid clustering with adaptive bounds: exact k-means over integers that skips what bounds can rule out.

Of each vector are kept its centroid, an upper bound of the distance to it, lower bounds of the next few centroids in order
of distance, and one lower bound of all the rest. When centroids move, bounds move by as much. Where the upper bound is
below all lower bounds from some place of the list on, only the centroids before that place are measured; where it isn't
below the remainder's bound either, all are (a rescan), and the list is made anew. How many bounds are kept adapts: a round
keeps as many as any vector of the round before had to look at, a share of the centroids at least.

Distances are exact integers, and bounds are rounded outwards, so a bound never decides a tie: clusters are those of
measuring everything. Vectors lie in blocks, packed in their narrowest integer; a round reads the blocks of the round before
from the shared folder and writes new ones with their sums by cluster, then the old ones are deleted. Only k sums reach the
driver.

Defined cases: a vector that is null, of another length, or with a null or non-finite component isn't kept; a component
beyond 2^27 after scaling raises, for its squared distance needn't fit a long; of repeated rows each counts, and is in the
result; a null vec_id is clustered but never starts a centroid; equal hashes start by the smaller vector; fewer kept vectors
than centroids start as many centroids as there are; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.shared import hold, materialize, small_batches, work_dir

CENTROIDS, ROUNDS, SIZE, SCALE, SEED = 8, 10, 64, 1024, "3"
#: Lower bounds kept of each vector at first, and at least.
BOUNDS, FEWEST = 3, 2
BLOCK = 4096
MOST = 1 << 27
#: Bounds are 32-bit floats; this much outwards covers their rounding.
SLACK = np.float64(4e-7)

BLOCKS = "ids array<bigint>, vectors binary, width int, state binary, bounds int, looked int, rescans bigint, sums array<bigint>"
FINAL = "ids array<bigint>, clusters array<int>, distances array<bigint>, sums array<bigint>"


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of x to every row of c."""
    if not len(x) or not len(c):
        return np.zeros((len(x), len(c)), np.int64)
    if max(np.abs(x).max(), np.abs(c).max()) <= 1 << 20:  # sums stay below 2^53, so floats are exact
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def squares_at(x: np.ndarray, c: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to the rows of c that its row of `at` names."""
    return np.stack([((x - c[at[:, j]]) ** 2).sum(1) for j in range(at.shape[1])], 1) if at.shape[1] else np.zeros((len(x), 0), np.int64)


def up(d: np.ndarray) -> np.ndarray:
    return (d * (1 + SLACK)).astype("<f4")


def down(d: np.ndarray) -> np.ndarray:
    """Lower bounds may become negative as centroids move; those then say nothing, and 0 says as much."""
    return (np.maximum(d, 0) * (1 - SLACK)).astype("<f4")


@dataclass
class Bounds:
    """Of the vectors of a block: centroid, upper bound; the next centroids and their lower bounds; the remainder's."""

    near: np.ndarray
    upper: np.ndarray
    listed: np.ndarray
    lower: np.ndarray
    rest: np.ndarray

    @classmethod
    def measured(cls, x: np.ndarray, c: np.ndarray, keep: int) -> Bounds:
        d2 = squares(x, c)
        order = np.argsort(d2, 1, kind="stable")  # equal distances: the smaller number first
        d = np.sqrt(np.take_along_axis(d2, order, 1).astype(float))
        keep = min(keep, len(c) - 1)
        rest = down(d[:, keep + 1]) if keep + 1 < len(c) else np.full(len(x), np.inf, "<f4")
        return cls(order[:, 0].astype("<u2"), up(d[:, 0]), order[:, 1 : keep + 1].astype("<u2"), down(d[:, 1 : keep + 1]), rest)

    def pack(self) -> bytes:
        return b"".join(np.ascontiguousarray(a).tobytes() for a in (self.near, self.upper, self.listed, self.lower, self.rest))

    @classmethod
    def unpack(cls, data: bytes, n: int, keep: int) -> Bounds:
        out, at = [], 0
        for kind, width in (("<u2", 1), ("<f4", 1), ("<u2", keep), ("<f4", keep), ("<f4", 1)):
            a = np.frombuffer(data, kind, n * width, at).copy()
            at += a.nbytes
            out.append(a)
        return cls(out[0], out[1], out[2].reshape(n, keep), out[3].reshape(n, keep), out[4])

    def fewer(self, keep: int) -> None:
        """Bounds beyond `keep` go into the remainder's."""
        if keep < self.listed.shape[1]:
            self.rest = np.minimum(self.rest, self.lower[:, keep:].min(1))
            self.listed, self.lower = self.listed[:, :keep].copy(), self.lower[:, :keep].copy()

    def moved(self, by: np.ndarray) -> None:
        """Bounds after centroids moved by these distances."""
        self.upper = up(self.upper.astype(float) + by[self.near] * (1 + SLACK))
        self.lower = down(self.lower.astype(float) - by[self.listed] * (1 + SLACK))
        self.rest = np.where(np.isinf(self.rest), self.rest, down(self.rest.astype(float) - by.max(initial=0) * (1 + SLACK)))

    def settle(self, x: np.ndarray, c: np.ndarray) -> tuple[int, int]:
        """Find every vector's centroid again. Most places of the list that any vector had to look at; vectors rescanned."""
        keep = self.listed.shape[1]
        #: below[:, z]: a lower bound of all centroids from place z of the list on.
        below = np.minimum.accumulate(np.concatenate([self.lower, self.rest[:, None]], 1)[:, ::-1], 1)[:, ::-1]
        rows = np.flatnonzero(self.upper >= below[:, 0])
        if not len(rows):
            return 0, 0
        d = np.sqrt(squares_at(x[rows], c, self.near[rows, None].astype(int))[:, 0].astype(float))
        self.upper[rows] = up(d)
        certain = self.upper[rows, None] < below[rows]
        place = np.where(certain.any(1), certain.argmax(1), keep + 1)
        looked = int(np.minimum(place, keep).max(initial=0))
        for z in range(1, keep + 1):
            own = rows[place == z]
            if len(own):
                at = np.concatenate([self.near[own, None], self.listed[own, :z]], 1).astype(int)
                d2 = squares_at(x[own], c, at)
                order = np.lexsort((at, d2), axis=1)  # by distance, then by number
                at, d = np.take_along_axis(at, order, 1), np.sqrt(np.take_along_axis(d2, order, 1).astype(float))
                self.near[own], self.upper[own] = at[:, 0], up(d[:, 0])
                self.listed[own, :z], self.lower[own, :z] = at[:, 1:], down(d[:, 1:])
        own = rows[place == keep + 1]
        if len(own):
            new = Bounds.measured(x[own], c, keep)
            self.near[own], self.upper[own], self.listed[own], self.lower[own], self.rest[own] = new.near, new.upper, new.listed, new.lower, new.rest
        return looked, len(own)


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of each component, x as double."""
    out = np.floor(values.astype(float) * SCALE)
    if len(out) and np.abs(out).max() > MOST:
        raise ValueError(f"a component beyond {MOST} after scaling: squared distances needn't fit a long")
    return out.astype(np.int64)


def narrowed(x: np.ndarray) -> tuple[bytes, int]:
    width = 2 if not len(x) or np.abs(x).max() < 1 << 15 else 4
    return x.astype(f"<i{width}").tobytes(), width


def unpacked(vectors: bytes, width: int) -> np.ndarray:
    return np.frombuffer(vectors, f"<i{width}").astype(np.int64).reshape(-1, SIZE)


def sums_by(near: np.ndarray, x: np.ndarray, k: int) -> list[int]:
    """Of each cluster the sums of its components, then their counts."""
    total = np.zeros((k, SIZE), np.int64)
    for j in range(k):
        total[j] = x[near == j].sum(0)
    return [*total.ravel().tolist(), *np.bincount(near, minlength=k).tolist()]


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the rows that are clustered."""
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where((F.size("embedding") == SIZE) & fine)


def first_centroids(kept: DataFrame, k: int) -> np.ndarray:
    """The vectors whose ids have the k smallest hashes."""
    hashed = kept.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256).alias("h"), "embedding")
    found = [r["embedding"] for r in hashed.orderBy("h", "embedding").limit(k).collect()]
    return scaled(np.array(found, float).reshape(-1, SIZE))


def _block(ids, vectors, width, state: Bounds, looked, rescans, sums) -> list:
    return [ids, vectors, width, state.pack(), state.listed.shape[1], looked, rescans, sums]


def _batch(row: list) -> pa.RecordBatch:
    kinds = [pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])


def assigned_first(kept: DataFrame, c: np.ndarray, bounds: int) -> DataFrame:
    """Vectors in blocks, everything measured."""

    def run(batches):
        hold("centroids")
        for ids, x in _gathered(batches):
            vectors, width = narrowed(x)
            state = Bounds.measured(x, c, bounds)
            yield _batch(_block(ids, vectors, width, state, state.listed.shape[1], len(x), sums_by(state.near, x, len(c))))

    return kept.mapInArrow(run, BLOCKS)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and scaled vectors of up to BLOCK rows."""
    ids: list = []
    parts: list[np.ndarray] = []
    for b in batches:
        if len(b):
            ids += b.column("vec_id").to_pylist()
            parts.append(scaled(b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)))
        while len(ids) >= BLOCK:
            x = np.concatenate(parts)
            yield ids[:BLOCK], x[:BLOCK]
            ids, parts = ids[BLOCK:], [x[BLOCK:]]
    if ids:
        yield ids, np.concatenate(parts)


def assigned_again(blocks: DataFrame, c: np.ndarray, by: np.ndarray, bounds: int) -> DataFrame:
    """Blocks after centroids moved."""

    def run(batches):
        hold("centroids")
        for b in batches:
            for r in b.to_pylist():
                x = unpacked(r["vectors"], r["width"])
                state = Bounds.unpack(r["state"], len(x), r["bounds"])
                state.fewer(bounds)
                state.moved(by)
                looked, rescans = state.settle(x, c)
                yield _batch(_block(r["ids"], r["vectors"], r["width"], state, looked, rescans, sums_by(state.near, x, len(c))))

    return blocks.mapInArrow(run, BLOCKS)


def measured_last(blocks: DataFrame, c: np.ndarray) -> DataFrame:
    """Ids, clusters and exact distances of the blocks, and each cluster's distances summed."""

    def run(batches):
        hold("centroids")
        for b in batches:
            for r in b.to_pylist():
                x = unpacked(r["vectors"], r["width"])
                near = Bounds.unpack(r["state"], len(x), r["bounds"]).near.astype(int)
                d2 = squares_at(x, c, near[:, None])[:, 0]
                sums = [int(d2[near == j].sum()) for j in range(len(c))]
                row = [([r["ids"]], pa.list_(pa.int64())), ([near.tolist()], pa.list_(pa.int32())), ([d2.tolist()], pa.list_(pa.int64())), ([sums], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in row], [f.split()[0] for f in FINAL.split(", ")])

    return blocks.mapInArrow(run, FINAL)


def summed(blocks: DataFrame) -> list[int]:
    """The column `sums` of all blocks, place by place: k rows of sums for each partition, k in all."""
    each = blocks.select(F.posexplode("sums").alias("place", "v")).groupBy("place").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v"))
    return [int(r["v"]) for r in sorted(each.collect())]


def discard(spark: SparkSession, where: str) -> None:
    """Delete a folder that nothing reads any more, wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def updated(c: np.ndarray, sums: list[int]) -> np.ndarray:
    """Componentwise floors of the means; empty clusters keep their centroid."""
    k = len(c)
    counts = sums[k * SIZE :]
    return np.array([[s // counts[j] for s in sums[j * SIZE : (j + 1) * SIZE]] if counts[j] else c[j] for j in range(k)], np.int64).reshape(k, SIZE)


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, bounds: int = BOUNDS, report: list | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector. `report` gets, of each
    round, how many bounds were kept, and how many vectors were rescanned."""
    spark = vectors.sparkSession
    small_batches(spark)
    kept = kept_vectors(vectors)
    c = first_centroids(kept, k)
    if not len(c):
        named = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return spark.createDataFrame([], named)
    where = work_dir(spark, "centroids")
    blocks = materialize(assigned_first(kept, c, bounds), f"{where}/0")
    for i in range(1, rounds + 1):
        new = updated(c, summed(blocks))
        by = np.sqrt(((new - c) ** 2).sum(1).astype(float))
        said = blocks.agg(F.max("looked"), F.sum("rescans"), F.max("bounds")).first()
        bounds = min(said[2], max(said[0], FEWEST, -(-len(c) // 8)))
        if report is not None:
            report.append((said[2], said[1]))
        c = new
        blocks = materialize(assigned_again(blocks, c, by, bounds), f"{where}/{i}")
        discard(spark, f"{where}/{i - 1}")
    last = materialize(measured_last(blocks, c), f"{where}/last")
    discard(spark, f"{where}/{rounds}")
    inertia = summed(last)
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]
    about = spark.createDataFrame([(j, inertia[j], sum(inertia), digests[j]) for j in range(len(c))], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    rows = last.select(F.explode(F.arrays_zip("ids", "clusters", "distances")).alias("r")).select(F.col("r.ids").alias("vec_id"), F.col("r.clusters").alias("cluster"), F.col("r.distances").alias("distance"))
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
