"""Sharding by histogram sort, in DataFrame operations alone.

Rows have a place on a line: text hash, then hash of doc_id, then a number of the row, so that equal texts lie together
and one text that holds a third of all rows can still be cut. Each round counts the exact bytes below candidate
boundaries, over all rows, in the cells that still hold a wanted boundary; a cell is then narrowed 4,096-fold. When every
boundary is within tolerance, rows are exchanged once, into their shards.

Defined cases: a null text has size 1; a very long text is one row, which is never cut; repeated rows keep a slot each, and
rows that tie on the line lie in an order of their own numbers; an empty table gives no rows; extra columns are ignored
unless named in `carry`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import materialize, text_of, work_dir

#: Bits by which a round narrows a cell; at most shards * 2^BITS counts reach the driver in a round.
BITS = 12
KEYS = ("text_hash", "id_hash", "row_hash")
LEAST = -(1 << 63)
#: Rows of a shard that are numbered in one task.
SLICE = 100_000


def _cell_of(cells: Sequence[tuple]) -> tuple[Column, Column]:
    """Which cell a row lies in (null: none) and its bucket there. A cell: values of whole keys; the shift that gives its
    buckets; the shift and value that bound it (None: all)."""
    cell, bucket = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, (whole, shift, bound, value) in reversed(list(enumerate(cells))):
        key = F.col(KEYS[len(whole)])
        inside = F.lit(True)
        for k, v in zip(KEYS, whole):
            inside = inside & (F.col(k) == v)
        if value is not None:
            inside = inside & (F.shiftright(key, bound) == value)
        cell = F.when(inside, F.lit(i)).otherwise(cell)
        bucket = F.when(inside, F.shiftright(key, shift)).otherwise(bucket)
    return cell, bucket


def splitters(keys: DataFrame, total: int, shards: int, tolerance: float) -> list[tuple[int, int, int]]:
    """Lower ends of shards 1.. on the line, each within tolerance * total / shards bytes of its ideal place, or one row."""
    slack = tolerance * total / shards
    # Of each boundary: its cell and the bytes before the cell.
    open_ = {j: (((), 64 - BITS, None, None), 0) for j in range(1, shards)} if total else {}
    done: dict[int, tuple[int, int, int]] = {}
    while open_:
        cells = list(dict.fromkeys(c for c, _ in open_.values()))
        cell, bucket = _cell_of(cells)
        found = keys.select(cell.alias("cell"), bucket.alias("bucket"), "size").where("cell is not null").groupBy("cell", "bucket").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
        bars: dict[int, list[tuple[int, int, int]]] = {}
        for r in sorted(found, key=lambda r: (r["cell"], r["bucket"])):
            bars.setdefault(r["cell"], []).append((r["bucket"], r["bytes"], r["rows"]))
        still = {}
        for j, (c, before) in open_.items():
            (whole, shift, *_), want, at = c, total * j / shards, before
            mine = bars[cells.index(c)]
            for k, (b, size, rows) in enumerate(mine):
                if at + size > want or k == len(mine) - 1:
                    break
                at += size
            edge = lambda x: (*whole, x << shift, *[LEAST] * (2 - len(whole)))  # noqa: E731, B023
            after = mine[k + 1][0] if k + 1 < len(mine) else None
            low, high = abs(want - at), abs(at + size - want)
            if low <= slack and (after is None or low <= high):
                done[j] = edge(b)
            elif after is not None and high <= slack:
                done[j] = edge(after)
            elif rows == 1 and (low <= high or after is not None or b + 1 < 1 << 63 - shift):  # no finer cut can part it
                done[j] = edge(b) if low <= high else edge(after if after is not None else b + 1)
            elif shift > 0:
                still[j] = ((whole, max(0, shift - BITS), shift, b), at)
            elif len(whole) < 2:
                still[j] = (((*whole, b), 64 - BITS, None, None), at)
            else:
                done[j] = edge(b) if low <= high or after is None else edge(after)
        open_ = still
    return [done[j] for j in sorted(done)]


def histogram_shards(docs: DataFrame, shards: int = 16, tolerance: float = 0.001, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: this law is by bytes), and the carried columns."""
    spark = docs.sparkSession
    text = text_of()
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), F.xxhash64("doc_id").alias("id_hash"), F.xxhash64(F.monotonically_increasing_id()).alias("row_hash"), *carry)
    keys = materialize(rows, work_dir(spark, "shards"))
    n, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ends = splitters(keys, total, shards, tolerance)
    place = F.struct(*KEYS)
    shard = sum(((place >= F.struct(*(F.lit(v).cast("long").alias(k) for k, v in zip(KEYS, e)))).cast("int") for e in ends), F.lit(0))
    slices = max(1, -(-n // (shards * SLICE)))
    out = keys.withColumn("shard", shard.cast("int")).withColumn("slice", F.pmod("row_hash", F.lit(slices)).cast("int"))
    within = Window.partitionBy("shard", "slice").orderBy(*KEYS)
    placed = out.withColumn("own", F.row_number().over(within).cast("long") - 1)
    if slices > 1:
        before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        bases = out.groupBy("shard", "slice").count().select("shard", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
        placed = placed.join(bases, ["shard", "slice"]).withColumn("own", F.col("own") + F.col("base"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("own").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *carry)


def write_shards(docs: DataFrame, folder: str, columns: Sequence[str], shards: int = 16, tolerance: float = 0.001) -> None:
    """Write the named columns as Parquet, a folder for each shard, files in slot order."""
    histogram_shards(docs, shards, tolerance, columns).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
