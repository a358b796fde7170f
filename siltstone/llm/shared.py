"""What the operators of this package have in common: files in shared folders, null-safe texts, Arrow batches."""

from __future__ import annotations

import contextlib
import gc
import itertools
import os
import re
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.session import materialize, prepare, spread, work_dir

__all__ = ["atomic_write", "columns_of", "distinct", "free_name", "gathered", "hold", "joined", "map_rows", "materialize", "Memo", "posix_path", "prepare", "runs_of", "small_batches", "spread", "text_of", "work_dir", "written_whole"]


def posix_path(uri: str) -> str:
    """The path of a folder that all machines mount. Memory-mapped files need one, so other stores are refused."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted shared folder; {uri} isn't one")
    return parts.path


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    out = f"__{name}"
    while out in taken:
        out += "_"
    return out


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch], int], Iterator[pa.RecordBatch]], *more: T.StructField) -> DataFrame:
    """mapInArrow over all columns, whatever their names, and further ones behind them: run gets the batches and the place
    of the column `text`; columns go by place."""
    names = [f"c{i}" for i in range(len(df.columns))]
    at = df.columns.index("text")
    schema = T.StructType([*(T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, df.schema.fields, strict=True)), *more])
    return df.toDF(*names).mapInArrow(lambda batches: run(batches, at), schema).toDF(*df.columns, *(f.name for f in more))


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of bounded size, for texts are long. Frames are lazy, so the session keeps the setting; smaller bounds
    of its own stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        now = re.match(r"\d+", spark.conf.get(key, None) or "")
        if not now or not 0 < int(now[0]) <= most:
            spark.conf.set(key, str(most))


def atomic_write(path: str, parts: list) -> int:
    """Write bytes-like parts to a temporary name, then rename: a retried or doubled task leaves one whole file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(own, "wb") as f:
        n = sum(f.write(p) for p in parts)
    os.replace(own, path)
    return n


@contextlib.contextmanager
def written_whole(*paths: str):
    """Files to write bytes to, under temporary names; renamed at the end, or removed where nothing was written to the
    first, or after an error."""
    os.makedirs(os.path.dirname(paths[0]), exist_ok=True)
    own = [f"{p}.{uuid.uuid4().hex}.tmp" for p in paths]
    files = [open(p, "wb") for p in own]  # noqa: SIM115
    try:
        yield files
        some = files[0].tell() > 0
    except BaseException:
        some = False
        raise
    finally:
        for f in files:
            f.close()
        for p, to in zip(own, paths, strict=True):
            if some:
                os.replace(p, to)
            else:
                os.remove(p)


#: Of a worker: the operator whose tables it holds, and what lets go of them.
_HOLDER: list[tuple[str, Callable[[], None]]] = []


def hold(operator: str, release: Callable[[], None] = lambda: None) -> None:
    """Called where a worker's task begins: tables of another operator, kept for its next task, are let go, so that a worker
    that serves several operators in turn holds those of one."""
    if not _HOLDER or _HOLDER[0][0] != operator:
        for _, other in _HOLDER:
            other()
        _HOLDER[:] = [(operator, release)]
        gc.collect()


class Memo(dict):
    """A dictionary of bounded size in two generations: what is asked for again outlives the turn of a generation."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def turn(self) -> None:
        """Called between texts: a full generation becomes the older one."""
        if len(self) > self.most // 2:
            self.older = self.copy()
            self.clear()

    def recall(self, key):
        """From the older generation, into this one; None if unknown."""
        got = self.older.get(key)
        if got is not None:
            self[key] = got
        return got


#: Bytes of batches that are worked on at once, about.
AT_ONCE = 1 << 22


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of batches in a row that hold up to AT_ONCE bytes together, or of one that holds more."""
    held, size = [], 0
    for b in batches:
        if held and size + b.nbytes > AT_ONCE:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    if held:
        yield pa.Table.from_batches(held)


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts in a row (or bytes as they are), and where each begins, with the end behind the last. No text
    is null."""
    a = texts if pa.types.is_large_binary(texts.type) else texts.cast(pa.large_string())
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    held = a.buffers()[2]
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held else np.empty(0, np.uint8)
    return data, at - at[0]


def distinct(data: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Distinct units of bytes that are cut at `starts`, from 0 on; and of each unit its place among them."""
    line = np.append(starts, len(data)).astype(np.int64) if len(starts) else np.zeros(1, np.int64)
    got = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(line), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    units, ends = joined(got.dictionary)
    whole, ends = units.tobytes(), ends.tolist()
    return [whole[a:z] for a, z in itertools.pairwise(ends)], got.indices.to_numpy(zero_copy_only=False)


def gathered(values: list[bytes], codes: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Packed numbers of the values that codes name, in a row, and how many each has."""
    kind = np.dtype(kind)
    size = np.fromiter(map(len, values), np.int64, len(values)) // kind.itemsize
    first = np.cumsum(size) - size
    n = size[codes]
    ends = np.cumsum(n)
    flat = np.frombuffer(b"".join(values), kind)
    at = np.repeat(first[codes] - ends + n, n)
    at += np.arange(len(at))
    return flat[at], n
