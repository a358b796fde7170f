"""Token ids in flat binary files.

Each partition of the sorted documents becomes three memory-mapped files: `ids` (little-endian unsigned integers, two
bytes each where the vocabulary fits, else four), `offsets` (little-endian unsigned 64-bit, one more than documents,
counted in ids) and `docs` (little-endian signed 64-bit document ids). A partition's base, the ids of all partitions
before it, is the prefix sum over the manifest.

Defined cases: null and empty texts hold the end id alone; very long texts are encoded whole; rows that repeat a doc_id
keep one entry each, in order of their texts; an empty table gives no files and no rows; rows without a doc_id come first;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import distinct, gathered, hold, joined, materialize, Memo, posix_path, runs_of, small_batches, text_of, written_whole

#: White space other than blank and line feed.
ODD = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
#: Blank and line feed; what a word of letters or digits may end before, whatever follows.
WHITE, MARKS = b" \n", b",.;:!?|$%#&*"
MEMO = 600_000
#: Documents of a block that is read back at once; ids that a task reads back, about.
BLOCK, TASK_IDS = 50_000, 8_000_000


class IdEncoder:
    """The tokenizers library, asked once for each distinct unit: blanks and line feeds with the word behind them, which
    ends before a mark, too, where a Latin letter or a digit stands there.

    Byte-level pre-tokens never reach from a character that isn't white space to a blank, nor from a letter or a digit to
    a mark, so units are encoded alone. A text with other white space or a special string is one unit.
    Units are cut and told apart as arrays of bytes, many texts at once. Those that are new are encoded in one call and
    told apart by their first token, or, where they don't begin with one blank or line feed, parted by the end string,
    which is a special token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.width = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        special = {i: t.content for i, t in self.tok.get_added_tokens_decoder().items() if t.special}
        self.mark_id, self.mark = next(iter(special.items()), (None, None))
        self.special = list(special.values())
        self.memo = Memo(MEMO)
        #: Whether a token begins with a blank or line feed, which byte-level vocabularies write so.
        first = (self.tok.id_to_token(i) or "?" for i in range(self.tok.get_vocab_size()))
        self.begins = np.array([t[0] in "ĠĊ" for t in first])

        self.white, self.mark_byte = _table(WHITE), _table(MARKS)
        self.word = _table(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
        odd = [c.encode() for c in ODD]
        self.odd_byte, self.odd_lead = _table(b"".join(c for c in odd if len(c) == 1)), _table(bytes({c[0] for c in odd if len(c) > 1}))
        #: Other white space of two and of three bytes as numbers.
        self.odd_two, self.odd_three = (np.array([int.from_bytes(c) for c in odd if len(c) == n]) for n in (2, 3))

    def _raw(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.width)

    def _whole(self, data: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Places of the texts that are encoded whole."""
        if self.mark is None:
            return np.flatnonzero(np.diff(line))
        at = [np.flatnonzero(self.odd_byte[data])]
        lead = np.flatnonzero(self.odd_lead[data])
        if len(lead):
            end = len(data) - 1
            two = data[lead].astype(np.int64) << 8 | data[np.minimum(lead + 1, end)]
            at.append(lead[np.isin(two, self.odd_two) | np.isin(two << 8 | data[np.minimum(lead + 2, end)], self.odd_three)])
        held = data.tobytes()
        for s in map(str.encode, self.special):
            i = held.find(s)
            while i >= 0:
                at.append(np.array([i]))
                i = held.find(s, i + 1)
        return np.unique(np.searchsorted(line, np.concatenate(at), "right") - 1)

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        """Whether a unit begins at each byte."""
        white = self.white[data]
        word = self.word[data]
        # À to ÿ but for the two signs among them, by their second byte.
        latin = np.flatnonzero(data[:-1] == 0xC3) + 1
        word[latin] = (data[latin] != 0x97) & (data[latin] != 0xB7)
        out = np.empty(len(data), bool)
        out[:1] = True
        out[1:] = (white[1:] & ~white[:-1]) | (self.mark_byte[data[1:]] & word[:-1])
        return out

    def _learn(self, new: list[bytes]) -> None:
        """Put units into the memo."""
        memo = self.memo
        # A word behind one blank or line feed needs no mark: its first token alone begins with white space.
        led = [u for u in new if u[0] in WHITE and u[1:2] not in (b"", b" ", b"\n")]
        for at in range(0, len(led), 512):
            some = led[at : at + 512]
            ids = self._raw(b"".join(some).decode())
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) != len(some):
                raise AssertionError("a unit didn't begin with one white space token")
            packed, w = ids.tobytes(), self.width.itemsize
            for u, a, z in zip(some, (starts * w).tolist(), [*(starts[1:] * w).tolist(), len(packed)], strict=True):
                memo[u] = packed[a:z]
        new = list(set(new).difference(led))
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            ids = self._raw(self.mark.join(u.decode() for u in some))
            ends = [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            start = 0
            for u, end in zip(some, ends, strict=True):
                memo[u] = ids[start:end].tobytes()
                start = end + 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row, and how many each text has."""
        data, line = joined(texts)
        cut = self._cuts(data)
        whole = self._whole(data, line)
        for k in whole.tolist():
            cut[line[k] : line[k + 1]] = False
        cut[line[:-1][np.diff(line) > 0]] = True
        starts = np.flatnonzero(cut)
        units, codes = distinct(data, starts)
        bounds = np.searchsorted(starts, line)
        memo = self.memo
        memo.turn()
        got = list(map(memo.get, units))
        for c in set(codes[bounds[whole]].tolist()):
            got[c] = self._raw(units[c].decode()).tobytes()
        if missing := [i for i, g in enumerate(got) if g is None]:
            self._learn([units[i] for i in missing if memo.recall(units[i]) is None])
            for i in missing:
                got[i] = memo[units[i]]
        ids, n = gathered(got, codes, self.width)
        return ids, np.diff(np.concatenate([[0], np.cumsum(n)])[bounds])


def _table(of: bytes) -> np.ndarray:
    """Whether each byte is among some."""
    out = np.zeros(256, bool)
    out[list(of)] = True
    return out


_LOADED: dict[str, IdEncoder] = {}


def encoder(path: str) -> IdEncoder:
    hold("token_files", _LOADED.clear)
    if path not in _LOADED:
        _LOADED[path] = IdEncoder(path)
    return _LOADED[path]


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> DataFrame:
    """Encode all texts, append end_id, write the files into `folder` (a URI on a shared mount); return the manifest:
    part, base (ids of all parts before), n_ids, n_docs, n_null (documents without an id, which come first), width.

    One exchange: texts go by range of doc_id. Ids are written as they come, so a partition may be of any size. Files are
    named by partition and renamed into place, so a task that runs again after a lost executor leaves the same files.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = posix_path(folder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        part, n_ids, n_docs, nulls = TaskContext.get().partitionId(), 0, 0, 0
        with written_whole(*(f"{path}/{part:06d}.{kind}" for kind in ("ids", "offsets", "docs"))) as (ids, offsets, names):
            offsets.write(bytes(8))
            for b in runs_of(batches):
                nulls += b.column("doc_id").null_count
                names.write(b.column("doc_id").fill_null(0).to_numpy().astype("<i8").tobytes())
                got, n = enc.encode(b.column("text").combine_chunks())
                n_docs += len(n)
                ends = np.cumsum(n)
                offsets.write((n_ids + ends + np.arange(1, len(n) + 1)).astype("<u8").tobytes())
                ids.write(np.insert(got, ends, end_id).tobytes())
                n_ids += len(got) + len(n)
        if n_docs:
            yield pa.RecordBatch.from_pydict({"part": [part], "n_ids": [n_ids], "n_docs": [n_docs], "n_null": [nulls], "width": [enc.width.itemsize]})

    made = materialize(ordered.mapInArrow(write, "part long, n_ids long, n_docs long, n_null long, width long"), f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return made.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the mapped files. Blocks of documents are dealt out to
    as many tasks as their ids need."""
    path = posix_path(folder)
    small_batches(spark)

    def read(batches):
        for b in batches:
            for part, base, nulls, width, block in zip(*(b.column(n).to_pylist() for n in ("part", "base", "n_null", "width", "block")), strict=True):
                ids = np.memmap(f"{path}/{part:06d}.ids", f"<u{width}", "r")
                offsets = np.memmap(f"{path}/{part:06d}.offsets", "<u8", "r")
                docs = np.memmap(f"{path}/{part:06d}.docs", "<i8", "r")
                for at in range(block * BLOCK, min(len(docs), (block + 1) * BLOCK), 1000):
                    ends = offsets[at : at + 1001].astype(np.int64)
                    crcs = [zlib.crc32(ids[a:z].astype("<u4").tobytes()) for a, z in zip(ends[:-1], ends[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(docs[at : at + 1000], mask=np.arange(at, at + len(crcs)) < nulls), pa.array(ends[:-1] + base), pa.array(np.diff(ends)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    total, files = manifest.agg(F.coalesce(F.sum("n_ids"), F.lit(0)), F.count(F.lit(1))).first()
    blocks = manifest.select("part", "base", "n_null", "width", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_docs") - 1) / BLOCK).cast("int"))).alias("block"))
    return blocks.repartition(max(1, files, -(-total // TASK_IDS)), "part", "block").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(folder: str, part: int, row: int, width: int = 2) -> np.ndarray:
    """The ids of one document, by its place: two offset reads and one range of the mapped file."""
    path = posix_path(folder)
    a, z = np.memmap(f"{path}/{part:06d}.offsets", "<u8", "r")[row : row + 2].astype(np.int64)
    return np.memmap(f"{path}/{part:06d}.ids", f"<u{width}", "r")[a:z]
