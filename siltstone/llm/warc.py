"""WARC archives with a two-level capture index.

Captures go by range of their key (host reversed, then path) into parts. A part is three files: `.warc.gz`, one gzip
member for each record; `.cdx.gz`, sorted index lines in compressed blocks; `.dir`, a line for each block with its first
key and place. A look-up searches the directory by halves, unpacks one block, searches it by halves, and reads the
record's range. Archives are read back by such look-ups of every key; a key that many captures share lies in many parts,
each of which is searched by a task of its own.

Defined cases: null html is an empty payload; a null url has an empty key; a null page_id never stands for others and
has an empty field; very long pages are one record; of records with equal payloads and equal page_id one is the response,
that of the smallest key and url; records whose page_id repeats are kept each; an empty table gives no files and no rows;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import mmap
import os
import re
import string
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.shared import materialize, posix_path, small_batches, written_whole

BLOCK = 500
#: Repeated digests that are broadcast at most, about 100 bytes each.
MOST_BROADCAST = 500_000
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
CONTROLS = "".join(map(chr, [*range(0x21), 0x7F]))
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: Bytes of archives that a task reads back, about.
TASK_BYTES = 8 << 20


def surt(url: str | None) -> str:
    """The key of a url: host labels in reverse, ")", path and query. Text that isn't a url is its own key."""
    m = re.match(URL, url or "")
    if not m:
        return _line_safe(url or "")
    host = re.sub(r":[0-9]*$", "", re.sub(r"^.*@", "", m[1])).translate(_LOWER)
    return _line_safe(",".join(reversed(host.split("."))) + ")" + (m[2] or "/"))


def _line_safe(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: int | None, url: str | None, html: bytes, size: int, digest: str, first: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit holds no payload, but its size and digest."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    http = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": name(page_id), "WARC-Date": DATE, "WARC-Target-URI": _line_safe(url or "about:blank"),
        "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Bytes": size, "X-Page-ID": "" if page_id is None else page_id,
    }
    if revisit:
        head |= {"WARC-Profile": REVISIT, "WARC-Refers-To": name(first), "X-Refers-To-Page-ID": first}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(http) + (0 if revisit else len(html))}
    top = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return top.encode() + http + (b"" if revisit else html) + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in top.decode().split("\r\n")[1:])
    body = rest[: int(head["Content-Length"])]
    return head, body.partition(b"\r\n\r\n")[2]


def _key(url: str) -> Column:
    """surt() as a column."""
    host = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_extract(url, URL, 1), "^.*@", ""), ":[0-9]*$", ""), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(url, URL, 2)
    key = F.coalesce(F.when(F.col(url).rlike(URL), F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))).otherwise(F.col(url)), F.lit(""))
    safe = F.array_join(F.transform(F.split(key, ""), lambda c: F.when((F.length(c) > 0) & F.contains(F.lit(CONTROLS), c), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)), "")
    return F.when(key.rlike(r"[\x00-\x20\x7f]"), safe).otherwise(key)


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write every page (page_id, url, html) into archives below `folder` (a URI on a shared mount); return the manifest:
    part, first_key, last_key, n_records, n_blocks, n_bytes.

    Of records with equal payloads of at least `least` bytes the one with the smallest page_id is a response, the
    others are revisits. The digests are grouped without the texts, so a payload that a third of all pages share costs
    a row for each task. Only digests that occur again are joined to the pages: by broadcast up to MOST_BROADCAST of
    them, beyond that in a shuffle join, whose large partitions Spark splits.
    """
    spark = pages.sparkSession
    small_batches(spark)
    path = posix_path(folder)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    rows = rows.select("*", F.sha1("html").alias("digest"), F.octet_length("html").cast("long").alias("size"), _key("url").alias("key"))
    own = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "key", "url"))
    firsts = rows.groupBy("digest").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    firsts = materialize(firsts, f"{folder}/repeated")
    few = firsts.count() <= MOST_BROADCAST
    typed = rows.join(F.broadcast(firsts) if few else firsts, "digest", "left")
    # Where equal rows are all first, the writer takes the first of them.
    first = F.col("first").isNull() | (F.col("size") < least) | own.eqNullSafe(F.col("first"))
    typed = typed.withColumn("tied", F.col("first").isNotNull() & (F.col("size") >= least) & first).withColumn("revisit", ~first).withColumn("first", F.col("first.page_id"))
    ordered = typed.withColumn("html", F.when(~F.col("revisit"), F.col("html"))).repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "digest", "url")

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        lines: list[str] = []
        edges: list[str] = []
        n = blocks = at = 0
        last = None
        with written_whole(*(f"{path}/{part:06d}.{kind}" for kind in ("warc.gz", "cdx.gz", "dir"))) as (warc, cdx, directory):

            def flush() -> None:
                nonlocal blocks
                if lines:
                    packed = gzip.compress("".join(lines).encode(), 6, mtime=0)
                    directory.write(f"{lines[0].split(chr(9), 1)[0]}\t{cdx.tell()}\t{len(packed)}\n".encode())
                    cdx.write(packed)
                    blocks += 1
                    lines.clear()

            for b in batches:
                for page_id, url, html, size, digest, first, revisit, tied, key in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "size", "digest", "first", "revisit", "tied", "key")), strict=True):
                    if tied:
                        revisit, last = last == (page_id, digest), (page_id, digest)
                    code = base64.b32encode(bytes.fromhex(digest)).decode()
                    packed = gzip.compress(record(page_id, url, html or b"", size, code, first, revisit), 6, mtime=0)
                    warc.write(packed)
                    lines.append(f"{key}\t{'' if page_id is None else page_id}\t{at}\t{len(packed)}\t{code}\t{'revisit' if revisit else 'response'}\n")
                    at += len(packed)
                    edges = [edges[0] if edges else key, key]
                    n += 1
                    if len(lines) == BLOCK:
                        flush()
            flush()
        if n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "first_key": [edges[0]], "last_key": [edges[1]], "n_records": pa.array([n], pa.int64()), "n_blocks": pa.array([blocks], pa.int64()), "n_bytes": pa.array([at], pa.int64())})

    return materialize(ordered.mapInArrow(write, "part long, first_key string, last_key string, n_records long, n_blocks long, n_bytes long"), f"{folder}/manifest")


class Part:
    """Reader of one part, over mapped files."""

    def __init__(self, folder: str, part: int):
        base = f"{folder}/{part:06d}"
        with open(f"{base}.dir", "rb") as f:
            self.directory = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.cdx, self.warc = open(f"{base}.cdx.gz", "rb"), open(f"{base}.warc.gz", "rb")  # noqa: SIM115
        self.block: tuple[int, list[list[str]]] = (-1, [])

    def _line(self, at: int) -> tuple[int, list[str]]:
        """Start and fields of the directory line that holds byte `at`."""
        start = self.directory.rfind(b"\n", 0, at) + 1
        return start, self.directory[start : self.directory.find(b"\n", at)].decode().split("\t")

    def lines(self, entry: list[str]) -> list[list[str]]:
        """The index lines of one block."""
        self.cdx.seek(int(entry[1]))
        return [x.split("\t") for x in gzip.decompress(self.cdx.read(int(entry[2]))).decode().split("\n")[:-1]]

    def read(self, line: list[str]) -> tuple[dict[str, str], bytes]:
        self.warc.seek(int(line[2]))
        return parse(gzip.decompress(self.warc.read(int(line[3]))))

    def find(self, key: str) -> Iterator[list[str]]:
        """Index lines of a key: by halves over the directory's bytes to the last block that begins before it, then by
        halves in the block."""
        low, high = 0, len(self.directory)
        while low < high:
            mid = (low + high) // 2
            start, entry = self._line(mid)
            if entry[0] < key:
                low = self.directory.find(b"\n", mid) + 1
            else:
                high = start
        at = self._line(low - 1)[0] if low else 0
        while at < len(self.directory):
            _, entry = self._line(at)
            if entry[0] > key:
                break
            if self.block[0] != at:  # keys that are asked for in order mostly lie in the block before
                self.block = (at, self.lines(entry))
            lines = self.block[1]
            i = bisect.bisect_left(lines, key, key=lambda x: x[0])
            while i < len(lines) and lines[i][0] == key:
                yield lines[i]
                i += 1
            at = self.directory.find(b"\n", at) + 1

    def close(self) -> None:
        for f in (self.directory, self.cdx, self.warc):
            f.close()


def look_up(manifest: list, folder: str, url: str) -> list[tuple[dict[str, str], bytes]]:
    """Records of a url: parts whose keys may hold it, then their indexes. manifest: collected rows (one for each part)."""
    key, out = surt(url), []
    for row in sorted(manifest, key=lambda r: r["part"]):
        if row["first_key"] <= key <= row["last_key"]:
            part = Part(posix_path(folder), row["part"])
            out += [part.read(x) for x in part.find(key)]
            part.close()
    return out


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame, urls: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the urls (a frame with a column
    url), by look-ups in the index. A payload whose digest isn't the recorded one is an error."""
    path = posix_path(folder)
    small_batches(spark)
    parts = sorted((r["first_key"], r["last_key"], r["part"]) for r in manifest.select("first_key", "last_key", "part").toLocalIterator())  # a row for each part
    total = manifest.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    shared = spark.sparkContext.broadcast(parts)

    def place(batches):
        """The parts that may hold each key: they are in order, and only a part's last key may be the next one's first."""
        parts = shared.value
        lasts = [x[1] for x in parts]
        for b in batches:
            keys, at = [], []
            for key in b.column("key").to_pylist():
                k = bisect.bisect_left(lasts, key)
                while k < len(parts) and parts[k][0] <= key:
                    keys.append(key)
                    at.append(parts[k][2])
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(at, pa.int64())], ["key", "part"])

    def read(batches):
        part, no = None, None
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        rows: list[tuple] = []
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        whole = lambda v: int(v) if v else None
        for b in batches:
            for key, k in zip(b.column("key").to_pylist(), b.column("part").to_pylist(), strict=True):
                if k != no:
                    if part:
                        part.close()
                    part, no = Part(path, k), k
                for line in part.find(key):
                    head, payload = part.read(line)
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"damaged record at {line[2]} of part {no}")
                    rows.append((whole(head.get("X-Page-ID")), int(head["X-Payload-Bytes"]), digest, head["WARC-Type"], whole(head.get("X-Refers-To-Page-ID"))))
                    if len(rows) == 1000:
                        yield out()
                        rows.clear()
        if rows:
            yield out()
        if part:
            part.close()

    asked = urls.select(_key("url").alias("key")).distinct().mapInArrow(place, "key string, part long")
    dealt = asked.repartitionByRange(max(1, -(-total // TASK_BYTES)), "part", "key").sortWithinPartitions("part", "key")
    return dealt.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
