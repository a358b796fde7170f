"""File sources and sinks: JSON lines and documents, office files, checksums, versioned tables with a switched view."""

from __future__ import annotations

import gzip
import io
import re
import time
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators import numbering
from siltstone.sources import versions

CHUNK = T.StructType([T.StructField(n, T.StringType()) for n in ("chunk_id", "chunk_key", "chunk_type", "content", "article_code", "article_title", "document_id", "source_document_id")])
MOST_BYTES, MOST_UNPACKED = 10 << 20, 50 << 20
KINDS = {".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".txt": "text/plain", ".pdf": "application/pdf"}
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class CorpusError(ValueError):
    """A corpus that breaks its rules."""


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = CHUNK, expected_rows: int | None = None) -> DataFrame:
    """One object a line, blank lines skipped; a malformed line fails the read. Fails where ids are missing or repeat,
    contents are blank, or the number of rows isn't the expected one."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    bad = df.agg(F.count_if(F.trim(F.coalesce("chunk_id", F.lit(""))) == "").alias("no_id"), F.count_if(F.trim(F.coalesce("content", F.lit(""))) == "").alias("blank"), F.count(F.lit(1)).alias("n")).first()
    repeated = df.groupBy("chunk_id").count().where("count > 1").limit(1).count()
    problems = [p for p, on in (("missing ids", bad["no_id"]), ("blank contents", bad["blank"]), ("repeated ids", repeated), ("row count", expected_rows is not None and bad["n"] != expected_rows)) if on]
    if problems:
        raise CorpusError(f"{path}: {', '.join(problems)}")
    return df


def read_json_document(spark: SparkSession, path: str, schema: str | T.StructType, array: str) -> DataFrame:
    """The objects of an array inside whole-file JSON documents."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.inline(array))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of files."""
    b = spark.read.format("binaryFile").load(path)
    return b.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_checksums(digests: DataFrame, inventory: DataFrame) -> DataFrame:
    """(name, problem) of files that an inventory (name, sha256) misses, or that are missing or changed."""
    both = inventory.withColumnRenamed("sha256", "wanted").join(digests, "name", "full")
    problem = F.when(F.col("wanted").isNull(), "unexpected").when(F.col("sha256").isNull(), "missing").when(F.col("wanted") != F.col("sha256"), "changed")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def docx_lines(content: bytes) -> list[str]:
    """Paragraphs and table rows of a document's body in order; cells joined by ` | `. Refuses what unpacks too large."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if sum(i.file_size for i in z.infolist()) > MOST_UNPACKED:
            raise ValueError("unpacks too large")
        name = next(n for n in z.namelist() if n.replace("\\", "/") == "word/document.xml")
        body = ElementTree.fromstring(z.read(name)).find(f"{W}body")
    text = lambda e: "".join("\t" if t.tag == f"{W}tab" else t.text or "" for t in e.iter() if t.tag in (f"{W}t", f"{W}tab")).strip()
    out = []
    for e in body:
        if e.tag == f"{W}p":
            out.append(text(e))
        elif e.tag == f"{W}tbl":
            for row in e.iter(f"{W}tr"):
                out.append(" | ".join(filter(None, (" ".join(filter(None, map(text, c.iter(f"{W}p")))) for c in row.iter(f"{W}tc")))))
    return [x for x in out if x]


def number_text(n: int, form: str) -> str:
    """A list number in a form of the word processor: decimal, letters (A to Z, AA, AB), roman."""
    if form in ("lowerLetter", "upperLetter"):
        s = ""
        while n:
            n, last = divmod(n - 1, 26)
            s = chr(ord("a") + last) + s
    elif form in ("lowerRoman", "upperRoman") and 0 < n < 4000:
        s = "".join(row[n // 10**place % 10] for row, place in zip(numbering.ROMAN, (3, 2, 1, 0), strict=True)).lower()
    else:
        return f"{n:02d}" if form == "decimalZero" else str(n)
    return s.upper() if form.startswith("upper") else s


def squeeze_lines(text: str) -> str:
    """White space squeezed in each line, at most one blank line in a row."""
    return re.sub(r"\n{3,}", "\n\n", "\n".join(" ".join(x.split()) for x in text.splitlines())).strip()


def extract_files(spark: SparkSession, path: str, pdf=None, least: int = 80, most: int = 200_000) -> DataFrame:
    """(name, text, problem) of files by type. pdf: a function from bytes to text; without one, PDF files are a problem.
    Files of no bytes aren't listed. Those that are too large, of another type, or whose text is too short or long, have a problem and no text."""
    b = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")

    def one(name: str, size: int, content: bytes) -> tuple[str | None, str | None]:
        kind = "." + name.rpartition(".")[2].lower()
        if size > MOST_BYTES:
            return None, "too_large"
        if kind not in KINDS or kind == ".pdf" and pdf is None:
            return None, "unsupported_type"
        try:
            text = "\n".join(docx_lines(content)) if kind == ".docx" else pdf(content) if kind == ".pdf" else content.decode("utf-8-sig")
        except Exception as e:  # noqa: BLE001 - whatever a damaged file raises is its problem
            return None, f"unreadable: {type(e).__name__}"
        text = squeeze_lines(text)
        return (text, None) if least <= len(text) <= most else (None, "text_length")

    def read(batches):
        for x in batches:
            got = [one(*r) for r in zip(*(x.column(c).to_pylist() for c in ("name", "length", "content")), strict=True)]
            yield pa.RecordBatch.from_arrays([x.column("name"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], ["name", "text", "problem"])

    return b.mapInArrow(read, "name string, text string, problem string")


def score_urls(urls: DataFrame, number: str, url: str = "url") -> DataFrame:
    """The url that names a document number: 10,000 for the number itself, and the shorter the better. An equal best
    score is an error."""
    key = re.sub(r"[^a-z0-9]", "", number.lower())
    bare = F.regexp_replace(F.lower(url), "[^a-z0-9]", "")
    scored = urls.withColumn("score", F.when(bare.contains(key), 10_000 + 1000 - F.length(url))).where("score is not null")
    best = scored.orderBy(F.desc("score")).limit(2)  # each task keeps two rows
    if len({r["score"] for r in best.select("score").collect()}) == 1 and best.count() == 2:
        raise CorpusError(f"{number}: more than one url")
    return best.limit(1)


def json_values(docs: DataFrame, column: str, *keys: str) -> DataFrame:
    """All columns and `found`, the first non-empty value of any of the keys at any depth of a JSON text."""
    wanted = {k.lower() for k in keys}

    def walk(x):
        if isinstance(x, dict):
            for k, v in x.items():
                if k.lower() in wanted and v not in (None, "", [], {}):
                    yield v
                yield from walk(v)
        elif isinstance(x, list):
            for v in x:
                yield from walk(v)

    def find(batches):
        import json

        for b in batches:
            got = [next((v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in walk(json.loads(t or "null"))), None) for t in b.column(b.schema.names.index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], [*b.schema.names, "found"])

    return docs.mapInArrow(find, T.StructType([*docs.schema.fields, T.StructField("found", T.StringType())]))


def to_documents(chunks: DataFrame, content: str = "content", key: str = "chunk_id") -> DataFrame:
    """(page_content, metadata, id): the rest of a chunk as JSON."""
    rest = [c for c in chunks.columns if c not in (content, key)]
    return chunks.select(F.col(content).alias("page_content"), F.to_json(F.struct(*rest)).alias("metadata"), F.col(key).alias("id"))


def write_index(chunks: DataFrame, root: str, version: str, fingerprint: str, key: str = "chunk_id") -> int:
    """Write an index version with its fingerprint in every row; verify count and fingerprint afterwards. An existing
    version isn't overwritten."""
    spark = chunks.sparkSession
    rows = chunks.withColumns({"_index_version": F.lit(version), "_index_fingerprint": F.lit(fingerprint)})
    rows.write.mode("errorifexists").parquet(f"{root}/{version}")
    n = chunks.count()
    got = spark.read.parquet(f"{root}/{version}").agg(F.count(F.lit(1)), F.count_if(F.col("_index_fingerprint") == fingerprint), F.count_distinct(key)).first()
    if tuple(got) != (n, n, n):
        raise CorpusError(f"index {version} has {tuple(got)} rows, of fingerprint, of ids; {n} were given")
    return n


def activate(spark: SparkSession, root: str, version: str, fingerprint: str, expected: int, view: str, verify_only: bool = False) -> str:
    """Make a version count whose rows all bear the fingerprint and are as many as expected, for every session that reads
    the index (see versions), and point this session's view at it. Returns verified, created, switched or already_active."""
    try:
        versions.verify(spark, root, version, fingerprint, expected)
    except versions.VersionError as e:
        raise CorpusError(str(e)) from e
    if verify_only:
        return "verified"
    before = versions.commit_of(spark, root)
    versions.commit(spark, root, version, fingerprint, expected, before.number if before else 0)
    versions.read_index(spark, root).createOrReplaceTempView(view)
    return "created" if before is None else "already_active" if before.version == version else "switched"


def write_sorted_json(df: DataFrame, path: str, *order: str) -> None:
    """Byte-stable JSON lines of a small table: one file, sorted."""
    df.coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def manifest(df: DataFrame, name: str, *key: str) -> DataFrame:
    """(name, rows, digest): a table's size and a digest of its keys that doesn't depend on their order but on how often each
    occurs: sums of two hashes of every row."""
    text = F.to_json(F.struct(*key))
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), text).cast("decimal(38,0)")), F.lit(0)).cast("string") for seed in (1, 2)]
    return df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws("|", *sums), 256).alias("digest"))


def registry(documents: DataFrame, files: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A registry of sources and its faults: one row for each document (document_id, number) with its file's digest and its
    official address; (document_id, problem) where a document has no file or more than one, its digest isn't the stated one,
    or no source or more than one names its number. documents: document_id, number, sha256; files: document_id, sha256;
    sources: number, url."""
    own = files.groupBy("document_id").agg(F.count(F.lit(1)).alias("files"), F.first("sha256").alias("found"))
    named = sources.groupBy(F.lower("number").alias("_number")).agg(F.count(F.lit(1)).alias("sources"), F.min("url").alias("url"))
    rows = documents.join(own, "document_id", "left").join(named, F.lower("number") == F.col("_number"), "left")
    tests = {"no_file": F.col("files").isNull(), "many_files": F.col("files") > 1, "changed": F.col("found") != F.col("sha256"), "no_source": F.col("sources").isNull(), "many_sources": F.col("sources") > 1}
    problems = rows.select("document_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in tests.items())))).alias("problem"))
    return rows.select("document_id", "number", F.col("found").alias("sha256"), "url"), problems


def sitemap_urls(fetch: Callable[[str], bytes], start: str, most: int = 200) -> list[str]:
    """Page addresses of a site's maps, which may name further maps, in order of first mention; gzipped maps are unpacked,
    no map is fetched twice, and more than `most` maps are an error."""
    todo, seen, out = [start], set(), {}
    while todo:
        url = todo.pop(0)
        if url in seen:
            continue
        if len(seen) == most:
            raise CorpusError(f"more than {most} maps")
        seen.add(url)
        raw = fetch(url)
        tree = ElementTree.fromstring(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
        found = [e.text.strip() for e in tree.iter() if e.tag.rpartition("}")[2] == "loc" and e.text]
        if tree.tag.rpartition("}")[2] == "sitemapindex":
            todo += found
        else:
            out.update(dict.fromkeys(found))
    return list(out)


def with_retry(fetch: Callable[[str], tuple[int, dict, bytes]], url: str, tries: int = 4, most_bytes: int = 50 << 20, kinds: tuple[str, ...] = (), sleep: Callable[[float], None] = time.sleep) -> bytes:
    """A response's body: tries again after 429 and 5xx, doubling the wait or as long as Retry-After says; other failures,
    a body over the bound or of another type are errors at once. fetch gives status, headers and body."""
    for n in range(tries):
        status, headers, body = fetch(url)
        low = {k.lower(): v for k, v in headers.items()}
        if status == 200:
            if len(body) > most_bytes or kinds and low.get("content-type", "").split(";")[0].strip().lower() not in kinds:
                raise CorpusError(f"{url}: too large or of the wrong type")
            return body
        if status != 429 and status < 500:
            break
        if n + 1 < tries:
            sleep(float(low["retry-after"]) if low.get("retry-after", "").isdigit() else 0.5 * 2**n)
    raise CorpusError(f"{url}: status {status}")


def numbered(paragraphs: DataFrame, levels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Paragraphs (key, pos, num_id, level, text) with `label`, the number that an office program shows. levels: num_id,
    level, start, format, pattern (like %1.%2), and restart, if there are rules; see operators.numbering."""
    return numbering.numbered(paragraphs, levels, key)
