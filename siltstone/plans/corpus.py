"""Corpus-building queries: HTML scans, units, chunks, ids, splits, reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import chunking as C
from siltstone.operators import review, units
from siltstone.plans.registry import query, table
from siltstone.session import materialize, spread, work_dir
from siltstone.sources import html as H


LINK_SQL = H.LINK.replace("'", "''")


@query("html_links", rf"""WITH m AS (SELECT page_id, trim(unnest(regexp_extract_all(html, '{LINK_SQL}', 1)), chr(34) || chr(39)) AS href FROM pages) SELECT page_id, href, count(*) AS mentions FROM m GROUP BY ALL""")
def html_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of a page with how often they are mentioned."""
    return H.links(table(spark, sf, "pages")).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("mentions"))


@query("html_headings", r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs, len(regexp_extract_all(html, '<li[ >]')) AS items FROM pages")
def html_headings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("paragraphs"), F.regexp_count("html", F.lit("<li[ >]")).cast("long").alias("items"))


@query("html_blocks")
def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Text blocks of every page in order: headings, paragraphs, items, tables."""
    return H.blocks(table(spark, sf, "pages"))


@query("relation_dedup", rf"""WITH m AS (SELECT page_id, trim(unnest(regexp_extract_all(html, '{LINK_SQL}', 1)), chr(34) || chr(39)) AS href FROM pages)
SELECT href, count(*) AS mention_count, min(page_id) AS first_page, CASE WHEN href LIKE 'http%' THEN 'EXTERNAL_REFERENCE' WHEN href LIKE '/%' THEN 'RELATED_TO' ELSE 'UNKNOWN' END AS kind FROM m GROUP BY href""")
def relation_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Relations by target: first source, mentions, type."""
    kind = F.when(F.col("href").startswith("http"), "EXTERNAL_REFERENCE").when(F.col("href").startswith("/"), "RELATED_TO").otherwise("UNKNOWN")
    return H.links(table(spark, sf, "pages")).groupBy("href").agg(F.count(F.lit(1)).alias("mention_count"), F.min("page_id").alias("first_page")).withColumn("kind", kind)


@query("citation_extract", r"SELECT conv_id, turn, len(list_distinct(regexp_extract_all(text, '([A-Z][a-z]+)', 1))) AS n_names FROM conversations")
def citation_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct marks of a text; capitalised words stand for citations."""
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Z][a-z]+)"), F.lit(1)))).cast("long").alias("n_names"))


@query("chunk_ids_uuid5", f"""WITH k AS (SELECT doc_id, concat_ws('|', source, 'clause=' || doc_id) AS key FROM documents), h AS (SELECT doc_id, key, sha1(from_hex('{C.NAMESPACE.hex}') || encode(key)) AS h FROM k)
SELECT doc_id, key AS chunk_key, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], substr('89ab', CAST((('0x' || h[17:17])::INTEGER % 4) AS INTEGER) + 1, 1) || h[18:20], h[21:32]) AS chunk_id FROM h""")
def chunk_ids_uuid5(spark: SparkSession, sf: str) -> DataFrame:
    """Stable ids from keys, derived in the JVM."""
    key = F.concat_ws("|", "source", F.concat(F.lit("clause="), F.col("doc_id").cast("string")))
    return table(spark, sf, "documents").select("doc_id", key.alias("chunk_key"), T.uuid5(str(C.NAMESPACE), key).alias("chunk_id"))


@query("breadcrumb_content", "SELECT doc_id, concat_ws(chr(10), 'Language: ' || lang, CASE WHEN source <> 'src0' THEN 'Source: ' || source END) || chr(10) || chr(10) || text AS content FROM documents")
def breadcrumb_content(spark: SparkSession, sf: str) -> DataFrame:
    """What leads a chunk, null parts left out, then a blank line and the text."""
    lead = F.concat_ws("\n", F.concat(F.lit("Language: "), "lang"), F.when(F.col("source") != "src0", F.concat(F.lit("Source: "), "source")))
    return table(spark, sf, "documents").select("doc_id", F.concat(lead, F.lit("\n\n"), "text").alias("content"))


@query("text_units", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS units, CAST(sum(length(trim(line))) AS BIGINT) AS chars FROM l WHERE trim(line) <> '' GROUP BY doc_id""")
def text_units(spark: SparkSession, sf: str) -> DataFrame:
    u = units.units(table(spark, sf, "documents"))
    return u.groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("recursive_split")
def recursive_split(spark: SparkSession, sf: str) -> DataFrame:
    return C.split_documents(spread(table(spark, sf, "documents").select("doc_id", "text")), 200, 20)


@query("structural_chunks")
def structural_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return C.chunk_documents(spread(table(spark, sf, "documents").select("doc_id", "text")))


@query("chunk_violations", f"""WITH c AS (SELECT doc_id, doc_id % 11 AS k, trim(text, chr(32) || chr(10)) AS t FROM documents),
u AS (SELECT doc_id, k, t, CASE WHEN k = 3 THEN concat(doc_id, '|None') ELSE concat(doc_id, '|article') END AS key, CAST(floor(len(regexp_extract_all(CASE WHEN k = 1 THEN '' ELSE t END, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')) * 1.3) AS BIGINT) AS n FROM c)
SELECT doc_id, 'blank' AS problem FROM u WHERE k = 1 UNION ALL SELECT doc_id, 'text_lost' FROM u WHERE k = 1 UNION ALL SELECT doc_id, 'none_in_key' FROM u WHERE k = 3
UNION ALL SELECT doc_id, 'too_long' FROM u WHERE n + CASE WHEN k = 2 THEN 7 ELSE 0 END > 400 UNION ALL SELECT doc_id, 'too_long' FROM u WHERE k = 7 AND n > 400 UNION ALL SELECT doc_id, 'wrong_token_count' FROM u WHERE k = 2
UNION ALL SELECT doc_id, 'changed_id' FROM u WHERE k = 4 UNION ALL SELECT doc_id, 'unknown_type' FROM u WHERE k = 5 UNION ALL SELECT doc_id, 'number_gap' FROM u WHERE k = 6
UNION ALL SELECT doc_id, x FROM u, (SELECT unnest(['repeated_id', 'repeated_id', 'repeated_key', 'repeated_key', 'article_not_alone', 'text_lost']) AS x) WHERE k = 7
UNION ALL SELECT doc_id, 'padded' FROM u WHERE k = 8""")
def chunk_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as chunks into which violations are planted by the number of the document."""
    docs = table(spark, sf, "documents")
    k, t = F.col("doc_id") % 11, F.expr("trim(BOTH ' \\n' FROM text)")
    text = F.when(k == 1, F.lit("")).when(k == 8, F.concat(t, F.lit(" "))).otherwise(t)
    key = F.concat(F.col("doc_id").cast("string"), F.when(k == 3, F.lit("|None")).otherwise(F.lit("|article")))
    chunks = docs.select(
        "doc_id", F.when(k == 6, 1).otherwise(0).cast("long").alias("chunk_no"), key.alias("chunk_key"), T.uuid5(str(C.NAMESPACE), F.when(k == 4, F.concat(key, F.lit("x"))).otherwise(key)).alias("chunk_id"),
        F.when(k == 5, "page").otherwise("article").alias("chunk_type"), text.alias("content"), (T.estimated_tokens(text) + F.when(k == 2, 7).otherwise(0)).alias("token_count"), F.when(k == 7, 2).otherwise(1).alias("copies"),
    )
    chunks = chunks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("chunk_no", F.col("chunk_no") + F.col("copy")).drop("copy", "copies")
    return C.violations(chunks, docs, 400)


REBUILT_SQL = r"SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) AS digest, true AS fits, CAST(0 AS BIGINT) AS problems FROM documents WHERE regexp_matches(text, '\S')"


def _rebuilt(parts: DataFrame, order: str, content: str, most: int) -> DataFrame:
    """(doc_id, digest, fits): the texts that parts make up, without white space, and whether each part keeps to the bound."""
    bare = F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, content))), lambda x: x[content]), ""), r"\s+", "")
    return parts.groupBy("doc_id").agg(F.md5(bare.cast("binary")).alias("digest"), (F.max(T.estimated_tokens(F.col(content))) <= most).alias("fits"))


@query("chunks_rebuild", REBUILT_SQL)
def chunks_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """The chunker's own chunks make up every text, fit, and break none of the chunk rules."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    # Read many times; the chunker runs once.
    chunks = materialize(C.chunk_documents(spread(docs)), work_dir(spark, "chunks"))
    found = C.violations(chunks, docs, 400).groupBy("doc_id").agg(F.count(F.lit(1)).alias("problems"))
    return _rebuilt(chunks, "chunk_no", "content", 400).join(found, "doc_id", "left").withColumn("problems", F.coalesce("problems", F.lit(0)))


@query("parts_rebuild", REBUILT_SQL)
def parts_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """The recursive splitter's parts without overlap make up every text and fit."""
    parts = C.split_documents(spread(table(spark, sf, "documents").select("doc_id", "text")), 200, 0)
    return _rebuilt(parts, "part_no", "part", 200).withColumn("problems", F.lit(0).cast("long"))


@query("chunking_summary", r"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT CASE WHEN length(line) < 80 THEN 'short' WHEN length(line) < 400 THEN 'middle' ELSE 'long' END AS chunk_type, CAST(floor(len(regexp_extract_all(line, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) * 1.3) AS BIGINT) AS n FROM l WHERE trim(line) <> '')
SELECT chunk_type, count(*) AS chunks, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, median(n) AS median, quantile_disc(n, 0.95) AS p95, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY GROUPING SETS ((), (chunk_type))""")
def chunking_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and token statistics of texts' lines as chunks, by type of length, and of all."""
    lines = spread(table(spark, sf, "documents").select("text")).select(F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")
    kind = F.when(F.length("line") < 80, "short").when(F.length("line") < 400, "middle").otherwise("long")
    return C.summary(lines.select(kind.alias("chunk_type"), T.estimated_tokens(F.col("line")).alias("token_count")))


@query("estimated_tokens", r"SELECT doc_id, CAST(floor(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) * 1.3) AS BIGINT) AS tokens FROM documents")
def estimated_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


def contracts(orders: DataFrame) -> DataFrame:
    """(doc_id, text): a contract for every order; its paragraphs name numbers that follow from the order's, some are left
    out, some say that there is no probation."""
    n = F.col("o_orderkey")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    lines = F.array_compact(F.array(
        F.when(n % 13 != 0, say("Hợp đồng xác định thời hạn ", n % 48, " tháng kể từ ngày ký.")),
        F.when(n % 7 == 0, F.lit("Hai bên không thỏa thuận về thử việc trong hợp đồng này.")).otherwise(say("Thời gian thử việc là ", n % 250, " ngày kể từ ngày ký.")),
        say("Mức lương cơ bản là ", n % 90 + 10, ".000.000 đồng", F.when(n % 3 == 0, F.lit(", trả vào ngày mười hằng tháng.")).otherwise(F.lit("."))),
        F.when(n % 5 == 0, say("Thời giờ làm việc: ", n % 14, " giờ/ngày, từ thứ hai đến thứ sáu.")).when(n % 5 == 1, say("Thời giờ làm việc theo tuần: mỗi tuần làm ", n % 60, " giờ.")).when(n % 5 == 2, say("Thời giờ làm việc: mỗi ngày người lao động làm ", n % 14, " giờ.")),
        F.when(n % 11 != 0, say("Bên đơn phương chấm dứt phải báo trước ", n % 60, " ngày.")),
    ))
    return orders.select(n.alias("doc_id"), F.array_join(lines, "\n").alias("text"))


@query("review_findings", """WITH o AS (SELECT o_orderkey AS n FROM orders),
f AS (SELECT n, 'probation' AS category, n % 7 <> 0 AS found, n % 250 AS value, CASE WHEN n % 250 > 180 THEN 'warning' WHEN n % 250 > 60 THEN 'attention' ELSE 'info' END AS severity FROM o
UNION ALL SELECT n, 'salary', true, NULL, CASE WHEN n % 3 = 0 THEN 'info' ELSE 'attention' END FROM o
UNION ALL SELECT n, 'working_time', n % 5 < 3, CASE WHEN n % 5 = 1 THEN n % 60 ELSE n % 14 END, CASE WHEN n % 5 = 1 THEN CASE WHEN n % 60 > 48 THEN 'warning' ELSE 'info' END WHEN n % 14 > 10 OR n % 5 = 0 AND n % 14 * 5 > 48 THEN 'warning' WHEN n % 14 > 8 THEN 'attention' ELSE 'info' END FROM o
UNION ALL SELECT n, 'termination', n % 11 <> 0, n % 60, CASE WHEN n % 60 < 30 AND n % 13 <> 0 AND n % 48 BETWEEN 1 AND 36 THEN 'warning' ELSE 'attention' END FROM o)
SELECT n AS doc_id, category, CASE WHEN found THEN severity ELSE 'attention' END AS severity, CASE WHEN found THEN 'supported' ELSE 'insufficient_evidence' END AS evidence, CASE WHEN found THEN CAST(value AS BIGINT) END AS value FROM f""")
def review_findings(spark: SparkSession, sf: str) -> DataFrame:
    """The review rules over a contract for every order, whose terms follow from its number."""
    return review.findings(contracts(table(spark, sf, "orders"))).withColumn("value", F.col("value").cast("long")).drop("excerpt")


@query("folded_keys", r"SELECT source, lang, upper(regexp_replace(lower(source || '-' || lang), '[^a-z0-9]', '', 'g')) AS key, count(*) AS n FROM documents GROUP BY ALL")
def folded_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).withColumn("key", T.document_number_key(F.concat_ws("-", "source", "lang")))


@query("fold_text", "SELECT doc_id, md5(translate(lower(text), 'áàâäãåéèêëíìîïóòôöõúùûüñçÿý', 'aaaaaaeeeeiiiiooooouuuuncyy')) AS digest FROM documents")
def fold_text(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without marks and case, by their digest."""
    return table(spark, sf, "documents").select("doc_id", F.md5(T.fold(F.col("text")).cast("binary")).alias("digest"))


@query("coverage_classes", """WITH p AS (SELECT page_id, regexp_extract(url, '/([a-z]{2})/', 1) AS lang FROM pages), d AS (SELECT DISTINCT lang FROM documents)
SELECT p.page_id, CASE WHEN p.lang = '' THEN 'no_note' WHEN d.lang IS NULL THEN 'unknown_document' ELSE 'covered' END AS class FROM p LEFT JOIN d USING (lang)""")
def coverage_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Notes of pages, resolved to documents, in classes."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "/([a-z]{2})/", 1).alias("lang"))
    d = table(spark, sf, "documents").select("lang").distinct().withColumn("known", F.lit(True))
    return p.join(d, "lang", "left").select("page_id", F.when(F.col("lang") == "", "no_note").when(F.col("known").isNull(), "unknown_document").otherwise("covered").alias("class"))


@query("sample_controls", """WITH s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('20260801:', doc_id)), doc_id) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT doc_id, lang, n FROM s WHERE n <= CASE lang WHEN 'en' THEN 20 ELSE 10 END""")
def sample_controls(spark: SparkSession, sf: str) -> DataFrame:
    """Controls by the hash of a seed and the id: so many for each stratum, none that is labelled already."""
    targets = F.when(F.col("lang") == "en", 20).otherwise(10)
    rest = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")
    w = Window.partitionBy("lang").orderBy(F.md5(F.concat(F.lit("20260801:"), F.col("doc_id").cast("string")).cast("binary")), "doc_id")
    return rest.withColumn("n", F.row_number().over(w).cast("long")).where(F.col("n") <= targets).select("doc_id", "lang", "n")
