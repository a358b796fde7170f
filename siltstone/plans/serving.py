"""Relational serving queries: catalogue, conversations, reviews; orders and line items stand for parent and child rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.text import fold, safe_url, squeeze
from siltstone.operators import serving as S
from siltstone.plans.registry import query, table

FOLD = "translate(lower({}), 'áàâäãåéèêëíìîïóòôöõúùûüñçÿý', 'aaaaaaeeeeiiiiooooouuuuncyy')"


@query("catalog_search_page", f"SELECT doc_id, source, lang, n_chars FROM documents WHERE contains({FOLD.format('source || chr(32) || text')}, 'ere') ORDER BY source, CAST(doc_id AS VARCHAR) LIMIT 20 OFFSET 20")
def catalog_search_page(spark: SparkSession, sf: str) -> DataFrame:
    """Second page of a search without marks and case."""
    hits = S.search(table(spark, sf, "documents"), "ÉRE", "source", "text")
    return S.page(hits, 2, 20, "source", F.col("doc_id").cast("string")).select("doc_id", "source", "lang", "n_chars")


@query("catalog_page_count", f"SELECT lang, count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM documents WHERE contains({FOLD.format('text')}, 'ere') GROUP BY lang")
def catalog_page_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(fold(F.col("text")).contains("ere")).groupBy("lang").agg(F.count(F.lit(1)).alias("total")).withColumn("pages", S.page_count(F.col("total"), 20))


@query("type_filter", "SELECT p_partkey, lower(p_name) AS name FROM part WHERE lower(p_brand) = 'brand#11' OR lower(p_brand) = 'brand#12'")
def type_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(F.lower("p_brand").isin("brand#11", "brand#12")).select("p_partkey", F.lower("p_name").alias("name"))


@query(
    "document_index",
    "SELECT source, count(*) AS chunks, min(doc_id) AS first_id, count(DISTINCT lang) AS languages, arg_min(n_chars, doc_id) AS first_chars, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source",
)
def document_index(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks grouped by document; the first one stands for it."""
    return table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.min("doc_id").alias("first_id"), F.count_distinct("lang").alias("languages"), F.min_by("n_chars", "doc_id").alias("first_chars"), F.sum("n_chars").alias("chars"))


@query(
    "conversation_summary",
    r"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, substr(trim(regexp_replace(max(CASE WHEN n = 1 THEN text END), '\s+', ' ', 'g')), 1, 120) AS preview FROM c GROUP BY conv_id""",
)
def conversation_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Messages and the last one's first 120 characters, white space squeezed."""
    c = table(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.max("turn").alias("last_turn"), F.substring(squeeze(F.max_by("text", "turn")), 1, 120).alias("preview"))


@query(
    "previous_question_asof",
    "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM conversations QUALIFY role = 'assistant'",
)
def previous_question_asof(spark: SparkSession, sf: str) -> DataFrame:
    out = S.previous_of_role(table(spark, sf, "conversations"), "conv_id", "turn", "user", "question", "text")
    return out.where("role = 'assistant'").select("conv_id", "turn", "question")


@query(
    "saved_answers",
    """SELECT o_orderkey, c_custkey, c_name, count(l_linenumber) AS lines, round(sum(l_extendedprice), 2) AS price FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderstatus = 'F' GROUP BY o_orderkey, c_custkey, c_name""",
)
def saved_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Bookmark, message and conversation as line item, order and customer: children are summed before the joins."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_linenumber").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("price"))
    orders = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return orders.join(lines, "o_orderkey").join(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey").select("o_orderkey", "c_custkey", "c_name", "lines", "price")


@query(
    "review_counters",
    """SELECT user_id, count(*) AS findings, count(CASE WHEN event_type <> 'error' AND value >= 50 THEN 1 END) AS warnings, count(CASE WHEN event_type <> 'error' AND value >= 20 AND value < 50 THEN 1 END) AS attention,
  count(CASE WHEN event_type = 'error' THEN 1 END) AS missing FROM events GROUP BY user_id""",
)
def review_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Missing evidence overrides the severity."""
    missing = F.col("event_type") == "error"
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("findings"), F.count_if(~missing & (F.col("value") >= 50)).alias("warnings"), F.count_if(~missing & (F.col("value") >= 20) & (F.col("value") < 50)).alias("attention"), F.count_if(missing).alias("missing"))


@query("review_page", "SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) BETWEEN 11 AND 20")
def review_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of every owner's rows, newest first."""
    return S.pages_of(table(spark, sf, "events"), "user_id", 2, 10, F.desc("ts"), F.desc("event_id")).select("event_id", "user_id", "event_type", "value")


@query(
    "session_validity",
    """WITH s AS (SELECT user_id, max(ts) AS seen, max(CASE WHEN event_type = 'error' THEN ts END) AS revoked FROM events GROUP BY user_id), m AS (SELECT max(ts) AS now FROM events)
SELECT user_id, CASE WHEN revoked IS NOT NULL AND revoked = seen THEN 'revoked' WHEN seen + INTERVAL 7 DAY <= now THEN 'expired' ELSE 'active' END AS state FROM s, m""",
)
def session_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions are good for 7 days after they were last seen, unless revoked."""
    e = table(spark, sf, "events")
    s = e.groupBy("user_id").agg(F.max("ts").alias("seen"), F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("revoked"))
    now = F.broadcast(e.agg(F.max("ts").alias("now")))  # one row
    return s.join(now).select("user_id", F.when(F.col("revoked") == F.col("seen"), "revoked").when(F.col("seen") + F.expr("INTERVAL 7 DAYS") <= F.col("now"), "expired").otherwise("active").alias("state"))


@query(
    "usable_sources",
    "WITH o AS (SELECT conv_id, role, min(turn) AS turn FROM conversations WHERE trim(text) <> '' GROUP BY ALL) SELECT conv_id, role, turn, 'S' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS source_id FROM o",
)
def usable_sources(spark: SparkSession, sf: str) -> DataFrame:
    return S.usable_sources(table(spark, sf, "conversations"), "role", "text", "conv_id", "turn").select("conv_id", "role", "turn", "source_id")


@query("coverage_antijoin", "SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def coverage_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    return S.missing_both_ways(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("stable_document_key", r"SELECT page_id, coalesce(nullif(regexp_replace(trim(regexp_extract(url, '://([^/?#]*)', 1)), '\.\d+$', ''), ''), 'unknown_doc') AS key FROM pages")
def stable_document_key(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", F.lit("  ").alias("document_id"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("article_code"))
    return p.select("page_id", S.document_key("document_id").alias("key"))


@query("url_safety", r"SELECT page_id, CASE WHEN regexp_matches(trim(url), '^(?i)https?://[^/\s?#]+') THEN trim(url) END AS safe FROM pages")
def url_safety(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", safe_url(F.col("url")).alias("safe"))


@query(
    "release_gates",
    """SELECT source, CAST(CASE WHEN count(*) >= 10 THEN 0 ELSE 1 END + CASE WHEN count(DISTINCT lang) >= 2 THEN 0 ELSE 1 END + CASE WHEN count(DISTINCT text) = count(*) THEN 0 ELSE 1 END AS BIGINT) AS n_failed,
  CASE WHEN count(*) >= 10 AND count(DISTINCT lang) >= 2 AND count(DISTINCT text) = count(*) THEN 'ready' ELSE 'not_ready' END AS verdict FROM documents GROUP BY source""",
)
def release_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Checks by document: enough chunks, several languages, no text twice. Texts are told apart by their digest."""
    t = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("langs"), F.count_distinct(F.md5(F.col("text").cast("binary"))).alias("texts"))
    failed = S.gates({"too_few_chunks": F.col("n") >= 10, "one_language": F.col("langs") >= 2, "repeated_text": F.col("texts") == F.col("n")})
    return t.select("source", F.size(failed).cast("long").alias("n_failed"), F.when(F.size(failed) == 0, "ready").otherwise("not_ready").alias("verdict"))


@query("source_priority", """WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS n FROM orders) SELECT c_custkey, coalesce(o_orderkey, -1) AS chosen, CASE WHEN o_orderkey IS NULL THEN 'unavailable' WHEN o_orderpriority = '1-URGENT' THEN 'preferred' ELSE 'fallback' END AS origin FROM customer LEFT JOIN o ON o_custkey = c_custkey AND n = 1""")
def source_priority(spark: SparkSession, sf: str) -> DataFrame:
    """Of each document the source of best priority; what has none is recorded."""
    first = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.struct("o_orderpriority", "o_orderkey")).alias("x"))
    out = table(spark, sf, "customer").select("c_custkey").join(first, "c_custkey", "left")
    return out.select("c_custkey", F.coalesce("x.o_orderkey", F.lit(-1)).alias("chosen"), F.when(F.col("x").isNull(), "unavailable").when(F.col("x.o_orderpriority") == "1-URGENT", "preferred").otherwise("fallback").alias("origin"))


@query("ownership_join", "SELECT c.conv_id, c.turn, length(c.text) AS chars FROM conversations c JOIN (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user' AND turn = 0) o USING (conv_id) WHERE role = 'assistant'")
def ownership_join(spark: SparkSession, sf: str) -> DataFrame:
    """Answers in conversations that a user opened: a semi join."""
    c = table(spark, sf, "conversations")
    owned = c.where("role = 'user' AND turn = 0").select("conv_id")
    return c.where("role = 'assistant'").join(owned, "conv_id", "left_semi").select("conv_id", "turn", F.length("text").cast("long").alias("chars"))


@query("reowned_conversations", "SELECT conv_id, count(*) AS messages, CASE WHEN conv_id % 3 = 0 THEN 1 ELSE conv_id % 5 END AS owner FROM conversations GROUP BY conv_id")
def reowned_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of one owner go to another: a projection, for tables aren't changed in place."""
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages")).withColumn("owner", F.when(F.col("conv_id") % 3 == 0, F.lit(1).cast("long")).otherwise(F.col("conv_id") % 5))


@query("lines_by_order", "WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, l_extendedprice, n AS place FROM r WHERE n <= 2")
def lines_by_order(spark: SparkSession, sf: str) -> DataFrame:
    """At most two rows of a group, the dearest first."""
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    return table(spark, sf, "lineitem").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 2").select("l_orderkey", "l_linenumber", "l_extendedprice", "place")
