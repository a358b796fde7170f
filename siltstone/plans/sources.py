"""Queries of citations, sources and audits whose inputs follow from the tables' numbers, so that SQL can say what must
come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import citations as C
from siltstone.operators import metrics as M
from siltstone.operators import ranking as R
from siltstone.plans.evaluation import GOLD_SQL, gold
from siltstone.plans.registry import query, table
from siltstone.plans.retrieval import BOUNDED_SQL, LISTS_SQL, _fused_sql, two_lists

def _number():
    return F.col("o_orderkey")


def _say(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def notes(orders: DataFrame) -> DataFrame:
    """Hits whose notes, codes and types follow from an order's number."""
    n = _number()
    note = F.when(n % 5 == 0, _say("Điều ", n % 40 + 1, " Nghị  định số ", n % 90, "/2020/nđ-cp về việc này")).when(n % 5 == 1, _say("theo điều ", n % 40 + 1, "a Bộ luật số 45/2019/QH14")).when(n % 5 == 3, "  ").when(n % 5 == 4, "Điềux 3, luật khác")
    code = F.when(n % 3 == 0, _say("20.2.LQ.", n % 50)).when(n % 3 == 1, "NĐ128.x")
    return orders.select(n.alias("order_id"), note.alias("source_note_text"), code.alias("article_code"), F.when(n % 7 == 0, _say(" ", n % 9)).alias("article_number"), F.when(n % 4 == 0, "nđ").when(n % 4 == 1, "LQ").alias("source_type"))


@query(
    "citation_labels",
    """WITH n AS (SELECT o_orderkey AS n FROM orders),
p AS (SELECT n, CASE WHEN n % 7 = 0 THEN CAST(n % 9 AS VARCHAR) WHEN n % 5 = 0 THEN CAST(n % 40 + 1 AS VARCHAR) WHEN n % 5 = 1 THEN concat(n % 40 + 1, 'a') WHEN n % 3 = 0 THEN CAST(n % 50 AS VARCHAR) END AS a,
  CASE WHEN n % 5 = 0 THEN concat(n % 90, '/2020/NĐ-CP') WHEN n % 5 = 1 THEN '45/2019/QH14' END AS d,
  CASE WHEN n % 5 = 1 THEN 'Bộ luật Lao động' WHEN n % 5 = 0 OR n % 4 = 0 THEN 'Nghị định' WHEN n % 4 = 1 THEN 'Văn bản luật' END AS t, CASE WHEN n % 3 = 0 THEN concat('20.2.LQ.', n % 50) WHEN n % 3 = 1 THEN 'NĐ128.x' END AS c FROM n)
SELECT n AS order_id, a AS article_number, t AS document_title, d AS document_number,
  CASE WHEN a IS NOT NULL AND t IS NOT NULL AND d IS NOT NULL THEN concat('Điều ', a, ' ', t, ' số ', d) WHEN a IS NOT NULL AND t IS NOT NULL THEN concat('Điều ', a, ' ', t) WHEN a IS NOT NULL THEN concat('Điều ', a) WHEN c IS NOT NULL THEN concat('Mã pháp điển ', c) ELSE 'Nguồn pháp luật' END AS citation_label FROM p""",
)
def citation_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Citations of a hit for every order."""
    return C.sources_of(notes(table(spark, sf, "orders"))).select("order_id", "article_number", "document_title", "document_number", "citation_label")


@query(
    "official_sources",
    """WITH n AS (SELECT o_orderkey AS n FROM orders)
SELECT n AS order_id, CASE WHEN n % 4 = 0 AND n % 30 < 20 THEN concat('https://law/', n % 30) WHEN n % 3 = 0 AND n % 40 < 20 THEN concat('https://law/', n % 40) WHEN n % 5 = 0 AND n % 50 < 20 THEN concat('https://law/', n % 50)
  WHEN n % 3 = 0 THEN concat('https://old/x?a=1&itemid=', n % 40 + 500) WHEN n % 3 = 1 THEN 'https://old/none' END AS official_url FROM n""",
)
def official_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of a hit for every order, from a registry of 20 documents."""
    n = _number()
    hits = table(spark, sf, "orders").select(
        n.alias("order_id"), F.when(n % 4 == 0, _say("DOC-", n % 30)).alias("source_document_id"), F.when(n % 5 == 0, _say(n % 50, "/2020/QH")).alias("document_number"),
        F.when(n % 3 == 0, F.array(_say("https://old/x?a=1&itemid=", n % 40 + 500), F.lit("https://old/y?ItemID=1"))).when(n % 3 == 1, F.array(F.lit("https://old/none"))).otherwise(F.array().cast("array<string>")).alias("source_urls"),
    )
    k = F.col("id").cast("string")
    registry = spark.range(20).select(F.concat(F.lit("doc-"), k).alias("source_document_id"), (F.col("id") + 500).cast("string").alias("item_id"), F.concat(k, F.lit("/2020/qh")).alias("document_number"), F.concat(F.lit("https://law/"), k).alias("canonical_url"))
    return C.official_urls(hits, registry, "order_id").select("order_id", "official_url")


@query(
    "unit_labels",
    """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS s, l_orderkey % 6 AS k FROM lineitem)
SELECT o AS order_id, s AS line, concat(CASE k WHEN 0 THEN concat('Bảng ', s) WHEN 1 THEN concat('Khoản ', s, ' · Điểm a, b') WHEN 2 THEN concat('Khoản ', s) WHEN 3 THEN 'Điểm a, b' WHEN 4 THEN 'Phần mở đầu' ELSE 'Nội dung điều' END, CASE WHEN s > 1 THEN concat(' · Phần ', s) ELSE '' END) AS label FROM l""",
)
def unit_labels(spark: SparkSession, sf: str) -> DataFrame:
    """What readers call the units that order lines stand for."""
    k, s = F.col("l_orderkey") % 6, F.col("l_linenumber")
    points = F.when(k.isin(1, 3), F.array(F.lit("a"), F.lit(" "), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    label = C.unit_label(F.when(k == 0, s), F.when(k.isin(1, 2), s.cast("string")).otherwise(F.lit(" ")), points, s, F.when(k == 4, F.lit("preamble")).otherwise(F.lit("article")))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), s.alias("line"), label.alias("label"))


@query("body_texts", r"""WITH d AS (SELECT doc_id, trim(text, E' \n\t\r') AS t FROM documents) SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN concat('body ', doc_id) ELSE t END) AS digest FROM d WHERE t <> '' AND NOT contains(t, E'\n\n')""")
def body_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of chunks that a heading and a blank line lead."""
    t = F.trim(F.col("text"), F.lit(" \n\t\r"))
    d = table(spark, sf, "documents").where((t != "") & ~t.contains("\n\n"))
    body = C.body_text(F.when(F.col("doc_id") % 3 == 0, _say("body ", F.col("doc_id"))), F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Law: x\nPart: y\n\n"), t)).otherwise(t))
    return d.select("doc_id", F.md5(body.cast("binary")).alias("digest"))


@query(
    "relation_lists",
    """WITH r AS (SELECT l_orderkey AS o, min(l_linenumber) AS pos, l_partkey % 5 AS t, l_suppkey % 2 AS k FROM lineitem GROUP BY ALL)
SELECT o AS order_id, array_to_string(list(t ORDER BY pos, t, k), ',') AS targets, array_to_string(list(k ORDER BY pos, t, k), ',') AS kinds, array_to_string(list(CASE WHEN t < 3 THEN 1 ELSE 0 END ORDER BY pos, t, k), ',') AS in_corpus FROM r GROUP BY o""",
)
def relation_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Relations of every order's lines as lists, each once, with whether the target is known (a join with the known ones)."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 5).alias("target_id"), (F.col("l_suppkey") % 2).cast("string").alias("relation_type"))
    known = spark.range(3).select(F.col("id").alias("target_id"), F.lit(True).alias("known"))
    rows = rows.join(known, "target_id", "left").withColumns({"target_code": F.lit(None).cast("string"), "href": F.lit("x"), "same_topic": F.lit(None).cast("boolean"), "target_in_corpus": F.coalesce("known", F.lit(False))})
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    out = C.relation_lists(rows, "l_orderkey", "l_linenumber")
    return out.select(F.col("l_orderkey").alias("order_id"), text(F.col("target_ids")).alias("targets"), text(F.col("relation_types")).alias("kinds"), text(F.transform("in_corpus", lambda x: x.cast("int"))).alias("in_corpus"))


@query("held_out_difference", "SELECT doc_id, source FROM documents WHERE doc_id % 10 = 3 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def held_out_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of a held-out set that no regression case names."""
    return table(spark, sf, "documents").where("doc_id % 10 = 3").select("doc_id", "source").join(table(spark, sf, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_anti")


@query("benchmark_enabled", """SELECT event_id FROM events WHERE coalesce(CASE WHEN event_id % 4 = 0 THEN event_id % 8 = 0 END, true)""")
def benchmark_enabled(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that are switched on; one that doesn't say is."""
    enabled = F.when(F.col("event_id") % 4 == 0, F.col("event_id") % 8 == 0)
    return table(spark, sf, "events").where(F.coalesce(enabled, F.lit(True))).select("event_id")


@query("pdf_texts", r"""SELECT doc_id, md5(trim(regexp_replace(translate(lower(text), '–—', '--'), '[\s\x{00A0}]+', ' ', 'g'))) AS digest FROM documents WHERE NOT contains(text, chr(173)) AND NOT regexp_matches(text, '-\s*\n') AND NOT regexp_matches(text, '(^|\n)\s*[0-9]{1,4}\s*(\n|$)')""")
def pdf_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as pages hold them: hyphens at line ends, soft hyphens and page numbers are planted, and must go."""
    d = table(spark, sf, "documents").where(~F.col("text").contains("­") & ~F.col("text").rlike(r"-\s*\n") & ~F.col("text").rlike(r"(^|\n)\s*[0-9]{1,4}\s*(\n|$)"))
    planted = F.regexp_replace(F.regexp_replace("text", r"([a-z])([a-z]{3})(?= )", "$1­$2"), r"([a-z])([a-z]{4})(?= )", "$1-\n$2")
    return d.select("doc_id", F.md5(T.pdf_text(F.concat(F.lit("  12 \n"), planted, F.lit("\nTrang 7\n"))).cast("binary")).alias("digest"))


@query("utc_times", "SELECT event_id, epoch_us(ts) // 1000000 AS seconds FROM events")
def utc_times(spark: SparkSession, sf: str) -> DataFrame:
    """Times written in four ways, read as the same second."""
    ts, k = F.date_trunc("second", "ts"), F.col("event_id") % 4
    text = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.concat(F.date_format(ts + F.expr("INTERVAL 7 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+07:00"))).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf, "events").select("event_id", F.unix_seconds(T.utc(text)).alias("seconds"))


RUNTIME_SQL = """c AS (SELECT o_orderkey AS n, o_orderkey % 10 <> 0 AS ok, o_orderkey % 6 = 0 AS fb, o_orderkey % 4 AS k FROM orders),
m AS (SELECT n, ok, ok AND NOT fb AS gen, k > 0 AS cited, CASE WHEN k > 0 THEN n % 9 <> 0 END AS valid, k > 0 AND n % 5 < 2 AS hit, NOT fb AND k > 0 AND n % 9 <> 0 AS scored, k FROM c)"""


def observations(orders: DataFrame) -> DataFrame:
    """Observed answers that follow from an order's number: k sources of which the first is expected in two of five."""
    n = _number()
    k = (n % 4).cast("int")
    chunks = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < k), lambda i: F.concat(F.lit("c"), i.cast("string")))
    none = F.array().cast("array<string>")
    return orders.select(
        n.alias("case_id"), F.when(n % 10 == 0, 500).otherwise(200).alias("http_status"), F.lit("text").alias("answer"), (n % 6 == 0).alias("fallback"), chunks.alias("cited_chunks"), none.alias("cited_articles"), k.alias("n_sources"),
        F.when(n % 5 < 2, F.array(F.lit("c0"), F.lit("z"))).otherwise(F.array(F.lit("z"))).alias("expected_chunks"), none.alias("expected_articles"), F.lit(True).alias("answerable"), F.when(n % 9 == 0, 1).otherwise(0).alias("unknown_chunks"),
    )


@query(
    "runtime_answer_summary",
    f"""WITH {RUNTIME_SQL}, s AS (SELECT *, CASE WHEN scored AND hit THEN round(1.0::DOUBLE / k, 4) ELSE 0.0 END AS p, CASE WHEN scored AND hit THEN 0.5 ELSE 0.0 END AS r FROM m)
SELECT count(*) AS cases, round(avg(ok::INT), 4) AS transport_rate, round(avg(gen::INT), 4) AS generated_rate, round(avg(cited::INT), 4) AS citation_rate, round(avg(hit::INT), 4) AS evidence_rate,
  round(avg((gen AND cited AND valid AND hit)::INT), 4) AS grounded_rate, count(CASE WHEN gen AND cited AND valid AND hit THEN 1 END) AS grounded, round(avg(valid::INT), 4) AS validity_rate, count(valid) AS applicable, count(*) - count(valid) AS not_applicable,
  round(avg(p), 4) AS mean_precision, round(avg(r), 4) AS mean_completeness FROM s""",
)
def runtime_answer_summary(spark: SparkSession, sf: str) -> DataFrame:
    return M.runtime_summary(M.runtime_case(observations(table(spark, sf, "orders"))))


@query(
    "answer_macro_mean",
    """WITH c AS (SELECT o_orderkey AS n, o_orderkey % 3 AS k, o_orderkey % 4 AS e FROM orders)
SELECT count(*) AS cases, round(avg((n % 2 = 0)::INT), 6) AS status_accuracy, round(avg(CASE WHEN k = 0 THEN 1.0 ELSE 1.0 / k END), 6) AS citation_validity, round(avg((k = 1)::INT), 6) AS inline_match,
  round(avg(CASE WHEN e > 0 THEN round(1.0::DOUBLE / e, 6) END), 6) AS citation_precision, round(avg(CASE WHEN e > 0 THEN 0.5 ELSE 0.0 END), 6) AS citation_completeness, round(avg(CASE WHEN e > 0 THEN 1.0 END), 6) AS claim_recall FROM c""",
)
def answer_macro_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Case metrics and their means; undefined ones are left out."""
    n = _number()
    some = lambda size, prefix: F.transform(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: i < size), lambda i: F.concat(F.lit(prefix), i.cast("string")))
    obs = table(spark, sf, "orders").select(
        n.alias("case_id"), F.lit("even").alias("expected_status"), F.when(n % 2 == 0, "even").otherwise("odd").alias("predicted_status"), F.array(F.lit("s0"), F.lit("s9")).alias("available"), some(n % 3, "s").alias("declared"), F.array(F.lit("s0")).alias("inline"),
        F.array(F.lit("a0"), F.lit("b")).alias("expected_articles"), some(n % 4, "a").alias("cited_articles"), some(n % 4, "r").alias("required"), some(F.lit(4), "r").alias("satisfied"),
    )
    out = M.answer_summary(M.answer_case(obs))
    return out.select("cases", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query(
    "token_audit",
    """WITH t AS (SELECT lang, len(regexp_extract_all(text, '[^ ]+')) AS t, CAST(n_chars // 6 AS BIGINT) AS p FROM documents)
SELECT lang, count(*) AS chunks, min(t) AS least, max(t) AS most, round(avg(t), 6) AS mean, quantile_disc(t, 0.95) AS p95, quantile_disc(t, 0.99) AS p99, count(CASE WHEN t > 400 THEN 1 END) AS truncated, count(CASE WHEN t <= 400 AND t > 368 THEN 1 END) AS near_limit,
  count(CASE WHEN t > 400 AND p > 400 THEN 1 END) AS both_over, count(CASE WHEN t > 400 AND p <= 400 THEN 1 END) AS missed, count(CASE WHEN t <= 400 AND p > 400 THEN 1 END) AS false_alarms, count(CASE WHEN t <= 400 AND p <= 400 THEN 1 END) AS both_under, round(corr(t, p), 6) AS pearson
FROM t GROUP BY GROUPING SETS ((), (lang))""",
)
def token_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Words as tokens, characters by six as the cheaper count."""
    t = table(spark, sf, "documents").select("lang", F.size(F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0))).cast("long").alias("tokens"), F.expr("n_chars div 6").alias("proxy"))
    return M.token_audit(t, 400, group="lang")


@query(
    "rerank_ablation",
    f"""WITH {LISTS_SQL}, {_fused_sql(0.9, 0.1)}, {BOUNDED_SQL}, {GOLD_SQL},
shown AS (SELECT 'raw' AS variant, item_id, doc_id, fused_rank AS rank FROM ranked WHERE fused_rank <= 10 UNION ALL SELECT 'bounded', item_id, doc_id, final_rank FROM chosen WHERE final_rank <= 10),
s AS (SELECT variant, item_id, count(DISTINCT lang) AS clusters, min(CASE WHEN EXISTS (SELECT 1 FROM gold g WHERE g.item_id = shown.item_id AND g.doc_id = shown.doc_id) THEN rank END) AS first FROM shown JOIN documents USING (doc_id) GROUP BY ALL)
SELECT variant, count(*) AS questions, round(avg(clusters), 6) AS mean_clusters, round(avg(CASE WHEN first IS NULL THEN 0.0 ELSE 1.0::DOUBLE / first END), 6) AS mrr, count(first) AS found FROM s GROUP BY variant""",
)
def rerank_ablation(spark: SparkSession, sf: str) -> DataFrame:
    """Fused order against bounded reranking: clusters among the first ten, and the first expected document."""
    fused = R.fused_rank(R.fuse(two_lists(spark, sf), {"dense": 0.9, "sparse": 0.1}), 30).join(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("cluster")), "doc_id")
    columns = ["item_id", "doc_id", "cluster"]
    raw = fused.where("fused_rank <= 10").select(F.lit("raw").alias("variant"), *columns, F.col("fused_rank").alias("rank"))
    both = raw.unionByName(R.bounded_rerank(fused).select(F.lit("bounded").alias("variant"), *columns, F.col("final_rank").alias("rank")))
    marked = both.join(gold(spark, sf).select("item_id", "doc_id", F.lit(True).alias("wanted")), ["item_id", "doc_id"], "left")
    s = marked.groupBy("variant", "item_id").agg(F.count_distinct("cluster").alias("clusters"), F.min(F.when(F.col("wanted"), F.col("rank"))).alias("first"))
    return s.groupBy("variant").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg("clusters"), 6).alias("mean_clusters"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.count("first").alias("found"))


@query(
    "retrieval_diagnostic",
    f"""WITH {LISTS_SQL}, {_fused_sql(0.9, 0.1)}, {BOUNDED_SQL}, {GOLD_SQL},
c AS (SELECT g.item_id, min(r.fused_rank) AS candidate_rank, min(f.final_rank) AS context_rank FROM gold g LEFT JOIN ranked r ON r.item_id = g.item_id AND r.doc_id = g.doc_id AND r.fused_rank <= 30 LEFT JOIN chosen f ON f.item_id = g.item_id AND f.doc_id = g.doc_id AND f.final_rank <= 10 GROUP BY g.item_id)
SELECT item_id, candidate_rank, context_rank, CASE WHEN candidate_rank IS NULL THEN 'not_retrieved' WHEN context_rank IS NULL THEN 'lost_in_selection' ELSE 'in_context' END AS verdict FROM c""",
)
def retrieval_diagnostic(spark: SparkSession, sf: str) -> DataFrame:
    """Where each question's expected documents stand among the candidates and in the context, and where they were lost."""
    fused = R.fused_rank(R.fuse(two_lists(spark, sf), {"dense": 0.9, "sparse": 0.1}), 30)
    context = R.bounded_rerank(fused.join(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("cluster")), "doc_id")).select("item_id", "doc_id", "final_rank")
    key = ["item_id", "doc_id"]
    rows = gold(spark, sf).select(*key).distinct().join(fused.select(*key, "fused_rank"), key, "left").join(context, key, "left")
    out = rows.groupBy("item_id").agg(F.min("fused_rank").cast("long").alias("candidate_rank"), F.min("final_rank").cast("long").alias("context_rank"))
    return out.withColumn("verdict", F.when(F.col("candidate_rank").isNull(), "not_retrieved").when(F.col("context_rank").isNull(), "lost_in_selection").otherwise("in_context"))


@query("compound_words", """WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS l FROM conversations) SELECT conv_id, turn, len(l) AS words FROM w""")
def compound_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of a text by a segmenter that is given as a function; this one knows no compounds."""
    plain = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), " ")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(T.segmented(plain, T.LongestMatch([]))).cast("long").alias("words"))


@query(
    "newest_of_each",
    "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) <= 2",
)
def newest_of_each(spark: SparkSession, sf: str) -> DataFrame:
    """The newest two rows of every owner and kind: an append-only log is read so."""
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf, "events").withColumn("n", F.row_number().over(w)).where("n <= 2").select("user_id", "event_type", "event_id", "value")


@query(
    "first_differences",
    r"""WITH d AS (SELECT doc_id, text, length(text) AS n, doc_id * 37 % greatest(length(text), 1) + 1 AS p FROM documents WHERE length(text) > 0 AND NOT contains(text, '¤'))
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN n + 1 ELSE p END AS place, md5(CASE WHEN doc_id % 4 > 1 THEN text[greatest(p - 20, 1) : greatest(p - 20, 1) + 40] END) AS around FROM d""",
)
def first_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Texts against copies: equal, longer by a character, or with one character changed at a place that follows from the id."""
    d = table(spark, sf, "documents").where((F.length("text") > 0) & ~F.col("text").contains("¤"))
    p = (F.col("doc_id") * 37 % F.greatest(F.length("text"), F.lit(1)) + 1).cast("int")
    k = F.col("doc_id") % 4
    copy = F.when(k == 0, F.col("text")).when(k == 1, F.concat("text", F.lit("¤"))).otherwise(F.concat(F.substring("text", F.lit(1), p - 1), F.lit("¤"), F.substring("text", p + 1, F.length("text"))))
    out = d.select("doc_id", "text", k.alias("k"), T.first_difference(F.col("text"), copy).alias("place"))
    return out.select("doc_id", "place", F.md5(F.when(F.col("k") > 1, T.window_at(F.col("text"), F.col("place"), 20)).cast("binary")).alias("around"))


@query("fingerprints", """SELECT event_id, sha256(concat('{"event_type":"', event_type, CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('","props_length":', length(props), ',"user_id":') END, CASE WHEN event_id % 3 = 0 THEN '","user_id":' ELSE '' END, user_id, '}')) AS fingerprint FROM events""")
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by the digest of their canonical JSON."""
    length = F.when(F.col("event_id") % 3 != 0, F.length("props")).alias("props_length")
    return table(spark, sf, "events").select("event_id", T.fingerprint(F.col("event_type"), length, F.col("user_id")).alias("fingerprint"))


@query(
    "article_order",
    """WITH a AS (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'x' ELSE concat(o_orderkey % 50, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE '' END) END AS number, o_custkey AS c FROM orders)
SELECT n AS order_id, c AS customer_id, number, row_number() OVER (PARTITION BY c ORDER BY CASE WHEN n % 5 = 0 OR n % 7 = 0 THEN 99999 ELSE n % 50 END, number NULLS FIRST, n) AS place FROM a""",
)
def article_order(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of each document in order of their number, those without one last."""
    n = _number()
    number = F.when(n % 5 == 0, None).when(n % 7 == 0, "x").otherwise(F.concat((n % 50).cast("string"), F.when(n % 2 == 0, "a").otherwise("")))
    rows = table(spark, sf, "orders").select(n.alias("order_id"), F.col("o_custkey").alias("customer_id"), number.alias("number"))
    w = Window.partitionBy("customer_id").orderBy(T.number_or_last(F.col("number")), F.asc_nulls_first("number"), "order_id")
    return rows.withColumn("place", F.row_number().over(w).cast("long"))
