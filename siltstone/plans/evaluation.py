"""Evaluation queries. Questions are benchmark items; what they expect are the documents with their first five words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators import metrics as M
from siltstone.operators import ranking as R
from siltstone.plans.registry import query, table
from siltstone.plans.retrieval import LISTS_SQL, two_lists
from siltstone.session import spread

GOLD_SQL = r"""gw AS (SELECT doc_id, source, regexp_extract_all(text, '[^ \t\n\r]+') AS l FROM documents),
gg AS (SELECT DISTINCT doc_id, source, unnest(list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i+4], ' '))) AS g FROM gw),
gi AS (SELECT item_id, array_to_string(regexp_extract_all(text, '[^ \t\n\r]+')[1:5], ' ') AS g FROM benchmark),
gold AS (SELECT DISTINCT item_id, doc_id, source FROM gi JOIN gg USING (g)),
want AS (SELECT b.item_id, count(DISTINCT gold.source) AS es, count(DISTINCT gold.doc_id) AS ed FROM benchmark b LEFT JOIN gold USING (item_id) GROUP BY b.item_id)"""


#: Items whose first words are looked for while documents are scanned; beyond that all sequences are compared.
MOST_ITEMS = 5_000


def _grams(docs: DataFrame, items: list[list[str]]) -> DataFrame:
    """(doc_id, source, g): five-word sequences of the words (l) of documents, of which each word stands in its place in
    some item's. Words go past once; a filter would be computed before they are dealt out and again after."""
    shared = docs.sparkSession.sparkContext.broadcast([sorted({w[j] for w in items}) for j in range(5)])

    def look_up(batches):
        known = [pa.array(w, pa.string()) for w in shared.value]
        for b in batches:
            each, n = b.column("l").flatten(), b.column("l").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), n)
            at = np.flatnonzero(pc.is_in(each, value_set=known[0]).to_numpy(zero_copy_only=False))
            at = at[at + 4 < np.cumsum(n)[row[at]]]
            for j in range(1, 5):
                at = at[pc.is_in(each.take(pa.array(at + j)), value_set=known[j]).to_numpy(zero_copy_only=False)]
            g = pc.binary_join_element_wise(*(each.take(pa.array(at + j)) for j in range(5)), " ")
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(row[at])) for c in ("doc_id", "source")), g], ["doc_id", "source", "g"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "source"))
    return docs.mapInArrow(look_up, f"{kinds}, g string")


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, doc_id, source): five-word sequences of all documents meet the first one of each item in an equi-join.
    Only sequences of words that items begin with are cut out."""
    split = lambda c: F.regexp_extract_all(c, F.lit(r"[^ \t\n\r]+"), F.lit(0))
    items = table(spark, sf, "benchmark").select("item_id", F.slice(split(F.col("text")), 1, 5).alias("w"))
    docs = spread(table(spark, sf, "documents").select("doc_id", "source", "text")).select("doc_id", "source", split(F.col("text")).alias("l"))
    if items.count() <= MOST_ITEMS:
        grams = _grams(docs, [r.w for r in items.select("w").collect() if len(r.w or []) == 5])
    else:
        starts = F.sequence(F.lit(1), F.size("l") - 4)
        grams = docs.where(F.size("l") >= 5).select("doc_id", "source", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("l", i, 5), " "))).alias("g"))
    return grams.join(items.select("item_id", F.array_join("w", " ").alias("g")), "g").select("item_id", "doc_id", "source").distinct()


def expected(spark: SparkSession, sf: str) -> DataFrame:
    sets = gold(spark, sf).groupBy("item_id").agg(F.collect_set("source").alias("articles"), F.collect_set("doc_id").alias("documents"))
    out = table(spark, sf, "benchmark").select("item_id").join(sets, "item_id", "left")
    return out.select("item_id", F.coalesce("articles", F.array().cast("array<string>")).alias("articles"), F.coalesce("documents", F.array().cast("array<bigint>")).alias("documents"))


def method_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The two lists and their fusion, with sources."""
    lists = two_lists(spark, sf)
    fused = R.fused_rank(R.fuse(lists, {"dense": 0.9, "sparse": 0.1}), 30).select("item_id", "doc_id", F.col("fused_rank").alias("rank"), F.lit("hybrid").alias("method"))
    both = lists.select("item_id", "doc_id", "rank", F.col("component").alias("method")).unionByName(fused)
    return both.join(table(spark, sf, "documents").select("doc_id", F.col("source").alias("article")), "doc_id")


METRICS_SQL = f"""{LISTS_SQL},
fused AS (SELECT item_id, doc_id, round(sum(CASE WHEN component = 'dense' THEN 0.9 ELSE 0.1 END / (60 + rank)), 9) AS score, min(rank) AS least_rank FROM lists GROUP BY ALL),
hits AS (SELECT component AS method, item_id, doc_id, rank FROM lists UNION ALL SELECT 'hybrid', item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, least_rank, CAST(doc_id AS VARCHAR)) FROM fused),
{GOLD_SQL},
flags AS (SELECT h.method, h.item_id, h.rank, d.source, h.doc_id, (SELECT count(*) > 0 FROM gold g WHERE g.item_id = h.item_id AND g.source = d.source) AS fs, (SELECT count(*) > 0 FROM gold g WHERE g.item_id = h.item_id AND g.doc_id = h.doc_id) AS fd
  FROM hits h JOIN documents d USING (doc_id) WHERE h.rank <= 5),
sums AS (SELECT method, item_id, count(DISTINCT CASE WHEN fs THEN source END) AS ns, count(DISTINCT CASE WHEN fd THEN doc_id END) AS nd, min(CASE WHEN fs THEN rank END) AS rs, min(CASE WHEN fd THEN rank END) AS rd FROM flags GROUP BY ALL),
metrics AS (SELECT m.method, w.item_id, w.es > 1 AS is_multi,
  CASE WHEN es = 0 THEN 1.0 ELSE CAST(coalesce(ns, 0) > 0 AS DOUBLE) END AS any_article, CASE WHEN es = 0 THEN 1.0 ELSE CAST(coalesce(ns, 0) = es AS DOUBLE) END AS all_article,
  round(CASE WHEN es = 0 THEN 1.0 ELSE CAST(coalesce(ns, 0) AS DOUBLE) / es END, 6) AS article_recall, round(CASE WHEN es = 0 THEN 0.0 ELSE coalesce(1.0::DOUBLE / rs, 0) END, 6) AS article_mrr,
  CASE WHEN ed = 0 THEN 1.0 ELSE CAST(coalesce(nd, 0) > 0 AS DOUBLE) END AS any_evidence, CASE WHEN ed = 0 THEN 1.0 ELSE CAST(coalesce(nd, 0) = ed AS DOUBLE) END AS all_evidence,
  round(CASE WHEN ed = 0 THEN 1.0 ELSE CAST(coalesce(nd, 0) AS DOUBLE) / ed END, 6) AS evidence_recall, round(CASE WHEN ed = 0 THEN 0.0 ELSE coalesce(1.0::DOUBLE / rd, 0) END, 6) AS evidence_mrr
  FROM want w CROSS JOIN (SELECT DISTINCT method FROM hits) m LEFT JOIN sums s ON s.method = m.method AND s.item_id = w.item_id)"""


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return M.metrics_at_k(method_hits(spark, sf), expected(spark, sf), 5)


@query("retrieval_metrics_at_k", f"WITH {METRICS_SQL} SELECT * FROM metrics")
def retrieval_metrics_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf)


@query(
    "metrics_stratified",
    f"WITH {METRICS_SQL} SELECT method, is_multi, count(*) AS n, {', '.join(f'round(avg({m}), 6) AS {m}' for m in M.METRICS)}, CAST(grouping(is_multi) AS BIGINT) AS all_strata FROM metrics GROUP BY GROUPING SETS ((method), (method, is_multi))",
)
def metrics_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return M.macro_means(_metrics(spark, sf), "is_multi")


@query(
    "method_comparison",
    f"""WITH {METRICS_SQL} SELECT a.item_id, round(b.article_mrr - a.article_mrr, 6) AS delta, CASE WHEN b.article_mrr > a.article_mrr THEN 'improved' WHEN b.article_mrr < a.article_mrr THEN 'regressed' ELSE 'same' END AS verdict
FROM metrics a JOIN metrics b USING (item_id) WHERE a.method = 'sparse' AND b.method = 'hybrid'""",
)
def method_comparison(spark: SparkSession, sf: str) -> DataFrame:
    m = _metrics(spark, sf).select("method", "item_id", "article_mrr")
    both = m.groupBy("item_id").agg(F.max(F.when(F.col("method") == "sparse", F.col("article_mrr"))).alias("a"), F.max(F.when(F.col("method") == "hybrid", F.col("article_mrr"))).alias("b"))
    return both.select("item_id", F.round(F.col("b") - F.col("a"), 6).alias("delta"), F.when(F.col("b") > F.col("a"), "improved").when(F.col("b") < F.col("a"), "regressed").otherwise("same").alias("verdict"))


GRID = [(c, k, w) for c in (10, 20, 30) for k in (20, 60) for w in (0.5, 0.7, 0.9)]
GRID_SQL = "grid AS (SELECT * FROM (VALUES " + ", ".join(f"({c}, {k}, {w})" for c, k, w in GRID) + ") AS t(candidates, rrf_k, dense_weight))"


@query(
    "tuning_grid_select",
    f"""WITH {LISTS_SQL}, {GOLD_SQL}, {GRID_SQL},
f AS (SELECT candidates, rrf_k, dense_weight, item_id, doc_id, round(sum(CASE WHEN component = 'dense' THEN CAST(dense_weight AS DOUBLE) ELSE 1 - CAST(dense_weight AS DOUBLE) END / (rrf_k + rank)), 9) AS score, min(rank) AS least_rank FROM lists, grid WHERE rank <= candidates GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY candidates, rrf_k, dense_weight, item_id ORDER BY score DESC, least_rank, CAST(doc_id AS VARCHAR)) AS rank FROM f QUALIFY rank <= 5),
h AS (SELECT candidates, rrf_k, dense_weight, item_id, count(*) AS found, min(rank) AS first FROM r JOIN gold USING (item_id, doc_id) GROUP BY ALL),
s AS (SELECT g.candidates, g.rrf_k, g.dense_weight, w.item_id, CASE WHEN ed = 0 THEN 1.0 ELSE CAST(coalesce(found, 0) AS DOUBLE) / ed END AS recall, CASE WHEN ed = 0 THEN 0.0 ELSE coalesce(1.0::DOUBLE / first, 0) END AS mrr
  FROM grid g CROSS JOIN want w LEFT JOIN h ON h.candidates = g.candidates AND h.rrf_k = g.rrf_k AND h.dense_weight = g.dense_weight AND h.item_id = w.item_id),
m AS (SELECT candidates, rrf_k, CAST(dense_weight AS DOUBLE) AS dense_weight, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr FROM s GROUP BY ALL)
SELECT CAST(candidates AS BIGINT) AS candidates, CAST(rrf_k AS BIGINT) AS rrf_k, dense_weight, recall, mrr, row_number() OVER (ORDER BY recall DESC, mrr DESC, candidates, rrf_k, dense_weight) AS place FROM m""",
)
def tuning_grid_select(spark: SparkSession, sf: str) -> DataFrame:
    """Every configuration over component lists that are ranked once; the best comes first."""
    grid = spark.createDataFrame(GRID, "candidates long, rrf_k long, dense_weight double")
    config = ["candidates", "rrf_k", "dense_weight"]
    lists = two_lists(spark, sf).join(F.broadcast(grid), F.col("rank") <= F.col("candidates"))  # 18 configurations
    w = F.when(F.col("component") == "dense", F.col("dense_weight")).otherwise(1 - F.col("dense_weight"))
    fused = lists.groupBy(*config, "item_id", "doc_id").agg(F.round(F.sum(w / (F.col("rrf_k") + F.col("rank"))), 9).alias("score"), F.min("rank").alias("least_rank"))
    top = fused.withColumn("rank", F.row_number().over(Window.partitionBy(*config, "item_id").orderBy(F.desc("score"), "least_rank", F.col("doc_id").cast("string")))).where("rank <= 5")
    found = top.join(gold(spark, sf).select("item_id", "doc_id"), ["item_id", "doc_id"]).groupBy(*config, "item_id").agg(F.count(F.lit(1)).alias("found"), F.min("rank").alias("first"))
    wanted = expected(spark, sf).select("item_id", F.size("documents").alias("ed"))
    s = wanted.join(F.broadcast(grid)).join(found, [*config, "item_id"], "left")
    recall = F.when(F.col("ed") == 0, 1.0).otherwise(F.coalesce("found", F.lit(0)) / F.col("ed"))
    mrr = F.when(F.col("ed") == 0, 0.0).otherwise(F.coalesce(1 / F.col("first"), F.lit(0.0)))
    m = s.groupBy(*config).agg(F.round(F.avg(recall), 6).alias("recall"), F.round(F.avg(mrr), 6).alias("mrr"))
    return m.withColumn("place", F.row_number().over(Window.orderBy(F.desc("recall"), F.desc("mrr"), *config)).cast("long"))  # 18 rows


@query(
    "latency_percentiles",
    "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, quantile_disc(value, 0.95) AS p95_nearest FROM events GROUP BY event_type",
)
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return M.latency(table(spark, sf, "events"), "value", "event_type")


@query(
    "diversity",
    f"""WITH {LISTS_SQL}, c AS (SELECT component, item_id, source, count(*) AS n FROM lists JOIN documents USING (doc_id) WHERE rank <= 10 GROUP BY ALL)
SELECT component, item_id, count(*) AS articles, round(1 - CAST(count(*) AS DOUBLE) / sum(n), 6) AS duplicate_rate, round(CAST(max(n) AS DOUBLE) / sum(n), 6) AS concentration FROM c GROUP BY ALL""",
)
def diversity(spark: SparkSession, sf: str) -> DataFrame:
    hits = two_lists(spark, sf, 10).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    c = hits.groupBy("component", "item_id", "source").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("component", "item_id").agg(F.count(F.lit(1)).alias("articles"), F.round(1 - F.count(F.lit(1)) / F.sum("n"), 6).alias("duplicate_rate"), F.round(F.max("n") / F.sum("n"), 6).alias("concentration"))


@query(
    "precision_recall_noise",
    f"""WITH {LISTS_SQL}, {GOLD_SQL}, g AS (SELECT DISTINCT component, item_id, source FROM lists JOIN documents USING (doc_id) WHERE rank <= 5),
n AS (SELECT component, item_id, count(*) AS got, count(CASE WHEN EXISTS (SELECT 1 FROM gold WHERE gold.item_id = g.item_id AND gold.source = g.source) THEN 1 END) AS shared FROM g GROUP BY ALL)
SELECT component, item_id, round(CAST(shared AS DOUBLE) / got, 6) AS precision, round(CASE WHEN es = 0 THEN 0.0 ELSE CAST(shared AS DOUBLE) / es END, 6) AS recall,
  round(CASE WHEN shared = 0 THEN 0.0 ELSE 2.0::DOUBLE * shared / (got + es) END, 6) AS f1, round(1 - CAST(shared AS DOUBLE) / got, 6) AS noise FROM n JOIN want USING (item_id)""",
)
def precision_recall_noise(spark: SparkSession, sf: str) -> DataFrame:
    hits = two_lists(spark, sf, 5).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    got = hits.groupBy("component", "item_id").agg(F.collect_set("source").alias("got")).join(expected(spark, sf), "item_id")
    return got.select("component", "item_id", *(F.round(c, 6).alias(n) for n, c in M.set_metrics(F.col("articles"), F.col("got")).items()))


@query(
    "graded_relevance",
    """WITH g AS (SELECT lang, quality + CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END AS grade FROM labels JOIN documents USING (doc_id))
SELECT lang, count(*) AS n, count(CASE WHEN grade = 0 THEN 1 END) AS irrelevant, count(CASE WHEN grade = 1 THEN 1 END) AS partial, count(CASE WHEN grade = 2 THEN 1 END) AS direct,
  round(avg(grade), 6) AS mean_grade, round(avg(grade) / 2, 6) AS normalized, CAST(grouping(lang) AS BIGINT) AS overall FROM g GROUP BY GROUPING SETS ((), (lang))""",
)
def graded_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Grades 0 to 2 from the labels, overall and by language. A grade outside aborts."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    grade = F.col("quality") + F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)
    g = table(spark, sf, "labels").join(docs, "doc_id").select("lang", F.when(grade.isin(0, 1, 2), grade).otherwise(F.raise_error(F.lit("grade out of range")).cast("int")).alias("grade"))
    counts = [F.count_if(F.col("grade") == i).alias(n) for i, n in enumerate(("irrelevant", "partial", "direct"))]
    return g.groupingSets([[], ["lang"]], "lang").agg(F.count(F.lit(1)).alias("n"), *counts, F.round(F.avg("grade"), 6).alias("mean_grade"), F.round(F.avg("grade") / 2, 6).alias("normalized"), F.grouping("lang").cast("long").alias("overall"))


CASES_SQL = r"""obs AS (SELECT conv_id AS case_id, count(*) AS turns, list_distinct(list(role)) AS roles, list_distinct(flatten(list(regexp_extract_all(lower(text), '\bthe[a-z]+')))) AS cited, list_distinct(flatten(list(regexp_extract_all(lower(text), '\btha[a-z]+')))) AS wanted FROM conversations GROUP BY conv_id)"""


@query(
    "answer_case_metrics",
    rf"""WITH {CASES_SQL} SELECT case_id, CASE WHEN len(wanted) > 0 THEN round(CAST(len(list_intersect(cited, wanted)) AS DOUBLE) / len(wanted), 6) END AS claim_recall, CASE WHEN len(cited) > 0 THEN round(CAST(len(list_intersect(cited, wanted)) AS DOUBLE) / len(cited), 6) END AS citation_precision, CAST(turns % 2 = 0 AS DOUBLE) AS status_accuracy FROM obs""",
)
def answer_case_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Case metrics over conversations: words in `the` stand for citations, words in `tha` for claims."""
    found = lambda p: F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all(F.lower("text"), F.lit(rf"\b{p}[a-z]+"), F.lit(0)))))
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("case_id")).agg(found("the").alias("cited_articles"), found("tha").alias("required"), F.count(F.lit(1)).alias("turns"))
    none = F.array().cast("array<string>")
    obs = c.select("case_id", F.lit("even").alias("expected_status"), F.when(F.col("turns") % 2 == 0, "even").otherwise("odd").alias("predicted_status"), none.alias("available"), none.alias("declared"), none.alias("inline"), F.col("required").alias("expected_articles"), "cited_articles", "required", F.col("cited_articles").alias("satisfied"))
    return M.answer_case(obs).select("case_id", "claim_recall", "citation_precision", "status_accuracy")


@query(
    "consensus",
    """WITH w AS (SELECT source, lang, unnest(regexp_extract_all(text, '[^ \t\n\r]{14,}')) AS w FROM documents), own AS (SELECT source, lang, list_sort(list_distinct(list(lower(w)))) AS p FROM w GROUP BY ALL),
twice AS (SELECT source, lang || k AS model, CASE WHEN k = 'b' AND source = 'src3' THEN list_append(p, 'other') ELSE p END AS p, k = 'c' AND source = 'src5' AS failed FROM own, (SELECT unnest(['a', 'b', 'c']) AS k) WHERE lang = 'en')
SELECT source AS case_id, count(*) AS n_models, count(*) >= 3 AND count(DISTINCT array_to_string(p, chr(10))) = 1 AND NOT bool_or(failed) AS agreed FROM twice GROUP BY source""",
)
def consensus(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as cases; the long words of their English texts are the claims of three models, of which one differs in src3
    and one failed in src5."""
    words = F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]{14,}"), F.lit(0)))
    claims = table(spark, sf, "documents").where("lang = 'en'").select("source", words.alias("claim")).withColumn("model", F.explode(F.array(F.lit("ena"), F.lit("enb"), F.lit("enc"))))
    other = claims.where("source = 'src3' and model = 'enb'").select("source", F.lit("other").alias("claim"), "model").distinct()
    rows = claims.unionByName(other).withColumn("failed", (F.col("source") == "src5") & (F.col("model") == "enc"))
    return M.consensus(rows.withColumnRenamed("source", "case_id"), 3)


@query("threshold_gate", f"WITH {METRICS_SQL}, mm AS (SELECT method, avg(article_recall) AS r, avg(article_mrr) AS m FROM metrics GROUP BY method) SELECT method, CAST(CASE WHEN r < 0.9 THEN 1 ELSE 0 END + CASE WHEN m < 0.3 THEN 1 ELSE 0 END AS BIGINT) AS failures FROM mm")
def threshold_gate(spark: SparkSession, sf: str) -> DataFrame:
    means = _metrics(spark, sf).groupBy("method").agg(F.avg("article_recall").alias("r"), F.avg("article_mrr").alias("m"))
    return means.select("method", F.size(M.gate({"recall": F.col("r"), "mrr": F.col("m")}, {"recall": 0.9, "mrr": 0.3})).cast("long").alias("failures"))


@query("rubric_summary", "WITH s AS (SELECT user_id, CAST(round(value) AS BIGINT) % 5 + 5 AS total FROM events) SELECT user_id, round(avg(total), 6) AS mean, min(total) AS least, avg(total) >= 8 AND min(total) >= 6 AS passed FROM s GROUP BY user_id")
def rubric_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Passes with a mean of at least 8 and no score under 6."""
    s = table(spark, sf, "events").select("user_id", (F.round("value").cast("long") % 5 + 5).alias("total"))
    return s.groupBy("user_id").agg(F.round(F.avg("total"), 6).alias("mean"), F.min("total").alias("least"), ((F.avg("total") >= 8) & (F.min("total") >= 6)).alias("passed"))


@query("correlation", "SELECT lang, round(corr(n_chars, len(regexp_extract_all(text, '[^ ]+'))), 6) AS pearson, count(CASE WHEN n_chars >= 2000 THEN 1 END) AS near_limit FROM documents GROUP BY lang")
def correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Pearson correlation of two length measures, and how many texts come near a limit."""
    n = F.size(F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)))
    return table(spark, sf, "documents").groupBy("lang").agg(F.round(F.corr("n_chars", n), 6).alias("pearson"), F.count_if(F.col("n_chars") >= 2000).alias("near_limit"))
