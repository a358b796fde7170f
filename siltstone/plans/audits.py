"""Quality audits of texts: repeated passages, counters, flags, duplicates, coverage, leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.text import sequence_ratio, squeeze, token_f1, words
from siltstone.operators.editing import match_without_reuse
from siltstone.plans.registry import query, table
from siltstone.session import materialize, work_dir


@query(
    "repeated_paragraph_ratio",
    r"""WITH p AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) AS p FROM documents), g AS (SELECT doc_id, p, count(*) AS n, length(p) AS len FROM p WHERE length(p) >= 80 GROUP BY ALL)
SELECT doc_id, round(CAST(sum(len * (n - 1)) AS DOUBLE) / sum(len * n), 6) AS ratio FROM g GROUP BY doc_id""",
)
def repeated_paragraph_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Share of a text's long paragraphs that stand in it again."""
    p = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("p")).withColumn("p", squeeze(F.col("p"))).where(F.length("p") >= 80)
    g = p.groupBy("doc_id", "p").agg(F.count(F.lit(1)).alias("n")).withColumn("len", F.length("p"))
    return g.groupBy("doc_id").agg(F.round(F.sum(F.col("len") * (F.col("n") - 1)) / F.sum(F.col("len") * F.col("n")), 6).alias("ratio"))


@query(
    "quality_counters",
    r"""SELECT doc_id, len(regexp_extract_all(text, '[\x{FFFD}]')) AS replacements, len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]')) AS controls, len(regexp_extract_all(text, '[\x{200B}-\x{200D}\x{FEFF}]')) AS zero_width,
  len(regexp_extract_all(text, '</?[a-zA-Z][^>]*>')) AS tags, len(regexp_extract_all(text, '[#*$%&|<>]')) AS symbols FROM documents""",
)
def quality_counters(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, sf, "documents").select("doc_id", n("�").alias("replacements"), n(r"[\x00-\x08\x0B\x0C\x0E-\x1F]").alias("controls"), n("[​-‍﻿]").alias("zero_width"), n("</?[a-zA-Z][^>]*>").alias("tags"), n(r"[#*$%&|<>]").alias("symbols"))


FLAGS = {"very_short": "n_chars < 200", "very_long": "n_chars > 10000", "no_sentence": "NOT contains(text, '.')", "upper_case": "text = upper(text)", "piped": "contains(text, ' | ')"}
WEIGHTS = {"very_short": 1, "very_long": 2, "no_sentence": 3, "upper_case": 1, "piped": 2}


@query("chunk_flags", "SELECT doc_id, CAST(" + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in FLAGS.values()) + " AS BIGINT) AS n_flags, CAST(" + " + ".join(f"CASE WHEN {c} THEN {WEIGHTS[n]} ELSE 0 END" for n, c in FLAGS.items()) + " AS BIGINT) AS severity FROM documents")
def chunk_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Rule flags of every text and their weighted sum."""
    flags = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(n)) for n, c in FLAGS.items())))
    weights = F.create_map(*(x for n, w in WEIGHTS.items() for x in (F.lit(n), F.lit(w))))
    out = table(spark, sf, "documents").select("doc_id", flags.alias("flags"))
    return out.select("doc_id", F.size("flags").cast("long").alias("n_flags"), F.aggregate("flags", F.lit(0).cast("long"), lambda acc, f: acc + F.coalesce(weights[f], F.lit(1))).alias("severity"))


@query("duplicate_keys", "SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that come again. Digests meet instead of texts."""
    return table(spark, sf, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("category_counts", "SELECT lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"))


@query(
    "split_leakage",
    "WITH s AS (SELECT source, lang, doc_id // 70 % 5 = 0 AS held FROM documents) SELECT source, lang, count(CASE WHEN held THEN 1 END) AS held, count(CASE WHEN NOT held THEN 1 END) AS kept FROM s GROUP BY ALL HAVING count(CASE WHEN held THEN 1 END) > 0 AND count(CASE WHEN NOT held THEN 1 END) > 0",
)
def split_leakage(spark: SparkSession, sf: str) -> DataFrame:
    """Groups that lie on both sides of a split."""
    held = F.expr("doc_id div 70") % 5 == 0
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count_if(held).alias("held"), F.count_if(~held).alias("kept")).where("held > 0 and kept > 0")


@query("sequence_completeness", "WITH s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS want FROM conversations) SELECT conv_id, count(*) AS turns, bool_and(turn = want) AS complete FROM s GROUP BY conv_id")
def sequence_completeness(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the turns run 0, 1, 2, ..."""
    s = table(spark, sf, "conversations").withColumn("want", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    return s.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.bool_and(F.col("turn") == F.col("want")).alias("complete"))


@query("occurrence_counter", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS occurrence FROM events")
def occurrence_counter(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", F.row_number().over(w).cast("long").alias("occurrence"))


@query("marginal_gain", "WITH m AS (SELECT event_type, extract('hour' FROM ts) AS h, avg(value) AS v FROM events GROUP BY ALL) SELECT event_type, h AS hour, round(v - lag(v) OVER (PARTITION BY event_type ORDER BY h), 6) AS gain FROM m")
def marginal_gain(spark: SparkSession, sf: str) -> DataFrame:
    """Each value less the one before it."""
    m = table(spark, sf, "events").groupBy("event_type", F.hour("ts").cast("long").alias("hour")).agg(F.avg("value").alias("v"))
    return m.select("event_type", "hour", F.round(F.col("v") - F.lag("v").over(Window.partitionBy("event_type").orderBy("hour")), 6).alias("gain"))


@query("first_seen_order", "WITH f AS (SELECT source, lang, min(doc_id) AS pos FROM documents GROUP BY ALL) SELECT source, array_to_string(list(lang ORDER BY pos), ',') AS languages FROM f GROUP BY source")
def first_seen_order(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct values of a group in order of first mention."""
    f = table(spark, sf, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("pos"))
    return f.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lang"))), lambda x: x["lang"]), ",").alias("languages"))


@query("longest_documents", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR) LIMIT 20")
def longest_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").orderBy(F.desc("n_chars"), F.col("doc_id").cast("string")).limit(20).select("doc_id", "n_chars")


@query("json_props", "SELECT event_type, count(*) AS n, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean_k FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    """A key of a JSON column."""
    return table(spark, sf, "events").withColumn("k", F.from_json("props", "k double")["k"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("k"), 6).alias("mean_k"))


@query("fuzzy_rebind")
def fuzzy_rebind(spark: SparkSession, sf: str) -> DataFrame:
    """Best matches inside one source, no document twice: of benchmark items with documents that hold their first five
    words, by token F1 and sequence ratio of the item with the line it stands in."""
    from siltstone.plans.evaluation import gold

    hit = gold(spark, sf).join(table(spark, sf, "benchmark").withColumnRenamed("text", "item"), "item_id").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    line = hit.select("item_id", "doc_id", "source", "item", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= 20)
    f1 = line.withColumn("f1", token_f1(words(F.col("item")), words(F.col("line"))))
    best = f1.withColumn("n", F.row_number().over(Window.partitionBy("item_id", "doc_id").orderBy(F.desc("f1"), "line"))).where("n = 1")
    scored = best.withColumn("score", F.round(0.5 * F.col("f1") + 0.5 * sequence_ratio("item", "line"), 6))
    where = work_dir(spark, "rebind")
    scored = materialize(scored.select("item_id", "doc_id", "source", "score"), f"{where}/scores")
    return match_without_reuse(scored, 0.2, f"{where}/rounds", "source", "item_id", "doc_id").select("item_id", "doc_id", "source", "score", "runner_up")
