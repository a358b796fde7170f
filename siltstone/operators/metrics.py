"""Retrieval and answer-quality metrics as grouped column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("any_article", "all_article", "article_recall", "article_mrr", "any_evidence", "all_evidence", "evidence_recall", "evidence_mrr")


def _half(found: Column, first: Column, size: Column, what: str, when_empty: float = 1.0, mrr_empty: float = 0.0) -> dict[str, Column]:
    empty = size == 0
    return {
        f"any_{what}": F.when(empty, when_empty).otherwise((found > 0).cast("double")),
        f"all_{what}": F.when(empty, when_empty).otherwise((found == size).cast("double")),
        f"{what}_recall": F.when(empty, when_empty).otherwise(found / size),
        f"{what}_mrr": F.when(empty, mrr_empty).otherwise(F.coalesce(1.0 / first, F.lit(0.0))),
    }


def metrics_at_k(hits: DataFrame, expected: DataFrame, k: int, when_empty: float = 1.0, mrr_empty: float = 0.0) -> DataFrame:
    """Eight metrics of each (method, item_id).

    hits: method, item_id, doc_id, article, rank; expected: item_id, articles, documents (arrays), a row for each item.
    Recall counts distinct articles, the reciprocal rank counts places. An empty expectation scores `when_empty`, and
    `mrr_empty` for reciprocal ranks.
    """
    top = hits.where(F.col("rank") <= k).groupBy("method", "item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "article", "doc_id"))).alias("top"))
    methods = hits.select("method").distinct()
    rows = expected.join(F.broadcast(methods)).join(top, ["method", "item_id"], "left")  # a few names of methods
    top_or_none = F.coalesce("top", F.array().cast("array<struct<rank:int,article:string,doc_id:bigint>>"))
    first = lambda name, of: F.array_min(F.transform(F.filter(F.col("t"), lambda x: F.array_contains(F.col(of), x[name])), lambda x: x["rank"]))
    found = lambda name, of: F.size(F.array_intersect(F.transform("t", lambda x: x[name]), F.col(of)))
    rows = rows.withColumn("t", top_or_none)
    cols = _half(found("article", "articles"), first("article", "articles"), F.size("articles"), "article", when_empty, mrr_empty)
    cols |= _half(found("doc_id", "documents"), first("doc_id", "documents"), F.size("documents"), "evidence", when_empty, mrr_empty)
    return rows.select("method", "item_id", (F.size("articles") > 1).alias("is_multi"), *(F.round(c, 6).alias(n) for n, c in cols.items()))


def macro_means(metrics: DataFrame, by: str, names=METRICS) -> DataFrame:
    """Means over all questions of a method, and of each stratum, in one pass."""
    sets = metrics.groupingSets([["method"], ["method", by]], "method", by)
    return sets.agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in names), F.grouping(by).cast("long").alias("all_strata"))


def latency(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, least, most; linear, nearest-rank percentiles."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"),
        *(F.round(F.percentile(value, q / 100), 6).alias(f"p{q}") for q in (50, 95)), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95_nearest"),
    )


def rounded_index_percentile(values: Column, q: float) -> Column:
    """Of a sorted array: the value at the half-even rounded place q * (n - 1)."""
    return F.element_at(values, (F.bround(F.lit(q) * (F.size(values) - 1)) + 1).cast("int"))


def set_metrics(expected: Column, got: Column, noise_of_nothing: float = 0.0) -> dict[str, Column]:
    """Precision, recall, F1 and noise of two arrays as sets."""
    e, g = F.array_distinct(expected), F.array_distinct(got)
    both = F.size(F.array_intersect(e, g))
    p = F.when(F.size(g) == 0, 0.0).otherwise(both / F.size(g))
    r = F.when(F.size(e) == 0, 0.0).otherwise(both / F.size(e))
    return {"precision": p, "recall": r, "f1": F.when(both == 0, 0.0).otherwise(2 * p * r / (p + r)), "noise": F.when(F.size(g) == 0, noise_of_nothing).otherwise(1 - both / F.size(g))}


def answer_case(df: DataFrame) -> DataFrame:
    """Per case, from expected_status, predicted_status and the arrays available, declared, inline, expected_articles,
    cited_articles, required, satisfied; undefined rates are null."""
    size, both = F.size, lambda a, b: F.size(F.array_intersect(a, b))
    rate = lambda n, d: F.when(d > 0, n / d)
    return df.select(
        "case_id",
        (F.col("expected_status") == F.col("predicted_status")).cast("double").alias("status_accuracy"),
        F.when(size("declared") == 0, 1.0).otherwise(both("declared", "available") / size("declared")).alias("citation_validity"),
        (F.array_sort("declared") == F.array_sort("inline")).cast("double").alias("inline_match"),
        F.round(rate(both("cited_articles", "expected_articles"), size("cited_articles")), 6).alias("citation_precision"),
        F.round(rate(both("cited_articles", "expected_articles"), size("expected_articles")), 6).alias("citation_completeness"),
        F.round(rate(both("required", "satisfied"), size("required")), 6).alias("claim_recall"),
    )


def gate(values: dict[str, Column], least: dict[str, float]) -> Column:
    """Failures of a threshold gate: what is null can't be scored, what is under its bound fails."""
    tests = [F.when(v.isNull(), F.lit(f"{n}:not_scoreable")).when(v < least[n], F.lit(f"{n}:below_minimum")) for n, v in values.items()]
    return F.array_compact(F.array(*tests))


def guardrail(status: Column, declared: Column, inline: Column, available: Column, answer: Column) -> Column:
    """Reason to reject an answer, or null: the declared sources must be the inline ones, all of them available; an answer
    needs one, a refusal has none."""
    unknown = F.size(F.array_except(declared, available)) > 0
    return (
        F.when(~status.isin("answered", "insufficient_evidence") | (F.trim(answer) == ""), F.lit("invalid_schema"))
        .when(unknown | (F.size(F.array_except(inline, available)) > 0), F.lit("citation_unknown"))
        .when((status == "answered") & (F.size(declared) == 0), F.lit("citation_missing"))
        .when((status == "insufficient_evidence") & (F.size(declared) + F.size(inline) > 0), F.lit("citation_unexpected"))
        .when(F.array_sort(F.array_distinct(declared)) != F.array_sort(F.array_distinct(inline)), F.lit("citation_mismatch"))
    )


def consensus(claims: DataFrame, models: int) -> DataFrame:
    """case_id, n_models, agreed: at least `models` models gave a case, without an error, the same set of claims.
    claims: case_id, model, claim, failed."""
    own = claims.groupBy("case_id", "model").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.lower(F.trim("claim")))), "\n"), 256).alias("print"), F.max(F.col("failed").cast("int")).alias("failed"))
    return own.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_models"), ((F.count(F.lit(1)) >= models) & (F.count_distinct("print") == 1) & (F.max("failed") == 0)).alias("agreed"))


def answer_summary(cases: DataFrame) -> DataFrame:
    """One row over answer_case(): means that leave undefined cases out, and how many cases there are. No case is an error."""
    means = [F.avg(c).alias(c) for c in ("status_accuracy", "citation_validity", "inline_match", "citation_precision", "citation_completeness", "claim_recall")]
    n = F.count(F.lit(1))
    return cases.agg(F.when(n == 0, F.raise_error(F.lit("at least one case is needed")).cast("long")).otherwise(n).alias("cases"), *means)


def runtime_case(df: DataFrame) -> DataFrame:
    """Of observed answers (case_id, http_status, answer, fallback, cited_chunks, cited_articles, n_sources, expected_chunks,
    expected_articles, answerable, unknown_chunks): which tests each case passes. Validity of cited chunks is null where
    nothing is cited; precision and completeness count chunks where the case names any, else articles."""
    size, both = F.size, lambda a, b: F.size(F.array_intersect(a, b))
    ok = F.col("http_status") == 200
    generated = ok & ~F.col("fallback") & (F.trim("answer") != "")
    cited = F.col("n_sources") > 0
    valid = F.when(cited, (size("cited_chunks") > 0) & (F.col("unknown_chunks") == 0))
    hit = (both("cited_articles", "expected_articles") > 0) | (both("cited_chunks", "expected_chunks") > 0)
    by_chunk = size("expected_chunks") > 0
    got, want = F.when(by_chunk, F.col("cited_chunks")).otherwise(F.col("cited_articles")), F.when(by_chunk, F.col("expected_chunks")).otherwise(F.col("expected_articles"))
    scored = F.col("answerable") & ~F.col("fallback") & cited & F.coalesce(valid, F.lit(True))
    precision = F.when(scored & (size(got) > 0), both(got, want) / size(got)).otherwise(0.0)
    complete = F.when(~scored, 0.0).when(size(want) == 0, 1.0).otherwise(both(got, want) / size(want))
    return df.select("case_id", ok.alias("transport"), generated.alias("generated"), cited.alias("cited"), valid.alias("valid"), hit.alias("hit"), (ok & generated & cited & F.coalesce(valid, F.lit(False)) & hit).alias("grounded"), F.round(precision, 4).alias("precision"), F.round(complete, 4).alias("completeness"))


def runtime_summary(cases: DataFrame) -> DataFrame:
    """Rates over runtime_case(): of all cases, validity of those that cite; 0 (validity 1) where there are none."""
    rate = lambda c: F.coalesce(F.round(F.avg(F.col(c).cast("int")), 4), F.lit(0.0))
    return cases.agg(
        F.count(F.lit(1)).alias("cases"), rate("transport").alias("transport_rate"), rate("generated").alias("generated_rate"), rate("cited").alias("citation_rate"), rate("hit").alias("evidence_rate"), rate("grounded").alias("grounded_rate"),
        F.count_if("grounded").alias("grounded"), F.coalesce(F.round(F.avg(F.col("valid").cast("int")), 4), F.lit(1.0)).alias("validity_rate"), F.count("valid").alias("applicable"), F.count_if(F.col("valid").isNull()).alias("not_applicable"),
        F.coalesce(F.round(F.avg("precision"), 4), F.lit(0.0)).alias("mean_precision"), F.coalesce(F.round(F.avg("completeness"), 4), F.lit(0.0)).alias("mean_completeness"),
    )


def token_audit(chunks: DataFrame, limit: int, margin: int = 32, group: str = "chunk_type", tokens: str = "tokens", proxy: str = "proxy") -> DataFrame:
    """Of each group and of all: token statistics, how many chunks are over the limit or within the margin below it, how a
    cheaper count stands to that (both over, only one of them, neither), and the correlation of the two counts."""
    t, p = F.col(tokens), F.col(proxy)
    over, guess = t > limit, p > limit
    disc = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {tokens})").cast("long").alias(f"p{int(q * 100)}")
    return chunks.groupingSets([[], [group]], group).agg(
        F.count(F.lit(1)).alias("chunks"), F.min(t).alias("least"), F.max(t).alias("most"), F.round(F.avg(t), 6).alias("mean"), disc(0.95), disc(0.99), F.count_if(over).alias("truncated"), F.count_if(~over & (t > limit - margin)).alias("near_limit"),
        F.count_if(over & guess).alias("both_over"), F.count_if(over & ~guess).alias("missed"), F.count_if(~over & guess).alias("false_alarms"), F.count_if(~over & ~guess).alias("both_under"), F.round(F.corr(t, p), 6).alias("pearson"),
    )
