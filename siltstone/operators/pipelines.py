"""Composite operators with injected models: embedding, pair scoring and answering are functions that the caller gives."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.text import inline_citations, json_object
from siltstone.operators.metrics import guardrail
from siltstone.operators.ranking import checked_pool

Embed = Callable[[Sequence[str]], list[list[float]]]
Score = Callable[[Sequence[tuple[str, str]]], list[float]]


class Retriever(Protocol):
    """Ranked hits of all questions: item_id, chunk_id, text, source, place (from 1), at most k of each question."""

    def __call__(self, questions: DataFrame, k: int) -> DataFrame: ...


def embed(df: DataFrame, model: Embed, text: str = "text", prefix: str = "passage: ", vector: str = "embedding") -> DataFrame:
    """All columns and the model's vector of each text, batch by batch. A prefix is put on once."""

    def run(batches):
        for b in batches:
            texts = [(t or "") if (t or "").startswith(prefix) else prefix + (t or "") for t in b.column(b.schema.names.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model(texts), pa.list_(pa.float32()))], [*b.schema.names, vector])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(vector, T.ArrayType(T.FloatType()))]))


def rerank(hits: DataFrame, model: Score, k: int, question: str = "question", text: str = "text", group: str = "article", query_id: str = "item_id", rank: str = "rank") -> DataFrame:
    """Hits in the order of a pair scorer, the best of each group. A batch whose scores fail, or aren't all finite, keeps
    its lexical order, below scored ones."""

    @F.pandas_udf(T.DoubleType())
    def scored(q: pd.Series, t: pd.Series) -> pd.Series:
        try:
            out = pd.Series(model(list(zip(q, t, strict=True))), dtype="float64")
            ok = len(out) == len(q) and bool((out.abs() < float("inf")).all())
        except Exception:  # noqa: BLE001 - a scorer that fails must not fail the search
            ok = False
        return out if ok else pd.Series([None] * len(q), dtype="float64")

    out = hits.withColumn("pair_score", scored(question, text))
    order = [F.desc_nulls_last("pair_score"), F.col(rank)]
    best = out.withColumn("_n", F.row_number().over(Window.partitionBy(query_id, group).orderBy(*order))).where("_n = 1").drop("_n")
    return best.withColumn("place", F.row_number().over(Window.partitionBy(query_id).orderBy(*order))).where(F.col("place") <= k)


def context(hits: DataFrame, query_id: str = "item_id", place: str = "place", label: str = "source", text: str = "text") -> DataFrame:
    """One rendered context of each question: a block for each source in order."""
    block = F.concat(F.lit("[S"), F.col(place).cast("string"), F.lit("] "), F.col(label), F.lit("\n"), F.col(text))
    return hits.groupBy(query_id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))


def answer(contexts: DataFrame, generate: Callable[[str, str], str], question: str = "question", tries: int = 2) -> DataFrame:
    """All columns, `answer` and `attempts`; an answer is null where each try failed."""

    def run(batches):
        for b in batches:
            out, used = [], []
            for q, c in zip(b.column(b.schema.names.index(question)).to_pylist(), b.column(b.schema.names.index("context")).to_pylist(), strict=True):
                got = None
                for n in range(1, tries + 1):  # noqa: B007
                    try:
                        got = generate(q, c)
                        break
                    except Exception:  # noqa: BLE001, S112 - the next try or none
                        continue
                out.append(got)
                used.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string()), pa.array(used, pa.int64())], [*b.schema.names, "answer", "attempts"])

    return contexts.mapInArrow(run, T.StructType([*contexts.schema.fields, T.StructField("answer", T.StringType()), T.StructField("attempts", T.LongType())]))


def pending_tasks(questions: DataFrame, models: Sequence[str], done: DataFrame) -> DataFrame:
    """Question and model pairs of an annotation panel that have no record yet. models: a stated, short list."""
    tasks = questions.select("item_id", F.explode(F.array(*(F.lit(m) for m in models))).alias("model"))
    return tasks.join(done.select("item_id", "model"), ["item_id", "model"], "left_anti")


def record_exchange(exchanges: DataFrame) -> DataFrame:
    """Two messages of each exchange (conv_id, ts, question, answer), the answer one microsecond later."""
    return exchanges.select("conv_id", F.explode(F.array(
        F.struct(F.lit("user").alias("role"), F.col("question").alias("text"), F.col("ts").alias("ts")),
        F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("text"), (F.col("ts") + F.expr("INTERVAL 1 MICROSECOND")).alias("ts")),
    )).alias("m")).select("conv_id", "m.*")


def rebind_evidence(golden: DataFrame, chunks: DataFrame) -> DataFrame:
    """item_id, evidence: ids that are still there; where none is, all chunks of the expected articles, in order.
    golden: item_id, evidence_ids, articles; chunks: chunk_id, article."""
    kept = golden.select("item_id", F.explode("evidence_ids").alias("chunk_id")).join(chunks.select("chunk_id"), "chunk_id", "left_semi").groupBy("item_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("kept"))
    by_article = golden.select("item_id", F.explode("articles").alias("article")).join(chunks, "article").groupBy("item_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("all"))
    return golden.select("item_id").join(kept, "item_id", "left").join(by_article, "item_id", "left").select("item_id", F.coalesce("kept", "all", F.array().cast("array<string>")).alias("evidence"))


def sanitized(text: Column, most: int = 6000) -> Column:
    """A source's text for a prompt: no control characters, no marks that look like a source's label or a fence, bounded."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " "), r"\[S(\d+)\]|```", "($1)")
    return F.substring(plain, 1, most)


def ask(questions: DataFrame, retrieve: Retriever, generate: Callable[[str, str], str], k: int = 5, tries: int = 2) -> DataFrame:
    """Questions (item_id, question) answered from their sources: item_id, answer, status, rejected (why an answer isn't
    shown: it failed, or the guardrail says so), sources (the ids that were given). A question without a hit isn't sent to
    the model. Answers are JSON objects with status, answer and sources."""
    checked_pool(k, k)
    hits = retrieve(questions, k).withColumn("text", sanitized(F.col("text")))
    given = hits.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list("place")), lambda p: F.concat(F.lit("S"), p.cast("string"))).alias("given"))
    asked = questions.select("item_id", "question").join(context(hits), "item_id").join(given, "item_id")
    raw = answer(asked, generate, tries=tries).withColumn("o", F.from_json(json_object(F.col("answer")), "status string, answer string, sources array<string>"))
    declared, text = F.coalesce("o.sources", F.array().cast("array<string>")), F.coalesce("o.answer", F.lit(""))
    why = F.when(F.col("answer").isNull(), "generation_failed").when(F.col("o.status").isNull(), "invalid_schema").otherwise(guardrail(F.col("o.status"), declared, inline_citations(text), F.col("given"), text))
    out = raw.select("item_id", why.alias("rejected"), F.col("o.status").alias("status"), text.alias("text"), F.col("given").alias("sources"))
    shown = out.select("item_id", F.when(F.col("rejected").isNull(), F.col("text")).alias("answer"), F.when(F.col("rejected").isNull(), F.col("status")).otherwise("rejected").alias("status"), "rejected", "sources")
    without = questions.select("item_id").join(given.select("item_id"), "item_id", "left_anti").select("item_id", F.lit(None).cast("string").alias("answer"), F.lit("insufficient_evidence").alias("status"), F.lit(None).cast("string").alias("rejected"), F.array().cast("array<string>").alias("sources"))
    return shown.unionByName(without)


def usable_models(models: DataFrame, least_context: int) -> DataFrame:
    """Models of a catalogue (id, prompt_price, completion_price, context_length) that cost nothing and read enough, the
    longest context first."""
    free = (F.col("prompt_price").cast("double") == 0) & (F.col("completion_price").cast("double") == 0)
    return models.where(free & (F.col("context_length") >= least_context)).orderBy(F.desc("context_length"), "id")


#: What may follow a state of an annotated case.
STEPS = {"draft": ("panel_reviewed",), "panel_reviewed": ("adjudicated", "human_review"), "human_review": ("adjudicated",), "adjudicated": ("locked",), "locked": ()}


def advance(cases: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases (case_id, status) after moves (case_id, status), and the moves that aren't allowed (case_id, problem): to a
    state that may not follow, of a case that isn't there, or twice."""
    twice = moves.groupBy("case_id").agg(F.count(F.lit(1)).alias("moves"), F.min("status").alias("to"))
    both = cases.join(twice, "case_id", "full")
    allowed = F.lit(False)
    for a, steps in STEPS.items():
        allowed = allowed | ((F.col("status") == a) & F.col("to").isin(*steps))
    problem = F.when(F.col("status").isNull(), "unknown_case").when(F.col("moves") > 1, "moved_twice").when(F.col("to").isNotNull() & ~allowed, "not_allowed")
    out = both.withColumn("problem", problem)
    return out.where("status is not null").select("case_id", F.when(F.col("to").isNotNull() & F.col("problem").isNull(), F.col("to")).otherwise(F.col("status")).alias("status")), out.where("problem is not null").select("case_id", "problem")
