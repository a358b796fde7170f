"""Catalogue, history and paging over relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import fold


def page(df: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    """One page in a total order: a global top-k, of which the pages before are cut off."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("pages count from 1 and hold 1 to 100 rows")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def pages_of(df: DataFrame, owner: str, number: int, size: int, *order: Column) -> DataFrame:
    """One page of every owner's rows, in a total order."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("pages count from 1 and hold 1 to 100 rows")
    w = Window.partitionBy(owner).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(w)).where(F.col("_row").between((number - 1) * size + 1, number * size)).drop("_row")


def page_count(total: Column, size: int) -> Column:
    """Pages of a result; 0 where it is empty."""
    return F.ceil(total / size).cast("long")


def search(df: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows in which a text without marks and case occurs."""
    return df.where(fold(F.concat_ws(" ", *columns)).contains(fold(F.lit(needle))))


def document_key(*candidates: str, article: str = "article_code") -> Column:
    """First non-blank id; else the article code without a numeric last part; else unknown_doc."""
    ids = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in candidates]
    code = F.nullif(F.regexp_replace(F.trim(F.col(article).cast("string")), r"\.\d+$", ""), F.lit(""))
    return F.coalesce(*ids, code, F.lit("unknown_doc"))


def usable_sources(df: DataFrame, key: str, text: str, question: str, order: str) -> DataFrame:
    """Sources with a non-blank key and text, the first of each key, numbered S1, S2, ... in order."""
    ok = df.where((F.trim(F.col(key).cast("string")) != "") & (F.trim(F.col(text)) != ""))
    one = ok.withColumn("_n", F.row_number().over(Window.partitionBy(question, key).orderBy(order))).where("_n = 1").drop("_n")
    return one.withColumn("source_id", F.concat(F.lit("S"), F.row_number().over(Window.partitionBy(question).orderBy(order))))


def previous_of_role(df: DataFrame, conversation: str, order: str, role: str, of: str, text: str) -> DataFrame:
    """As-of join: to each row the last text of a role before it in its conversation."""
    w = Window.partitionBy(conversation).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(of, F.last(F.when(F.col("role") == role, F.col(text)), ignorenulls=True).over(w))


def missing_both_ways(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that one side has alone: (key, side)."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("right")))


def gates(checks: dict[str, Column]) -> Column:
    """Codes of the checks that don't hold; what is null doesn't hold."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())))
