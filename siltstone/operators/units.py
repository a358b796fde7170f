"""Structural parsing of legal text: headings, clauses, points, as window functions over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What begins an article, a clause, a point, a chapter.
ARTICLE = r"^(?i:Điều|Article)\s+(\d+(?:\.[\w]+)*)[.:]?\s*(.*)$"
CLAUSE = r"^(\d+[a-zA-ZđĐ]?)\.\s+(.+)$"
POINT = r"^([a-zđ])\)\s+(.+)$"
CHAPTER = r"^(?i:Chương|Chapter|Mục|Section)\s+(\S+)\s*(.*)$"
INTERNAL_LINK = r"ViewNoiDungPhapDien\(\s*['\"](\d+)['\"]\s*\)"


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line) of non-blank lines."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line != ''")


def units(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, article, chapter, clause, point, unit_type, text, unit_occurrence).

    Article, chapter and clause hold for the lines below them until the next one; a clause ends at an article, and lines
    inside a quoted amendment don't open clauses. unit_occurrence counts a label that comes again.
    """
    rows = lines(docs, key, text)
    before = Window.partitionBy(key).orderBy("pos")
    opens = F.when(F.col("line").rlike('^["“](?i:Điều|Article)\\s+\\d+'), 1).otherwise(0)
    closes = F.when(F.col("line").rlike('["”]\\s*[;.]?\\s*$'), 1).otherwise(0)
    rows = rows.withColumn("quoted", F.sum(opens).over(before) > F.sum(closes).over(before) - closes)
    own = lambda pattern, i: F.when(~F.col("quoted") & F.col("line").rlike(pattern), F.regexp_extract("line", pattern, i))
    rows = rows.withColumns({"own_article": own(ARTICLE, 1), "own_chapter": own(CHAPTER, 1), "own_clause": own(CLAUSE, 1), "own_point": own(POINT, 1)})
    rows = rows.withColumns({"article": F.last("own_article", ignorenulls=True).over(before), "chapter": F.last("own_chapter", ignorenulls=True).over(before), "article_no": F.count("own_article").over(before)})
    inside = Window.partitionBy(key, "article_no").orderBy("pos")
    rows = rows.withColumn("clause", F.last("own_clause", ignorenulls=True).over(inside)).withColumn("clause_no", F.count("own_clause").over(inside))
    rows = rows.withColumn("point", F.last("own_point", ignorenulls=True).over(Window.partitionBy(key, "article_no", "clause_no").orderBy("pos")))
    kind = F.when(F.col("own_article").isNotNull(), "article").when(F.col("own_chapter").isNotNull(), "chapter").when(F.col("own_clause").isNotNull(), "clause").when(F.col("own_point").isNotNull(), "point").when(F.col("clause").isNotNull(), "clause_continuation").otherwise("preamble")
    rows = rows.withColumn("unit_type", kind)
    labelled = Window.partitionBy(key, "article_no", "unit_type", F.coalesce("own_clause", F.lit("")), F.coalesce("own_point", F.lit(""))).orderBy("pos")
    return rows.withColumn("unit_occurrence", F.row_number().over(labelled)).select(key, "pos", "article", "chapter", "clause", "point", "unit_type", F.col("line").alias("text"), "unit_occurrence")


def article_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, article, first_pos, end_pos): a body ends where the next heading begins."""
    heads = lines(docs, key, text).where(F.col("line").rlike(ARTICLE)).select(key, F.regexp_extract("line", ARTICLE, 1).alias("article"), F.col("pos").alias("first_pos"))
    return heads.withColumn("end_pos", F.lead("first_pos").over(Window.partitionBy(key).orderBy("first_pos")))


def sequence_gaps(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_articles, complete): whether the numbers, in order of first mention, run 1..n."""
    first = spans.groupBy(key, "article").agg(F.min("first_pos").alias("pos"))
    numbered = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "article"))), lambda x: x["article"]).alias("line"), F.count(F.lit(1)).alias("n_articles"))
    return numbered.select(key, "n_articles", (F.col("line") == F.transform(F.sequence(F.lit(1), F.col("n_articles").cast("int")), lambda i: i.cast("string"))).alias("complete"))


def linearize(rows: DataFrame, key: str, cells: str, header: str) -> DataFrame:
    """A table's text: header and rows, cells joined by ` | `, empty cells left out."""
    join = lambda c: F.array_join(F.filter(c, lambda x: F.trim(x) != ""), " | ")
    return rows.select(key, F.concat_ws("\n", join(F.col(header)), F.array_join(F.transform(cells, join), "\n")).alias("text"))


def rule_matches(units: DataFrame, rules: DataFrame, unit_id: str = "unit_id", rule: str = "rule") -> DataFrame:
    """Units that a rule names: the same id, or one below it after a `|`; a rule that ends in `|` names all below.

    An equi-join: a unit meets rules by every prefix of its id that ends at a bar, of which it has few.
    """
    parts = F.split(unit_id, r"\|")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "|"))
    by_prefix = units.withColumn("_prefix", F.explode(prefixes))
    return by_prefix.join(rules.withColumn("_prefix", F.regexp_replace(rule, r"\|$", "")), "_prefix").drop("_prefix")
