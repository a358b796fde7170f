"""Corpus edits and matching by order: inserts, replacements, rebuilt parts, title paths, matches without reuse."""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import materialize


def insert_after(units: DataFrame, inserted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Units with others put behind their anchors, numbered anew. units: key, unit_id, pos, text; inserted: key, anchor,
    seq, unit_id, text. An anchor that isn't there leaves its insert out."""
    placed = inserted.join(units.select(key, F.col("unit_id").alias("anchor"), "pos"), [key, "anchor"])
    both = units.select(key, "unit_id", "pos", F.lit(0).alias("seq"), "text").unionByName(placed.select(key, "unit_id", "pos", "seq", "text"))
    return both.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("pos", "seq", "unit_id")) - 1).drop("seq")


def apply_effects(units: DataFrame, decisions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Units after legal effects (unit_id, action, text): excluded ones and their descendants go, replaced ones get the
    new text and keep the old one's digest. The decision closest to a unit counts."""
    from siltstone.operators.units import rule_matches

    matched = rule_matches(units, decisions.select(F.col("unit_id").alias("rule"), "action", F.col("text").alias("new_text")))
    closest = matched.groupBy(key, "unit_id").agg(F.max_by(F.struct("rule", "action", "new_text"), F.length("rule")).alias("d"))
    out = units.join(closest, [key, "unit_id"], "left").where(F.coalesce(F.col("d.action") != "exclude", F.lit(True)))
    replaced = (F.col("d.action") == "replace") & (F.col("d.rule") == F.col("unit_id"))
    return out.select(*[c for c in units.columns if c != "text"], F.when(replaced, F.col("d.new_text")).otherwise(F.col("text")).alias("text"), F.when(replaced, F.sha2("text", 256)).alias("replaced_sha256"))


def merge_rebuilt(old: DataFrame, rebuilt: DataFrame, article: str = "article") -> DataFrame:
    """Of each article the rebuilt chunks where there are any, else the old ones."""
    return old.join(rebuilt.select(article).distinct(), article, "left_anti").unionByName(rebuilt)


def increasing_paths(places: list[list[int]]) -> int:
    """How many strictly increasing choices of one place each there are, counted up to 2."""
    ends = [(-1, 1)]  # place, ways to end there
    for options in places:
        before = sorted(ends)
        keys = [p for p, _ in before]
        ways = [0]
        for _, w in before:
            ways.append(min(2, ways[-1] + w))
        ends = [(p, n) for p in sorted(set(options)) if (n := ways[bisect_left(keys, p)])]
        if not ends:
            return 0
    return min(2, sum(w for _, w in ends))


def unique_title_paths(titles: DataFrame, paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, paths): in how many increasing sequences (0, 1, 2 for more) a document's titles, in order, stand among its
    paragraphs. titles: key, no, title; paragraphs: key, pos, text. Only paragraphs equal to a title are gathered."""
    t = titles.withColumn("title", F.lower(F.trim("title")))
    found = t.join(paragraphs.withColumn("title", F.lower(F.trim("text"))).select(key, "pos", "title"), [key, "title"], "left").select(key, "no", "pos")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        places = [[int(p) for p in g.dropna()] for _, g in pdf.sort_values("no").groupby("no")["pos"]]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "paths": [increasing_paths(places)]})

    return found.groupBy(key).applyInPandas(count, f"{key} {titles.schema[key].dataType.simpleString()}, paths long")


def match_without_reuse(scores: DataFrame, least: float, where: str, question: str = "item_id", left: str = "old_id", right: str = "new_id", score: str = "score", turn: str | None = None) -> DataFrame:
    """Greedy matches inside each question: the best pair first, no id twice, none under `least`; the runner-up's score
    of each left id is kept. Ties go by ids. With a column `turn`, left ids choose in its order instead, each the best that
    is left.

    Pairs that are best for both of their sides are what the greedy way would take sooner or later, so each round takes all
    of them at once and strikes out what they use up. A question's pairs needn't meet in one task; rounds are as many as the
    longest line of pairs that wait for one another, and each is written below `where`.
    """
    best_two = scores.withColumn("_n", F.row_number().over(Window.partitionBy(question, left).orderBy(F.desc(score), right)))
    second = best_two.where("_n = 2").select(question, left, F.col(score).alias("runner_up"))
    lefts = Window.partitionBy(question, left).orderBy(F.desc(score), right)
    rights = Window.partitionBy(question, right).orderBy(*([turn] if turn else []), F.desc(score), left)
    open_pairs = scores.where(F.col(score) >= least).select(question, left, right, score, *([turn] if turn else []))
    found: DataFrame | None = None
    for i in itertools.count():
        ranked = open_pairs.withColumn("_l", F.row_number().over(lefts)).withColumn("_r", F.row_number().over(rights))
        ranked = materialize(ranked.withColumn("_took", (F.col("_l") == 1) & (F.col("_r") == 1)), f"{where}/{i}")
        took = ranked.where("_took").select(question, left, right, score)
        found = took if found is None else found.unionByName(took)
        if ranked.where("not _took").isEmpty():
            return found.join(second, [question, left], "left")
        open_pairs = ranked.drop("_l", "_r", "_took").join(took.select(question, left), [question, left], "left_anti").join(took.select(question, right), [question, right], "left_anti")


def formula_links(units: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tables with the nearest other unit before and behind them. units: key, pos, unit_id, unit_type."""
    other = F.when(F.col("unit_type") != "table", F.col("unit_id"))
    w = Window.partitionBy(key).orderBy("pos")
    before = F.last(other, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.first(other, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return units.select(key, "unit_id", "unit_type", before.alias("before"), behind.alias("behind")).where("unit_type = 'table'").drop("unit_type")


def linear_formula(rows: list[list[str]]) -> str | None:
    """A fraction set as a table of two rows, in one line: the lead, (numerator / denominator), what follows."""
    clean = [[re.sub(r"\s+", " ", c).strip() for c in r] for r in rows]
    if len(clean) != 2 or not clean[0] or not clean[1]:
        return None
    top, low = [c for c in clean[0] if c], [c for c in clean[1] if c]
    if not top or len(low) != 1:
        return None
    lead, rest = (top[0], top[1:]) if len(top) > 1 and top[0].endswith("=") else ("", top)
    return " ".join(x for x in (lead, f"({rest[0]} / {low[0]})", *rest[1:]) if x)


def column_code_row(cells: list[str]) -> bool:
    """Whether a row only numbers its columns: (1), (2) or A, B, 1, 2."""
    marks = [c.strip().strip("()") for c in cells if c.strip()]
    return len(marks) > 1 and all(re.fullmatch(r"\d{1,2}|[A-ZĐ]", m) for m in marks)


def connected(edges: DataFrame, where: str, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of an undirected graph, root the least node of a component.

    Large and small stars in turn: a node's greater neighbours are tied to the least of its neighbours and itself, then its
    lesser ones are. Edges never grow in number, and as whole neighbourhoods move at once, a path of any length takes rounds
    as its logarithm. When each edge ties a node to its root, it ends. Each round is written below `where`.
    """
    given = materialize(edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct(), f"{where}/edges")
    now = given.where("x != y")
    for i in itertools.count():
        flat = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = flat.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        large = flat.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        lowest = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(lowest, "x").where("y != m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        now = materialize(small.unionByName(lowest.withColumnRenamed("m", "y")).distinct(), f"{where}/{i}")
        ends = now.select(F.col("x").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("y").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty():
            nodes = given.select(F.explode(F.array("x", "y")).alias("node")).distinct()
            return nodes.join(now.select(F.col("x").alias("node"), F.col("y").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
