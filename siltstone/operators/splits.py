"""Splits of a benchmark that don't leak: items that share an article, directly or through others, stay on one side."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.editing import connected
from siltstone.session import materialize

#: Hexadecimal digits of a component's hash that deal components out for running sums: 4,096 parts of each category.
DIGITS = 3


def components(items: DataFrame, links: DataFrame, where: str, item: str = "item_id", article: str = "article") -> DataFrame:
    """Items with `component`, the least name among those that hang together. links: item, article.

    Each item hangs on the least of its articles, whose names come before all items'. So only articles that an item joins to
    its least one are edges: items of one article, mostly nearly all, have none, and take no part in the rounds. An article of
    many items has as many edges as those that join it to others.
    """
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    own = links.where(F.col(item).isNotNull() & F.col(article).isNotNull()).select(item, node("a", article).alias("_article"))
    hung = materialize(own.groupBy(item).agg(F.min("_article").alias("_least"), F.max("_article").alias("_last")), f"{where}/hung")
    joining = hung.where("_least < _last").select(item, "_least")
    edges = own.join(joining, item).where("_article != _least").select(F.col("_least").alias("a"), F.col("_article").alias("b")).distinct()
    found = connected(edges, where).select(F.col("node").alias("_least"), "root")
    named = items.join(hung.select(item, "_least"), item, "left").join(found, "_least", "left")
    return named.withColumn("component", F.coalesce("root", "_least", node("i", item))).drop("_least", "root")


def split_without_leaks(items: DataFrame, links: DataFrame, shares: Mapping[str, float], where: str, item: str = "item_id", article: str = "article", category: str = "category") -> DataFrame:
    """Items with component, size and split. items: item, category; links: item, article; shares: split to its share.

    Components are dealt out within their commonest category (the least of equal ones), in order of a hash: one goes to the
    split in which its middle lies on a line of the category's items. So a split's share of a category is off by half of the
    component at either of its borders at most. Running sums are of parts by hash first, then within each part, so no
    category needs one task. A null item has no side and is left out; a null category is one of its own.
    """
    named = materialize(components(items, links, f"{where}/components", item, article), f"{where}/items")
    kinds = named.groupBy("component", category).agg(F.count(F.lit(1)).alias("n"))
    whole = kinds.groupBy("component").agg(F.sum("n").alias("size"), F.min_by(category, F.struct((-F.col("n")).alias("n"), F.col(category))).alias("_kind"))
    whole = materialize(whole.withColumn("_hash", F.md5("component")).withColumn("_part", F.substring("_hash", 1, DIGITS)), f"{where}/sizes")
    parts = whole.groupBy("_kind", "_part").agg(F.sum("size").alias("_n"))
    of_kind = Window.partitionBy("_of")
    parts = parts.withColumnRenamed("_kind", "_of").withColumn("_before", F.sum("_n").over(of_kind.orderBy("_part")) - F.col("_n")).withColumn("_all", F.sum("_n").over(of_kind)).drop("_n")
    parts = parts.withColumnRenamed("_part", "_at")
    placed = whole.join(parts, F.col("_kind").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_at")))
    own = F.sum("size").over(Window.partitionBy("_kind", "_part").orderBy("_hash", "component"))
    middle = (F.col("_before") + own - F.col("size") / 2) / F.col("_all") * float(sum(shares.values()))
    split, upto = F.lit(list(shares)[-1]), 0.0
    borders = []
    for name, share in shares.items():
        upto += share
        borders.append((name, upto))
    for name, border in reversed(borders[:-1]):
        split = F.when(F.col("_middle") < border, name).otherwise(split)
    dealt = placed.withColumn("_middle", middle).select("component", "size", split.alias("split"))
    return named.join(dealt, "component")
