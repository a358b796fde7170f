"""Automatic numbers of office documents, as joins and running sums: lists that styles inherit, definitions with overrides,
counters that restart.

A style's list and level are the nearest ones up its line of ancestors, found by links that reach twice as far each round.
A counter is how many paragraphs of its level came since it last restarted: a running count, less the count at the last
restart, so one sort of a list's paragraphs does for all levels.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import materialize

#: Fixed value: levels that a list may have.
LEVELS = 9
# Thousands, hundreds, tens and ones in Roman numerals, which go up to 3999.
ROMAN = (("", "M", "MM", "MMM"), ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))


class NumberingError(ValueError):
    """Styles that inherit from themselves."""


def roman(n: Column) -> Column:
    digits = (F.array(*map(F.lit, row))[(F.floor(n / 10**place) % 10).cast("int")] for row, place in zip(ROMAN, (3, 2, 1, 0), strict=True))
    return F.when((n > 0) & (n < 4000), F.concat(*digits)).otherwise(n.cast("string"))


def letters(n: Column) -> Column:
    """A to Z, AA, AB and so on."""
    start = F.struct(n.cast("bigint").alias("rest"), F.lit("").alias("text"))
    step = lambda s, _: F.when(s["rest"] > 0, F.struct(F.floor((s["rest"] - 1) / 26).alias("rest"), F.concat(F.char(F.lit(65) + (s["rest"] - 1) % 26), s["text"]).alias("text"))).otherwise(s)
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, step, lambda s: s["text"])).otherwise(n.cast("string"))


def number_label(n: Column, form: Column) -> Column:
    """A number in a form of the word processor; null for an unknown form."""
    padded = F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))
    out = F.when(form == "decimal", n.cast("string")).when(form == "decimalZero", padded).when(form == "none", "")
    for name, f in (("Roman", roman), ("Letter", letters)):
        out = out.when(form == f"upper{name}", f(n)).when(form == f"lower{name}", F.lower(f(n)))
    return out


def style_lists(styles: DataFrame, where: str, key: list[str] | None = None) -> DataFrame:
    """(key, style, num_id, level): what each style has or inherits. styles: key, style, based_on, num_id, level. A style
    that isn't there ends a line; one that inherits from itself is an error."""
    key = key or []
    now = styles.select(*key, "style", F.col("based_on").alias("up"), "num_id", "level")
    most = now.count()
    for i in itertools.count():
        far = now.select(*key, F.col("style").alias("up"), F.col("up").alias("further"), F.col("num_id").alias("num_id_"), F.col("level").alias("level_"))
        now = materialize(now.join(far, [*key, "up"], "left").select(*key, "style", F.col("further").alias("up"), F.coalesce("num_id", "num_id_").alias("num_id"), F.coalesce("level", "level_").alias("level")), f"{where}/styles-{i}")
        open_lines = now.where("up is not null")
        if open_lines.isEmpty():
            return now.drop("up")
        if 1 << i > most:
            raise NumberingError(f"styles inherit from themselves: {[r['style'] for r in open_lines.orderBy('style').limit(5).collect()]}")


def definitions(levels: DataFrame, instances: DataFrame, overrides: DataFrame) -> DataFrame:
    """(num_id, level, start, format, pattern, restart) of the lists. levels: abstract_id, level, start, format, pattern,
    restart (null: after the level above; 0: never; else the level, from 1, that it restarts after); instances: num_id,
    abstract_id; overrides: num_id, level, start (a new start), and the other columns, null but for a new definition."""
    own = instances.join(levels, "abstract_id").select("num_id", "level", *(F.col(c).alias(f"{c}_") for c in ("start", "format", "pattern", "restart")))
    both = own.join(overrides, ["num_id", "level"], "full")
    new = F.col("format").isNotNull()
    pick = lambda c: F.when(new, F.col(c)).otherwise(F.col(f"{c}_")).alias(c)
    return both.select("num_id", "level", F.coalesce("start", "start_").alias("start"), pick("format"), pick("pattern"), pick("restart")).where("format is not null")


def listed(paragraphs: DataFrame, lists: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Paragraphs (style, num_id, level) with the list and the level that hold for them: their own, else their style's; the
    list 0 is none, and a list without a level is of level 0."""
    rows = paragraphs.join(lists.withColumnsRenamed({"num_id": "num_id_", "level": "level_"}), [*(key or []), "style"], "left")
    num = F.coalesce("num_id", "num_id_")
    return rows.withColumn("num_id", F.when(num != 0, num)).withColumn("level", F.when(F.col("num_id").isNotNull(), F.coalesce("level", "level_", F.lit(0)))).drop("num_id_", "level_")


def numbered(paragraphs: DataFrame, defined: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, label, text) of paragraphs (key, pos, num_id, level, text): the number that is shown, null where there is
    none, or where the list has no such level. defined: num_id, level, start, format, pattern, restart (as `definitions`),
    with the key where documents have lists of their own.

    A level counts on until a paragraph of an outer level that it restarts after. A pattern's %k is the number of level k,
    or its start where it hasn't counted yet; one of a level that isn't defined stays.
    """
    if "restart" not in defined.columns:
        defined = defined.withColumn("restart", F.lit(None).cast("int"))
    by = [c for c in (key, "num_id") if c in defined.columns]
    after = F.when(F.col("restart").isNull(), F.col("level") - 1).when(F.col("restart") > 0, F.col("restart") - 1)
    row = F.struct(F.col("start").cast("bigint").alias("start"), "format", "pattern", after.cast("int").alias("after"))
    lists = defined.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.col("level").cast("int"), row))).alias("of"))
    lists = lists.select(*by, F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.col("of")[k]).alias("of"))
    rows = paragraphs.join(lists, by, "left").withColumn("own", F.col("of")[F.when(F.col("level").between(0, LEVELS - 1), F.col("level")).cast("int")])
    w = Window.partitionBy(key, "num_id").orderBy("pos")
    fine = F.col("own").isNotNull()
    rows = rows.withColumns({f"c{k}": F.sum((fine & (F.col("level") == k)).cast("bigint")).over(w) for k in range(LEVELS)})
    restarts = lambda k: fine & (F.col("level") < k) & (F.col("level") <= F.col("of")[k]["after"])
    rows = rows.withColumns({f"b{k}": F.last(F.when(restarts(k), F.col(f"c{k}")), ignorenulls=True).over(w) for k in range(1, LEVELS)} | {"b0": F.lit(0)})
    value = lambda k: F.col("of")[k]["start"] + F.greatest(F.col(f"c{k}") - F.coalesce(F.col(f"b{k}"), F.lit(0)) - 1, F.lit(0))
    rows = rows.withColumn("values", F.array(*(F.when(fine, value(k)) for k in range(LEVELS))))
    shown = F.transform("values", lambda v, k: number_label(v, F.col("of")[k]["format"]))
    put = lambda text, k: F.replace(text, F.concat(F.lit("%"), (k + 1).cast("string")), F.coalesce(F.col("shown")[k], F.concat(F.lit("%"), (k + 1).cast("string"))))
    rows = rows.withColumn("shown", shown)
    label = F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), F.replace(F.col("own.pattern"), F.lit("\t"), F.lit(" ")), put)
    return rows.select(key, "pos", F.trim(label).alias("label"), "text")
