"""Queries of list numbers, matches, splits and index versions: inputs follow from the tables' numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import numbering as N
from siltstone.operators.editing import match_without_reuse
from siltstone.operators.splits import split_without_leaks
from siltstone.plans.registry import query, table
from siltstone.session import work_dir
from siltstone.sources import versions as V

#: Lists of a template: definitions, lists, what lists override, and styles with their ancestors.
LEVELS = [("A", 0, 1, "upperRoman", "Chương %1", None), ("A", 1, 1, "decimal", "%1.%2.", None), ("A", 2, 1, "lowerLetter", "%3)", None), ("A", 3, 1, "decimalZero", "%3-%4", 0),
          ("B", 0, 3, "decimal", "%1.", None), ("B", 1, 1, "lowerRoman", "(%2)", None), ("B", 2, 1, "upperLetter", "%1.%2.%3", 1), ("B", 3, 1, "none", "* %4", None)]
LISTS = [(1, "A"), (2, "B"), (3, "A"), (4, "B")]
OVERRIDES = [(3, 0, 5, None, None, None), (3, 1, 2, "upperLetter", "%2/", None), (4, 5, 7, "decimal", "%6", None)]
STYLES = [("s0", None, 1, 0), ("s1", "s0", None, 1), ("s2", "s1", 2, None), ("s3", "s2", None, 2), ("s4", "s3", None, None), ("s5", None, None, None), ("s6", "s9", 4, 3)]


def _values(rows: list[tuple]) -> str:
    say = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(say, r)) + ")" for r in rows)


def _label_sql(n: str, form: str) -> str:
    digit = lambda row, p: f"[{', '.join(repr(x) for x in row)}][{n} // {10**p} % 10 + 1]"
    roman = f"CASE WHEN {n} < 4000 THEN concat({', '.join(digit(r, p) for r, p in zip(N.ROMAN, (3, 2, 1, 0), strict=True))}) ELSE CAST({n} AS VARCHAR) END"
    letter = f"CASE WHEN {n} > 702 THEN concat(chr(CAST(64 + ({n} - 703) // 676 + 1 AS INTEGER)), chr(CAST(65 + ({n} - 703) // 26 % 26 AS INTEGER)), chr(CAST(65 + ({n} - 703) % 26 AS INTEGER))) WHEN {n} > 26 THEN concat(chr(CAST(64 + ({n} - 1) // 26 AS INTEGER)), chr(CAST(65 + ({n} - 1) % 26 AS INTEGER))) ELSE chr(CAST(64 + {n} AS INTEGER)) END"
    return f"CASE {form} WHEN 'decimal' THEN CAST({n} AS VARCHAR) WHEN 'decimalZero' THEN CASE WHEN {n} < 10 THEN concat('0', {n}) ELSE CAST({n} AS VARCHAR) END WHEN 'none' THEN '' WHEN 'upperRoman' THEN {roman} WHEN 'lowerRoman' THEN lower({roman}) WHEN 'upperLetter' THEN {letter} WHEN 'lowerLetter' THEN lower({letter}) END"


NUMBERING_SQL = f"""WITH RECURSIVE lv(a, level, start, format, pattern, restart) AS (VALUES {_values(LEVELS)}), ls(num, a) AS (VALUES {_values(LISTS)}), ov(num, level, start, format, pattern, restart) AS (VALUES {_values(OVERRIDES)}), st(style, up, num, level) AS (VALUES {_values(STYLES)}),
df AS MATERIALIZED (SELECT num, level, coalesce(ov.start, lv.start) AS start, coalesce(ov.format, lv.format) AS format, coalesce(ov.pattern, lv.pattern) AS pattern, CASE WHEN coalesce(ov.restart, lv.restart, -1) < 0 THEN level - 1 WHEN coalesce(ov.restart, lv.restart) = 0 THEN -1 ELSE coalesce(ov.restart, lv.restart) - 1 END AS last FROM (SELECT * FROM ls JOIN lv USING (a)) lv FULL JOIN ov USING (num, level) WHERE coalesce(ov.format, lv.format) IS NOT NULL),
up AS (SELECT style, up, num, level FROM st UNION ALL SELECT u.style, s.up, coalesce(u.num, s.num), coalesce(u.level, s.level) FROM up u JOIN st s ON u.up = s.style),
sr AS (SELECT style, max(num) AS num, max(level) AS level FROM (SELECT style, last(num ORDER BY k) AS num, last(level ORDER BY k) AS level FROM (SELECT *, (num IS NOT NULL)::INT + (level IS NOT NULL)::INT AS k FROM up) GROUP BY style) GROUP BY style),
p AS (SELECT l_orderkey % 97 AS doc_id, l_orderkey * 8 + l_linenumber AS pos, concat('s', l_partkey % 8) AS style, CASE l_suppkey % 4 WHEN 0 THEN l_suppkey % 3 + 1 WHEN 1 THEN CASE WHEN l_partkey % 3 = 0 THEN 0 END END AS num, CASE WHEN l_quantity % 3 = 0 THEN l_partkey % 4 END AS level FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)),
q AS MATERIALIZED (SELECT doc_id, pos, nullif(coalesce(p.num, sr.num), 0) AS num, coalesce(p.level, sr.level, 0) AS level FROM p LEFT JOIN sr USING (style)),
c AS (SELECT q.*, pattern FROM q JOIN df USING (num, level)),
t AS (SELECT c.doc_id, c.pos, c.num, d.level AS k, d.start, d.format, max(o.pos) FILTER (o.level < d.level AND o.level <= d.last) AS reset FROM c JOIN df d USING (num) LEFT JOIN c o ON o.doc_id = c.doc_id AND o.num = c.num AND o.pos <= c.pos GROUP BY ALL),
v AS (SELECT t.doc_id, t.pos, t.k, start + greatest(count(o.pos) - 1, 0) AS n, format FROM t LEFT JOIN c o ON o.doc_id = t.doc_id AND o.num = t.num AND o.level = t.k AND o.pos <= t.pos AND o.pos > coalesce(reset, -1) GROUP BY t.doc_id, t.pos, t.k, start, format),
s AS (SELECT doc_id, pos, k, {_label_sql("n", "format")} AS shown FROM v),
w AS (SELECT doc_id, pos, {", ".join(f"max(shown) FILTER (k = {k}) AS s{k}" for k in range(6))} FROM s GROUP BY doc_id, pos)
SELECT q.doc_id, q.pos, trim({"".join("replace(" for _ in range(6))}c.pattern{"".join(f", '%{k + 1}', coalesce(s{k}, '%{k + 1}'))" for k in range(6))}) AS label FROM q LEFT JOIN c USING (doc_id, pos) LEFT JOIN w USING (doc_id, pos)"""


@query("word_numbering", NUMBERING_SQL)
def word_numbering(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of paragraphs, one for each order line, whose lists come from themselves or from their styles."""
    new = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    more = "level int, start int, format string, pattern string, restart int"
    defined = N.definitions(new(LEVELS, f"abstract_id string, {more}"), new(LISTS, "num_id int, abstract_id string"), new(OVERRIDES, f"num_id int, {more}"))
    lists = N.style_lists(new(STYLES, "style string, based_on string, num_id int, level int"), work_dir(spark, "styles"))
    n = F.col("l_suppkey") % 4
    own = F.when(n == 0, F.col("l_suppkey") % 3 + 1).when((n == 1) & (F.col("l_partkey") % 3 == 0), 0)
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")))
    rows = lines.select(
        (F.col("l_orderkey") % 97).alias("doc_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit("s"), (F.col("l_partkey") % 8).cast("string")).alias("style"),
        own.cast("int").alias("num_id"), F.when(F.col("l_quantity") % 3 == 0, F.col("l_partkey") % 4).cast("int").alias("level"), F.lit("").alias("text"),
    )
    return N.numbered(N.listed(rows, lists), defined).select("doc_id", "pos", "label")


@query(
    "greedy_matches",
    """WITH RECURSIVE s AS (SELECT l_suppkey AS q, l_orderkey AS a, l_partkey AS b, max(round(l_quantity + l_linenumber / 10, 1)) AS s FROM lineitem GROUP BY ALL),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, a, b) AS i FROM s WHERE s >= 10),
g AS (SELECT DISTINCT q, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, false AS took, CAST([] AS BIGINT[]) AS la, CAST([] AS BIGINT[]) AS lb FROM r
  UNION ALL SELECT g.q, r.i, r.a, r.b, f.free, CASE WHEN f.free THEN list_append(la, r.a) ELSE la END, CASE WHEN f.free THEN list_append(lb, r.b) ELSE lb END FROM g JOIN r ON r.q = g.q AND r.i = g.i + 1, LATERAL (SELECT NOT list_contains(la, r.a) AND NOT list_contains(lb, r.b) AS free) f),
u AS (SELECT q, a, s AS runner_up FROM s QUALIFY row_number() OVER (PARTITION BY q, a ORDER BY s DESC, b) = 2)
SELECT g.q AS supplier, g.a AS order_id, g.b AS part, CAST(r.s AS DOUBLE) AS score, CAST(u.runner_up AS DOUBLE) AS runner_up FROM g JOIN r USING (q, i) LEFT JOIN u ON u.q = g.q AND u.a = g.a WHERE took""",
)
def greedy_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and parts of each supplier, matched by score, none twice."""
    score = F.max(F.round(F.col("l_quantity") + F.col("l_linenumber") / 10, 1)).cast("double")
    scores = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part")).agg(score.alias("score"))
    return match_without_reuse(scores, 10, work_dir(spark, "matches"), "supplier", "order_id", "part")


SHARES = {"dev": 0.6, "test": 0.25, "held": 0.15}


@query(
    "leak_free_split",
    """WITH RECURSIVE i AS (SELECT o_orderkey AS item_id, o_orderpriority AS category FROM orders),
k AS MATERIALIZED (SELECT o_orderkey AS item_id, concat('a:c', o_custkey) AS x FROM orders UNION SELECT o_orderkey, concat('a:d', o_orderkey // 512) FROM orders WHERE o_orderkey % 64 = 0),
e AS MATERIALIZED (SELECT DISTINCT a.x, b.x AS y FROM k a JOIN k b USING (item_id)),
r AS (SELECT x, x AS y FROM k UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS MATERIALIZED (SELECT x, min(y) AS component FROM r GROUP BY x),
n AS MATERIALIZED (SELECT item_id, category, min(component) AS component FROM i JOIN k USING (item_id) JOIN c USING (x) GROUP BY ALL),
z AS (SELECT component, sum(m) AS size, arg_min(category, (-m, category)) AS kind FROM (SELECT component, category, count(*) AS m FROM n GROUP BY ALL) GROUP BY component),
p AS (SELECT *, (sum(size) OVER (PARTITION BY kind ORDER BY md5(component), component ROWS UNBOUNDED PRECEDING) - size / 2) / sum(size) OVER (PARTITION BY kind) AS middle FROM z)
SELECT item_id, category, component, CAST(size AS BIGINT) AS size, CASE WHEN middle < 0.6 THEN 'dev' WHEN middle < 0.85 THEN 'test' ELSE 'held' END AS split FROM n JOIN p USING (component)""",
)
def leak_free_split(spark: SparkSession, sf: str) -> DataFrame:
    """Orders in three sides; those of one customer, or of some neighbouring numbers, stay together."""
    orders = table(spark, sf, "orders")
    n = F.col("o_orderkey")
    links = orders.select(n.alias("item_id"), F.explode(F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.when(n % 64 == 0, F.concat(F.lit("d"), F.floor(n / 512).cast("string"))))).alias("article"))
    items = orders.select(n.alias("item_id"), F.col("o_orderpriority").alias("category"))
    return split_without_leaks(items, links, SHARES, work_dir(spark, "split")).select("item_id", "category", "component", "size", "split")


@query(
    "index_versions",
    """WITH r(reader, later) AS (VALUES ('pinned', 0), ('current', 1), ('rolled back', 0), ('first commit', 0))
SELECT reader, doc_id, CAST(n_chars + later AS BIGINT) AS n_chars, CASE WHEN later = 1 THEN 'b' ELSE 'a' END AS version FROM documents, r""",
)
def index_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as readers see them: one that began before a switch, one after it, one after going back, one of a commit."""
    docs, root = table(spark, sf, "documents").select("doc_id", "n_chars"), work_dir(spark, "index")
    n = V.write_version(docs, root, "a", "fa")
    first = V.commit(spark, root, "a", "fa", n, after=0)
    readers = {"pinned": V.read_index(spark, root)}
    V.write_version(docs.withColumn("n_chars", F.col("n_chars") + 1), root, "b", "fb")
    V.commit(spark, root, "b", "fb", n, after=first.number)
    readers["current"] = V.read_index(spark, root)
    V.roll_back(spark, root)
    readers |= {"rolled back": V.read_index(spark, root), "first commit": V.read_index(spark, root, first.number)}
    out = None
    for name, df in readers.items():
        rows = df.select(F.lit(name).alias("reader"), "doc_id", "n_chars", F.col("_index_version").alias("version"))
        out = rows if out is None else out.unionByName(rows)
    return out
