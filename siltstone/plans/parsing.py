"""Queries of the legal parser over documents whose lines follow from the orders' numbers: tables of contents, quoted
articles, forms, missing articles, tails and attachments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import parsing as P
from siltstone.plans.registry import query, table

From = Callable[[str, str, str], str]


def planted(over: From, orders: str) -> str:
    """SQL of the lines (n, p, line) by order; `over` deals out numbers up to an expression, as either dialect writes it."""
    d = f"(SELECT o_orderkey AS n, o_orderkey % 4 + 2 AS m FROM {orders})"
    articles = f"(SELECT n, m, i FROM {over(d, 'm', 'i')} WHERE NOT (n % 11 = 0 AND i = 2))"
    attachments = f"(SELECT n, a FROM {over(d, 'n % 3', 'a')})"
    forms = f"(SELECT n, a, f FROM {over(attachments, 'n % 2 + a % 2', 'f')})"
    parts = [
        f"SELECT n, 0 AS p, 'CỘNG HÒA' AS line FROM {d} AS d",
        f"SELECT n, 10 + i, concat('Điều ', i, '. Tên ', i, ' .....') FROM {over(d, 'm', 'i')} WHERE n % 3 = 0",
        f"SELECT n, 1000, 'Chương I QUY ĐỊNH' FROM {d} AS d",
        f"SELECT n, 2000 * i, concat('Điều ', i, '. Tên ', i) FROM {articles} AS a",
        f"SELECT n, 2000 * i + 1, concat('1. Khoản một của ', i, '  ') FROM {articles} AS a",
        f"SELECT n, 2000 * i + 1 + j, concat(j + 1, '. Khoản') FROM {over(articles, '(n + i) % 3', 'j')} WHERE true",
        f"SELECT n, 2000 * i + 40, '' FROM {articles} AS a WHERE (n + i) % 4 = 0",
        f"SELECT n, 2000 * i + 50, concat('Điều ', i + 1, '. Trích dẫn') FROM {articles} AS a WHERE (n + i) % 5 = 0",
        f"SELECT n, 2000 * i + 51, 'nội dung trích' FROM {articles} AS a WHERE (n + i) % 5 = 0",
        f"SELECT n, 2000 * i + 60, 'Số 5 + 6 Ngày 1 tháng 2 năm 2020' FROM {articles} AS a WHERE (n + i) % 7 = 0",
        f"SELECT n, 2000 * i + 90, 'Chương II TIẾP' FROM {articles} AS a WHERE i = 2",
        f"SELECT n, 2000 * m + 80, 'điều khoản cuối./. TM. CHÍNH PHỦ ký' FROM {d} AS d WHERE n % 5 = 0 AND m <> 2",
        f"SELECT n, 90000, 'Nơi nhận:' FROM {d} AS d WHERE n % 2 = 0",
        f"SELECT n, 90001, '- Như trên' FROM {d} AS d WHERE n % 2 = 0",
        f"SELECT n, 91000 + 1000 * a, concat('PHỤ LỤC ', a) FROM {attachments} AS a",
        f"SELECT n, 91001 + 1000 * a, concat('Danh mục ', a) FROM {attachments} AS a",
        f"SELECT n, 91000 + 1000 * a + 10 * f, concat('Mẫu số 0', f) FROM {forms} AS f",
        f"SELECT n, 91001 + 1000 * a + 10 * f, 'Điều 1. .....' FROM {forms} AS f",
        f"SELECT n, 91002 + 1000 * a + 10 * f, 'ghi chú' FROM {forms} AS f",
    ]
    return " UNION ALL ".join(parts)


def _duck(rows: str, most: str, name: str) -> str:
    return f"{rows} AS r, unnest(range(1, {most} + 1)) AS g({name})"


def _spark(rows: str, most: str, name: str) -> str:
    return f"{rows} AS r LATERAL VIEW explode(filter(sequence(0, cast({most} AS int)), x -> x > 0)) g AS {name}"


def planted_text(n: Column, copies: Column) -> Column:
    """The text that planted() deals out in lines, of an order whose number comes so many times."""
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    upto = lambda most: F.filter(F.sequence(F.lit(0), most.cast("int")), lambda x: x > 0)
    m = n % 4 + 2
    final = lambda when: F.when(when & (n % 5 == 0) & (m != 2), F.lit("điều khoản cuối./. TM. CHÍNH PHỦ ký"))

    def article(i: Column) -> Column:
        lines = F.concat_ws(
            "\n", say("Điều ", i, ". Tên ", i), say("1. Khoản một của ", i, "  "), F.when((n + i) % 3 > 0, F.lit("2. Khoản")), F.when((n + i) % 3 > 1, F.lit("3. Khoản")), F.when((n + i) % 4 == 0, F.lit("")),
            F.when((n + i) % 5 == 0, say("Điều ", i + 1, ". Trích dẫn\nnội dung trích")), F.when((n + i) % 7 == 0, F.lit("Số 5 + 6 Ngày 1 tháng 2 năm 2020")), F.when(i == 2, F.lit("Chương II TIẾP")), final(i == m),
        )
        return F.when(~((n % 11 == 0) & (i == 2)), lines)

    def attachment(a: Column) -> Column:
        forms = F.transform(upto(n % 2 + a % 2), lambda f: say("Mẫu số 0", f, "\nĐiều 1. .....\nghi chú"))
        return F.concat_ws("\n", say("PHỤ LỤC ", a), say("Danh mục ", a), forms)

    # Of a number below zero the line that stands behind the last article comes before them.
    text = F.concat_ws(
        "\n", final(m < 0), F.lit("CỘNG HÒA"), F.when(n % 3 == 0, F.transform(upto(m), lambda i: say("Điều ", i, ". Tên ", i, " ....."))), final(m == 0), F.lit("Chương I QUY ĐỊNH"), F.transform(upto(m), article),
        F.when(n % 2 == 0, F.lit("Nơi nhận:\n- Như trên")), F.transform(upto(n % 3), attachment),
    )
    again = F.array_join(F.flatten(F.transform(F.split(text, "\n", -1), lambda x: F.array_repeat(x, copies.cast("int")))), "\n")
    return F.when(copies > 1, again).otherwise(text)


#: Orders of a task: what their documents' lines take stays in memory.
AT_ONCE = 50_000


def planted_docs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text) and the articles that they need (doc_id, no). Only orders' numbers are dealt out; texts are
    made of them where they are asked for."""
    numbers = table(spark, sf, "orders").where("o_orderkey is not null").select(F.col("o_orderkey").alias("doc_id"))
    # As many as other shuffles have at least, or Spark deals lines out anew to join them with what those make.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, -(-numbers.count() // AT_ONCE))
    dealt = numbers.repartition(tasks, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies"))
    return dealt.select("doc_id", planted_text(F.col("doc_id"), F.col("copies")).alias("text")), dealt.select("doc_id", F.explode(F.expr("sequence(1, cast(doc_id % 4 + 2 as int))")).alias("no"))


LINES_SQL = f"""l AS MATERIALIZED (SELECT n, p, line, CAST(row_number() OVER (PARTITION BY n ORDER BY p) - 1 AS INTEGER) AS pos FROM ({planted(_duck, "orders")})),
h AS MATERIALIZED (SELECT n, pos, CAST(regexp_extract(line, '^Điều (\\d+)\\.', 1) AS BIGINT) AS no, trim(regexp_extract(line, '^Điều \\d+\\.(.*)$', 1)) AS title FROM l WHERE line LIKE 'Điều %'),
d AS (SELECT n, n % 4 + 2 AS m, max(pos) + 1 AS size FROM l GROUP BY n),
nx AS MATERIALIZED (SELECT a.n, a.pos, a.no, min(b.pos) FILTER (b.no = a.no + 1) AS nxt, min(b.pos) AS nany FROM h a LEFT JOIN h b ON a.n = b.n AND b.pos > a.pos GROUP BY ALL),
e AS MATERIALIZED (SELECT x.n, x.pos, x.no, x.nxt, trim(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos), ''), ' ' || chr(10)) AS body, count(*) FILTER (regexp_matches(l.line, '^\\d{{1,3}}\\. ')) AS c FROM nx x JOIN d USING (n) LEFT JOIN l ON l.n = x.n AND l.pos > x.pos AND l.pos < CASE WHEN x.no < d.m THEN x.nxt ELSE coalesce(x.nany, d.size) END GROUP BY ALL),
ch AS (SELECT n, pos AS start, no, nxt, [pos] AS path, body = '' AS empty, c, length(body) AS size, (length(body) - length(replace(body, '.....', ''))) // 5 AS dots FROM e WHERE no = 1
  UNION ALL SELECT ch.n, start, e.no, e.nxt, list_append(path, e.pos), empty OR body = '', ch.c + e.c, size + length(body), dots + (length(body) - length(replace(body, '.....', ''))) // 5 FROM ch JOIN e ON e.n = ch.n AND e.pos = ch.nxt AND e.no = ch.no + 1),
best AS MATERIALIZED (SELECT n, path FROM ch JOIN d USING (n) WHERE no = m QUALIFY row_number() OVER (PARTITION BY n ORDER BY empty, c DESC, greatest(0, ch.size - 5 * dots) DESC, start) = 1),
main AS MATERIALIZED (SELECT n, unnest(path) AS pos FROM best UNION ALL SELECT n, min(pos) FROM h JOIN d USING (n) WHERE no <= m AND n NOT IN (SELECT n FROM best) GROUP BY n, no)"""


@query("main_sequence", f"WITH RECURSIVE {LINES_SQL} SELECT n AS doc_id, no, title, pos FROM main JOIN h USING (n, pos)")
def main_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """The articles' own headings among tables of contents, quotations and forms."""
    docs, needed = planted_docs(spark, sf)
    return P.main_sequence(docs, needed)


@query(
    "appendix_containers",
    f"""WITH RECURSIVE {LINES_SQL},
fin AS (SELECT n, max(pos) AS last FROM main GROUP BY n),
k AS (SELECT l.n, l.pos, line, CASE WHEN main.pos IS NOT NULL THEN 'article' WHEN l.pos > last AND line LIKE 'PHỤ LỤC %' THEN 'attachment' WHEN l.pos > last AND line = 'Nơi nhận:' THEN 'tail' WHEN l.pos > last AND line LIKE 'Mẫu số %' THEN 'form' WHEN line LIKE 'Chương %' THEN 'chapter' WHEN l.pos > last AND line LIKE 'Điều %' AND p > 91000 THEN 'article' END AS kind, lead(line) OVER (PARTITION BY l.n ORDER BY l.pos) AS ahead FROM l JOIN fin USING (n) LEFT JOIN main ON main.n = l.n AND main.pos = l.pos),
b AS MATERIALIZED (SELECT n, pos, line, kind, ahead, CASE kind WHEN 'attachment' THEN 1 WHEN 'tail' THEN 1 WHEN 'form' THEN 2 WHEN 'chapter' THEN 3 ELSE 4 END AS level FROM k WHERE kind IS NOT NULL),
f AS MATERIALIZED (SELECT b.n, b.pos, b.line, b.kind, b.ahead, b.level, coalesce(min(o.pos) FILTER (o.pos > b.pos AND o.level <= b.level), any_value(d.size)) AS end_pos, max(o.pos) FILTER (o.pos < b.pos AND o.level < b.level) AS up FROM b JOIN d USING (n) LEFT JOIN b o ON o.n = b.n GROUP BY ALL),
g AS MATERIALIZED (SELECT *, CASE kind WHEN 'attachment' THEN string_split(line, ' ')[3] WHEN 'form' THEN string_split(line, ' ')[3] WHEN 'tail' THEN NULL ELSE rtrim(string_split(line, ' ')[2], '.') END AS number, row_number() OVER (PARTITION BY n, kind ORDER BY pos) AS place FROM f),
i AS MATERIALIZED (SELECT *, concat(kind, '=', CASE WHEN kind = 'attachment' THEN CAST(place AS VARCHAR) ELSE coalesce(number, CAST(place AS VARCHAR)) END) AS label FROM g),
j AS MATERIALIZED (SELECT *, concat(label, CASE WHEN row_number() OVER (PARTITION BY n, up, label ORDER BY pos) > 1 THEN concat('~', row_number() OVER (PARTITION BY n, up, label ORDER BY pos)) ELSE '' END) AS own FROM i),
t AS (SELECT n, pos, concat(n, '|', own) AS id, 1 AS depth FROM j WHERE up IS NULL UNION ALL SELECT j.n, j.pos, concat(t.id, '|', j.own), depth + 1 FROM t JOIN j ON j.n = t.n AND j.up = t.pos)
SELECT j.n AS doc_id, t.id AS container_id, kind, number, line AS title, CASE WHEN kind = 'attachment' THEN ahead END AS subtitle, j.pos AS first_pos, end_pos, u.id AS parent_id, t.depth AS depth FROM j JOIN t ON t.n = j.n AND t.pos = j.pos LEFT JOIN t u ON u.n = j.n AND u.pos = j.up""",
)
def appendix_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Attachments, forms, chapters and articles, one within the other."""
    docs, needed = planted_docs(spark, sf)
    return P.text_containers(docs, P.main_sequence(docs, needed))


@query(
    "built_articles",
    f"""WITH RECURSIVE {LINES_SQL},
o AS (SELECT l.*, max(main.pos) OVER (PARTITION BY l.n ORDER BY l.pos) AS art, max(main.pos) OVER (PARTITION BY l.n) AS fin FROM l LEFT JOIN main ON main.n = l.n AND main.pos = l.pos),
s AS (SELECT n, art, min(pos) AS stop FROM o WHERE pos > art AND (line LIKE 'Chương %' OR art = fin AND (line = 'Nơi nhận:' OR line LIKE 'PHỤ LỤC %' OR line LIKE 'Mẫu số %' OR line LIKE 'Điều %')) GROUP BY n, art),
r AS (SELECT n, art, trim(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (pos > art AND line NOT LIKE 'Số 5 + 6%'), ''), ' ' || chr(10)) AS body, max(pos) + 1 AS end_pos FROM o LEFT JOIN s USING (n, art) WHERE art IS NOT NULL AND (stop IS NULL OR pos < stop) GROUP BY n, art),
t AS (SELECT n, art, min(pos) AS tail_pos FROM o WHERE art = fin AND pos > art AND line = 'Nơi nhận:' GROUP BY n, art)
SELECT r.n AS doc_id, no, title, concat('Điều ', no, '. ', title) AS heading, regexp_replace(body, '/\\. TM\\. CHÍNH PHỦ.*$', '/.', 's') AS body, r.art AS first_pos, end_pos, tail_pos FROM r JOIN h ON h.n = r.n AND h.pos = r.art LEFT JOIN t ON t.n = r.n AND t.art = r.art""",
)
def built_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles with their bodies, cut clear of chapters, page lines and the administrative tail."""
    docs, needed = planted_docs(spark, sf)
    return P.built_articles(docs, needed)
