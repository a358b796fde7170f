"""The parser of legal documents, on lines: the main sequence of articles among headings that come more than once, nested
containers (attachments, forms, chapters, articles), and articles with their bodies.

A text is cut where it is read, before its headings or into the lines that may open a container, and only those are dealt
out, never all lines; where the documents come dealt out by their key, nothing of them is. Chains of headings are followed
for all documents of a batch at once. Windows that look ahead are ordered backwards, for Spark grows those row by row.

Defined cases: null and empty texts have no lines; a heading without a body counts as empty; a document that lacks a needed
article has no whole chain, its first heading of each number counts; ties between chains go to the one that begins first;
a number beyond 64 bits is none that is needed, but its line is a heading.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What begins an article, a clause, a chapter or section, an attachment, a form; placeholder dots; what begins
# the administrative tail, alone in a line or behind the last sentence; lines that only a printed page has.
ARTICLE = r"^Điều\s+(\d+)\s*[.．]\s*(.*?)$"
CLAUSE = r"^\d{1,3}\.(\s|$)"
CHAPTER = r"(?iu)^(?:Chương|Mục)\s+([IVXLCDM]+|\d+[A-Za-zĐđ]?)(?:$|[.．:].*|\s.*)$"
ATTACHMENT = r"(?iu)^PHỤ\s+LỤC(?:\s+([IVXLCDM]+|\d+))?[.\s:]*$"
FORM = r"(?iu)^Mẫu\s+số\s+(\d+[a-zA-Z]?)$"
DOTS = "....."
TAIL = r"^(?:\s*(?iu:Nơi\s+nhận)\s*:\s*$|VĂN PHÒNG QUỐC HỘI$|TM\.\s*CHÍNH PHỦ(?:\s|$)|(?:(?:KT\.|TL\.|TUQ\.)\s*)?BỘ TRƯỞNG(?:\s|$))"
INLINE_TAIL = r"(?iu)^(.*?/\.)\s*(?:(?:TM|KT|TL|TUQ)\.\s*)?(?:CHÍNH PHỦ|BỘ TRƯỞNG)(?:\s.*|[A-ZÀ-ỸĐ].*|)$"
PAGE_ARTIFACT = r"(?iu)^(?:\(Xem tiếp theo Công báo số\s+\d+(?:\s*\+\s*\d+)?\)|Số\s+\d+(?:\s*\+\s*\d+)?\s*Ngày\s+\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4})$"
#: Containers close those of their level and of deeper ones.
LEVELS = {"attachment": 1, "tail": 1, "form": 2, "chapter": 3, "article": 4}


def text_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line) of all lines, blank ones too, as they stand."""
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def _ahead(value: Column, *parts: str) -> Column:
    """The nearest value behind a row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*parts).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1))


def _segments(text: Column) -> Column:
    """A text cut before each line that may be an article's heading: of each segment its lines and length, whether its first
    line is a heading, of which number and title, clauses and dots behind that line and dots in it, where the first character
    behind that line stands that isn't blank (-1: none), and where the last one of all ends."""

    dots = lambda t: ((F.length(t) - F.length(F.replace(t, F.lit(DOTS)))) / len(DOTS)).cast("long")

    def parts(s: Column) -> Column:
        top = F.substring_index(s, "\n", 1)
        return F.struct(s.alias("all"), top.alias("top"), F.length(s).cast("long").alias("length"), top.rlike(ARTICLE).alias("is_head"), F.length(F.regexp_replace(F.substr(s, F.length(top) + 2), r"^\s+", "")).cast("long").alias("filled"))

    def of(x: Column) -> Column:
        s, top, is_head = x["all"], x["top"], x["is_head"]
        return F.struct(
            (x["length"] - F.length(F.replace(s, F.lit("\n")))).cast("long").alias("lines"), x["length"].alias("length"), is_head.alias("is_head"),
            F.when(is_head, F.regexp_extract(top, ARTICLE, 1).try_cast("bigint")).alias("no"), F.when(is_head, F.trim(F.regexp_extract(top, ARTICLE, 2))).alias("title"),
            F.size(F.regexp_extract_all(s, F.lit(r"\n\d{1,3}\.(?=\s|[\u0085\u2028\u2029]?(?:\n|$))"), F.lit(0))).cast("long").alias("clauses"), dots(s).alias("dots"), dots(top).alias("own_dots"),
            F.when(x["filled"] > 0, x["length"] - x["filled"]).otherwise(-1).alias("first"), F.length(F.regexp_replace(s, r"\s+$", "")).cast("long").alias("last"),
        )

    # What is asked for more than once is made in a step of its own, for Spark works out a function's body as it stands.
    return F.transform(F.transform(F.split(text, r"(?<=\n)(?=Điều\s)", -1), parts), of)


def _chosen(seg: dict[str, np.ndarray], doc: np.ndarray, end: np.ndarray, need: np.ndarray, need_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments that begin with a heading of the main sequence, in order; where each line and character count begins. `seg`:
    fields of all segments of a batch, `doc`: the document of each, `end`: where a document's segments end, `need`: the
    needed numbers in order of documents and numbers, `need_at`: where those of a document begin.

    A heading is linked to the next one of the next needed number; links are doubled until they reach the last number."""
    begin = lambda x: np.append(0, np.cumsum(x))
    at, line, clauses, dots = (begin(seg[c]) for c in ("length", "lines", "clauses", "dots"))
    none = np.empty(0, np.int64)
    heads = np.flatnonzero(seg["is_head"])
    known = heads[seg["known"][heads]]
    if not len(known) or not len(need):
        return none, line, at
    # A level is the place of (document, number) among all that are needed; levels of a document follow one another.
    values, code = np.unique(np.concatenate([need, seg["no"][known]]), return_inverse=True)
    wanted = np.repeat(np.arange(len(end)), np.diff(need_at)) * len(values) + code[: len(need)]
    asked = doc[known] * len(values) + code[len(need) :]
    level = np.minimum(np.searchsorted(wanted, asked), len(wanted) - 1)
    node, level = known[wanted[level] == asked], level[wanted[level] == asked]
    if not len(node):
        return none, line, at
    order = np.lexsort((node, level))
    node, level, own = node[order], level[order], doc[node[order]]
    last = level == need_at[own + 1] - 1
    width = len(doc) + 1
    following = np.searchsorted(level * width + node, (level + 1) * width + node)
    linked = np.minimum(following, len(node) - 1)
    linked = np.where(~last & (following < len(node)) & (level[linked] == level + 1), linked, -2)
    # The last article ends at the next heading of any number, or with its document.
    after = np.append(heads, len(doc))[np.searchsorted(heads, node, "right")]
    to = np.where(last, np.minimum(after, end[own]), np.where(linked >= 0, node[np.maximum(linked, 0)], node + 1))
    first = np.where(seg["first"][node] >= 0, at[node] + seg["first"][node], at[node + 1])
    some = first < at[to]
    size = np.where(some, at[to - 1] + seg["last"][to - 1] - first, 0)
    sums = np.array([~some, clauses[to] - clauses[node], size, dots[to] - dots[node] - seg["own_dots"][node]], np.int64)
    jump = np.where(last, -1, linked)
    while (far := np.flatnonzero(jump >= 0)).size:
        over = jump[far]
        sums[:, far] += sums[:, over]
        jump[far] = jump[over]
    start = np.flatnonzero((level == need_at[own]) & (jump == -1))
    empty, n_clauses, chars, n_dots = sums[:, start]
    start = start[np.lexsort((-node[start], np.maximum(0, chars - len(DOTS) * n_dots), n_clauses, empty == 0, own[start]))]
    now = start[np.append(own[start][1:] != own[start][:-1], True)] if len(start) else start
    whole = np.zeros(len(end), bool)
    whole[own[now]] = True
    took = np.zeros(len(node), bool)
    took[np.append(True, level[1:] != level[:-1]) & ~whole[own]] = True
    while len(now):
        took[now] = True
        now = linked[now]
        now = now[now >= 0]
    return np.sort(node[took]), line, at


def _main(docs: DataFrame, needed: DataFrame, key: str, text: str, cut: bool = False) -> DataFrame:
    """(key, main): of every document the headings that make up its articles, in order: no, title, pos, and if `cut`, the
    text from the heading to the next of them or the document's end, and whether it is the last."""
    asked = needed.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_set(F.col("no").cast("bigint"))).alias("need"))
    own = [key, _segments(F.col(text)).alias("segments")] + ([F.col(text).alias("text")] if cut else [])
    # Spark takes the needed numbers for as few as their file is small; without the hint it may send all through the driver.
    rows = docs.select(*own).join(asked.hint("merge"), F.col(key) == F.col("_key")).drop("_key")

    def choose(batches):
        for b in batches:
            lists, need = b.column("segments"), b.column("need")
            n, needs = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), need.value_lengths().to_numpy(zero_copy_only=False)
            flat, doc, end = lists.flatten(), np.repeat(np.arange(b.num_rows), n), np.cumsum(n)
            field = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
            seg = {c: x.fill_null(0 if c == "no" else False if c == "is_head" else -1).to_numpy(zero_copy_only=False) for c, x in field.items() if c != "title"}
            seg["known"] = field["no"].is_valid().to_numpy(zero_copy_only=False)
            main, line, at = _chosen(seg, doc, end, need.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(needs)))
            own = doc[main]
            begin = (end - n)[own]
            took = {"no": field["no"].take(pa.array(main)), "title": field["title"].take(pa.array(main)), "pos": pa.array((line[main] - line[begin]).astype(np.int32))}
            if cut:
                last = np.append(own[1:] != own[:-1], True)[: len(own)]
                # Without the line feed before the next heading.
                stop = np.where(last, at[end[own]], np.append(at[main], 0)[1:] - 1)
                column = b.column("text")
                texts = {d: column[d].as_py() for d in np.unique(own).tolist()}
                took["cut"] = pa.array([texts[d][x:z] for d, x, z in zip(own.tolist(), (at[main] - at[begin]).tolist(), (stop - at[begin]).tolist(), strict=True)], pa.string())
                took["last"] = pa.array(last)
            ends = np.append(0, np.cumsum(np.bincount(own, minlength=b.num_rows))).astype(np.int32)
            each = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(took.values()), list(took)))
            yield pa.RecordBatch.from_arrays([b.column(key), each], [key, "main"])

    more = ",cut:string,last:boolean" if cut else ""
    return rows.mapInArrow(choose, f"{key} {docs.schema[key].dataType.simpleString()}, main array<struct<no:bigint,title:string,pos:int{more}>>")


def main_sequence(docs: DataFrame, needed: DataFrame, where: str = "", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, no, title, pos) of the headings that make up a document's articles. needed: key, no. Nothing is written `where`.

    Chains begin at each heading of the first needed number and go on with the next heading of each further number. A
    chain's score: no article is empty; then clauses; then characters, less the dots of forms. Chains that meet share their
    further way, so scores are summed along links that reach twice as far in each round.
    """
    return _main(docs, needed, key, text).select(key, F.inline("main"))


#: What a line that opens a container has, once its blank ends are off.
OPENING = (ATTACHMENT, TAIL, FORM, CHAPTER, ARTICLE)


def _opens(line: Column) -> Column:
    out = line.rlike(OPENING[0])
    for p in OPENING[1:]:
        out |= line.rlike(p)
    return out


def openings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line, following, n_lines) of the lines that may open a container, without blank ends: behind an attachment
    the next line that isn't blank with its place, and the number of the document's lines. Nothing is dealt out."""
    lines = docs.where(F.col(key).isNotNull()).select(key, F.split(text, "\n", -1).alias("lines"))
    full = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("pos"), F.regexp_replace(x, r"^\s+|\s+$", "").alias("line"))), lambda x: x["line"] != "")
    rows = lines.select(key, F.size("lines").alias("n_lines"), full.alias("full"))
    rows = rows.select(key, "n_lines", F.explode(F.arrays_zip(F.col("full").alias("own"), F.slice("full", 2, F.greatest(F.size("full"), F.lit(1))).alias("next"))).alias("x"))
    rows = rows.select(key, F.col("x.own.pos").alias("pos"), F.col("x.own.line").alias("line"), F.col("x.next").alias("following"), "n_lines")
    return _only_openings(rows)


def _only_openings(rows: DataFrame) -> DataFrame:
    return rows.where(_opens(F.col("line"))).withColumn("following", F.when(F.col("line").rlike(ATTACHMENT), F.col("following")))


def _openings_of(lines: DataFrame, key: str) -> DataFrame:
    """The same of lines that are rows already."""
    by_pos, all_ = Window.partitionBy(key).orderBy("pos"), Window.partitionBy(key)
    rows = lines.where(F.col(key).isNotNull()).select(key, "pos", F.regexp_replace("line", r"^\s+|\s+$", "").alias("line"), (F.max("pos").over(all_) + 1).alias("n_lines")).where("line != ''")
    return _only_openings(rows.select(key, "pos", "line", F.lead(F.struct("pos", "line")).over(by_pos).alias("following"), "n_lines"))


def _kinds(rows: DataFrame, main: DataFrame, key: str) -> DataFrame:
    """Openings with the container that they open, if any: up to the last article of the main sequence only chapters and its
    articles; behind it attachments and the tail, forms in attachments, and what stands in those."""
    by_pos = Window.partitionBy(key).orderBy("pos")
    own = main.groupBy(F.col(key).alias("_key")).agg(F.collect_set("pos").alias("own"))
    rows = rows.join(own.hint("merge"), F.col(key) == F.col("_key"), "left").drop("_key")
    rows = rows.withColumns({"main": F.when(F.array_contains("own", F.col("pos")), True), "behind": F.col("pos") > F.coalesce(F.array_max("own"), F.lit(-1))}).drop("own")
    found = F.when(F.col("main"), "article").when(F.col("behind") & F.col("line").rlike(ATTACHMENT), "attachment").when(F.col("behind") & F.col("line").rlike(TAIL), "tail").when(F.col("behind") & F.col("line").rlike(FORM), "form").when(F.col("line").rlike(CHAPTER), "chapter").when(F.col("behind") & F.col("line").rlike(ARTICLE), "article")
    rows = rows.withColumn("kind", found).withColumn("top", F.last(F.when(F.col("kind").isin("attachment", "tail"), F.col("kind")), ignorenulls=True).over(by_pos))
    fits = F.col("kind").isin("attachment", "tail") | F.col("top").isNull() & (F.col("kind") != "form") | (F.col("top") == "attachment")
    # Behind the last article of the body an article is one of an attachment.
    fits &= ~((F.col("kind") == "article") & F.col("main").isNull() & F.col("top").isNull())
    rows = rows.withColumn("kind", F.when(fits, F.col("kind")))
    level = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in LEVELS.items()))
    number = F.coalesce(*(F.when(F.col("kind") == k, F.regexp_extract("line", p, 1)) for k, p in (("attachment", ATTACHMENT), ("form", FORM), ("chapter", CHAPTER), ("article", ARTICLE))))
    return rows.withColumns({"level": level, "number": F.when(number != "", number)}).drop("main", "behind", "top")


def containers(lines: DataFrame, main: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, container_id, kind, number, title, subtitle, first_pos, end_pos, parent_id, depth) of a document's containers.

    A container holds from its line to the next one of its level or of an outer level; those that it holds lie within. An
    attachment's number in its id is its place among the document's; other ids tell repeated labels of one parent apart.
    Places of the main sequence are those of article headings.
    """
    return _nested(_openings_of(lines, key), main, key)


def text_containers(docs: DataFrame, main: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The containers of texts, whose lines aren't dealt out but for those that may open one."""
    return _nested(openings(docs, key, text), main, key)


def _nested(rows: DataFrame, main: DataFrame, key: str) -> DataFrame:
    rows = _kinds(rows, main, key)
    by_pos = Window.partitionBy(key).orderBy("pos")
    before = by_pos.rowsBetween(Window.unboundedPreceding, -1)
    ahead, following = F.lead(F.struct("pos", "kind")).over(by_pos), F.col("following")
    closes = F.coalesce((ahead["pos"] == following["pos"]) & ahead["kind"].isin("attachment", "tail"), F.lit(False))
    rows = rows.withColumn("subtitle", F.when((F.col("kind") == "attachment") & ~closes, following["line"])).drop("following")
    rows = rows.where("kind is not null")
    deepest = max(LEVELS.values())
    of_level = lambda pick, value: F.coalesce(*(F.when(F.col("level") == n, pick(value(n))) for n in range(1, deepest + 1)))
    end = of_level(lambda v: _ahead(v, key), lambda n: F.when(F.col("level") <= n, F.col("pos")))
    parent = of_level(lambda v: F.last(v, ignorenulls=True).over(before), lambda n: F.when(F.col("level") < n, F.col("pos")))
    rows = rows.withColumns({"end_pos": F.coalesce(end, F.col("n_lines")), "parent_pos": parent})
    # A parent that has ended before isn't one: outer levels close what lies deeper, so only the last outer one can be.
    place = F.row_number().over(Window.partitionBy(key, "kind").orderBy("pos"))
    label = F.when(F.col("kind") == "attachment", place.cast("string")).otherwise(F.coalesce("number", place.cast("string")))
    again = F.row_number().over(Window.partitionBy(key, "parent_pos", "kind", "label").orderBy("pos"))
    rows = rows.withColumn("label", label).withColumn("label", F.concat("kind", F.lit("="), "label", F.when(again > 1, F.concat(F.lit("~"), again.cast("string"))).otherwise("")))
    # A container's parent is the last outer one before it, so ids of a level follow from those of the outer levels.
    rows = rows.withColumns({"container_id": F.lit(None).cast("string"), "parent_id": F.lit(None).cast("string")})
    for n in range(1, deepest + 1):
        over = F.last(F.when(F.col("level") < n, F.col("container_id")), ignorenulls=True).over(before)
        rows = rows.withColumn("parent_id", F.when(F.col("level") == n, over).otherwise(F.col("parent_id")))
        rows = rows.withColumn("container_id", F.when(F.col("level") == n, F.concat_ws("|", F.coalesce("parent_id", F.col(key).cast("string")), "label")).otherwise(F.col("container_id")))
    return rows.select(key, "container_id", "kind", "number", F.col("line").alias("title"), "subtitle", F.col("pos").alias("first_pos"), "end_pos", "parent_id", (F.size(F.split("container_id", r"\|")) - 1).alias("depth"))


def contained_lines(lines: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines with the id of the innermost container that holds each; null before the first."""
    opened = found.select(key, F.col("first_pos").alias("pos"), F.col("container_id").alias("opened"))
    last = F.last("opened", ignorenulls=True).over(Window.partitionBy(key).orderBy("pos"))
    return lines.join(opened, [key, "pos"], "left").withColumn("container_id", last).drop("opened")


def built_articles(docs: DataFrame, needed: DataFrame, where: str = "", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, no, title, heading, body, first_pos, end_pos, tail_pos) of the articles of the main sequence. Nothing is written
    `where`.

    A body ends at the next article of the sequence, the last one's at the first line behind it that begins the tail, an
    attachment, a form or another heading; it stops where a chapter begins, and is without lines that only pages have. A
    tail that is set behind the last sentence is cut off. tail_pos: where the document's tail begins, if it does.
    """
    rows = _main(docs, needed, key, text, cut=True).select(key, F.inline("main")).withColumnRenamed("pos", "first_pos")

    def marked(x: Column, i: Column) -> Column:
        bare, inside = x["bare"], i > 0
        outer = bare.rlike(TAIL) | bare.rlike(ATTACHMENT) | bare.rlike(FORM) | bare.rlike(ARTICLE)
        return F.struct(x["line"].alias("line"), (inside & (bare.rlike(CHAPTER) | F.col("last") & outer)).alias("stops"), (inside & F.col("last") & bare.rlike(TAIL)).alias("tail"), bare.rlike(PAGE_ARTIFACT).alias("page"))

    lines = F.transform(F.split("cut", "\n", -1), lambda x: F.struct(x.alias("line"), F.regexp_replace(x, r"^\s+|\s+$", "").alias("bare")))
    rows = rows.withColumn("lines", F.transform(lines, marked)).drop("cut", "last")
    place = lambda name: F.nullif(F.array_position(F.transform("lines", lambda x: x[name]), True), F.lit(0))
    rows = rows.withColumns({"size": (F.coalesce(place("stops"), F.size("lines") + 1) - 1).cast("int"), "tail_pos": (F.col("first_pos") + place("tail") - 1).cast("int")})
    own = F.filter(F.slice("lines", F.lit(2), F.col("size") - 1), lambda x: ~x["page"])
    joined = F.regexp_replace(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    cut = F.when(F.col("joined").contains("/."), F.regexp_extract("joined", "(?s)" + INLINE_TAIL, 1))
    rows = rows.select(key, "no", "title", joined.alias("joined"), "first_pos", (F.col("first_pos") + F.col("size")).alias("end_pos"), "tail_pos")
    body = F.when(cut != "", cut).otherwise(F.col("joined"))
    return rows.select(key, "no", "title", F.concat(F.lit("Điều "), F.col("no").cast("string"), F.lit(". "), "title").alias("heading"), body.alias("body"), "first_pos", "end_pos", "tail_pos")
