"""Token-bounded chunks of structured text. A document is cut where it is read; nothing is shuffled.

A ruler knows where a text's tokens lie, so that how far a budget reaches from any place is a search among offsets, and
no part of a text is counted twice. Cuts are chosen among boundaries that are listed once for a whole text.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import estimated_tokens, uuid5

#: Fixed value: the namespace that chunk ids are derived in.
NAMESPACE = uuid.UUID("c3c8cf32-8418-4903-8d01-e28bb7c040d3")
SEPARATORS = ("\n\n", "\n", ". ", "; ", ", ", " ")
WORDS = re.compile(r"\w+|[^\w\s]")
# Where a text may be cut, from strongest to weakest (blanks come after these), and marks that open a unit.
SENTENCE = r"[.!?]+[\"'”’)]*(?=\s|$)"
SEMICOLON = r";(?=\s|$)"
COMMA = r",(?=\s|$)"
LEADING_MARK = re.compile(r"\s*(?:\d+[a-zA-ZđĐ]?|[a-zA-ZđĐ]\d*)[.)]\s+")
OPENING_END = re.compile(r"[:;]|[.!?](?=\s|$)")
#: Marks that open a part belong to the end of the one before.
STRAY = re.compile(r"[\s:;.,]*")
BLANKS, WORD = re.compile(r"\s*"), re.compile(r"\S+")
CLAUSE, POINT = re.compile(r"(\d+[a-zA-ZđĐ]?)\.\s+\S"), re.compile(r"([a-zđ])\)\s+\S")
SUBPOINT = re.compile(r"(?:^|(?<=[\n;:]))\s*(?=[a-zđĐ]\d+\))")
#: Characters of the context that leads the parts of a split point.
CONTEXT = 320
Counter = Callable[[str], int]


def estimated(text: str) -> int:
    """Words and marks times 1.3, rounded down."""
    return int(len(WORDS.findall(text)) * 1.3)


class Ruler:
    """Offsets of a text's tokens, for counts that are tokens times a factor, rounded down."""

    factor = 1.3

    def __init__(self, text: str):
        spans = [m.span() for m in WORDS.finditer(text)]
        self.length = len(text)
        self.starts, self.ends = [a for a, _ in spans], [z for _, z in spans]

    def tokens(self, budget: int) -> int:
        """The most tokens that a budget covers."""
        n = int((budget + 1) / self.factor) + 1
        while n > 0 and int(n * self.factor) > budget:
            n -= 1
        return n

    def reach(self, begin: int, budget: int) -> int:
        """The furthest end of what begins here and keeps to the budget."""
        past = bisect_right(self.ends, begin) + self.tokens(budget)
        return self.starts[past] if past < len(self.starts) else self.length

    def back(self, end: int, budget: int) -> int:
        """The earliest begin of what ends here and keeps to the budget."""
        before = bisect_left(self.starts, end) - self.tokens(budget) - 1
        return self.ends[before] if before >= 0 else 0


def ruler_for(count: Counter) -> Callable[[str], Ruler]:
    """Rulers of any count of tokens that doesn't fall as a text grows."""
    if count is estimated:
        return Ruler

    class Counted(Ruler):
        def __init__(self, text: str):
            self.text, self.length = text, len(text)

        def reach(self, begin: int, budget: int) -> int:
            return begin + bisect_right(range(1, self.length - begin + 1), budget, key=lambda n: count(self.text[begin : begin + n]))

        def back(self, end: int, budget: int) -> int:
            return end - bisect_right(range(1, end + 1), budget, key=lambda n: count(self.text[end - n : end]))

    return Counted


def last_mark(marks: Sequence[int], low: int, high: int) -> int | None:
    """The last of the marks from low to high."""
    i = bisect_right(marks, high)
    return marks[i - 1] if i and marks[i - 1] >= low else None


def split_recursive(text: str, size: int, overlap: int = 0, count: Counter = estimated, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Parts of at most `size` tokens, cut behind the strongest separator in the last two thirds of what fits; each part
    begins with up to `overlap` tokens of the one before."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("sizes are positive and overlaps smaller")
    body = text.strip()
    ruler = ruler_for(count)(body)
    marks = [(len(s), [m.start() + len(s) for m in re.finditer(f"(?={re.escape(s)})", body)]) for s in separators]
    parts: list[str] = []
    begin = 0
    while begin < len(body):
        end = max(begin + 1, ruler.reach(begin, size))
        if end < len(body):
            least = begin + max(1, (end - begin) // 3)
            cuts = (last_mark(m, least + width, end) for width, m in marks)
            cut = next((c for c in cuts if c is not None and body[begin:c].strip()), end)
        else:
            cut = end
        parts.append(body[begin:cut].strip())
        if cut == len(body):
            break
        again = ruler.back(cut, overlap) if overlap else cut
        begin = again if again > begin else cut
    return [p for p in parts if p]


def split_to_fit(text: str, budget: int, count: Counter = estimated) -> list[str]:
    """Parts without overlap, cut at the last sentence end within the budget, else semicolon, comma, blank; a word that
    alone is too long is cut by characters, or kept whole where the budget covers none. A mark like `1.` that opens a part
    is no sentence; stray marks that a cut leaves in front of a part end the part before."""
    body = text.strip()
    ruler = ruler_for(count)(body)
    marks = [[m.end() for m in re.finditer(p, body)] for p in (SENTENCE, SEMICOLON, COMMA)] + [[m.start() for m in re.finditer(r"\s+", body)]]
    parts: list[str] = []
    begin = 0
    while begin < len(body):
        end = ruler.reach(begin, budget)
        opened = LEADING_MARK.match(body, begin)
        least = [opened.end() + 1 if opened else begin + 1, begin + 1, begin + 1, begin + 1]
        cut = end if end == len(body) else next((c for m, low in zip(marks, least, strict=True) if (c := last_mark(m, low, end)) is not None), None)
        if cut is None:
            word = WORD.match(body, begin).end()
            cut = min(end, word) if end > begin else word
        shown = STRAY.match(body, begin, cut).end() if parts else begin
        if shown > begin:
            parts[-1] += body[begin:shown].rstrip()
        if shown < cut:
            parts.append(body[shown:cut].rstrip())
        begin = BLANKS.match(body, cut).end()
    return parts


def point_context(text: str, most: int = CONTEXT) -> str:
    """What leads the parts of a split point: its opening, up to the first colon, semicolon or sentence end behind its mark,
    or all of it where there is none. Of one longer than the bound the words within it, and a sign that it goes on."""
    text = text.strip()
    mark = LEADING_MARK.match(text)
    ends = [m.end() for m in OPENING_END.finditer(text, mark.end() if mark else 0)]
    opening = text[: ends[0]] if ends else text
    if len(opening) <= most:
        return opening
    kept, _, rest = text[:most].rstrip().rpartition(" ")
    return f"{(kept or rest).rstrip(' ,;:')} …"


def breadcrumb(parts: Sequence[tuple[str, str | None]]) -> str:
    """Labelled lines that lead every chunk of a document, empty ones left out."""
    return "\n".join(f"{label}: {value.strip()}" for label, value in parts if value and value.strip())


def rendered(lead: str, body: str) -> str:
    return f"{lead}\n\n{body}" if lead else body


def chunk_id(key: str) -> str:
    if not key or key.isspace():
        raise ValueError("a chunk key isn't blank")
    return str(uuid.uuid5(NAMESPACE, key))


def label_ranges(labels: list[str]) -> str:
    """Labels in order, runs of neighbouring letters as a range: a-c,e."""
    runs: list[list[str]] = []
    for x in labels:
        if runs and len(x) == 1 and len(runs[-1][-1]) == 1 and ord(x) == ord(runs[-1][-1]) + 1:
            runs[-1].append(x)
        else:
            runs.append([x])
    return ",".join(r[0] if len(r) == 1 else f"{r[0]}-{r[-1]}" for r in runs)


def structure(text: str) -> list[tuple[str | None, list[tuple[str | None, str]]]]:
    """Clauses (None: what comes before the first) with their points (None: the clause's own lines)."""
    clauses: list[tuple[str | None, list[tuple[str | None, str]]]] = []
    for line in filter(None, map(str.strip, text.split("\n"))):
        c, p = CLAUSE.match(line), POINT.match(line)
        if c or not clauses:
            clauses.append((c[1] if c else None, [(None, line)]))
        elif p:
            clauses[-1][1].append((p[1], line))
        else:
            label, body = clauses[-1][1][-1]
            clauses[-1][1][-1] = (label, f"{body}\n{line}")
    return clauses


def subpoints(text: str) -> list[str]:
    """A point cut before its marks like a1)."""
    return [p.strip() for p in SUBPOINT.split(text) if p.strip()]


def chunk_text(article: str, text: str, most: int, count: Counter = estimated, lead: str = "") -> Iterator[tuple[str, str, str]]:
    """(key, type, text) of a text's chunks: the whole, if it fits; else clauses, what comes before the first one joined to
    it where both fit; of a clause too long its points, packed greedily; of a point too long its subpoints, each behind the
    point's context, or else its parts. Lead lines count in the budget and stand before every chunk. A label that comes
    again is told apart by its occurrence."""
    whole = lambda t: rendered(lead, t)
    fits = lambda t: count(whole(t)) <= most
    text = text.strip()
    if not text:
        return
    if fits(text):
        yield f"{article}|article", "article", whole(text)
        return
    budget = max(0, most - count(lead) - (1 if lead else 0))

    def segments(key: str, body: str) -> Iterator[tuple[str, str, str]]:
        below = subpoints(body)
        if len(below) > 1:
            context = point_context(below[0])
            bodies = [below[0], *(f"{context}\n{x}" for x in below[1:])]
        else:
            bodies = below
        parts = [p for b in bodies for p in ([b] if fits(b) else split_to_fit(b, budget, count))]
        for i, part in enumerate(parts, 1):
            yield f"{key}|segment={i}", "fallback_segment", whole(part)

    def cut(key: str, kind: str, body: str) -> Iterator[tuple[str, str, str]]:
        if fits(body):
            yield key, kind, whole(body)
        else:
            yield from segments(key, body)

    clauses = structure(text)
    if len(clauses) > 1 and clauses[0][0] is None:
        joined = "\n".join(b for _, points in clauses[:2] for _, b in points)
        if fits(joined):
            clauses[:2] = [(clauses[1][0], [(None, joined)])]
    seen: dict[str, int] = {}
    for number, points in clauses:
        if number is None:
            key = f"{article}|preamble"
        else:
            seen[number] = seen.get(number, 0) + 1
            key = f"{article}|clause={number}" + (f"|occurrence={seen[number]}" if seen[number] > 1 else "")
        body = "\n".join(b for _, b in points)
        if fits(body) or len(points) == 1:
            yield from cut(key, "preamble" if number is None else "clause", body)
            continue
        used: dict[str, int] = {}
        for pack in packed([(x, b) for x, b in points], fits):
            labels = label_ranges([x for x, _ in pack if x]) or "lead"
            used[labels] = used.get(labels, 0) + 1
            own = f"{key}|points={labels}" + (f"|occurrence={used[labels]}" if used[labels] > 1 else "")
            yield from cut(own, "points", "\n".join(b for _, b in pack))


def packed(points: list[tuple[str | None, str]], fits: Callable[[str], bool]) -> Iterator[list[tuple[str | None, str]]]:
    """Points in runs that fit together."""
    run: list[tuple[str | None, str]] = []
    for point in points:
        if run and not fits("\n".join(b for _, b in [*run, point])):
            yield run
            run = []
        run.append(point)
    if run:
        yield run


def table_chunks(header: list[str], rows: list[list[str]], target: int, most: int, count: Counter = estimated, lead: str = "") -> list[tuple[str, tuple[str, ...]]]:
    """(text, warnings) of a table's chunks: groups of rows under the target, each behind the header. A row that is too long
    alone is cut between words. A header that is over the target leads single rows; one over the most is an error."""
    line = lambda row: " | ".join(c.strip() for c in row if c and c.strip())
    top = line(header)
    show = lambda body: rendered(lead, "\n".join(x for x in (top, *body) if x))
    size = lambda body: count(show(body))
    if size([]) > most:
        raise ValueError("the repeated header alone is over the most tokens")
    wide = size([]) > target
    lines = [x for x in map(line, rows) if x]
    out: list[tuple[str, tuple[str, ...]]] = []
    group: list[str] = []

    def close() -> None:
        if group:
            out.append((show(group), ()))
            group.clear()

    for row in lines:
        if size([*group, row]) <= target:
            group.append(row)
            continue
        close()
        if size([row]) <= target:
            group.append(row)
        elif wide and size([row]) <= most:
            out.append((show([row]), ("oversized_table_header_context",)))
        else:
            budget = (most if wide else target) - size([]) - 1
            for part in split_to_fit(row, max(1, budget), count):
                out.append((show([part]), ("oversized_table_row_split", *(("oversized_table_header_context",) if wide else ()))))
    close()
    return out or [(show([]), ())]


def chunk_documents(docs: DataFrame, most: int = 400, key: str = "doc_id", text: str = "text", count: Counter = estimated, lead: str | None = None) -> DataFrame:
    """(key, chunk_no, chunk_key, chunk_id, chunk_type, content, token_count) of every document; lead names a column of
    lines that stand before every chunk."""

    def cut(batches):
        for b in batches:
            rows = []
            for k, t, top in zip(b.column("k").to_pylist(), b.column("t").to_pylist(), b.column("l").to_pylist(), strict=True):
                rows += [(k, i, ck, chunk_id(ck), kind, body, count(body)) for i, (ck, kind, body) in enumerate(chunk_text(str(k), t or "", most, count, top or ""))]
            kinds = (b.schema.field("k").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [key, "chunk_no", "chunk_key", "chunk_id", "chunk_type", "content", "token_count"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), (F.col(lead) if lead else F.lit(None)).cast("string").alias("l"))
    return rows.mapInArrow(cut, f"{key} {rows.schema['k'].dataType.simpleString()}, chunk_no long, chunk_key string, chunk_id string, chunk_type string, content string, token_count long")


def split_documents(docs: DataFrame, size: int, overlap: int, key: str = "doc_id", text: str = "text", count: Counter = estimated) -> DataFrame:
    """(key, part_no, part) of every document by the recursive splitter."""

    def cut(batches):
        for b in batches:
            rows = [(k, i, p) for k, t in zip(b.column("k").to_pylist(), b.column("t").to_pylist(), strict=True) for i, p in enumerate(split_recursive(t or "", size, overlap, count))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((b.schema.field("k").type, pa.int64(), pa.string()))], [key, "part_no", "part"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(cut, f"{key} {rows.schema['k'].dataType.simpleString()}, part_no long, part string")


def summary(chunks: DataFrame, group: str = "chunk_type", tokens: str = "token_count") -> DataFrame:
    """Counts and token statistics by chunk type, and of all."""
    p95 = F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {tokens})").cast("long")
    stats = [F.count(F.lit(1)).alias("chunks"), F.min(tokens).alias("least"), F.max(tokens).alias("most"), F.round(F.avg(tokens), 6).alias("mean"), F.median(tokens).alias("median"), p95.alias("p95"), F.sum(tokens).alias("total")]
    return chunks.groupingSets([[], [group]], group).agg(*stats)


TYPES = ("article", "preamble", "clause", "points", "fallback_segment", "table")


def violations(chunks: DataFrame, docs: DataFrame, most: int, key: str = "doc_id", text: str = "text", lead: str | None = None) -> DataFrame:
    """(key, problem) of chunks that break the rules; an empty result is what is wanted. Ids and keys are distinct, and an
    id is its key's; keys begin with their document's and name nothing missing; types are known, and a whole article is its
    document's only chunk; texts aren't blank or padded, begin with their lead, have the stated tokens and at most `most`;
    chunks are numbered from 0 on, segments of a key from 1 on; a document's chunks make up its text, but for context that
    is repeated before subpoints; and every chunk has a document."""
    of = lambda name, rows: rows.select(key, F.lit(name).alias("problem"))
    own = F.col(key).cast("string")
    lines = docs.select(F.col(key).alias("of"), (F.col(lead) if lead else F.lit("")).alias("top"), F.col(text).alias("source"))
    with_docs = chunks.join(lines, F.col(key) == F.col("of"), "left")
    top = F.coalesce(F.col("top"), F.lit(""))
    tests = {
        "blank": F.trim("content") == "", "padded": F.col("content") != F.trim("content"), "too_long": F.col("token_count") > most, "wrong_token_count": F.col("token_count") != estimated_tokens(F.col("content")),
        "changed_id": F.col("chunk_id") != uuid5(str(NAMESPACE), F.col("chunk_key")), "none_in_key": F.col("chunk_key").contains("None") | F.col("chunk_key").contains("null"), "foreign_key": ~F.startswith("chunk_key", F.concat(own, F.lit("|"))),
        "unknown_type": ~F.coalesce(F.col("chunk_type").isin(*TYPES), F.lit(False)), "no_lead": (top != "") & ~F.startswith("content", F.concat(top, F.lit("\n\n"))), "no_document": F.col("of").isNull(),
    }
    each = with_docs.select(key, F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in tests.items())))).alias("problem"))
    twice = lambda column: of(f"repeated_{column.removeprefix('chunk_')}", chunks.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(column))).where("n > 1"))
    number = F.regexp_extract("chunk_key", r"\|segment=(\d+)$", 1)
    segments = chunks.where(number != "").groupBy(key, F.regexp_replace("chunk_key", r"\|segment=\d+$", "").alias("base")).agg(F.sort_array(F.collect_list(number.cast("int"))).alias("ns")).where(F.col("ns") != F.sequence(F.lit(1), F.size("ns")))
    counted = chunks.groupBy(key).agg(F.sort_array(F.collect_list("chunk_no")).alias("ns"), F.count_if(F.col("chunk_type") == "article").alias("articles"))
    gaps, extra = counted.where(F.col("ns") != F.transform(F.sequence(F.lit(1), F.size("ns")), lambda i: i.cast("long") - 1)), counted.where((F.col("articles") > 0) & (F.size("ns") > 1))
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    body = F.when(F.startswith("content", F.concat(top, F.lit("\n\n"))) & (top != ""), F.substr("content", F.length(top) + 3)).otherwise(F.col("content"))
    joined = with_docs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", body.alias("b")))), lambda x: x["b"]), "").alias("all"))
    lost = docs.select(key, text).join(joined, key, "left").where(bare(F.coalesce(F.col(text), F.lit(""))) != bare(F.coalesce("all", F.lit(""))))
    # Subpoints repeat their point's context: there the text's words must all be found, in order of the chunks.
    lost = lost.where(~F.coalesce(F.col(text), F.lit("")).rlike(r"(?:^|[\n;:])\s*[a-zđĐ]\d+\)") | (F.length(bare(F.coalesce("all", F.lit("")))) < F.length(bare(F.col(text)))))
    out = each.unionByName(twice("chunk_id")).unionByName(twice("chunk_key"))
    for name, rows in (("segment_gap", segments), ("number_gap", gaps), ("article_not_alone", extra), ("text_lost", lost)):
        out = out.unionByName(of(name, rows))
    return out
