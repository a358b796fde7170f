"""HTML scans with the standard library's parser: links, text blocks, tables."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIDDEN = frozenset(("script", "style", "template", "noscript"))
BLOCKS = {"p": "paragraph", "li": "item", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "title": "title", "td": "cell", "th": "cell", "div": "block"}


#: A link's address with its quotes: any order of attributes, either quote or none, any case.
LINK = r"""(?is)<a(?:\s(?:[^>"']|"[^"]*"|'[^']*')*?)?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


def links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, href) of every link, in the JVM."""
    return pages.select(key, F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("href")).withColumn("href", F.trim("href", F.lit("\"'")))


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.kind, self.run, self.hidden = "block", [], 0
        self.table: list[list[str]] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text and self.table is not None and self.kind == "cell":
            self.table[-1].append(text) if self.table else self.table.append([text])
        elif text:
            self.out.append((self.kind, text))

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        if tag == "table":
            self.flush()
            self.table = []
        elif tag == "tr" and self.table is not None:
            self.flush()
            self.table.append([])
        if tag in BLOCKS:
            self.flush()
            self.kind = BLOCKS[tag]
        elif tag == "br":
            self.run.append(" ")

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag in BLOCKS or tag in ("table", "tr"):
            self.flush()
            self.kind = "block"
        if tag == "table" and self.table is not None:
            rows = [" | ".join(r) for r in self.table if r]
            if rows:
                self.out.append(("table", "\n".join(rows)))
            self.table = None

    def handle_data(self, data):
        if not self.hidden:
            self.run.append(data)


def read_blocks(html: str | None) -> list[tuple[str, str]]:
    """(kind, text) of a page's blocks in order; a table is one block, its cells joined by ` | `."""
    r = _Reader()
    r.feed(html or "")
    r.close()
    r.flush()
    return r.out


def blocks(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, kind, text) of every block."""

    def read(batches):
        for b in batches:
            rows = [(k, i, kind, text) for k, h in zip(b.column(key).to_pylist(), b.column("html").to_pylist(), strict=True) for i, (kind, text) in enumerate(read_blocks(h))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((b.schema.field(key).type, pa.int64(), pa.string(), pa.string()))], [key, "pos", "kind", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, "html").mapInArrow(read, f"{key} {kind}, pos long, kind string, text string")
