"""Citations and sources of hits: labels, official addresses, unit labels, bodies, relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Titles by number, by kind in a note, by type of source; and how notes name articles and documents.
CANONICAL_TITLES = {"45/2019/QH14": "Bộ luật Lao động"}
KIND_TITLES = {"bộ luật": "Bộ luật", "luật": "Luật", "nghị định": "Nghị định", "thông tư": "Thông tư"}
TYPE_TITLES = {"LQ": "Văn bản luật", "NĐ": "Nghị định", "TT": "Thông tư"}
EDGE, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
ARTICLE = rf"(?iu){EDGE}Điều\s+(\d+[a-zA-ZđĐ]?){END}"
DOCUMENT = rf"(?iu){EDGE}(Bộ\s+luật|Luật|Nghị\s+định|Thông\s+tư)\s+số\s+(\d+/\d{{4}}/[0-9A-ZÀ-ỸĐ-]+)"
ITEM_ID = r"(?i)[?&]ItemID=(\d+)"
#: Rows of a registry that are broadcast at most; beyond that its joins shuffle.
MOST_BROADCAST = 200_000


def optional(c: Column) -> Column:
    """Trimmed text; null where nothing is left."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def _found(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, group), F.lit(""))


def _titled(c: Column, titles: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in titles.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def citation(row: DataFrame) -> dict[str, Column]:
    """article_number, document_number, document_title and citation_label of a hit's fields (source_note_text, article_code,
    article_number, document_number, document_title, source_type). A number comes from its own field, else from the note,
    an article's at last from the end of its code."""
    own = lambda name: optional(F.col(name)) if name in row.columns else F.lit(None).cast("string")
    note, code = own("source_note_text"), own("article_code")
    article = F.coalesce(own("article_number"), _found(note, ARTICLE, 1), _found(code, r"(?:^|\.)\s*(\d+[a-zA-ZđĐ]?)\s*$", 1))
    number = F.coalesce(own("document_number"), F.upper(_found(note, DOCUMENT, 2)))
    kind = F.lower(F.regexp_replace(_found(note, DOCUMENT, 1), r"\s+", " "))
    title = F.coalesce(own("document_title"), _titled(number, CANONICAL_TITLES), _titled(kind, KIND_TITLES), _titled(F.upper(own("source_type")), TYPE_TITLES))
    label = F.when(article.isNotNull(), F.concat_ws(" ", F.concat(F.lit("Điều "), article), title, F.when(number.isNotNull(), F.concat(F.when(title.isNull(), "văn bản số ").otherwise("số "), number))))
    return {"article_number": article, "document_title": title, "document_number": number, "citation_label": F.coalesce(label, F.concat(F.lit("Mã pháp điển "), code), F.lit("Nguồn pháp luật"))}


def official_urls(hits: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """hits with official_url: the registry's canonical_url by the source's id, else by the item id in one of its addresses
    (the first that is known), else by the document's number; at last the hit's first address. hits: key, source_document_id,
    source_urls, document_number. registry: source_document_id, item_id, document_number, canonical_url, each id once."""
    small = registry.count() <= MOST_BROADCAST
    side = lambda df: F.broadcast(df) if small else df
    fold = lambda c: F.lower(optional(c))
    by = lambda name: registry.select(fold(F.col(name)).alias(f"_{name}"), F.col("canonical_url").alias(f"_by_{name}")).where(F.col(f"_{name}").isNotNull())
    ids = hits.select(key, F.posexplode(F.transform("source_urls", lambda u: _found(u, ITEM_ID, 1))).alias("_at", "_item")).where("_item is not null")
    item = ids.join(side(by("item_id")), F.col("_item") == F.col("_item_id")).groupBy(key).agg(F.min_by("_by_item_id", "_at").alias("_by_item_id"))
    out = hits.join(side(by("source_document_id")), fold(F.col("source_document_id")) == F.col("_source_document_id"), "left").join(item, key, "left")
    out = out.join(side(by("document_number")), fold(F.col("document_number")) == F.col("_document_number"), "left")
    url = F.coalesce("_by_source_document_id", "_by_item_id", "_by_document_number", optional(F.get("source_urls", F.lit(0))))
    return out.select(*[f"`{c}`" for c in hits.columns], url.alias("official_url"))


def unit_label(table_index: Column, clause: Column, points: Column, segment: Column, unit_type: Column) -> Column:
    """What a reader calls a chunk: its table, clause and points, clause, points, the preamble, or the article's text; from
    the second segment on with its number."""
    clause, listed = optional(clause), F.array_join(F.filter(F.coalesce(points, F.array().cast("array<string>")), lambda p: F.trim(p) != ""), ", ")
    named = F.when(table_index.isNotNull(), F.concat(F.lit("Bảng "), table_index.cast("string")))
    named = named.when(clause.isNotNull() & (listed != ""), F.concat(F.lit("Khoản "), clause, F.lit(" · Điểm "), listed)).when(clause.isNotNull(), F.concat(F.lit("Khoản "), clause))
    named = named.when(listed != "", F.concat(F.lit("Điểm "), listed)).when(unit_type == "preamble", "Phần mở đầu").otherwise("Nội dung điều")
    return F.concat(named, F.when(segment > 1, F.concat(F.lit(" · Phần "), segment.cast("string"))).otherwise(""))


def body_text(body: Column, content: Column) -> Column:
    """A chunk's own text: its body, else what stands behind the first blank line of its content, else all of it."""
    behind = F.trim(F.regexp_extract(content, r"(?s)^.*?\n\n(.*)$", 1), F.lit(" \n\t\r"))
    return F.coalesce(optional(body), F.nullif(behind, F.lit("")), optional(content))


def relation_lists(relations: DataFrame, key: str, order: str) -> DataFrame:
    """Of each row's relations (key, order, target_id, target_code, relation_type, href, same_topic, target_in_corpus) five
    lists of one length, in order, each relation once."""
    same = [key, "target_id", "target_code", "relation_type", "href"]
    once = relations.groupBy(*same).agg(F.min(F.struct(order, "same_topic", "target_in_corpus")).alias("first"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(f"first.{order}").alias("at"), "target_id", "target_code", "relation_type", "first.same_topic", "first.target_in_corpus")))
    listed = once.groupBy(key).agg(rows.alias("r"))
    take = lambda name, none: F.transform("r", lambda x: F.coalesce(x[name], F.lit(none)) if none is not None else x[name])
    return listed.select(key, take("target_id", None).alias("target_ids"), take("target_code", None).alias("target_codes"), take("relation_type", None).alias("relation_types"), take("same_topic", False).alias("same_topic"), take("target_in_corpus", False).alias("in_corpus"))


def sources_of(hits: DataFrame) -> DataFrame:
    """Hits as sources: ids and texts, fallback fields joined, the citation beside them."""
    own = lambda *names: F.coalesce(*(optional(F.col(n)) for n in names if n in hits.columns), F.lit(None).cast("string"))
    return hits.withColumn("article_code", own("article_code", "codification_code")).transform(lambda df: df.withColumns(citation(df)))
