"""Text functions as column expressions; what the JVM can't do is an Arrow function at the end."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

Segmenter = Callable[[Sequence[str]], list[list[str]]]

# Letters with marks and what they fold to, for the closed alphabet of the supported languages; tokens.
MARKED = "àáảãạăằắẳẵặâầấẩẫậäåçèéẻẽẹêềếểễệëìíỉĩịïîñòóỏõọôồốổỗộơờớởỡợöùúủũụưừứửữựüûỳýỷỹỵÿđ"
PLAIN = "aaaaaaaaaaaaaaaaaaaceeeeeeeeeeeeiiiiiiinoooooooooooooooooouuuuuuuuuuuuuyyyyyyd"
WORD = r"[\p{L}\p{N}]+(?:_[\p{L}\p{N}]+)*"
ASCII_WORD = r"[a-z0-9]+"


def words(text: Column, pattern: str = WORD) -> Column:
    """Tokens of a text in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def fold(text: Column) -> Column:
    """Lower case without marks, for the closed alphabet; stays in the JVM."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def paragraphs_normalized(text: Column) -> Column:
    """No-break blanks and carriage returns mapped, runs of blanks as one, at most two line feeds in a row."""
    out = F.regexp_replace(F.regexp_replace(text, " ", " "), r"\r\n?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" ?\n ?", "\n"), r"\n{3,}", "\n\n"))


def pdf_text(text: Column) -> Column:
    """Text of a page description in one line: soft hyphens and hyphens at a line's end go, lines that are page numbers too;
    lower case, one kind of dash, one blank. Composed letters (nfc) are put together before."""
    out = F.regexp_replace(F.regexp_replace(text, "\u00ad", ""), r"(?<=[\p{L}\p{N}_])-\s*\n\s*(?=[\p{L}\p{N}_])", "")
    out = F.regexp_replace(out, r"(?im)^\s*(?:trang\s*)?\d{1,4}\s*$", " ")
    return F.trim(F.regexp_replace(F.translate(F.lower(out), "–—", "--"), r"[\s\u00a0]+", " "))


def utc(text: Column) -> Column:
    """A time in ISO form, with an offset or Z, or without one, which is then UTC; or a date like 31/12/2020."""
    stamp = F.try_to_timestamp(F.when(text.rlike(r"(?i)(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z"))))
    return F.coalesce(F.when(text.rlike(r"^\d{4}-\d\d-\d\d[T ]"), stamp), F.try_to_timestamp(F.concat(text, F.lit(" 00:00:00 +00:00")), F.lit("d/M/yyyy HH:mm:ss xxx")), F.when(text.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_timestamp(F.concat(text, F.lit("T00:00:00Z")))))


def document_number_key(text: Column) -> Column:
    """Upper-case letters and digits alone."""
    return F.upper(F.regexp_replace(fold(text), "[^a-z0-9]", ""))


def slug(text: Column, sep: str = "-") -> Column:
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", sep), f"^{sep}+|{sep}+$", "")


def estimated_tokens(text: Column) -> Column:
    """Words and marks times 1.3, rounded down."""
    return F.floor(F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))) * 1.3).cast("long")


def prefixed(text: Column, prefix: str) -> Column:
    """A prefix once."""
    return F.when(F.startswith(text, F.lit(prefix)), text).otherwise(F.concat(F.lit(prefix), text))


def inline_citations(text: Column) -> Column:
    """Distinct ids of [S1]-like marks in order of first mention."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(S\d+)\]"), F.lit(1)))


def json_object(text: Column) -> Column:
    """From the first { to the last }, without a code fence; null where there is none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID of version 5."""
    ns = F.unhex(F.lit(namespace.replace("-", "")))
    h = F.sha1(F.concat(ns, name.cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token sets; 0 where one is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2.0 * common / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))))


def first_difference(a: Column, b: Column) -> Column:
    """Place of the first character (from 1) in which two texts differ; null where they are equal."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y))
    return F.when(~a.eqNullSafe(b), F.nullif(F.array_position(differ, True), F.lit(0)).cast("long"))


def window_at(text: Column, place: Column, width: int) -> Column:
    """What stands around a place."""
    return F.substring(text, F.greatest(place - width, F.lit(1)).cast("int"), F.lit(2 * width + 1))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of a row as JSON, its fields in order of their names, nulls left out; columns are named."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def number_or_last(text: Column, last: int = 99_999) -> Column:
    """The number that a text begins with, to sort by; texts without one come last."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*(\d{1,9})", 1), F.lit("")).cast("long"), F.lit(last))


def safe_url(url: Column) -> Column:
    """The url if it is http(s) with a host."""
    return F.when(F.trim(url).rlike(r"^(?i)https?://[^/\s?#]+"), F.trim(url))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def fold_any(text: pd.Series) -> pd.Series:
    """Lower case without marks for any alphabet; the barred d is mapped before marks are taken off."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = unicodedata.normalize("NFD", t.replace("đ", "d").replace("Đ", "D"))
        return "".join(c for c in t if not unicodedata.combining(c)).casefold()

    return text.map(one)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


class LongestMatch:
    """A segmenter of compounds from a dictionary: the longest known run of syllables is one word, joined by _."""

    def __init__(self, compounds: Sequence[str]):
        self.known = {tuple(unicodedata.normalize("NFC", c).lower().replace("_", " ").split()) for c in compounds}
        self.longest = max(map(len, self.known), default=1)

    def __call__(self, texts: Sequence[str]) -> list[list[str]]:
        return [self._cut(re.findall(r"\w+|[^\w\s]", unicodedata.normalize("NFC", t))) for t in texts]

    def _cut(self, parts: list[str]) -> list[str]:
        low, out, i = [p.lower() for p in parts], [], 0
        while i < len(parts):
            n = next((n for n in range(min(self.longest, len(parts) - i), 1, -1) if tuple(low[i : i + n]) in self.known), 1)
            out.append("_".join(parts[i : i + n]))
            i += n
        return out


def segmented(text: Column, segmenter: Segmenter) -> Column:
    """Words of a text by a segmenter that the caller gives, batch by batch."""

    @F.pandas_udf(ArrayType(StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series(segmenter([t or "" for t in texts]))

    return cut(text)
