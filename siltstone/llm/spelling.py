"""Spelling variants: words one code point apart, found by a rare-first prefix filter over bigrams, grouped under the
commoner form.

Words are counted over all texts, each task summing its own first. Their bigrams are put in one order for all words, the
rarest first (ties by the bigram, then the place). One edit touches two bigrams of a word at most, so of the three first
ones of either word, one is common to both and lies clear of the edit: what stands before it, or what stands behind it, is
equal. Only words that share such a bigram and such a part are joined, under limits of place: the other part's length is
equal or one more, and as one edit leaves either its first or its second half alone, that half is in the key too. Pairs are
then verified by their edit distance. No key is capped; a key says more than half of a word, so it is shared by few.

The number of distinct bigrams is bounded by the alphabet (90 code points, 8,100 bigrams), so their counts are one array.
A form has at least twice its word's occurrences, so chains of forms are short (their length is at most the logarithm of
the most frequent word's count) and are followed by doubling.

Defined cases: null and empty texts have no words; a null doc_id deletes no code point; very long texts are read whole, in
pieces of bounded memory; repeated rows count each; ties between near words go to the smallest in code-point order; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import hold, materialize, small_batches, work_dir

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form occurs so many times as often as its word, at least.
FORM_RATIO = 2
#: One in so many (document, run) pairs loses a code point.
DELETED = 97
#: After lower-casing A-Z by bytes, runs of a-z and U+00C0-U+00FF that can give a word.
RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
LETTERS = re.compile("[A-Za-zÀ-ÿ]*")
#: Code points of the alphabet, and characters of a text read at once.
ALPHABET, PIECE = 90, 1 << 22
#: Distinct words that a task sums before it hands them on.
HELD = 400_000


def runs_of_text(text: str) -> Iterator[Counter]:
    """Counts of the runs of a text: of the whole, or of pieces cut where no run is, for a text of any length."""
    at = 0
    while at < len(text):
        end = LETTERS.match(text, min(at + PIECE, len(text))).end()
        yield Counter(RUN.findall(text[at:end].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
        at = end


def add_words(held: dict[str, int], doc_id: int | None, runs: Counter) -> None:
    """Count a document's runs, with the chosen code points deleted, where they stay long enough."""
    start = zlib.crc32(f"{doc_id}:".encode()) if doc_id is not None else None
    for run, n in runs.items():
        if start is not None:
            h = zlib.crc32(run.encode(), start)
            if h % DELETED == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
                if len(run) < LEAST_LENGTH:
                    continue
        held[run] = held.get(run, 0) + n


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: words of at least LEAST_COUNT occurrences in all texts."""
    small_batches(docs.sparkSession)

    def count(batches):
        hold("spelling")
        held: dict[str, int] = {}
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for runs in runs_of_text(text):
                    add_words(held, doc_id, runs)
                    if len(held) > HELD:
                        yield _rows(held)
                        held = {}
        yield _rows(held)

    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _rows(held: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


def _bigrams() -> Column:
    """Numbers of a word's bigrams in order, by the places of their code points in the alphabet: a-z, then U+00C0-U+00FF."""
    code = lambda at: F.ascii(F.substring("word", at, F.lit(1)))
    place = lambda at: code(at) - F.when(code(at) < 128, 97).otherwise(192 - 26)
    return F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: place(i) * ALPHABET + place(i + 1))


def bigram_counts(words: DataFrame) -> DataFrame:
    """One row `counts`: how often each possible bigram occurs in the words, by its number."""
    seen = words.select(F.explode(_bigrams()).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))
    every = words.sparkSession.range(ALPHABET * ALPHABET).select(F.col("id").cast("int").alias("bigram"), F.lit(0).cast("bigint").alias("n"))
    whole = seen.unionByName(every).groupBy("bigram").agg(F.sum("n").alias("n"))
    return whole.agg(F.sort_array(F.collect_list(F.struct("bigram", "n"))).alias("all")).select(F.transform("all", lambda x: x["n"]).alias("counts"))


def rarest(words: DataFrame, counts: DataFrame) -> DataFrame:
    """Words with their three first bigrams in the order of all: `first`, structs of n, bigram, place (from 0)."""
    spelt = words.withColumn("bigrams", _bigrams()).withColumn("counts", counts.scalar())
    ordered = F.array_sort(F.transform("bigrams", lambda b, i: F.struct(F.col("counts")[b].alias("n"), b.alias("bigram"), i.alias("place"))))
    return spelt.select("word", "n", F.slice(ordered, 1, 3).alias("first"))


def _halves(side: str, bigram: Column, same: Column, rest: Column) -> list[Column]:
    """Keys of one part that is equal and one that may hold the edit. `longer` marks keys under which a word waits for one
    that is shorter by a code point."""
    m = F.length(rest)
    key = lambda size, half, part: F.xxhash64(F.lit(side), bigram, same, size, F.lit(half), part)
    left = lambda n: F.substring(rest, F.lit(1), n)
    right = lambda n: F.substring(rest, m - n + 1, n)
    own, less = F.floor(m / 2).cast("int"), F.floor((m - 1) / 2).cast("int")
    row = lambda k, longer: F.struct(k.alias("key"), F.lit(longer).alias("longer"))
    fits = lambda k: F.when(m > 0, row(k, True))
    return [row(key(m, 0, left(own)), False), row(key(m, 1, right(m - own)), False), fits(key(m - 1, 0, left(less))), fits(key(m - 1, 1, right(m - 1 - less)))]


def keys(words: DataFrame, counts: DataFrame) -> DataFrame:
    """key, longer, word, n: what each word is joined by."""
    each = rarest(words, counts).select("word", "n", F.explode("first").alias("b"))
    before = F.substring("word", F.lit(1), F.col("b.place"))
    behind = F.substring("word", F.col("b.place") + 3, F.length("word"))
    found = F.array(*_halves("before", F.col("b.bigram"), before, behind), *_halves("behind", F.col("b.bigram"), behind, before))
    return each.select("word", "n", F.explode(F.filter(found, lambda k: k.isNotNull())).alias("k")).select("k.key", "k.longer", "word", "n")


def near_pairs(words: DataFrame, counts: DataFrame) -> DataFrame:
    """word, n, near, near_n: pairs of words one edit apart, each once.

    A word has up to two dozen keys, but Spark judges their size by that of the words' file: without the hint it would send
    all keys of one side through the driver."""
    every = keys(words, counts)
    a, b = every.where("not longer").drop("longer"), every.select("key", "longer", F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = a.hint("merge").join(b.hint("merge"), "key").where("longer or word < near").where(F.levenshtein("word", "near", 1) == 1)
    return met.select("word", "n", "near", "near_n").dropDuplicates(["word", "near"])


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n of every word."""
    none = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("bigint").alias("near_n"))
    back = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))))
    found = none.unionByName(pairs).unionByName(back).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    leads = -F.col("best.less") >= FORM_RATIO * F.col("n")
    return found.select("word", "n", "n_near", F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n"))


def roots(linked: DataFrame, where: str) -> DataFrame:
    """word, root of every word that has a form: forms followed to the last, twice as far in each round."""
    now, step = linked.where("form is not null").select("word", F.col("form").alias("root")), 0
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = materialize(now.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"{where}/{step}")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now, step = now.select("word", "root"), step + 1


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts."""
    where = work_dir(docs.sparkSession, "spelling")
    words = materialize(vocabulary(docs), f"{where}/words")
    counts = materialize(bigram_counts(words), f"{where}/counts")
    linked = materialize(forms(words, near_pairs(words, counts)), f"{where}/forms")
    return linked.join(roots(linked, f"{where}/roots").hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
