"""Benchmark decontamination: rare n-gram seeds join texts to items, then Smith-Waterman alignment.

Words are runs of letters and digits in lower case, told apart by a 64-bit hash. A text leaks an item if their local
alignment scores at least half of what the whole item would. With these scores an alignment of half of an item's L words
keeps at least L / 3 - 1 of its two-word sequences unbroken and covers at most 5 / 3 L words of the text. So of the L - 1
sequences those that are most frequent in the texts may be left out: whichever all but L / 3 - 3 are taken, a leak holds
two of them (one, where an item is so short that no more need stay). The rarest are taken, by counts over all texts, and
written as a table from seed to item; the texts' seeds join it by hash, pairs with two seeds close enough together are
candidates, and what would reach the score is never passed over. A long item is also judged by its parts of LONG words,
each of which overlaps the next by half: a passage of LONG / 2 words is a leak however long its item is. The score is the
largest share, of the item or of a part.

What is broadcast is a bit for each hash of a seed, of at most MOST_BITS; it spares seeds that no item has the shuffle.
Beyond that size it lets more through, and the join decides. Equal texts meet the items once.

Defined cases: null and empty texts and items match nothing; very long texts are searched whole; between alignments of equal
score the first counts; an empty table gives no rows, and an empty benchmark keeps all; items of fewer than three words have
one seed of all their words, those of three have their single words; repeated rows and items give a row each; a null doc_id
or item_id stays null; extra columns are ignored or kept, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import columns_of, free_name, hold, materialize, runs_of, small_batches, text_of, work_dir

THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.75
#: Words of the parts of longer items.
LONG = 100
#: Seeds of an item that a candidate has close together, where a leak keeps as many.
TOGETHER = 2
#: Items that one row holds against a text; a text of more candidates has several rows.
ITEMS_A_ROW = 200
#: Bits of the broadcast table of hashes: at least, for each seed, and at most (16 MB).
LEAST_BITS, BITS_A_SEED, MOST_BITS = 1 << 16, 64, 1 << 27
#: Bytes of texts that are cut into words at once, about; a longer word is taken whole.
BLOCK = 1 << 18
WORD = re.compile(r"[^\W_]+")
OTHER = re.compile(r"[^\x00-\x7f]+")
#: Which bytes of lower-case UTF-8 stand in words, once other characters are blanked; a number for each; the base of the hash.
_IN_WORD = np.array([i >= 128 or chr(i).isalnum() for i in range(256)])
_VALUE = np.where(_IN_WORD, np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64), np.uint64(0))
_BASE = 0x5851F42D4C957F2D
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each at least."""
    size = max(BLOCK, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        got = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            got.append(np.cumprod(steps))
        if size > BLOCK:
            return got[0], got[1]
        _POWERS[size] = (got[0], got[1])
    return _POWERS[size]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _plain(text: str) -> bytes:
    """Lower-case UTF-8 in which no byte over 127 stands outside a word."""
    text = text.lower()
    if not text.isascii():
        for c in {c for run in OTHER.findall(text) for c in run if not c.isalnum()}:
            text = text.replace(c, " ")
    return text.encode()


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts in a row, and where each text ends. A word's hash is the sum of its bytes' numbers times
    powers of a base: running sums over a block give those of all its words."""
    plain = [_plain(t) for t in texts]
    data = np.frombuffer(b"\n".join([*plain, b""]), np.uint8)
    borders = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)) + 1)
    hashes, begins, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(data):
        inside = _IN_WORD[data[at : at + BLOCK]]
        if inside[-1]:
            last = np.flatnonzero(~inside)
            if len(last):
                inside = inside[: last[-1] + 1]
            else:
                n = BLOCK
                while (inside := _IN_WORD[data[at : at + n]])[-1]:
                    n *= 2
        n = len(inside)
        power, inverse = _powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[data[at : at + n]] * power[:n], out=sums[1:])
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        begin, end = edge[::2], edge[1::2]
        hashes.append(_mixed((sums[end] - sums[begin]) * inverse[begin]))
        begins.append(begin + at)
        at += n
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), borders)


def seeds_of(ws: np.ndarray, gram: int) -> np.ndarray:
    """A hash for each sequence of `gram` words, 1 or 2."""
    return _mixed(ws[:-1] * np.uint64(0x9E3779B97F4A7C15) + ws[1:] if gram == 2 else ws ^ np.uint64(0xD1B54A32D192ED03))


def shape(size: int) -> tuple[int, int, int]:
    """Of an item of `size` words: words of a seed; seeds that a leak keeps at least; words of the text that it covers at most."""
    gram = 1 if size in (1, 3) else 2
    need = 2 if size == 3 else max(1, -((3 - size) // 3))
    return gram, need, size if size < 3 else 5 * size // 3


class Seen:
    """Which seeds are sought: a bit for each hash, and the lengths of seeds."""

    def __init__(self, cells: np.ndarray, grams: list[int]):
        self.cells, self.grams = cells, grams

    def places(self, ws: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words in texts in a row where a sought seed may stand, in order, and the seeds."""
        at, seeds = [], []
        for gram in self.grams:
            if len(ws) < gram:
                continue
            keys = seeds_of(ws, gram)
            slot = keys & np.uint64(64 * len(self.cells) - 1)
            hit = (self.cells[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0
            if gram == 2:
                borders = ends[:-1] - 1
                hit[borders[(borders >= 0) & (borders < len(hit))]] = False
            place = np.flatnonzero(hit)
            at.append(place)
            seeds.append(keys[place])
        if len(at) == 1:
            return at[0], seeds[0]
        if not at:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        place, key = np.concatenate(at), np.concatenate(seeds)
        order = np.argsort(place, kind="stable")
        return place[order], key[order]


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of two word sequences: score, begin and end in the text. Row by row over the item; gaps in
    the text by a running maximum."""
    n = len(text)
    best, where = 0.0, (0, 0)
    h = np.zeros(n + 1)
    origin = np.arange(n + 1)
    slope = GAP * np.arange(n + 1)
    for w in item:
        diagonal = h[:-1] + np.where(text == w, MATCH, MISMATCH)
        up = h[1:] + GAP
        take = diagonal >= up
        cell = np.concatenate([[0.0], np.maximum(diagonal, up)])
        came = np.concatenate([[0], np.where(take, origin[:-1], origin[1:])])
        fresh = cell <= 0
        cell[fresh] = 0.0
        came[fresh] = np.flatnonzero(fresh)
        lifted = cell - slope
        top = np.maximum.accumulate(lifted)
        # The place that each running maximum comes from.
        source = np.maximum.accumulate(np.where(lifted >= top, np.arange(n + 1), 0))
        h = top + slope
        origin = came[source]
        k = int(h.argmax())
        if h[k] > best:
            best, where = float(h[k]), (int(origin[k]), k)
    return best, *where


def merged(ranges: Iterator[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def best_leak(item: np.ndarray, text: np.ndarray, ranges: Iterator[tuple[int, int]]) -> tuple[float, int, int]:
    """(share, first word, last word + 1) of an item's best alignment within ranges of a text. Before it, all seeds of the
    item are counted there."""
    gram, need, span = shape(len(item))
    own = np.unique(seeds_of(item, gram))
    best = (0.0, 0, 0)
    for a, z in merged(ranges):
        part = text[a:z]
        p = np.flatnonzero(np.isin(seeds_of(part, gram), own))
        if len(p) < need:
            continue
        first, last = p[: len(p) - need + 1], p[need - 1 :]
        near = last - first <= span - gram
        for x, y in merged(zip(np.maximum(last[near] + gram - span, 0).tolist(), np.minimum(first[near] + span, len(part)).tolist(), strict=True)):
            score, b, e = align(item, part[x:y])
            if score > best[0]:
                best = (score, a + x + b, a + x + e)
    return best[0] / (MATCH * len(item)), best[1], best[2]


def _digest() -> Column:
    return F.md5(text_of().cast("binary"))


def _parts(benchmark: DataFrame, where: str) -> DataFrame:
    """item (its text's digest), part, words (packed hashes), seeds (one for each place), n_take (how many of the rarest are
    taken), together, gram, span: of each distinct item, whole, and of each part of a long one."""
    texts = benchmark.select(_digest().alias("item"), text_of().alias("text")).where("text != ''").dropDuplicates(["item"])
    names = ("item", "part", "words", "seeds", "n_take", "together", "gram", "span")

    def cut(batches):
        kinds = (pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        for b in batches:
            rows = []
            for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
                ws, _ = words_of([text])
                begins = [*range(0, len(ws) - LONG, LONG // 2), len(ws) - LONG] if len(ws) > LONG else []
                for part, own in enumerate([ws, *(ws[a : a + LONG] for a in begins)] if len(ws) else []):
                    gram, need, span = shape(len(own))
                    together = min(TOGETHER, need)
                    seeds = seeds_of(own, gram)
                    rows.append((item, part, own.tobytes(), seeds.view(np.int64), len(seeds) - need + together, together, gram, span))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    schema = "item string, part int, words binary, seeds array<bigint>, n_take int, together int, gram int, span int"
    return materialize(texts.mapInArrow(cut, schema), f"{where}/parts")


def _seen(seeds: DataFrame) -> Seen | None:
    """The table of bits of the column `seed`; None where there are none. What comes to the driver has a fixed bound."""
    n, grams = seeds.agg(F.approx_count_distinct("seed"), F.array_sort(F.collect_set("gram"))).first()
    if not n:
        return None
    bits = max(LEAST_BITS, min(MOST_BITS, 1 << (BITS_A_SEED * n - 1).bit_length()))
    slot = F.col("seed").bitwiseAND(F.lit(bits - 1))
    cells = seeds.select(F.shiftright(slot, 6).alias("cell"), F.expr(f"shiftleft(1L, cast((seed & {bits - 1}L) & 63 as int))").alias("bit"))
    got = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got.column("cell").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return Seen(out, grams)


def _rare_seeds(texts: DataFrame, parts: DataFrame, where: str) -> DataFrame:
    """seed, item, part, together, gram, span: of each item and part the seeds that are rarest in the texts, as many as a
    leak can't do without."""
    spark = texts.sparkSession
    every = parts.select("item", "part", "n_take", "together", "gram", "span", F.explode("seeds").alias("seed"))
    seen = _seen(every)
    if seen is not None:
        sought = spark.sparkContext.broadcast(seen)

        def counted(batches):
            hold("decontaminate")
            for run in runs_of(batches):
                seeds, n = np.unique(sought.value.places(*words_of(run.column("text").to_pylist()))[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array(n, pa.int64())], ["seed", "n"])

        counts = texts.select("text").mapInArrow(counted, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n"))
        items = every.groupBy("seed").agg(F.count(F.lit(1)).alias("m"))
        cost = items.join(counts, "seed").select("seed", (F.col("n").cast("double") * F.col("m")).alias("cost"))
        every = every.join(cost, "seed", "left")
    else:
        every = every.withColumn("cost", F.lit(0.0))
    rarest = F.row_number().over(Window.partitionBy("item", "part").orderBy(F.coalesce("cost", F.lit(0.0)), "seed"))
    rare = every.withColumn("place", rarest).where("place <= n_take").select("seed", "item", "part", "together", "gram", "span").distinct()
    return materialize(rare, f"{where}/seeds")


def _candidates(docs: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """digest of a text, and some of the items whose seeds stand in it close together: for each its parts, with their words
    and the ranges that hold every leak. None where nothing is sought."""
    spark = docs.sparkSession
    where = work_dir(spark, "leaks")
    texts = docs.select(text_of().alias("text")).where("text != ''")
    parts = _parts(benchmark, where)
    rare = _rare_seeds(texts, parts, where)
    seen = _seen(rare)
    if seen is None:
        return None
    sought = spark.sparkContext.broadcast(seen)

    def found(batches):
        hold("decontaminate")
        for run in runs_of(batches):
            ws, ends = words_of(run.column("text").to_pylist())
            at, seeds = sought.value.places(ws, ends)
            text = np.searchsorted(ends, at, side="right")
            some, begin = np.unique(text, return_index=True)
            offsets = pa.array(np.append(begin, len(at)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((at - np.append(0, ends)[text]).astype(np.int32), seeds.view(np.int64))]
            yield pa.RecordBatch.from_arrays([run.column("digest").combine_chunks().take(pa.array(some)), *lists], ["digest", "places", "seeds"])

    hits = texts.select(_digest().alias("digest"), "text").mapInArrow(found, "digest string, places array<int>, seeds array<bigint>").dropDuplicates(["digest"])
    hits = hits.select("digest", F.explode(F.arrays_zip("places", "seeds")).alias("x")).select("digest", F.col("x.places").alias("place"), F.col("x.seeds").alias("seed"))
    before = F.lag("place").over(Window.partitionBy("digest", "item", "part").orderBy("place"))
    pairs = hits.join(rare, "seed").withColumn("before", F.when(F.col("together") == 1, F.col("place")).otherwise(before))
    near = pairs.where("place - before <= span - gram").select("digest", "item", "part", F.struct(F.expr("greatest(place + gram - span, 0)").alias("a"), F.expr("before + span").alias("z")).alias("range"))
    ranges = near.groupBy("digest", "item", "part").agg(F.collect_list("range").alias("ranges")).join(parts.select("item", "part", "words"), ["item", "part"])
    items = ranges.groupBy("digest", "item").agg(F.array_sort(F.collect_list(F.struct("part", "words", "ranges"))).alias("parts"))
    row = F.floor((F.row_number().over(Window.partitionBy("digest").orderBy("item")) - 1) / ITEMS_A_ROW).alias("row")
    some = items.select("digest", row, F.struct("item", "parts").alias("x")).groupBy("digest", "row").agg(F.collect_list("x").alias("items")).drop("row")
    return materialize(some, f"{where}/candidates")


def _judged(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """key, item, score, first_word, end_word: what the texts of rows (key, digest, text) leak. Each row is judged where it is
    read, unless the candidates' digests, which thin the texts first, are too many for a broadcast of Spark's own measure."""
    kind = rows.schema["key"].dataType.simpleString()

    def judge(batches):
        hold("decontaminate")
        kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
        for b in batches:
            of, got = [], []
            for i, (text, items) in enumerate(zip(b.column("text").to_pylist(), b.column("items").to_pylist(), strict=True)):
                ws, _ = words_of([text])
                for x in items:
                    tries = [best_leak(np.frombuffer(p["words"], np.uint64), ws, ((r["a"], r["z"]) for r in p["ranges"])) for p in x["parts"]]
                    best = max(tries, key=lambda t: t[0])
                    if best[0] >= THRESHOLD:
                        of.append(i)
                        got.append((x["item"], *best))
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(of, pa.int64())), *(pa.array([g[k] for g in got], t) for k, t in enumerate(kinds))], ["key", "item", "score", "first_word", "end_word"])

    digests = materialize(candidates.select("digest").distinct(), work_dir(rows.sparkSession, "digests"))
    some = rows.join(digests, "digest", "left_semi")
    return some.join(candidates, "digest").select("key", "text", "items").mapInArrow(judge, f"key {kind}, item string, score double, first_word bigint, end_word bigint")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word: a row for each text and item that it leaks."""
    small_batches(docs.sparkSession)
    candidates = _candidates(docs, benchmark)
    if candidates is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, first_word long, end_word long")
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), _digest().alias("digest"), text_of().alias("text"))
    ids = benchmark.select(_digest().alias("item"), F.col("item_id").cast("long").alias("item_id"))
    return _judged(rows, candidates).join(ids, "item").select(F.col("key").alias("doc_id"), "item_id", "score", "first_word", "end_word")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text leaks an item, all columns."""
    spark = docs.sparkSession
    small_batches(spark)
    candidates = _candidates(docs, benchmark)
    if candidates is None:
        return docs
    rows = docs.select(_digest().alias("key"), _digest().alias("digest"), text_of().alias("text"))
    leaky = materialize(_judged(rows, candidates).select("key").distinct(), work_dir(spark, "leaky"))
    key = free_name(docs, "digest")
    return docs.withColumn(key, _digest()).join(leaky.withColumnRenamed("key", key), key, "left_anti").select(*columns_of(docs))
