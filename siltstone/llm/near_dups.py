"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Equal texts are one text from the start. Each text's five-word shingles are weighted by TF-IDF, by exact document
frequencies of all shingles; samples of them agree for two texts with probability equal to their weighted Jaccard
similarity, and are banded. A text whose mean inverse frequency is under COMMON is sampled by its term counts too, into
the same buckets: what many texts share weighs little, and copies that many texts share must meet nevertheless. In each
bucket of each band all texts are held against the most central one, and then each against its successor in the order of
the signatures if these two aren't connected yet, so a bucket costs a number of pairs in proportion to its texts. Where a
bucket's texts then lie in different components, those outside its largest one are held against all others, in blocks of bounded size, by a matrix product
that bounds the similarity from above; only links come out. So every pair with a bucket in common is tested or already
connected. A pair is a link if its weighted Jaccard similarity is 0.8 or more, with TF-IDF or with term counts. Classes
are connected components.

Texts are told apart by their 128-bit digest and then numbered. Buckets and texts that many rows have are joined by a
broadcast of bounded size, all others by a shuffle.

Defined cases: null texts and texts without a word are no copies of anything; texts of fewer than five words are one
shingle; very long texts are read whole; rows without doc_id get no class; of rows that repeat a doc_id and a text one is
kept, of texts that repeat the smallest doc_id one (the one of smallest digest) stands for the class; an empty table gives
no rows; extra columns are ignored or kept as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import columns_of, free_name, hold, materialize, small_batches, text_of, work_dir
from siltstone.llm.shingles import Frequencies, count_frequencies, mix, shingle_rows, weighted_jaccard

SIMILARITY, BANDS, ROWS = 0.8, 14, 4
#: Texts whose mean inverse frequency is lower are sampled by term counts too.
COMMON = 0.85
#: Texts of a block that are held against those of another; how many of either at once; columns of a product.
BLOCK, SIDE, COLUMNS = 2048, 256, 8192
#: Rows that are broadcast at most, and rows of a key that are many.
MOST_BROADCAST, MANY = 1_000_000, 1_000
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_ODD = mix(_SEEDS) | np.uint64(1)
_INVERSE = np.array([pow(int(x), -1, 1 << 64) for x in _ODD], np.uint64)


def _exponential(z: np.ndarray) -> np.ndarray:
    """Exp(1) draws that rise with the hashes."""
    return -np.log1p(-(z >> np.uint64(11)).astype(np.float64) * 2.0**-53)


def sample_rows(begin: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of each text (its shingles from begin[i] to begin[i + 1], one at least) one 64-bit sample for each of the
    BANDS * ROWS draws: the chosen shingle and its quantum.

    Improved consistent weighted sampling draws r and c from Gamma(2, 1) and b uniform for each draw and shingle, takes
    t = floor(ln w / r + b) and ln y = r (t - b), and chooses the shingle of least ln c - ln y - r. Here the three come
    from exponential draws a, d and f: c = a + d, r (1 - b) = ln(c / a), r b = f, which have the wanted distributions
    together; then a shingle of weight 1 has t = 0 and the value ln a, so that of all those the least hash is chosen.
    """
    n = len(begin) - 1
    of = np.repeat(np.arange(n), np.diff(begin))
    one = w == 1.0
    plain, rest, ln_w = h[one], h[~one], np.log(w[~one])
    plain_of, rest_of = of[one], of[~one]
    plain_texts, rest_texts = _firsts(plain_of), _firsts(rest_of)
    out = np.empty((n, len(_SEEDS)), np.uint64)
    for k, (seed, odd) in enumerate(zip(_SEEDS, _ODD, strict=True)):
        least, chosen = np.full(n, np.inf), np.zeros(n, np.uint64)
        if len(plain):
            z = np.minimum.reduceat((plain ^ seed) * odd, plain_texts)
            texts = plain_of[plain_texts]
            least[texts] = np.log(_exponential(z) + 1e-300)
            chosen[texts] = z * _INVERSE[k] ^ seed
        if len(rest):
            z = (rest ^ seed) * odd
            a, d, f = _exponential(z) + 1e-300, _exponential(mix(z ^ np.uint64(0x2545F4914F6CDD1D))), _exponential(mix(z ^ np.uint64(0x5851F42D4C957F2D)))
            c = a + d
            r = np.log(c / a) + f + 1e-300
            b = f / r
            t = np.floor(ln_w / r + b)
            value = np.log(c) - r * (t - b) - r
            low = np.minimum.reduceat(value, rest_texts)
            texts = rest_of[rest_texts]
            best = np.flatnonzero(value == np.repeat(low, np.diff(rest_texts, append=len(rest))))
            best = best[_firsts(rest_of[best])]
            wins = low < least[texts]
            quantum = t[best].astype(np.int64).view(np.uint64) * np.uint64(0xA0761D6478BD642F)
            chosen[texts[wins]] = (rest[best] + quantum)[wins]
        out[:, k] = mix(chosen)
    return out


def _firsts(of: np.ndarray) -> np.ndarray:
    """Where the values of an array in order begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(of)), bool), of[1:] != of[:-1]]))


def band_rows(begin: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of each text one hash for each band."""
    s = sample_rows(begin, h, w).reshape(-1, BANDS, ROWS)
    acc = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(s), 1))
    for k in range(ROWS):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + s[:, :, k])
    return acc


WORDY = r"[^\x20\x09-\x0D]"


def text_key() -> Column:
    """A text's digest."""
    return F.md5(text_of().cast("binary"))


def joined(left: DataFrame, right: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """Inner join with a frame of distinct keys that says in column n how many rows of the left one each has. Keys of many
    rows are broadcast, so that they don't meet in a task; there are at most MOST_BROADCAST of them."""
    total = right.agg(F.sum(n)).first()[0] or 0
    many = max(MANY, -(-total // MOST_BROADCAST))
    heavy = right.where(F.col(n) > many)
    if not heavy.limit(1).count():
        return left.join(right, on)
    hot = F.broadcast(heavy)
    return left.join(hot, on).unionByName(left.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(right.where(F.col(n) <= many), on))


def exact_classes(docs: DataFrame, where: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) of every row with a doc_id and a word in its text; and (rep, digest, first, n, bytes, text) of the
    distinct texts. rep is the text's number, first the smallest doc_id that has it, n how many rows. Texts meet in a
    partial aggregate first, so copies don't gather in a task."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.where(F.col("text").rlike(WORDY)).withColumn("digest", text_key())
    one = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("text").alias("text"))
    one = one.select(F.monotonically_increasing_id().alias("rep"), "digest", "first", "n", F.octet_length("text").cast("long").alias("bytes"), "text")
    return rows.select("doc_id", "digest"), materialize(one, f"{where}/texts")


def signatures(texts: DataFrame, df: Frequencies) -> DataFrame:
    """(rep, band, bucket, sig): a row for each band by TF-IDF, and one by term counts where the text needs it and that is
    another bucket; sig, the hash of the next band, orders a bucket."""
    small_batches(texts.sparkSession)

    def sign(batches):
        hold("near-dups")
        for b in batches:
            begin, h, tf = shingle_rows(b.column("text").to_pylist())
            some = np.flatnonzero(np.diff(begin))
            if not len(some):
                continue
            reps, begin = b.column("rep").to_numpy(zero_copy_only=False)[some], np.append(begin[some], len(h))
            w = df.weights(h, tf)
            s = band_rows(begin, h, w)
            every, at = np.repeat(reps, BANDS), np.tile(np.arange(BANDS, dtype=np.int32), len(reps))
            rows = [(every, at, s.ravel(), np.roll(s, -1, 1).ravel())]
            common = np.flatnonzero(np.add.reduceat(w, begin[:-1]) < COMMON * np.add.reduceat(tf, begin[:-1]))
            if len(common):
                size = np.diff(begin)[common]
                own = np.concatenate([[0], np.cumsum(size)])
                place = np.arange(own[-1]) + np.repeat(begin[common] - own[:-1], size)
                c = band_rows(own, h[place], tf[place].astype(np.float64))
                other = np.flatnonzero((c != s[common]).ravel())
                rows.append((np.repeat(reps[common], BANDS)[other], np.tile(np.arange(BANDS, dtype=np.int32), len(common))[other], c.ravel()[other], np.roll(c, -1, 1).ravel()[other]))
            reps, at, buckets, sigs = (np.concatenate([r[i] for r in rows]) for i in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(at), pa.array(buckets.view(np.int64)), pa.array(sigs.view(np.int64))], ["rep", "band", "bucket", "sig"])

    return texts.select("rep", "text").mapInArrow(sign, "rep long, band int, bucket long, sig long")


def vectors(texts: DataFrame, df: Frequencies) -> DataFrame:
    """(rep, vector): a text's shingle hashes, TF-IDF weights and counts, packed one after the other."""
    small_batches(texts.sparkSession)

    def pack(batches):
        hold("near-dups")
        for b in batches:
            begin, h, tf = shingle_rows(b.column("text").to_pylist())
            w = df.weights(h, tf)
            packed = [h[a:z].tobytes() + w[a:z].astype("<f4").tobytes() + tf[a:z].astype("<u4").tobytes() for a, z in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(packed, pa.binary())], ["rep", "vector"])

    return texts.select("rep", "text").mapInArrow(pack, "rep long, vector binary")


def unpacked(vector: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, weights and counts."""
    n = len(vector) // 16
    return np.frombuffer(vector, "<u8", n), np.frombuffer(vector, "<f4", n, 8 * n).astype(np.float64), np.frombuffer(vector, "<u4", n, 12 * n).astype(np.float64)


def alike(a: tuple, b: tuple) -> bool:
    """Whether two unpacked vectors make a link."""
    return any(weighted_jaccard((a[0], a[k]), (b[0], b[k])) >= SIMILARITY for k in (1, 2))


def similar(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """(a, b, linked) of pairs (a, b). The text that more pairs hold is named a; pairs come sorted by a, whose vector is
    kept meanwhile."""
    both = pairs.join(packed.withColumnsRenamed({"rep": "b", "vector": "vector_b"}), "b").join(packed.withColumnsRenamed({"rep": "a", "vector": "vector_a"}), "a")

    def judge(batches):
        hold("near-dups")
        kept: tuple = (None, None)
        for x in batches:
            out = []
            for a, va, vb in zip(x.column("a").to_pylist(), x.column("vector_a").to_pylist(), x.column("vector_b").to_pylist(), strict=True):
                if kept[0] != a:
                    kept = (a, unpacked(va))
                out.append(alike(kept[1], unpacked(vb)))
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), pa.array(out, pa.bool_())], ["a", "b", "linked"])

    return both.mapInArrow(judge, "a long, b long, linked boolean")


def connected(texts: DataFrame, where: str) -> DataFrame:
    """(node, root) of the texts (rep, text, bytes) that are similar to others: the smallest that each is connected with."""
    n, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    df = count_frequencies(texts, f"{where}/df", n, size)
    signed = materialize(signatures(texts, df), f"{where}/bands")
    bucket = ["band", "bucket"]
    sizes = materialize(signed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"{where}/sizes")
    members = materialize(joined(signed, sizes, bucket), f"{where}/members")
    # A text is the more central the larger its buckets are.
    central = members.groupBy("rep").agg(F.sum("n").alias("central"))
    members = materialize(members.join(central, "rep"), f"{where}/central")
    ids = members.select("rep").distinct()
    few = ids.count()
    # The texts that are held against each other: those with a bucket to share.
    some = texts.join(F.broadcast(ids) if few <= MOST_BROADCAST else ids, "rep", "left_semi")
    packed = materialize(vectors(some, df), f"{where}/vectors")
    leads = materialize(members.groupBy(*bucket).agg(F.max_by("rep", F.struct("central", -F.col("rep"))).alias("lead"), F.count(F.lit(1)).alias("rows")), f"{where}/leads")
    star = joined(members, leads, bucket, "rows").where("rep != lead").select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b"))
    star = materialize(star.distinct(), f"{where}/star")
    found = materialize(similar(star, packed).where("linked").select("a", "b"), f"{where}/found")
    roots = components(found, f"{where}/first")
    # What the stars have connected isn't tested again, nor are their pairs.
    line = materialize(successors(rooted(members, roots)).distinct().join(star, ["a", "b"], "left_anti"), f"{where}/line")
    found = materialize(similar(line, packed).where("linked").select("a", "b"), f"{where}/found-line")
    roots = merged(roots, found, f"{where}/second")
    rest = across(members.where("n > 2").select(*bucket, "rep"), roots, packed, f"{where}/across")
    return merged(roots, materialize(rest.distinct(), f"{where}/found-across"), f"{where}/last")


def rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members with their root, which is the text itself where it has no link."""
    return members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def across(members: DataFrame, roots: DataFrame, packed: DataFrame, where: str) -> DataFrame:
    """(a, b) of similar texts that share a bucket and lie in different components."""
    bucket = ["band", "bucket"]
    placed = materialize(rooted(members, roots), f"{where}/placed")
    parts = placed.groupBy(*bucket, "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy(*bucket).agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = materialize(mixed.select(*bucket, "main", "n", blocks(F.col("n") - F.col("most")).alias("n_x"), blocks(F.col("n")).alias("n_y")), f"{where}/mixed")
    at = joined(placed, mixed, bucket)
    turn = lambda of: F.pmod(F.xxhash64("rep"), of).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    x = at.where("root != main").select(*bucket, turn(F.col("n_x")).alias("x"), every("n_y").alias("y"), F.lit(0).alias("side"), "rep", "root")
    y = at.select(*bucket, every("n_x").alias("x"), turn(F.col("n_y")).alias("y"), F.lit(1).alias("side"), "rep", "root")
    key = [*bucket, "x", "y"]
    rows = x.unionByName(y).join(packed, "rep").repartition(*key).sortWithinPartitions(*key, "side", "rep")

    def compare(batches):
        hold("near-dups")
        at, left, right = None, [], []
        for b in batches:
            out: list[tuple[int, int]] = []
            for row in zip(*(b.column(c).to_pylist() for c in (*key, "side", "rep", "root", "vector")), strict=True):
                if row[:4] != at or len(right) == SIDE:
                    out += linked_across(left, right)
                    right = []
                    if row[:4] != at:
                        at, left = row[:4], []
                (right if row[4] else left).append((*row[5:7], *unpacked(row[7])))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["a", "b"])
        out = linked_across(left, right)
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def linked_across(left: list[tuple], right: list[tuple]) -> list[tuple[int, int]]:
    """(a, b) of similar texts of different roots, one of either list; entries: rep, root, hashes, weights, counts. A sum
    of roots of products is at least the sum of the smaller weights: what stays under the bound can't be similar."""
    if not left or not right:
        return []
    known = {v[0] for v in left}
    found, texts = np.unique(np.concatenate([v[2] for v in left] + [v[2] for v in right if v[0] not in known]), return_counts=True)
    columns = found[texts > 1]  # what one text has alone can't be shared
    if not len(columns):
        return []
    out = []
    for first in range(0, len(left), SIDE):
        some = left[first : first + SIDE]
        possible = np.zeros((len(some), len(right)), bool)
        for k in (3, 4):
            low = np.zeros((len(some), len(right)), np.float32)
            for c in range(0, len(columns), COLUMNS):
                low += _roots(some, columns[c : c + COLUMNS], k) @ _roots(right, columns[c : c + COLUMNS], k).T
            total = np.array([v[k].sum() for v in some])[:, None] + np.array([v[k].sum() for v in right])[None, :]
            possible |= low * (1 + SIMILARITY) >= SIMILARITY * total * (1 - 1e-4)
        for i, j in np.argwhere(possible).tolist():
            p, q = some[i], right[j]
            if p[1] != q[1] and alike(p[2:], q[2:]):
                out.append((min(p[0], q[0]), max(p[0], q[0])))
    return out


def _roots(texts: list[tuple], columns: np.ndarray, k: int) -> np.ndarray:
    """A row for each text: the roots of its weights (k = 3) or counts (4) of the shingles in these columns."""
    m = np.zeros((len(texts), len(columns)), np.float32)
    for i, v in enumerate(texts):
        a, z = np.searchsorted(v[2], columns[[0, -1]])
        h = v[2][a : z + 1]
        at = np.minimum(np.searchsorted(columns, h), len(columns) - 1)
        hit = columns[at] == h
        m[i, at[hit]] = np.sqrt(v[k][a : z + 1][hit])
    return m


def successors(members: DataFrame) -> DataFrame:
    """(a, b) of members of different roots next to each other in their bucket by signature. The order is dealt out by
    range, so a large bucket lies in many tasks; where a range ends, across() has the pair."""
    line = members.select("band", "bucket", "sig", "rep", "root").repartitionByRange("band", "bucket", "sig", "rep").sortWithinPartitions("band", "bucket", "sig", "rep")

    def next_to(batches):
        last = None
        for x in batches:
            keys = np.stack([x.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("band", "bucket", "rep", "root")], 1)
            if last is not None:
                keys = np.concatenate([last, keys])
            same = (keys[1:, 0] == keys[:-1, 0]) & (keys[1:, 1] == keys[:-1, 1]) & (keys[1:, 3] != keys[:-1, 3])
            a, b = keys[:-1, 2][same], keys[1:, 2][same]
            last = keys[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return line.mapInArrow(next_to, "a long, b long")


def components(edges: DataFrame, where: str) -> DataFrame:
    """(node, root): the smallest node that each node of the edges is connected with. In a round each node turns to its least
    neighbour if that is smaller; such paths are followed to their ends, and the edges go on between the ends, without
    those that have become loops. Of the ends of two rounds half the nodes at most are left. All is written to the shared
    folder."""
    left = materialize(_undirected(edges), f"{where}/edges-0")
    labels = None
    for i in range(100):
        if labels is not None and not left.limit(1).count():
            return labels
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).withColumn("root", F.least("node", "root"))
        up = _followed(materialize(up, f"{where}/up-{i}"), f"{where}/up-{i}")
        labels = up if labels is None else _relabelled(labels, up, f"{where}/labels-{i}")
        ends = left.join(up.withColumnsRenamed({"node": "a", "root": "of_a"}), "a").join(up.withColumnsRenamed({"node": "b", "root": "of_b"}), "b")
        left = materialize(_undirected(ends.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))), f"{where}/edges-{i + 1}")
    raise RuntimeError("components didn't settle")


def _undirected(edges: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b."""
    return edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _followed(up: DataFrame, where: str) -> DataFrame:
    """(node, root) with the ends of the paths that (node, root) makes, which fall; their lengths halve each time."""
    for i in range(100):
        far = up.select(F.col("node").alias("root"), F.col("root").alias("far"))
        nxt = materialize(up.join(far, "root").select("node", F.col("root").alias("old"), F.col("far").alias("root")), f"{where}-{i}")
        up = nxt.select("node", "root")
        if not nxt.where("old != root").limit(1).count():
            return up
    raise RuntimeError("paths didn't end")


def _relabelled(labels: DataFrame, up: DataFrame, where: str) -> DataFrame:
    """labels with the roots that their roots have in up, where they are there."""
    far = up.select(F.col("node").alias("root"), F.col("root").alias("far"))
    return materialize(labels.join(far, "root", "left").select("node", F.coalesce("far", "root").alias("root")), where)


def merged(roots: DataFrame, more: DataFrame, where: str) -> DataFrame:
    """(node, root) after further edges (a, b): only the roots that these join are worked on."""
    if not more.limit(1).count():
        return roots
    ends = rooted(rooted(more.withColumnRenamed("a", "rep"), roots).select(F.col("root").alias("a"), F.col("b").alias("rep")), roots)
    new = more.select(F.col("a").alias("node")).unionByName(more.select(F.col("b").alias("node"))).distinct().join(roots, "node", "left_anti")
    every = roots.unionByName(new.select("node", F.col("node").alias("root")))
    return _relabelled(every, components(ends.select("a", F.col("root").alias("b")), where), f"{where}/merged")


def _classes(docs: DataFrame, where: str) -> DataFrame:
    """(digest, n, class_id, chosen, alone) of every distinct text of rows that have a doc_id and words: chosen says that it
    stands for its class, as the text of the smallest doc_id (of its texts the one of smallest digest) does; alone that one
    row has it and it has no near copy."""
    _, texts = exact_classes(docs, where)
    roots = connected(texts.select("rep", "bytes", "text"), where).withColumnRenamed("node", "rep")
    own = texts.select("rep", "digest", "first", "n").join(roots, "rep", "left")
    near = materialize(own.where("root is not null"), f"{where}/near")
    chosen = near.groupBy("root").agg(F.min(F.struct("first", "digest")).alias("c"), F.count(F.lit(1)).alias("texts"))
    near = joined(near, chosen, ["root"], "texts").select("digest", "n", F.col("c.first").alias("class_id"), (F.col("digest") == F.col("c.digest")).alias("chosen"), F.lit(False).alias("alone"))
    single = own.where("root is null").select("digest", "n", F.col("first").alias("class_id"), F.lit(True).alias("chosen"), (F.col("n") == 1).alias("alone"))
    return materialize(near.unionByName(single), f"{where}/classes")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & text_of().rlike(WORDY)).select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("digest"))


def duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), kept (the row stands for its class) of every row."""
    own = joined(_keyed(docs), _classes(docs, work_dir(docs.sparkSession, "near-dups")), ["digest"])
    wordless = docs.where(F.col("doc_id").isNull() | ~text_of().rlike(WORDY)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("doc_id").cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return own.select("doc_id", "class_id", ((F.col("doc_id") == F.col("class_id")) & F.col("chosen")).alias("kept")).unionByName(wordless)


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each class left, all columns. Rows that repeat a doc_id and its text count as copies."""
    where = work_dir(docs.sparkSession, "near-dups-kept")
    own = columns_of(docs)
    classes = _classes(docs, where)
    # Rows that go, by doc_id and digest; a text of one row without near copies has none.
    some = joined(_keyed(docs), classes.where("not alone"), ["digest"])
    gone = materialize(some.where("not chosen or doc_id != class_id").select("doc_id", "digest").distinct(), f"{where}/gone")
    few = gone.count()
    key, text = free_name(docs, "key"), free_name(docs, "text_key")
    marked = docs.withColumns({key: F.col("doc_id").cast("long"), text: text_key()})
    gone = gone.withColumnsRenamed({"doc_id": key, "digest": text})
    left = marked.join(F.broadcast(gone) if few <= MOST_BROADCAST else gone, [key, text], "left_anti")
    again = some.where("chosen and doc_id = class_id").groupBy("doc_id", "digest").count().where("count > 1").drop("count")
    again = materialize(again.withColumnsRenamed({"doc_id": key, "digest": text}), f"{where}/again")
    if not again.limit(1).count():
        return left.select(*own)
    twice, number = free_name(docs, "again"), free_name(docs, "number")
    left = left.join(again.withColumn(twice, F.lit(True)), [key, text], "left")
    order = Window.partitionBy(key, text).orderBy(*[F.to_json(F.struct(c)) for c, name in zip(own, docs.columns) if name not in ("doc_id", "text")] or [F.lit(0)])
    first = left.where(F.col(twice)).withColumn(number, F.row_number().over(order)).where(F.col(number) == 1)
    return left.where(F.col(twice).isNull()).select(*own).unionByName(first.select(*own))
