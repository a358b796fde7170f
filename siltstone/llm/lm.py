"""Language-model scores from an Elias-Fano n-gram trie of order three.

Level one holds the words of the training texts: hashes in order as an Elias-Fano sequence, so that a word's id is its
rank, and exact counts. Level two holds, for every word b, its successors c; level three, for every pair a b, the words c
seen behind it, each as the place that c has among the successors of b alone (context-relative, so the numbers are small).
Level three is reached by the word b and its predecessor a, the same kind of list. In each list the numbers of a context,
raised by what the contexts before it took, are one monotone sequence; monotone pointers give a context's range, and a
search is for the number raised by the value before the range, within the range. Levels two and three hold smoothed
probabilities and backoff masses in 16-bit codes, even steps of their logarithms (STEP).

All files are memory-mapped and cut into parts of equal token mass, as many as the tokens need: by (b, c) in level two, by
(b, a) in level three. A frequent word lies in several parts; what belongs to it as a whole (its backoff mass, how many of
its successors lie in earlier parts) is a number for each part, held beside the borders of the parts. What a task builds
is bounded by a part and, beyond it, by the words that follow one pair. Counting tasks add up what they hold before they
pass it on, and a building task adds up what it has received whenever that grows large. Triples are added up, and put on
level three, in pieces by range of the context, so that what a task holds beside a part is a piece's.

Probability: interpolated Kneser-Ney with discounts for counts of 1, 2 and more. Level three: the count of a b c less its
discount over the count of a b, and the mass taken off times level two. Level two: how many words a were seen before b c,
less a discount, over that number for all c, and the mass taken off times the unigram (c + 0.1) / (N + 0.1 (V + 1)), so
every word, known or not, has a positive probability. Discounts follow from counts of counts; those of level two are
counted in each part, where a word in several parts counts once in each. The context of a text's first word is the end of
a text; a context that wasn't seen gives way to the next lower level.

Defined cases: a null or empty text is one end token; a null doc_id counts as held out; repeated rows count each; where
nothing is trained on, all scores are 0; very long texts are scored whole, of any number of distinct words; an empty table
gives no rows; ties don't arise; extra columns are ignored. Words are told apart by 64-bit hashes, and keys of two words are
one 64-bit number, so more than 2^32 - 2 distinct words in all are an error.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import elias_fano
from siltstone.llm.shared import distinct, materialize, posix_path, small_batches, text_of, work_dir, written_whole

#: Tokens of a part of levels two and three, on average, and words of a part of level one.
PART_TOKENS, PART_WORDS = 3_000_000, 500_000
#: Characters that are counted or scored at once; triples that a building task holds before it adds them up.
AT_ONCE, HELD = 1 << 22, 4_000_000
#: Triples that are added up or put on level three at once, about; a context's are never parted.
PIECE = 1 << 18
#: Parts of each level that a worker keeps open.
MOST_OPEN = 2_000
#: Distinct words from which a triple of their places doesn't fit 63 bits.
ONE_KEY = 1 << 21
#: What no word hashes from: it holds a blank.
END = b" "
#: Whether a byte parts words.
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\f"))
#: Codes of probabilities: 0 is none, each further one a step down from 1 in powers of ten.
STEP = 0.0002
_U = np.uint64


def tokens(text: str) -> list[bytes]:
    """Words with A-Z in lower case, then the end."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def codes(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.rint(-np.log10(p) / STEP), 0, 65534) + 1, 0).astype("<u2")


_DECODED = np.concatenate([[0.0], 10.0 ** (-STEP * np.arange(65535))])


def index(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: distinct word hashes in order; of each token its place among them; tokens of each text. They are those of
    tokens(), cut in one array of bytes for all texts."""
    lines = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"".join(x for line in lines for x in (line, END)), np.uint8)
    blank = _BLANK[data]
    edges = np.flatnonzero(np.diff(blank, prepend=True))
    starts, ends = edges[::2], edges[1::2]
    size = ends - starts
    words, codes = distinct(data[~blank], np.cumsum(size) - size)
    before = np.searchsorted(starts, np.cumsum([len(line) + 1 for line in lines], dtype=np.int64))
    sizes = np.diff(before, prepend=0) + 1
    at = np.full(len(codes) + len(lines), len(words), np.int64)
    own = np.ones(len(at), bool)
    own[np.cumsum(sizes) - 1] = False
    at[own] = codes
    words = [*words, END] if lines else words
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    order = np.argsort(hashes)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return hashes[order], rank[at], sizes


_END_HASH = np.array([xxhash.xxh64_intdigest(END)], np.uint64)


def triples(hashes: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct triples of a run of texts as contexts (b * n + a) and words c, places among its words, in order, where n - 1
    stands for what is before the end before a text; and of each token its triple."""
    n = len(hashes) + 1
    starts = np.cumsum(sizes) - sizes
    b = np.roll(at, 1)
    b[starts] = np.searchsorted(hashes, _END_HASH)[0]
    a = np.roll(b, 1)
    a[starts] = n - 1
    if n < ONE_KEY:
        key, token = np.unique((b * n + a) * n + at, return_inverse=True)
        return *np.divmod(key, n), token
    # Three places don't fit one number: contexts are numbered first, and there are no more of them than tokens.
    context, of = np.unique(b * n + a, return_inverse=True)
    key, token = np.unique(of * n + at, return_inverse=True)
    return context[key // n], key % n, token


def _groups(batches, columns, at_once):
    """Rows of the batches in runs of bounded length, column-wise."""
    held, size = [], 0
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
            held.append(row)
            size += len(row[-1])
            if size >= at_once:
                yield tuple(zip(*held))
                held, size = [], 0
    if held:
        yield tuple(zip(*held))


def _starts(*line: np.ndarray) -> np.ndarray:
    """Where a value of arrays in order begins."""
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in line])]))


def _find(seq: elias_fano.Sequence, keys: np.ndarray) -> np.ndarray:
    """Places of keys in order, of which each is searched once, however often it stands there."""
    first = _starts(keys)
    return np.repeat(seq.find(keys[first]), np.diff(first, append=len(keys)))


def _runs(of: np.ndarray):
    """(value, begin, end) of the runs of equal values."""
    if len(of):
        cuts = (np.flatnonzero(of[1:] != of[:-1]) + 1).tolist()
        for a, z in zip([0, *cuts], [*cuts, len(of)], strict=True):
            yield int(of[a]), a, z


def _add_up(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, successor) of runs in order, and the sums of their counts. Empties the list."""
    contexts, nexts, counts = (np.concatenate([r[i] for r in held]) for i in range(3))
    held.clear()
    known, place = np.unique(contexts, return_inverse=True)
    key, counts = elias_fano.sums(place.astype(np.uint64) << _U(32) | nexts, counts)
    return known[(key >> _U(32)).astype(np.int64)], (key & _U(0xFFFFFFFF)).astype(np.uint32), counts


def _pieces(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """What _add_up() makes of runs of which each is in order, in pieces by range of the context."""
    # Of every run a context in `step`: those that part the pieces are off by `step` rows of each run, an eighth of a piece.
    step = max(1, PIECE // (8 * len(held)))
    borders = np.unique(np.sort(np.concatenate([r[0][::step] for r in held]))[PIECE // step :: PIECE // step])
    cuts = [[0, *np.searchsorted(r[0], borders).tolist(), len(r[0])] for r in held]
    for i in range(len(borders) + 1):
        if own := [tuple(x[c[i] : c[i + 1]] for x in r) for r, c in zip(held, cuts, strict=True) if c[i] < c[i + 1]]:
            yield _add_up(own)


def _read_raw(path: str):
    """(sizes of contexts, successors, counts) of the pieces of a part's raw triples."""
    with open(path, "rb") as f:
        while head := f.read(24):
            n_contexts, n, size = np.frombuffer(head, "<u8").astype(int).tolist()
            raw = _unpacked(f.read(size))
            yield raw[:n_contexts].astype(np.int64), raw[n_contexts : n_contexts + n], raw[n_contexts + n :].astype(np.float64)


def _level(starts: np.ndarray, numbers: np.ndarray) -> list[np.ndarray]:
    """Pointers to the ranges that begin at `starts`, and the ranges' numbers, rising in each, as one monotone sequence."""
    ends = np.append(starts[1:], len(numbers))
    took = np.cumsum(numbers[ends - 1].astype(np.uint64) + _U(1))
    raised = np.repeat(np.append(_U(0), took[:-1]), ends - starts)
    raised += numbers.astype(np.uint64, copy=False)
    return [*elias_fano.encode(np.append(starts, len(numbers)), len(numbers) + 1), *elias_fano.encode(raised, int(took[-1]))]


class Level:
    """What _level() made."""

    def __init__(self, arrays: list[np.ndarray]):
        self.pointers, self.values = elias_fano.Sequence(*arrays[:4]), elias_fano.Sequence(*arrays[4:8])

    def begin(self, of: np.ndarray) -> np.ndarray:
        return self.pointers.get(of).astype(np.int64)

    def search(self, of: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each number in its context's range, -1 where it isn't there, and where that range begins. Contexts
        come in order, and the numbers of each."""
        first = _starts(of) if len(of) else np.empty(0, np.int64)
        size = np.diff(first, append=len(of))
        begin, end = self.begin(of[first]), self.begin(of[first] + 1)
        base = np.where(begin > 0, self.values.get(np.maximum(begin - 1, 0)) + _U(1), _U(0))
        at = self.values.find(np.repeat(base, size) + numbers.astype(np.uint64))
        begin = np.repeat(begin, size)
        return np.where((at >= begin) & (at < np.repeat(end, size)), at, -1), begin


class Words:
    """Level one: parts by range of the hash."""

    def __init__(self, folder: str, parts: list[tuple[int, int, int, int]], total: int):
        #: Of each part: number of its file, first hash, first id, tokens before.
        self.folder, self.parts, self.total = folder, parts, total
        self.first, self.before = np.array([p[1] for p in parts], np.uint64), np.array([p[3] for p in parts], np.float64)
        self.open: dict[int, tuple] = {}

    def part(self, k: int) -> tuple[elias_fano.Sequence, np.ndarray, np.ndarray]:
        if k not in self.open:
            if len(self.open) >= MOST_OPEN:
                self.open.clear()
            *seq, counts, sums = elias_fano.load(f"{self.folder}/{self.parts[k][0]:06d}.words")
            self.open[k] = (elias_fano.Sequence(*seq), counts, sums)
        return self.open[k]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of hashes in order."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        if not len(self.parts):
            return ids, counts
        for k, a, z in _runs(np.searchsorted(self.first, hashes, "right") - 1):
            if k < 0:
                continue
            seq, count, _ = self.part(k)
            at = seq.find(hashes[a:z] - self.first[k])
            hit = at >= 0
            ids[a:z][hit] = at[hit] + self.parts[k][2]
            counts[a:z][hit] = count[at[hit]]
        return ids, counts

    def id_at_mass(self, mass: float) -> tuple[int, float, int]:
        """The id whose tokens hold the given place of all tokens in order of id; the tokens before it, and its own."""
        k = max(0, int(np.searchsorted(self.before, mass, "right")) - 1)
        _, count, sums = self.part(k)
        i = min(int(np.searchsorted(sums, max(0, mass - self.parts[k][3]), "right")), len(sums) - 1)
        return self.parts[k][2] + i, self.parts[k][3] + int(sums[i]) - int(count[i]), int(count[i])


def _borders(words: Words, width: int, parts: int) -> np.ndarray:
    """Keys word * width + other that bound the parts: equal token mass by the count of the word; inside a word that is
    more than a part, by the counts of the other."""
    out = []
    for j in range(1, parts):
        first, before, own = words.id_at_mass(words.total * j / parts)
        rest = (words.total * j / parts - before) / max(1, own)
        second = words.id_at_mass(words.total * min(max(rest, 0.0), 1.0))[0] if own * parts > words.total else 0
        out.append(first * width + second)
    return np.unique(np.array([0, *out], np.uint64))


class Trie:
    """Levels two and three over the words. A part is opened when it is asked for."""

    def __init__(self, folder: str, words: Words, borders: np.ndarray, v: int, split: dict[int, float] | None = None, skip: np.ndarray | None = None, discounts=()):
        self.folder, self.words, self.borders, self.v = folder, words, borders, v
        #: Keys are word * width + other; v stands before the end before a text.
        self.width = v + 1
        #: Backoff mass of the words that lie in several parts; of each part, successors of its first word in earlier ones.
        self.split, self.skip, self.discounts = split or {}, skip if skip is not None else np.zeros(len(borders), np.int64), discounts
        self.open: dict[tuple[int, str], tuple | None] = {}

    def part(self, k: int, kind: str) -> tuple | None:
        key = (k, kind)
        if key not in self.open:
            if len(self.open) >= 3 * MOST_OPEN:
                self.open.clear()
            try:
                a = elias_fano.load(f"{self.folder}/{k:06d}.{kind}")
            except FileNotFoundError:  # no triple has a key in this part
                a = None
            if a is None:
                self.open[key] = None
            elif kind == "triples":
                self.open[key] = (Level(a), a[8], a[9])
            else:
                self.open[key] = (elias_fano.Sequence(*a[:4]), Level(a[4:]), *a[12:])
        return self.open[key]

    def _parts(self, keys: np.ndarray, kind: str):
        """(number, opened part, begin, end, word, other) of the runs of keys that share a part."""
        for k, a, z in _runs(np.searchsorted(self.borders, keys, "right") - 1):
            if part := self.part(k, kind):
                word, other = np.divmod(keys[a:z], _U(self.width))
                yield k, part, a, z, word, other

    def pairs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of keys b * width + c in order: the place of c among the successors of b (-1: not seen), and the discounted
        probability."""
        rank, p = np.full(len(keys), -1, np.int64), np.zeros(len(keys))
        for k, (firsts, level, code, _), a, z, b, c in self._parts(keys, "pairs"):
            of = _find(firsts, b)
            some = np.flatnonzero(of >= 0)
            at, begin = level.search(of[some], c[some])
            hit = at >= 0
            some, at = some[hit], at[hit]
            rank[a + some] = at - begin[hit] + np.where(of[some] == 0, self.skip[k], 0)
            p[a + some] = _DECODED[code[at]]
        return rank, p

    def backoff(self, words: np.ndarray) -> np.ndarray:
        """Mass that level two leaves to the unigram behind words in order; all of it behind one that has no successor."""
        out = np.ones(len(words))
        for _, (firsts, _, _, mass), a, z, b, _ in self._parts(words.astype(np.uint64) * _U(self.width), "pairs"):
            of = firsts.find(b)
            out[a:z][of >= 0] = _DECODED[mass[of[of >= 0]]]
        if self.split:
            ids = np.array(sorted(self.split), np.int64)
            at = np.minimum(np.searchsorted(ids, words), len(ids) - 1)
            hit = ids[at] == words
            out[hit] = np.array([self.split[i] for i in ids.tolist()])[at[hit]]
        return out

    def third(self, keys: np.ndarray, of: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of contexts b * width + a in order, and of successors by context and rank: each successor's discounted
        probability, and the mass that its context leaves to level two (1 where the context wasn't seen)."""
        p, mass = np.zeros(len(of)), np.ones(len(of))
        for k, (firsts, level, *_), a, z, b, other in self._parts(keys, "contexts"):
            word = _find(firsts, b)
            some = np.flatnonzero(word >= 0)
            at, _ = level.search(word[some], other[some])
            place = np.full(z - a, -1, np.int64)
            place[some] = at
            last, code, left = self.part(k, "triples")
            begin, end = np.searchsorted(of, [a, z])
            here = place[of[begin:end] - a]
            seen = np.flatnonzero(here >= 0)
            mass[begin + seen] = _DECODED[left[here[seen]]]
            seen = seen[rank[begin + seen] >= 0]
            at, _ = last.search(here[seen], rank[begin + seen])
            hit = at >= 0
            p[begin + seen[hit]] = _DECODED[code[at[hit]]]
        return p, mass


def _write_words(counted: DataFrame, folder: str) -> tuple[Words, int, int]:
    """Level one from (h, c): parts by range of the unsigned hash; ids by prefix sums over the parts."""
    path = posix_path(folder)
    n = counted.count()
    # The order of unsigned hashes is that of signed ones with the top bit turned.
    line = counted.withColumn("h", F.col("h").bitwiseXOR(F.lit(-(1 << 63)))).repartitionByRange(max(1, -(-n // PART_WORDS)), "h").sortWithinPartitions("h")

    def write(batches):
        from pyspark import TaskContext

        hs, cs = [], []
        for b in batches:
            hs.append(b.column("h").to_numpy(zero_copy_only=False))
            cs.append(b.column("c").to_numpy(zero_copy_only=False))
        if not hs or not sum(map(len, hs)):
            return
        h = np.concatenate(hs).astype(np.int64).view(np.uint64) ^ _U(1 << 63)
        c = np.concatenate(cs).astype("<u8")
        part = TaskContext.get().partitionId()
        elias_fano.save(f"{path}/{part:06d}.words", [*elias_fano.encode(h - h[0], int(h[-1] - h[0]) + 1), c, np.cumsum(c, dtype="<u8")])
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "first": pa.array([int(h[:1].view(np.int64)[0])], pa.int64()), "n": pa.array([len(h)], pa.int64()), "mass": pa.array([int(c.sum())], pa.int64())})

    rows = sorted(materialize(line.mapInArrow(write, "part long, first long, n long, mass long"), f"{folder}/words-manifest").collect(), key=lambda r: r["part"])
    out, ids, mass = [], 0, 0
    for r in rows:
        out.append((r["part"], r["first"] % (1 << 64), ids, mass))
        ids, mass = ids + r["n"], mass + r["mass"]
    return Words(path, out, mass), ids, mass


def _blobs(part: np.ndarray, borders: np.ndarray, keys: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    """A row for each part that keys in order fall into: differences of its keys, then the further numbers, packed."""
    got = list(_runs(part))
    packed = [_packed(np.concatenate([np.diff(keys[a:z], prepend=borders[k]), *(x[a:z].astype(np.uint64) for x in more)])) for k, a, z in got]
    return pa.RecordBatch.from_arrays([pa.array([k for k, *_ in got], pa.int32()), pa.array([z - a for _, a, z in got], pa.int64()), pa.array(packed, pa.binary())], ["part", "n", "blob"])


def _by_part(batches, borders: np.ndarray, width: int):
    """(part, its packed rows' arrays: keys and further numbers, one row at a time) of rows that come in order of part."""
    rows = ((k, n, blob) for b in batches for k, n, blob in zip(b.column("part").to_pylist(), b.column("n").to_pylist(), b.column("blob").to_pylist(), strict=True))
    for k, own in itertools.groupby(rows, key=lambda r: r[0]):
        yield k, ((np.cumsum(x[0], dtype=np.uint64) + borders[k], *x[1:]) for _, n, blob in own for x in [_unpacked(blob).reshape(width, n)])


def train(texts: DataFrame, folder: str) -> tuple[Trie, int, int]:
    """(trie, N, V) of a frame with a column text; files go below `folder` (a URI on a shared mount)."""
    spark = texts.sparkSession
    path = posix_path(folder)
    only = texts.select("text")

    def unigrams(batches):
        for (group,) in _groups(batches, ["text"], AT_ONCE):
            h, at, _ = index(group)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.bincount(at, minlength=len(h)))], ["h", "c"])

    small_batches(spark)
    counted = materialize(only.mapInArrow(unigrams, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), f"{folder}/unigrams")
    words, v, total = _write_words(counted, folder)
    if not total:
        return Trie(path, words, np.array([0], np.uint64), 1), 0, 0
    if v >= (1 << 32) - 1:
        raise ValueError("more than 2^32 distinct words: keys don't fit 64 bits")
    width = v + 1
    borders = _borders(words, width, max(1, -(-total // PART_TOKENS)))
    words.open.clear()
    n_parts = len(borders)
    inside = borders[borders % _U(width) != 0] // _U(width)
    split = set(inside.astype(np.int64).tolist())
    shared = spark.sparkContext.broadcast((words, borders))

    def shares(k: int) -> bool:
        """Whether a part has a share of a word in several parts."""
        return bool((shared.value[1][k : k + 2] % _U(width)).any())

    def count(batches):
        words, borders = shared.value
        for (group,) in _groups(batches, ["text"], AT_ONCE):
            h, at, sizes = index(group)
            context, c, place = triples(h, at, sizes)
            n = len(h) + 1
            b, a = np.divmod(context, n)
            ids = np.append(words.find(h)[0], v).astype(np.uint64)
            keys = ids[b] * _U(width) + ids[a]
            yield _blobs(np.searchsorted(borders, keys, "right") - 1, borders, keys, ids[c], np.bincount(place))

    def build(batches):
        """Contexts, and the raw triples for level three; passes on, of every pair b c, how many words came before it."""
        borders = shared.value[1]
        for k, runs in _by_part(batches, borders, 3):
            held, n = [], 0
            for keys, c, count in runs:
                held.append((keys, c.astype(np.uint32), count.astype(np.int64)))
                n += len(keys)
                if n > HELD:
                    pieces = list(zip(*_pieces(held), strict=True))
                    held.clear()  # one column at a time is held twice
                    held.append(tuple(np.concatenate(pieces.pop(0)) for _ in range(3)))
                    n = 0 if len(held[0][0]) > HELD // 2 else len(held[0][0])
            contexts, sizes, pairs, ones = [], [], [], np.zeros(4, np.int64)
            with written_whole(f"{path}/{k:06d}.raw") as (raw,):
                for keys, c, count in _pieces(held):
                    starts = _starts(keys)
                    size = np.diff(starts, append=len(c))
                    packed = _packed(np.concatenate([size.astype(np.uint64), c.astype(np.uint64), count.astype(np.uint64)]))
                    raw.write(np.array([len(size), len(c), len(packed)], "<u8").tobytes() + packed)
                    contexts.append(keys[starts])
                    sizes.append(size)
                    pairs.append(np.unique(keys // _U(width) * _U(width) + c, return_counts=True))
                    ones += [(count == i).sum() for i in (1, 2, 3, 4)]
            held.clear()
            b, a = np.divmod(np.concatenate(contexts), _U(width))
            size = np.concatenate(sizes)
            first = _starts(b)
            elias_fano.save(f"{path}/{k:06d}.contexts", [*elias_fano.encode(b[first], int(b[-1]) + 1), *_level(first, a)])
            pair, before = elias_fano.sums(*map(np.concatenate, zip(*pairs, strict=True)))
            out = _blobs(np.searchsorted(borders, pair, "right") - 1, borders, pair, before)
            edge = (int(b[0]), int(size[b == b[0]].sum()), int(b[-1]), int(size[b == b[-1]].sum()))
            stats = [*edge, *ones.tolist(), *(int((before == i).sum()) for i in (1, 2, 3, 4))]
            only_first = lambda x: pa.array([x] + [None] * (out.num_rows - 1), pa.int64())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([*out.columns, *map(only_first, [k, int(shares(k)), *stats])], [*out.schema.names, *MADE])

    def second(batches):
        """Level two of a part."""
        words, borders = shared.value
        d, totals = weights.value
        for k, runs in _by_part(batches, borders, 2):
            keys, before = elias_fano.sums(*map(np.concatenate, zip(*runs)))
            b, c = np.divmod(keys, _U(width))
            first = _starts(b)
            given = d[np.minimum(before, 3).astype(np.int64)]
            all_ = np.add.reduceat(before.astype(np.float64), first)
            own = b[first].astype(np.int64)
            for i in {0, len(own) - 1}:
                all_[i] = totals.get(int(own[i]), all_[i])
            mass = np.add.reduceat(given, first)
            size = np.diff(first, append=len(b))
            elias_fano.save(f"{path}/{k:06d}.pairs", [*elias_fano.encode(b[first], int(b[-1]) + 1), *_level(first, c), codes((before - given) / np.repeat(all_, size)), codes(np.minimum(mass / all_, 1.0))])
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int64()), "edge": pa.array([int(shares(k))], pa.int64()), **{n: pa.array([x], t) for n, x, t in (("w1", int(own[0]), pa.int64()), ("n1", int(size[0]), pa.int64()), ("m1", float(mass[0] / all_[0]), pa.float64()), ("w2", int(own[-1]), pa.int64()), ("n2", int(size[-1]), pa.int64()), ("m2", float(mass[-1] / all_[-1]), pa.float64()))}})

    def third(batches):
        """Level three of a part, from its raw triples."""
        where, borders, split_mass, skip, d = last.value
        trie = Trie(where, shared.value[0], borders, v, split_mass, skip)
        for batch in batches:
            for k in batch.column("k").to_pylist():
                firsts, level = trie.part(k, "contexts")
                b = np.repeat(firsts.get(np.arange(firsts.n)), np.diff(level.begin(np.arange(firsts.n + 1))))
                done, sizes, ranks, own, left = 0, [], [], [], []
                for size, c, count in _read_raw(f"{path}/{k:06d}.raw"):
                    pair, place = np.unique(np.repeat(b[done : done + len(size)], size) * _U(width) + c, return_inverse=True)
                    rank = trie.pairs(pair)[0]
                    if (rank < 0).any():
                        raise AssertionError("a pair of a triple isn't in level two")
                    given = d[np.minimum(count, 3).astype(np.int64)]
                    starts = np.cumsum(size) - size
                    whole = np.add.reduceat(count, starts)
                    done += len(size)
                    sizes.append(size)
                    ranks.append(rank.astype(np.uint32)[place])
                    own.append(codes((count - given) / np.repeat(whole, size)))
                    left.append(codes(np.minimum(np.add.reduceat(given, starts) / whole, 1.0)))
                size, rank, own, left = map(np.concatenate, (sizes, ranks, own, left))
                elias_fano.save(f"{path}/{k:06d}.triples", [*_level(np.cumsum(size) - size, rank), own, left])
                trie.open.clear()
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64())})

    dealt = only.mapInArrow(count, BLOB).repartition(n_parts, "part").sortWithinPartitions("part")
    made = materialize(dealt.mapInArrow(build, f"{BLOB}, {', '.join(f'{x} long' for x in MADE)}"), f"{folder}/built")
    own = made.where("k is not null")
    sums = own.agg(*(F.sum(x).alias(x) for x in MADE[6:])).first()
    d3, d2 = (np.array([0.0, *_discounts(*(sums[f"{x}{i}"] for i in (1, 2, 3, 4)))]) for x in "tp")
    # Of the parts that hold a share of a word in several parts: a few numbers each.
    totals: dict[int, int] = defaultdict(int)
    for r in own.where("edge = 1").select("w1", "x1", "w2", "x2").toLocalIterator():
        for w, x in {(r["w1"], r["x1"]), (r["w2"], r["x2"])}:
            if w in split:
                totals[w] += x
    weights = spark.sparkContext.broadcast((d2, dict(totals)))
    paired = materialize(made.select("part", "n", "blob").repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(second, "part long, edge long, w1 long, n1 long, m1 double, w2 long, n2 long, m2 double"), f"{folder}/paired")
    mass: dict[int, float] = defaultdict(float)
    skip, so_far = np.zeros(n_parts, np.int64), {}
    for r in sorted(paired.where("edge = 1").collect(), key=lambda r: r["part"]):
        skip[r["part"]] = so_far.get(r["w1"], 0)
        for w, n, m in {(r["w1"], r["n1"], r["m1"]), (r["w2"], r["n2"], r["m2"])}:
            if w in split:
                so_far[w] = so_far.get(w, 0) + n
                mass[w] += m
    last = spark.sparkContext.broadcast((path, borders, dict(mass), skip, d3))
    materialize(own.select("k").repartition(n_parts, "k").mapInArrow(third, "k long"), f"{folder}/third")
    return Trie(path, words, borders, v, {w: min(m, 1.0) for w, m in mass.items()}, skip, (d2[1:].tolist(), d3[1:].tolist())), total, v


BLOB = "part int, n long, blob binary"
#: Of a part: its number, whether it has a share of a word in several parts, its first and last word with their triples,
#: counts of counts of triples and pairs.
MADE = ("k", "edge", "w1", "x1", "w2", "x2", *(f"{x}{i}" for x in "tp" for i in (1, 2, 3, 4)))


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts, each between 0 and the count."""
    if not n1 or not n2:
        return (0.5, 0.75, 0.75)
    y = n1 / (n1 + 2 * n2)
    bound = lambda d, c: min(max(d, 0.05 * c), 0.98 * c)
    return bound(1 - 2 * y * n2 / n1, 1), bound(2 - 3 * y * n3 / n2, 2), bound(3 - 4 * y * n4 / max(1, n3), 3)


def _varints(x: np.ndarray) -> bytes:
    """How many numbers, of each how many bytes it has without its leading zeros, and these bytes, the lowest first."""
    x = np.ascontiguousarray(x, "<u8")
    size = np.zeros(len(x), np.uint8)
    for k in range((int(x.max()) if len(x) else 0).bit_length() + 7 >> 3):
        size += x >= _U(1 << 8 * k)
    return len(x).to_bytes(8, "little") + size.tobytes() + x.view(np.uint8).reshape(-1, 8)[_HELD[size]].tobytes()


#: Of each size of a number, which of its eight bytes are held.
_HELD = np.arange(8) < np.arange(9)[:, None]


def _read_varints(data: np.ndarray) -> np.ndarray:
    n = int(data[:8].view("<u8")[0])
    out = np.zeros((n, 8), np.uint8)
    out[_HELD[data[8 : 8 + n]]] = data[8 + n :]
    return out.view("<u8").ravel()


def _packed(x: np.ndarray) -> bytes:
    """Numbers, compressed, behind the size of what they decompress to."""
    raw = _varints(x)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpacked(blob: bytes) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(pa.py_buffer(blob).slice(8), int.from_bytes(blob[:8], "little"))
    return _read_varints(np.frombuffer(raw, np.uint8))


class Scorer:
    def __init__(self, trie: Trie, total: int, v: int):
        self.trie, self.total = trie, total
        self.floor = total + 0.1 * (v + 1)

    def score(self, texts: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n_tokens, n_known, base_score, score of each text."""
        trie, width = self.trie, _U(self.trie.width)
        h, at, sizes = index(texts)
        ids, counts = trie.words.find(h)
        starts = np.cumsum(sizes) - sizes
        uni = (counts + 0.1) / self.floor
        base = np.add.reduceat(np.log10(uni)[at], starts)
        known = np.add.reduceat((counts > 0).astype(np.int64)[at], starts)
        n = len(h) + 1
        context, c, token = triples(h, at, sizes)
        ids = np.append(ids, trie.v)
        # Level two, of the distinct pairs.
        pair, of_pair = np.unique(context // n * n + c, return_inverse=True)
        b, second = np.divmod(pair, n)
        first = _starts(b)
        size = np.diff(first, append=len(b))
        mass, seen = np.ones(len(first)), ids[b[first]] >= 0
        mass[seen] = trie.backoff(ids[b[first][seen]])
        some = np.flatnonzero((ids[b] >= 0) & (ids[second] >= 0))
        rank, p = np.full(len(pair), -1, np.int64), np.zeros(len(pair))
        rank[some], p[some] = trie.pairs(ids[b[some]].astype(np.uint64) * width + ids[second[some]].astype(np.uint64))
        p += np.repeat(mass, size) * uni[second]
        # Level three, of the distinct triples.
        p, rank = p[of_pair], rank[of_pair]
        begin = _starts(context)
        word, other = np.divmod(context[begin], n)
        seen = (ids[word] >= 0) & (ids[other] >= 0)
        place = np.cumsum(seen) - 1
        of = np.repeat(np.where(seen, place, -1), np.diff(begin, append=len(context)))
        some = np.flatnonzero(of >= 0)
        own, left = trie.third(ids[word[seen]].astype(np.uint64) * width + ids[other[seen]].astype(np.uint64), of[some], rank[some])
        p[some] = own + left * p[some]
        return sizes, known, base, np.add.reduceat(np.log10(p)[token], starts)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; learned from those whose
    crc32(doc_id as text) mod 10 isn't 0."""
    spark = docs.sparkSession
    folder = work_dir(spark, "lm")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True))
    rows = docs.select("doc_id", held.alias("held_out"), text_of().alias("text"))
    trie, total, v = train(rows.where("not held_out"), folder)
    trie.words.open.clear()
    shared = spark.sparkContext.broadcast((trie, total, v))

    def score(batches):
        scorer = Scorer(*shared.value)
        for ids, held_out, texts in _groups(batches, ["doc_id", "held_out", "text"], AT_ONCE):
            if total:
                n, known, base, got = scorer.score(texts)
            else:
                n = np.array([len(tokens(t)) for t in texts], np.int64)
                known, base, got = np.zeros(len(n), np.int64), np.zeros(len(n)), np.zeros(len(n))
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(held_out, pa.bool_()), pa.array(n), pa.array(known), pa.array([total] * len(n), pa.int64()), pa.array(base), pa.array(got)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())
    small_batches(spark)
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
