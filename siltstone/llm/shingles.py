"""Word shingles as 64-bit hashes, and the document frequency of every shingle.

Document frequencies lie in files: parts by range of the hash, each an Elias-Fano sequence of the shingles that two texts
or more have, with exact counts. What isn't there has a frequency of 1. Parts are as many as the texts' bytes need, and
a worker maps those that it asks for.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from siltstone.llm import elias_fano
from siltstone.llm.shared import hold, materialize, posix_path, small_batches

WORDS = 5
#: Bytes of text for each part of the document frequencies; bytes that are counted at once; parts that stay open.
PART_BYTES, AT_ONCE, MOST_OPEN = 8 << 20, 4 << 20, 5_000
_ROTATE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_rows(texts: Iterable[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its distinct shingle hashes in order, and how often each occurs: where each text's begin (and the end
    of all), hashes, counts. A text of fewer words has one shingle of all its words; one without words has none. ASCII
    case and white space don't count."""
    local: dict[bytes, int] = defaultdict(itertools.count().__next__)
    at: list[int] = []
    sizes = []
    for t in texts:
        ws = t.encode("utf-8", "surrogatepass").lower().split()
        at.extend(map(local.__getitem__, ws))
        sizes.append(len(ws))
    size = np.array(sizes, np.int64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, local), np.uint64, len(local))[np.array(at, np.int64)]
    of = np.repeat(np.arange(len(size)), size)
    begin = np.cumsum(size) - size
    found, texts_of = [], []
    for k in range(1, words + 1):
        # Windows of k words: of all texts that are long enough, or of those that have just k.
        if k == words:
            first = np.flatnonzero(of[: max(0, len(of) - k + 1)] == of[k - 1 :])
        else:
            first = begin[size == k]
        if not len(first):
            continue
        acc = w[first].copy()
        for i in range(1, k):
            acc = mix(acc * _ROTATE + w[first + i])
        found.append(mix(acc))
        texts_of.append(of[first])
    if not found:
        return np.zeros(len(size) + 1, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    h, t = np.concatenate(found), np.concatenate(texts_of)
    order = np.argsort(h)
    order = order[np.argsort(t[order].astype(np.uint16 if len(size) < 1 << 16 else np.int64), kind="stable")]
    h, t = h[order], t[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])]))
    return np.searchsorted(t[new], np.arange(len(size) + 1)), h[new], np.diff(new, append=len(h))


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text in order, and how often each occurs."""
    return shingle_rows([text], words)[1:]


class Frequencies:
    """In how many of all texts a shingle occurs."""

    def __init__(self, folder: str, parts: int, texts: int):
        self.folder, self.parts, self.texts = folder, parts, texts
        self.open: dict[int, tuple | None] = {}

    def part_of(self, h: np.ndarray) -> np.ndarray:
        """Parts by the top 32 bits; in order of the hash."""
        return ((h >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)).astype(np.int64)

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Of distinct hashes in order."""
        out = np.ones(len(h), np.int64)
        of = self.part_of(h)
        cuts = (np.flatnonzero(of[1:] != of[:-1]) + 1).tolist()
        for a, z in zip([0, *cuts], [*cuts, len(h)], strict=True):
            if a == z:
                continue
            k = int(of[a])
            if k not in self.open:
                if len(self.open) >= MOST_OPEN:
                    self.open.clear()
                try:
                    *seq, n = elias_fano.load(f"{self.folder}/{k:06d}.df")
                    self.open[k] = (elias_fano.Sequence(*seq), n)
                except FileNotFoundError:  # none of its shingles is in two texts
                    self.open[k] = None
            if self.open[k]:
                seq, n = self.open[k]
                at = seq.find(h[a:z])
                out[a:z][at >= 0] = n[at[at >= 0]]
        return out

    def weights(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """TF-IDF of shingles, in any order: the count times log((N + 1) / df) over log(N + 1), which is 1 for a shingle of
        one text and still over 0 for one of all texts."""
        known, back = np.unique(h, return_inverse=True)
        df = self.counts(known)
        idf = np.where(df == 1, 1.0, np.log((self.texts + 1) / df) / np.log(self.texts + 1))
        return tf * idf[back]


def count_frequencies(texts: DataFrame, folder: str, n_texts: int, n_bytes: int) -> Frequencies:
    """Document frequencies of all shingles of a frame with a column text, in files below `folder` (a URI on a shared
    mount). Tasks add up what they have read at a time; sums meet by range of the hash."""
    path = posix_path(folder)
    small_batches(texts.sparkSession)
    out = Frequencies(path, max(1, -(-n_bytes // PART_BYTES)), n_texts)

    def count(batches):
        hold("near-dups")
        held, size = [], 0

        def sums():
            h, n = np.unique(shingle_rows(held)[1], return_counts=True)
            of = out.part_of(h)
            cuts = (np.flatnonzero(of[1:] != of[:-1]) + 1).tolist()
            runs = [(a, z) for a, z in zip([0, *cuts], [*cuts, len(h)], strict=True) if a < z]
            # A run of hashes is an Elias-Fano sequence above its first; counts are mostly 1.
            blobs = [b"".join(x.tobytes() for x in (h[a : a + 1], *elias_fano.encode(h[a:z] - h[a], int(h[z - 1] - h[a]) + 1)[:3])) for a, z in runs]
            more = [np.stack([np.flatnonzero(n[a:z] > 1), n[a:z][n[a:z] > 1]]).astype("<u4").tobytes() for a, z in runs]
            return pa.RecordBatch.from_arrays([pa.array([int(of[a]) for a, _ in runs], pa.int32()), pa.array(blobs, pa.binary()), pa.array(more, pa.binary())], ["part", "hashes", "more"])

        for b in batches:
            for t in b.column("text").to_pylist():
                held.append(t)
                size += len(t)
                if size >= AT_ONCE:
                    yield sums()
                    held, size = [], 0
        if held:
            yield sums()

    def build(batches):
        rows = (r for b in batches for r in zip(b.column("part").to_pylist(), b.column("hashes").to_pylist(), b.column("more").to_pylist(), strict=True))
        for k, own in itertools.groupby(rows, key=lambda r: r[0]):
            hs, ns = [], []
            for _, blob, more in own:
                x = np.frombuffer(blob, np.uint64)
                low = int(x[4])
                high = x[5 + low :]
                zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))]).astype(np.uint64)
                hs.append(elias_fano.Sequence(x[1:5], x[5 : 5 + low], high, zeros).get(np.arange(int(x[1]))) + x[0])
                n = np.ones(len(hs[-1]), np.int64)
                places, counts = np.frombuffer(more, "<u4").reshape(2, -1)
                n[places] = counts
                ns.append(n)
            h, n = elias_fano.sums(np.concatenate(hs), np.concatenate(ns))
            h, n = h[n > 1], n[n > 1]
            if len(h):
                elias_fano.save(f"{path}/{k:06d}.df", [*elias_fano.encode(h, int(h[-1]) + 1), n.astype("<u8")])
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32())})

    dealt = texts.select("text").mapInArrow(count, "part int, hashes binary, more binary").repartition(out.parts, "part").sortWithinPartitions("part")
    materialize(dealt.mapInArrow(build, "part int"), f"{folder}/df-manifest")
    return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller weights over the sum of the larger ones; hashes in order."""
    (ha, wa), (hb, wb) = a, b
    total = float(wa.sum() + wb.sum())
    if not total:
        return 0.0
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    hit = hb[at] == ha
    low = float(np.minimum(wa[hit], wb[at[hit]]).sum())
    return low / (total - low)
