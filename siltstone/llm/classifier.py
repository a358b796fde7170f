"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features of a text are indicators of its n-grams: of bytes (one to four), of words (one and two), and of three in a row of
how far back a word was last seen (one to eight words, or further). They are hashed to 2^18 places. Each indicator is
scaled by the log-count ratio of its place between good and bad texts, scaled vectors have length one, and a linear model
of hinge loss is fitted to them by dual coordinate descent. The weights are blended with their mean, which leans towards
the counts alone. Margins become scores by a logistic curve, fitted on margins of texts that the model hadn't seen.

The fit is on a bounded sample: SAMPLE labelled documents, in order of a hash of their ids, of at most MOST_FEATURES
places each (a text of more is left out, the others stay); so at most SAMPLE * MOST_FEATURES numbers reach the driver. The
model that tasks get is 2^18 weights, at any size of the input. Every text is scored whole, in blocks of bounded memory.

Defined cases: null and empty texts have no n-grams, their score is that of the bias alone; very long texts are scored whole
(only a word of over a megabyte is cut); repeated rows are scored each, and of those of one id one text is learned; of
different labels for an id the smallest holds; a null doc_id isn't held out and has no label; labels of one kind, or none,
give every text the share of good ones, smoothed; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import hold, small_batches, text_of

BITS = 18
#: Most labelled documents that are learned from, and most places that one of them may have.
SAMPLE, MOST_FEATURES = 4000, 32_768
#: One in FOLDS documents, by a hash of the id, is held out: the one of this remainder.
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
#: Bytes of a text that are worked on at once; words that blocks have in common.
AT_ONCE, BACK = 1 << 20, 8
COST, EPOCHS, BLEND = 1.0, 20, 0.25
SPACES = b" \t\n\x0b\x0c\r"
#: Odd multipliers that hash n-grams; any would do.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_SPACE = np.isin(np.arange(256), list(SPACES))
_POWERS = np.cumprod(np.concatenate([[1], np.full(4095, 0x100000001B3, np.uint64)]).astype(np.uint64))


def blocks(data: bytes) -> Iterator[bytes]:
    """A text's bytes in blocks that end between words; each begins some words before the end of the one before."""
    begin = 0
    while len(data) - begin > AT_ONCE:
        cut = max(data.rfind(c, begin + AT_ONCE // 2, begin + AT_ONCE) for c in SPACES)
        cut = cut if cut > 0 else begin + AT_ONCE
        yield data[begin:cut]
        back = cut
        for _ in range(BACK):
            back = max(back - 4096, *(data.rfind(c, begin, back) for c in SPACES))
        begin = back if back > begin + AT_ONCE // 4 else cut - 3
    yield data[begin:]


def places(data: bytes) -> np.ndarray:
    """Hashed places of the n-grams of a block, with repeats."""
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return np.empty(0, np.int64)
    wide = x.astype(np.uint32)
    grams = [wide]
    for n in (1, 2, 3):
        grams.append(grams[-1][:-1] | wide[n:] << np.uint32(8 * n))
    found = [(g.astype(np.uint64) * np.uint64(8) + np.uint64(n)) * ODD[0] for n, g in enumerate(grams)]
    space = _SPACE[x]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if len(starts):
        # A word's hash: its bytes by powers of a number, those behind it count nothing.
        inner = np.arange(len(x))
        inner[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(x))))
        h = np.add.reduceat(np.where(space, 0, (x.astype(np.uint64) + np.uint64(1)) * _POWERS[inner & 4095]), starts) * ODD[1]
        h ^= h >> np.uint64(31)
        found.append((h + np.uint64(5)) * ODD[1])
        found.append(((h[:-1] * ODD[2]) ^ (h[1:] + np.uint64(6))) * ODD[1])
        seen = np.zeros(len(h), np.uint64)
        for k in range(BACK, 0, -1):
            seen[k:][h[k:] == h[:-k]] = k
        found.append((seen[:-2] * np.uint64(81) + seen[1:-1] * np.uint64(9) + seen[2:] + np.uint64(1 << 40)) * ODD[3] if len(h) > 2 else np.empty(0, np.uint64))
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


class Reader:
    """Distinct places of texts; holds one mark for each place."""

    def __init__(self):
        self.last, self.seen = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, bool)

    def features(self, text: str) -> np.ndarray:
        data = text.encode("utf-8", "surrogatepass")
        parts = []
        for block in blocks(data):
            p = places(block)
            order = np.arange(len(p))
            self.last[p] = order
            p = p[self.last[p] == order]
            p = p[~self.seen[p]]
            if len(data) > AT_ONCE:
                self.seen[p] = True
            parts.append(p)
        out = np.concatenate(parts)
        self.seen[out] = False
        return out


class Model:
    """weights: of each place, times its ratio; ratio: what vectors' lengths are measured with."""

    def __init__(self, weights: np.ndarray, ratio: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.ratio, self.bias, self.slope, self.shift = weights, ratio, bias, slope, shift

    def margin(self, at: np.ndarray) -> float:
        if not len(at):
            return self.bias
        r = self.ratio[at]
        return float(self.weights[at].sum(dtype=float) / max(np.sqrt((r * r).sum(dtype=float)), 1e-9)) + self.bias

    def score(self, at: np.ndarray) -> float:
        return float(logistic(self.slope * self.margin(at) + self.shift))


def logistic(z):
    return 0.5 * (1 + np.tanh(np.asarray(z, float) / 2))


def log_ratios(texts: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Of each place: the log of its share among the good texts' indicators to that among the bad ones', smoothed by one."""
    counts = np.ones((2, 1 << BITS))
    for at, q in zip(texts, good, strict=True):
        counts[int(q), at] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def descend(texts: list[np.ndarray], good: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS, least: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights of the scaled indicators, and the bias: dual coordinate descent for hinge loss, until no multiplier moves by
    `least`. The bias is the weight of one more feature that is always on."""
    rng = np.random.default_rng(0)
    w, bias = np.zeros(1 << BITS), 0.0
    values = []
    for at in texts:
        v = ratio[at]
        values.append(v / max(np.sqrt(v @ v), 1e-9))
    y = np.where(good, 1.0, -1.0)
    # Kinds weigh alike, however many there are of each.
    most = cost * np.where(good, len(y) / (2 * good.sum()), len(y) / (2 * (~good).sum()))
    alpha = np.zeros(len(texts))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(texts)):
            at, v = texts[i], values[i]
            slope = y[i] * (w[at] @ v + bias) - 1
            new = min(max(alpha[i] - slope / (v @ v + 1), 0.0), most[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < least:
            break
    return w, bias


def learned(texts: list[np.ndarray], good: np.ndarray) -> Model:
    ratio = log_ratios(texts, good)
    w, bias = descend(texts, good, ratio)
    used = w != 0
    w = BLEND * w + (1 - BLEND) * np.abs(w[used]).mean() * used if used.any() else w
    return Model((w * ratio).astype(np.float32), ratio.astype(np.float32), bias)


def calibrated(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins of unseen texts, targets smoothed, by Newton's method."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    theta = np.array([1.0, 0.0])
    loss = lambda t: float(np.sum(np.logaddexp(0, x @ t) - target * (x @ t))) + 1e-6 * float(t @ t)
    for _ in range(50):
        p = logistic(x @ theta)
        slope = x.T @ (p - target) + 2e-6 * theta
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 2e-6 * np.eye(2), slope)
        size = 1.0
        while size > 1e-6 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def fit(texts: list[np.ndarray], good: np.ndarray, folds: int = 3) -> Model | float:
    """The model of all texts; its curve is fitted on margins that models of the other folds give. Without texts of both
    kinds (as many as folds), the smoothed share of good ones."""
    good = np.asarray(good, bool)
    if min(good.sum(), (~good).sum()) < folds:
        return float((good.sum() + 1) / (len(good) + 2))
    fold, margins = np.zeros(len(good), int), np.zeros(len(good))
    for q in (True, False):
        own = np.flatnonzero(good == q)
        fold[own] = np.arange(len(own)) % folds
    for f in range(folds):
        other = learned([t for t, k in zip(texts, fold, strict=True) if k != f], good[fold != f])
        for i in np.flatnonzero(fold == f):
            margins[i] = other.margin(texts[i])
    model = learned(texts, good)
    model.slope, model.shift = calibrated(margins, good)
    return model


def remainder(name: str = "doc_id"):
    return F.crc32(F.col(name).cast("string").cast("binary")) % FOLDS


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_features: int = MOST_FEATURES) -> Model | float:
    """The model for these documents, from labelled ones that aren't held out."""
    small_batches(docs.sparkSession)
    own = labels.where("doc_id is not null and quality in (0, 1)").where(remainder() != HELD_OUT)
    few = own.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.where("doc_id is not null").select("doc_id", text_of().alias("text")).join(F.broadcast(few), "doc_id")

    def read(batches):
        hold("classifier")
        reader = Reader()
        for b in batches:
            found = [reader.features(t) for t in b.column("text").to_pylist()]
            packed = [np.sort(f).astype("<u4").tobytes() if len(f) <= most_features else None for f in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(packed, pa.binary())], ["doc_id", "quality", "places"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    read_rows = rows.mapInArrow(read, f"doc_id {kind}, quality int, places binary").where("places is not null")
    got = read_rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("places").alias("places")).collect()  # of repeated ids one text
    got.sort(key=lambda r: r["doc_id"])
    return fit([np.frombuffer(r["places"], "<u4").astype(np.int64) for r in got], np.array([r["quality"] == 1 for r in got], bool))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fitted(docs, labels)
    rows = docs.select("doc_id", F.coalesce(remainder() == HELD_OUT, F.lit(False)).alias("held_out"), text_of().alias("text"))

    def run(batches):
        hold("classifier")
        reader = Reader()
        for b in batches:
            scores = [model if isinstance(model, float) else model.score(reader.features(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
