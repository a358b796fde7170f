"""Quality rules: lines are labelled content or boilerplate by a linear-chain conditional random field.

Each line gives a few binary features; Viterbi decoding over all lines of a text finds the best labels; a text is kept
if the lines labelled content hold enough of its characters. The field's weights are learned from a bounded sample of
labelled documents, or are the ones below where no labels of both kinds are there.

The sample: SAMPLE documents at most, and SAMPLE_LINES lines of whole texts at most, both by order of a hash of the id and
the text, so that a rerun takes the same ones; a text of more than TEXT_LINES lines, or of more than are left, is left out
alone. Only the features of their lines reach the driver, of SAMPLE * TEXT_LINES lines at most.

Defined cases: null and empty texts have no words and fail the base rules; very long texts are judged whole; repeated rows
are judged each; ties between labels go to content; an empty table gives no rows, and no labels leave the prior weights;
extra columns, whatever their names, are kept by keep_documents and ignored by judge_documents.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import hold, map_rows, small_batches, text_of
from siltstone.llm.stopwords import ALL

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
NOTICE = re.compile(r"licen[sc]ed|copyright|©|all rights reserved|cookie|subscribe|sign up|log in|click here|terms of|privacy policy", re.IGNORECASE)
LEAST_WORDS, MOST_REPEATED, CONTENT_SHARE = 50, 50, 0.5
#: Most labelled documents, and lines of them, that the field is fitted on.
SAMPLE, SAMPLE_LINES, TEXT_LINES = 2000, 400_000, 4000

FEATURES = (
    "symbols over 2 %", "symbols over 8 %", "upper case over half", "upper case over 90 %", "few distinct words", "very few distinct words", "lone symbols among words", "exclamation marks", "no function word", "function words under 8 %",
    "function words over 20 %", "under 4 words", "over 12 words", "ends a sentence", "digits over 10 %", "repeats an earlier line", "notice words", "long words",
)
#: Weights for content where nothing can be learned: of each feature, then the start, then staying.
PRIOR = (-1.5, -2.0, -1.5, -1.0, -1.5, -2.5, -2.0, -1.0, -0.8, -0.5, 1.0, 0.0, 0.3, 0.5, -0.5, -0.5, -1.0, -0.3)
PRIOR_START, PRIOR_STAY = 1.0, 0.7


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()  # splits at exactly the six white space bytes
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[str] = set()
    dups = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    return len(words), chars, symbols, dups, repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    pair = at[:-1] * len(ids) + at[1:]
    if len(ids) < 1 << 20:
        key = pair[:-1] * len(ids) + at[2:]
    else:
        key = np.unique(pair, return_inverse=True)[1][:-1] * len(ids) + at[2:]
    line = np.sort(key)
    again = line[1:][line[1:] == line[:-1]]
    if not len(again):
        return 0
    hit = np.isin(key, again)
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k : n - 2 + k] |= hit
    return int(cover.sum())


def line_features(line: str, repeated: bool) -> tuple[int, ...]:
    """Which FEATURES a line has."""
    words = line.split()
    n, size = len(words), len(line)
    marks = sum(line.count(c) for c in SYMBOLS)
    upper = sum(map(str.isupper, line)) if line != line.lower() else 0
    letters = upper + sum(map(str.islower, line)) if upper * 8 > size else size
    distinct = len(set(words))
    lone = sum(w in "|*#-<>&$%" for w in words) if marks or "-" in line else 0
    stops = sum(w in ALL for w in map(_bare, words))
    digits = sum(map(str.isdigit, line))
    tests = (
        marks * 50 > size, marks * 12 > size, upper * 2 > letters, upper * 10 > letters * 9, n >= 8 and distinct * 2 < n, n >= 8 and distinct * 5 < n, lone * 10 > n, line.count("!") * 20 > size, not stops, stops * 12 < n,
        stops * 5 > n, n < 4, n > 12, line.rstrip()[-1:] in (".", "?", ":", "…"), digits * 10 > size, repeated, NOTICE.search(line) is not None, size > 12 * n,
    )
    return tuple(i for i, x in enumerate(tests) if x)


def _bare(word: str) -> str:
    return word.strip(".,;:!?\"'()#*$%&|<>").lower()


def lines_of(text: str) -> tuple[list[tuple[int, ...]], list[int]]:
    """Features and characters of the lines with a word, in order."""
    seen: set[str] = set()
    feats, sizes = [], []
    for line in text.split("\n"):
        bare = line.strip()
        if bare:
            feats.append(line_features(bare, bare in seen))
            sizes.append(len(bare))
            seen.add(bare)
    return feats, sizes


class Field:
    """Linear-chain field over labels 1 (content) and 0 (boilerplate): weights are for label 1, half with either sign;
    `stay` is won where a label equals the one before."""

    def __init__(self, weights, start: float, stay: float, lean: float = 0.0):
        self.weights, self.start, self.stay, self.lean = np.asarray(weights, float), float(start), float(stay), float(lean)

    def scores(self, feats: list[tuple[int, ...]]) -> list[float]:
        w = self.weights
        return [self.lean + float(sum(w[i] for i in f)) for f in feats]

    def viterbi(self, feats: list[tuple[int, ...]]) -> list[int]:
        """The best labels of a text's lines; ties go to content."""
        if not feats:
            return []
        back = []
        scores = self.scores(feats)
        bad, good = -(scores[0] + self.start) / 2, (scores[0] + self.start) / 2
        for s in scores[1:]:
            from_bad = bad + self.stay > good
            to_good = bad > good + self.stay
            back.append((0 if from_bad else 1, 0 if to_good else 1))
            bad, good = (bad + self.stay if from_bad else good) - s / 2, (bad if to_good else good + self.stay) + s / 2
        label = int(good >= bad)
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1]

    def content_share(self, text: str) -> float:
        """Share of the characters that stand in content lines."""
        feats, sizes = lines_of(text)
        total = sum(sizes)
        return sum(s for s, x in zip(sizes, self.viterbi(feats), strict=True) if x) / total if total else 0.0

    def gradient(self, feats: list[tuple[int, ...]], labels: list[int]) -> tuple[np.ndarray, float, float, float]:
        """Of the log likelihood of one text."""
        batch = Batch([(_matrix(feats), np.array(labels))])
        g = batch.gradient(self)[0]
        return g[:-3], float(g[-3]), float(g[-2]), float(g[-1])


def _matrix(feats: list[tuple[int, ...]]) -> np.ndarray:
    out = np.zeros((len(feats), len(FEATURES)))
    for i, f in enumerate(feats):
        out[i, list(f)] = 1
    return out


class Batch:
    """Texts whose lines are worked through side by side: line t of all texts that have so many, the longest texts first,
    in one step of the forward-backward pass."""

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray]]):
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i][0]))
        size = np.array([len(texts[i][0]) for i in order])
        self.n = len(texts)
        #: How many texts have a line t; where step t's lines begin among all lines, which are dealt out by step.
        self.live = np.array([int((size > t).sum()) for t in range(size.max(initial=0))])
        self.begin = np.concatenate([[0], np.cumsum(self.live)]).astype(np.int64)
        self.features = np.concatenate([np.stack([texts[i][0][t] for i in order[:k]]) for t, k in enumerate(self.live)])
        self.labels = np.concatenate([np.array([texts[i][1][t] for i in order[:k]]) for t, k in enumerate(self.live)]).astype(float)
        self.of = np.concatenate([np.array(order[:k]) for k in self.live])
        self.steps = [slice(a, z) for a, z in zip(self.begin[:-1], self.begin[1:], strict=True)]

    def gradient(self, field: Field) -> np.ndarray:
        """Of each text: weights, start, stay and lean."""
        half = (self.features @ field.weights + field.lean) / 2
        own = np.stack([-half, half], 1)
        own[self.steps[0]] += (-field.start / 2, field.start / 2)
        a, b = own.copy(), np.zeros_like(own)
        for t, k in enumerate(self.live[1:], 1):
            before = a[self.steps[t - 1]][:k]
            a[self.steps[t]] += np.stack([np.logaddexp(before[:, 0] + field.stay, before[:, 1]), np.logaddexp(before[:, 0], before[:, 1] + field.stay)], 1)
        for t in range(len(self.live) - 2, -1, -1):
            k = self.live[t + 1]
            nxt = own[self.steps[t + 1]] + b[self.steps[t + 1]]
            at = b[self.steps[t]]
            at[:k] = np.stack([np.logaddexp(field.stay + nxt[:, 0], nxt[:, 1]), np.logaddexp(nxt[:, 0], field.stay + nxt[:, 1])], 1)
        z = np.logaddexp(*(a + b).T)
        p = np.exp((a + b)[:, 1] - z)
        out = np.zeros((self.n, len(FEATURES) + 3))
        rest = self.labels - p
        np.add.at(out[:, : len(FEATURES)], self.of, rest[:, None] * self.features)
        np.add.at(out[:, -1], self.of, rest)
        first = self.steps[0]
        out[self.of[first], -3] = rest[first]
        for t, k in enumerate(self.live[1:], 1):
            left, right = self.steps[t - 1], self.steps[t]
            same = np.exp(a[left][:k] + field.stay + own[right] + b[right] - z[right][:, None]).sum(1)
            out[self.of[right], -2] += (self.labels[left][:k] == self.labels[right]) - same
        return out


def fit(sample: list[tuple[str, int]], rounds: int = 30, rate: float = 0.5, ridge: float = 1e-3) -> Field:
    """Learn from whole texts labelled good (1) or bad (0)."""
    return fit_lines([(lines_of(t)[0], q) for t, q in sample], rounds, rate, ridge)


def fit_lines(sample: list[tuple[list[tuple[int, ...]], int]], rounds: int = 30, rate: float = 0.5, ridge: float = 1e-3) -> Field:
    """Learn from the lines' features of texts labelled good (1) or bad (0). A bad text may hold good lines: its lines are
    boilerplate only where the log odds of their features, counted over the sample, say so."""
    parts = [(_matrix(f), q) for f, q in sample if f]
    if len({q for _, q in parts}) < 2:
        return Field(PRIOR, PRIOR_START, PRIOR_STAY)
    count, lines = np.ones((2, len(FEATURES))), np.full(2, 2.0)
    for m, q in parts:
        lines[q] += len(m)
        count[q] += m.sum(0)
    p = count / lines[:, None]
    odds, rest = np.log(p[1] / p[0]), np.log((1 - p[1]) / (1 - p[0]))
    batch = Batch([(m, np.ones(len(m)) if q else (m @ (odds - rest) + rest.sum() > 0).astype(float)) for m, q in parts])
    weight = 1.0 / np.array([len(m) for m, _ in parts])
    field = Field(np.zeros(len(FEATURES)), 0.0, 0.0)
    seen = np.zeros(len(FEATURES) + 3)
    for _ in range(rounds):
        x = np.concatenate([field.weights, [field.start, field.stay, field.lean]])
        g = weight @ batch.gradient(field) / len(parts) - ridge * x
        seen += g * g
        x = x + rate * g / np.sqrt(seen + 1e-12)
        field = Field(x[:-3], x[-3], min(x[-2], 2.0), x[-1])  # a longer memory would judge texts, not lines
    return field


def fitted(docs: DataFrame, labels: DataFrame | None, sample: int = SAMPLE, most_lines: int = SAMPLE_LINES) -> Field:
    """The field for these documents: fitted on at most `sample` of them that carry a quality label."""
    if labels is None:
        return fit([])
    few = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.md5(F.col("text").cast("binary"))]
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(order[2]))).where("n = 1")  # of repeated ids one text
    few_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) < min(TEXT_LINES, most_lines)
    rows = rows.where(few_lines).select("doc_id", "quality", "text", order[0].alias("place"))

    def features(batches):
        for b in batches:
            found = [lines_of(t)[0] for t in b.column("text").to_pylist()]
            bits = [np.array([sum(1 << i for i in f) for f in fs], "<u4").tobytes() for fs in found]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("place", "doc_id", "quality")), pa.array(bits, pa.binary())], ["place", "doc_id", "quality", "bits"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(features, f"place long, doc_id {kind}, quality int, bits binary").collect()
    unpack = lambda bits: [tuple(i for i in range(len(FEATURES)) if x >> i & 1) for x in np.frombuffer(bits, "<u4").tolist()]
    taken, left = [], most_lines
    for r in sorted(got, key=lambda r: (r["place"], r["doc_id"])):
        if len(r["bits"]) // 4 <= left:
            left -= len(r["bits"]) // 4
            taken.append((unpack(r["bits"]), r["quality"]))
    return fit_lines(taken)


KINDS = (("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64()))
DDL = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, content_share double"


def verdict(field: Field, text: str) -> tuple:
    n, chars, symbols, dups, repeats = base_counts(text)
    failed = n < LEAST_WORDS or 100 * repeats > MOST_REPEATED * n
    share = field.content_share(text)
    return n, chars, symbols, dups, repeats, failed, not failed and share >= CONTENT_SHARE, share


def judge_documents(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and content_share of every document."""
    small_batches(docs.sparkSession)
    field = fitted(docs, labels)
    rows = docs.select("doc_id", text_of().alias("text"))

    def judge(batches):
        hold("quality")
        for b in batches:
            got = [verdict(field, t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([g[i] for g in got], t) for i, (_, t) in enumerate(KINDS))], ["doc_id", *(n for n, _ in KINDS)])

    return rows.mapInArrow(judge, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {DDL}")


def keep_documents(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows of docs that the rules keep, all columns."""
    small_batches(docs.sparkSession)
    field = fitted(docs, labels)

    def keep(batches, at):
        hold("quality")
        for b in batches:
            yield b.filter(pa.array([verdict(field, t or "")[6] for t in b.column(at).to_pylist()], pa.bool_()))

    return map_rows(docs, keep)
