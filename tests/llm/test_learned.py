"""Quality classifier, centroid clustering and spelling variants against brute force and held-out labels."""

import hashlib
import random
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import centroids, classifier, queries, spelling

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op12_centroids", "op13_spelling"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in Path("/root/testdata/sf0.001").glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.queries()[name](spark, "/root/testdata/sf0.001")
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want)) and want


# Classifier


def test_held_out_quality(spark):
    """Of labelled documents that the fit never saw, and none that it saw is held out."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in classifier.score_documents(docs, labels).collect()}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(r.predicted == q for r, q in held) / len(held) > 0.9
    good, bad = [r.score for r, q in held if q], [r.score for r, q in held if not q]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    turned = labels.withColumn("quality", F.when(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in classifier.score_documents(docs.withColumn("lang", F.lit("x")).repartition(5), turned).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in got.items())


def test_descent_solves_the_dual():
    """No coordinate can be bettered, and the weights are the sum that the multipliers say."""
    rng = np.random.default_rng(0)
    texts = [np.unique(rng.integers(0, 60, 12)) for _ in range(40)]
    good = np.array([t[0] < 3 for t in texts])
    ratio = classifier.log_ratios(texts, good)
    w, bias = classifier.descend(texts, good, ratio, epochs=5000, least=1e-9)
    x = np.zeros((len(texts), 61))
    for i, t in enumerate(texts):
        x[i, t] = ratio[t] / np.sqrt(ratio[t] @ ratio[t])
        x[i, 60] = 1
    v = np.append(w[:60], bias)
    y = np.where(good, 1, -1)
    cost = np.where(good, len(y) / (2 * good.sum()), len(y) / (2 * (~good).sum()))
    value = lambda u: u @ u / 2 + cost @ np.maximum(0, 1 - y * (x @ u))
    for _ in range(300):
        assert value(v) <= value(v + rng.normal(size=61) * rng.choice([1e-3, 1e-2, 0.1])) + 1e-6


def test_ratios_are_plain_counts():
    texts = [np.array([1, 2]), np.array([2, 3]), np.array([3])]
    r = classifier.log_ratios(texts, np.array([True, True, False]))
    n = 1 << classifier.BITS
    assert abs(r[2] - (np.log(3 / (n + 4)) - np.log(1 / (n + 1)))) < 1e-9 and abs(r[3] - (np.log(2 / (n + 4)) - np.log(2 / (n + 1)))) < 1e-9


def test_long_texts_have_the_indicators_of_their_parts(monkeypatch):
    """Blocks give what the whole gives, but for words seen before that lie beyond a block's beginning."""
    text = " ".join(random.Random(0).choice(["Ärger", "of", "the", "and", "x"] + [f"w{i}" for i in range(300)]) for _ in range(4000))
    whole = set(classifier.Reader().features(text).tolist())
    monkeypatch.setattr(classifier, "AT_ONCE", 2000)
    reader = classifier.Reader()
    parts = reader.features(text)
    assert len(parts) == len(set(parts.tolist())) and whole <= set(parts.tolist()) and len(parts) < 1.02 * len(whole)
    assert not reader.seen.any() and len(reader.features("a" * 9000)) < 40
    assert set(reader.features(text).tolist()) == set(parts.tolist())


def test_classifier_of_odd_rows(spark):
    good, bad = "It was the best of times and it was the worst of times.", "### $$$ SALE!! &&& NOW!! ***"
    rows = [(i, f"{good if i % 2 else bad} {i}") for i in range(60)] + [(1, f"{good} 1"), (100, None), (101, ""), (None, good), (102, "x" * 200_000), (103, good * 3000)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1), (None, 0), (100, None), (101, 1)], "doc_id long, quality int")
    got = classifier.score_documents(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = got.collect()
    assert len(got) == len(rows) and all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 60)
    assert [r.predicted for r in got if r.doc_id in (None, 103)] == [1, 1] and {r.score for r in got if r.doc_id in (100, 101)} != set()
    assert not [r for r in got if r.doc_id is None][0].held_out
    for few, want in ((labels.where("quality = 1"), 1.0), (labels.where("false"), 0.5)):
        scores = {r.score for r in classifier.score_documents(docs, few).collect()}
        assert len(scores) == 1 and abs(scores.pop() - want) < 0.05
    assert classifier.score_documents(docs.where("false"), labels).count() == 0
    # A text of more places than the bound is left out alone.
    kept = classifier.fitted(docs, labels, most_features=400)
    assert isinstance(kept, classifier.Model) and classifier.fitted(docs, labels, most_features=0) == 2 / 3  # of the empty text alone


# Centroids


def plain_clusters(rows, k, rounds):
    """Everything measured, in Python's integers."""
    x = [[int(np.floor(1024 * float(v))) for v in e] for _, e in rows]
    order = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"3:{rows[i][0]}".encode()).hexdigest(), rows[i][1]))
    c = [x[i] for i in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for v in x]
        c = [[sum(col) // own.count(j) for col in zip(*(v for v, o in zip(x, own, strict=True) if o == j), strict=True)] if j in own else m for j, m in enumerate(c)]
    last = [near(v) for v in x]
    return sorted((i, j, d, sum(e for e, o in last if o == j), sum(e for e, _ in last), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(rows, last, strict=True))


@pytest.mark.parametrize(("k", "grain", "n"), [(8, 1, 300), (8, 16, 200), (12, 4, 150), (1, 4, 20), (8, 4, 5)])
def test_clusters_are_those_of_measuring_everything(spark, k, grain, n):
    """Coarse grains give many equal distances; few vectors give few centroids."""
    rng = np.random.default_rng(k * n)
    rows = [(i, [float(v) for v in np.round(rng.normal(size=64) * rng.choice([1, 1, 3])) * grain / 1024]) for i in range(n)]
    rows += [(n + i, rows[i % 3][1]) for i in range(n // 3)]  # repeated vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert sorted(map(tuple, centroids.clusters(df, k=k, rounds=4).collect())) == plain_clusters(rows, k, 4)


def test_bounds_spare_measuring(spark):
    """Apart groups: after a round or two nothing is rescanned, and fewer bounds are kept."""
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(8, 64)) * 4
    rows = [(i, [float(v) for v in middle[i % 8] + rng.normal(size=64) * 0.1]) for i in range(800)]
    report = []
    got = centroids.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rounds=5, report=report).collect()
    assert len(got) == 800 and report[0] == (3, 800) and report[-1][1] < 400 and report[-1][0] <= report[0][0]
    assert sorted(map(tuple, got)) == plain_clusters(rows, 8, 5)


def test_settled_bounds_bound():
    rng = np.random.default_rng(5)
    x = rng.integers(-90, 90, (400, 64))
    c = x[:9].copy()
    state = centroids.Bounds.measured(x, c, 3)
    for _ in range(6):
        new = c + rng.integers(-6, 7, c.shape)
        state.moved(np.sqrt(((new - c) ** 2).sum(1).astype(float)))
        c = new
        state.settle(x, c)
        state = centroids.Bounds.unpack(state.pack(), len(x), 3)
        d2 = centroids.squares(x, c)
        d = np.sqrt(d2)
        every = np.arange(len(x))
        assert (state.near == d2.argmin(1)).all() and (state.upper >= d[every, state.near]).all()
        for j in range(3):
            assert (state.lower[:, j] <= d[every, state.listed[:, j]]).all()
        for i in range(len(x)):
            assert all(state.rest[i] <= d[i, j] for j in set(range(9)) - {state.near[i], *state.listed[i].tolist()})


def test_vectors_of_odd_rows(spark):
    fine = [0.5] * 64
    rows = [(1, fine), (1, fine), (2, None), (3, []), (4, [0.5] * 63), (5, [*fine[1:], None]), (6, [*fine[1:], float("nan")]), (7, [*fine[1:], float("inf")]), (8, [-0.0001] * 64), (None, [0.25] * 64)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, cluster int")
    got = centroids.clusters(df).collect()
    assert sorted((r.vec_id or 0, r.distance == 0) for r in got)[1:] == [(1, True), (1, True), (8, True)] and len(got) == 4
    assert centroids.scaled(np.array([[-0.0001, 0.0009766]])).tolist() == [[-1, 1]]
    assert centroids.clusters(df.where("false")).collect() == []
    with pytest.raises(ValueError, match="fit a long"):
        centroids.scaled(np.array([1e9]))
    wide = np.array([[1 << 26] * 64, [-(1 << 26)] * 64])
    assert centroids.squares(wide, wide[:1]).tolist() == [[0], [1 << 60]] and centroids.unpacked(*centroids.narrowed(wide)).tolist() == wide.tolist()


# Spelling


def plain_words(rows):
    """Words and their counts, read character by character."""
    count = Counter()
    for i, text in rows:
        run = ""
        for ch in (text or "") + " ":
            if "a" <= ch <= "z" or "A" <= ch <= "Z" or "À" <= ch <= "ÿ":
                run += chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
            elif run:
                h = zlib.crc32(f"{i}:{run}".encode())
                if i is not None and h % 97 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                count[run] += 1
                run = ""
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    words = plain_words(rows)
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words)


def got_variants(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string").repartition(3)
    key = lambda r: tuple(("" if v is None else v) for v in r)
    return sorted(map(tuple, spelling.spelling_variants(df).collect()), key=key)


@pytest.mark.parametrize(("alphabet", "seed"), [("ab", 0), ("abcé", 1), ("aÿ×", 2)])
def test_variants_are_those_of_all_pairs(spark, alphabet, seed):
    """Few letters give repeated bigrams, long runs of one letter and many ties."""
    r = random.Random(seed)
    base = ["".join(r.choice(alphabet) for _ in range(r.randint(5, 9))) for _ in range(120)]
    rows = [(i, " ".join(r.choice(base) for _ in range(60)) + " " + " ".join(r.choice(base).upper() for _ in range(4))) for i in range(60)]
    assert got_variants(spark, rows) == sorted(plain_variants(rows), key=lambda r: tuple(("" if v is None else v) for v in r))


def test_chains_and_odd_rows(spark):
    chain = "abcdef " * 3 + "abcdeg " * 6 + "abcdhg " * 12 + "abcihg " * 24 + "abjihg " * 48
    rows = [(1, None), (2, ""), (3, chain), (3, chain), (None, "zzzzz zzzzz;zzzzz"), (5, "Ünder ünder ÜNDER Ünder"), (6, "a" * 50_000)]
    got = {r[0]: r for r in got_variants(spark, rows)}
    assert got == {r[0]: r for r in plain_variants(rows)}
    assert got["abcdef"][:3] == ("abcdef", "abcdeg", "abjihg") and got["abcdef"][4:] == (1, 12)
    assert got["zzzzz"] == ("zzzzz", None, "zzzzz", 3, 0, None)
    assert got_variants(spark, [(1, None)]) == []


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " ".join(random.Random(1).choice(["alphabet", "Ärmel", "gamma-ray", "x"]) for _ in range(500))
    whole = sum(spelling.runs_of_text(text), Counter())
    monkeypatch.setattr(spelling, "PIECE", 7)
    assert sum(spelling.runs_of_text(text), Counter()) == whole


def test_keys_of_words_stay_off_the_driver(spark, tmp_path):
    words = spark.createDataFrame([("letter", 9), ("leter", 3), ("lotter", 4), ("other", 5)], "word string, n long")
    words.write.parquet(str(tmp_path / "words"))
    words = spark.read.parquet(str(tmp_path / "words"))
    pairs = spelling.near_pairs(words, spelling.bigram_counts(words))
    assert "Broadcast" not in pairs._jdf.queryExecution().sparkPlan().toString()
    assert sorted((r.word, r.near) for r in pairs.collect()) == [("leter", "letter"), ("letter", "lotter")]
