"""Sharding, language model, archives and the pipeline."""

import base64
import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import elias_fano, lm, queries, shards, warc
from siltstone.llm.shared import work_dir
from tests.llm.test_texts import prose


@pytest.mark.parametrize("hot", [0.0, 0.4])
def test_shards(spark, hot):
    rows = [(i, "same text" * 9 if i < 600 * hot else "x" * (i * 37 % 400)) for i in range(600)] + [(7, None), (7, None), (None, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int").repartition(5)
    got = shards.histogram_shards(docs, 16, 0.001).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    mean = sum(sizes.values()) / 16
    assert set(sizes) == set(range(16)) and max(abs(s - mean) for s in sizes.values()) <= 2 * 401
    for k in range(16):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows}
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_identical_rows_are_split(spark, monkeypatch):
    monkeypatch.setattr(shards, "SLICE", 20)
    docs = spark.createDataFrame([(1, "abc")] * 320, "doc_id long, text string").repartition(4)
    got = shards.histogram_shards(docs, 4, 0.001).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [80] * 4
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(80)) for k in range(4))


def test_shards_of_nothing(spark):
    assert shards.histogram_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    shards.write_shards(docs, str(tmp_path / "s"), ["text"], 4)
    assert spark.read.parquet(str(tmp_path / "s")).select("doc_id", "text").exceptAll(docs).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=80, unique=True), st.lists(st.integers(0, 6000), max_size=30))
def test_elias_fano(values, asked):
    v = np.array(sorted(values), np.uint64)
    s = elias_fano.Sequence(*elias_fano.encode(v, 5001))
    place = {x: i for i, x in enumerate(v.tolist())}
    q = np.array(sorted(asked), np.uint64)
    assert s.find(q).tolist() == [place.get(x, -1) for x in q.tolist()]
    assert s.get(np.arange(len(v))).tolist() == v.tolist()


def test_large_sequences():
    rng = np.random.default_rng(0)
    v = np.unique(rng.integers(0, 1 << 62, 5000).astype(np.uint64) * np.uint64(3))
    s = elias_fano.Sequence(*elias_fano.encode(v, 1 << 64))
    assert s.find(v).tolist() == list(range(len(v))) and (s.get(np.arange(len(v))) == v).all()
    assert (lm._read_varints(np.frombuffer(lm._varints(v), np.uint8)) == v).all()


def plain_model(rows, discounts):
    """The same model from plain counts: which rows are held out, and (n_tokens, n_known, base, score) of a text."""
    tok = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    held = {i: i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    uni, tri = Counter(), Counter()
    for i, t in rows:
        if not held[i]:
            w = tok(t)
            uni.update(w)
            tri.update(zip(["start", None, *w], [None, *w], w, strict=False))
    d2, d3 = ([0.0, *d] for d in discounts)
    bi = Counter((b, c) for _, b, c in tri)
    whole2, back2, whole3, back3 = Counter(), Counter(), Counter(), Counter()
    for (b, _), n in bi.items():
        whole2[b] += n
        back2[b] += d2[min(n, 3)]
    for (a, b, _), n in tri.items():
        whole3[a, b] += n
        back3[a, b] += d3[min(n, 3)]
    total, v = sum(uni.values()), len(uni)

    def score(t):
        base = full = 0.0
        a, b = "start", None
        for c in tok(t):
            p = (uni[c] + 0.1) / (total + 0.1 * (v + 1))
            base += math.log10(p)
            if whole2[b]:
                p = (bi[b, c] - d2[min(bi[b, c], 3)] + back2[b] * p) / whole2[b]
            if whole3[a, b]:
                p = (tri[a, b, c] - d3[min(tri[a, b, c], 3)] + back3[a, b] * p) / whole3[a, b]
            full += math.log10(p)
            a, b = b, c
        return len(tok(t)), sum(uni[w] > 0 for w in tok(t)), base, full

    return held, total, score, tri


@pytest.mark.parametrize("texts", [[""], ["", " "], ["A b", " a", "a ", "\t\n\x0b\f\r"], ["a\x00 a", "a\x1c\x1d\x85b", "\u00c4\u00e4 \u2003 \U0001f600"], ["x" * 9 + " X" * 9, "xxxxxxxx"]])
def test_words_of_many_texts_are_cut_at_once(texts, monkeypatch):
    want = [lm.tokens(t) for t in texts]
    monkeypatch.setattr(lm, "tokens", None)  # no text is cut by itself
    h, at, sizes = lm.index(texts)
    assert sizes.tolist() == [len(w) for w in want]
    assert h[at].tolist() == [lm.xxhash.xxh64_intdigest(x) for w in want for x in w]
    assert h.tolist() == sorted(set(h[at].tolist()))


def test_triples_of_many_words(monkeypatch):
    """Contexts numbered first give what one number for each triple gives, and any number of words fits."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 90, 50)) for _ in range(20)]
    h, at, sizes = lm.index(texts)
    one = lm.triples(h, at, sizes)
    monkeypatch.setattr(lm, "ONE_KEY", 2)
    assert all((x == y).all() for x, y in zip(one, lm.triples(h, at, sizes), strict=True))
    monkeypatch.undo()
    n = lm.ONE_KEY + 10
    hashes = np.sort(np.append(np.arange(1, n, dtype=np.uint64), lm._END_HASH))
    at = np.append(rng.permutation(n - 1), np.searchsorted(hashes, lm._END_HASH))
    context, c, token = lm.triples(hashes, at, np.array([len(at)]))
    assert (c[token] == at).all() and (context[token][2:] == at[1:-1] * (n + 1) + at[:-2]).all()


@pytest.mark.parametrize("part", [300, 3_000_000])
def test_scores_against_plain_counts(spark, monkeypatch, part):
    """Several parts, a frequent word and a frequent second word in more than one of them; and one part."""
    monkeypatch.setattr(lm, "PART_TOKENS", part)
    monkeypatch.setattr(lm, "PART_WORDS", 100)
    monkeypatch.setattr(lm, "AT_ONCE", 5000)
    monkeypatch.setattr(lm, "HELD", 200)
    few = lambda i: " ".join(f"v{x % 7}" for x in np.random.default_rng(i).integers(0, 50, 40))
    rows = [(i, f"The {prose(i % 25, 20)} {few(i)} the The ÉA\x0bb") for i in range(60)] + [(200 + i, f"a b u{i}") for i in range(700)]
    rows += [(100, None), (101, ""), (None, "v1 v2 v3 w1"), (102, "unseen v1 v2 words"), (3, "twice"), (3, "the " * 3000)]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    held = plain_model(rows, [(0.5,) * 3] * 2)[0]
    trie, n, v = lm.train(spark.createDataFrame([(t or "",) for i, t in rows if not held[i]], "text string"), work_dir(spark, "lm-test"))
    assert (len(trie.borders) > 20 and len(trie.split) > 2) == (part == 300)
    held, total, score, tri = plain_model(rows, trie.discounts)
    assert total == n
    counts = [Counter(tri.values())[k] for k in (1, 2, 3, 4)]
    assert np.allclose(trie.discounts[1], lm._discounts(*counts))
    got = lm.score_documents(docs).collect()
    want = {(i, t or ""): score(t) for i, t in rows}
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == Counter((i, held[i], *want[i, t or ""][:2], total) for i, t in rows)
    by = {(r.doc_id, r.n_tokens): r for r in got}
    for i, t in rows:
        k, _, base, full = want[i, t or ""]
        r = by[i, k]
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - full) < k * 2 * lm.STEP  # a code is off by half a step
    folder = work_dir(spark, "op9-query")
    docs.write.parquet(f"{folder}/documents.parquet")
    for r in queries.op9_lm_scores(spark, folder).collect():
        assert abs(r.score - by[r.doc_id, r.n_tokens].score) < 1e-9


def test_probabilities_sum_to_one(spark):
    """Over all known words, the end, and one unknown word, behind contexts that were seen and that weren't."""
    texts = [f"{prose(i, 30)} x y" for i in range(40)]
    trie, n, v = lm.train(spark.createDataFrame([(t,) for t in texts], "text string"), work_dir(spark, "lm-test"))
    words = sorted({w.encode() for t in texts for w in t.lower().split()} | {lm.END})
    ids, counts = trie.words.find(np.sort(np.array([lm.xxhash.xxh64_intdigest(w) for w in words], np.uint64)))
    uni = (counts + 0.1) / (n + 0.1 * (v + 1))
    one = lambda w: int(trie.words.find(np.array([lm.xxhash.xxh64_intdigest(w)], np.uint64))[0][0])
    for a, b in ((b"x", b"y"), (b"y", b"x"), (lm.END, b"x")):
        keys = np.uint64(one(b) * trie.width) + ids.astype(np.uint64)
        rank, p = trie.pairs(keys)
        p = p + trie.backoff(np.array([one(b)])) * uni
        own, left = trie.third(np.array([one(b) * trie.width + one(a)], np.uint64), np.zeros(len(ids), np.int64), rank)
        assert abs(p.sum() + (1 - uni.sum()) * trie.backoff(np.array([one(b)]))[0] - 1) < 1e-3
        assert abs(own.sum() + left[0] - 1) < 1e-3 and (left < 1 if a == b"x" else left == 1).all()


def test_numbers_are_packed_and_repeated_keys_sought_once(monkeypatch):
    for v in ([], [0], [0, 255, 256, (1 << 56) - 1, 1 << 56, (1 << 64) - 1], list(range(70_000))):
        x = np.array(v, np.uint64)
        assert (lm._unpacked(lm._packed(x)) == x).all() and len(lm._read_varints(np.frombuffer(lm._varints(x), np.uint8))) == len(v)
    asked, plain = [], elias_fano.Sequence.find
    monkeypatch.setattr(elias_fano.Sequence, "find", lambda self, keys: asked.append(len(keys)) or plain(self, keys))
    s = elias_fano.Sequence(*elias_fano.encode(np.array([2, 5, 9], np.uint64), 10))
    assert lm._find(s, np.array([1] * 300 + [2] * 500 + [9] * 200, np.uint64)).tolist() == [-1] * 300 + [0] * 500 + [2] * 200
    assert asked == [3]


def test_triples_go_in_pieces(spark, monkeypatch):
    """Pieces are bounded, part no context and add up to the whole; files of the trie and scores stay the same."""
    rng = np.random.default_rng(9)
    runs = []
    for n in (5000, 1, 300, 20_000):
        key = np.unique(rng.integers(0, 900, n).astype(np.uint64) << np.uint64(32) | rng.integers(0, 40, n).astype(np.uint64))
        runs.append((key >> np.uint64(32), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), rng.integers(1, 9, len(key))))
    whole = lm._add_up(list(runs))
    docs = spark.createDataFrame([(i, prose(i % 9, 60)) for i in range(50)], "doc_id long, text string").repartition(2)
    scores = lambda: {r.doc_id: r.score for r in lm.score_documents(docs).collect()}
    want = scores()
    monkeypatch.setattr(lm, "PIECE", 64)
    got = list(lm._pieces(list(runs)))
    assert all((np.concatenate(x) == y).all() for x, y in zip(zip(*got, strict=True), whole, strict=True))
    assert len(got) > 100 and max(len(x[0]) for x in got) <= 64 + 64 // 8 + 40  # and the rest of one context
    assert all(x[0][-1] < y[0][0] for x, y in zip(got, got[1:]))
    assert scores() == want


def test_a_level_is_made_in_little_memory():
    """At most three and a half numbers for each value, of what is made too (4.8 before values were encoded in blocks)."""
    n = 1 << 20
    starts, numbers = np.arange(0, n, 4), np.tile(np.arange(4, dtype=np.uint32), n // 4)
    tracemalloc.start()
    level = lm._level(starts, numbers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.5 * 8 * n
    seq = elias_fano.Sequence(*level[4:8])
    assert (seq.get(np.arange(n)) == np.arange(n)).all()


def test_model_of_nothing(spark):
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    r = lm.score_documents(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)


def test_held_out_texts_are_predicted(spark):
    got = queries.op9_lm_scores(spark, "/root/testdata/sf0.001").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_archives(spark):
    rows = [(i, f"https://user@www.Ex{i % 7}.com:80/p{i}?q={i % 3}", f"<p>{'same' if i % 3 == 0 else i}</p>") for i in range(300)]
    rows += [(1000, None, None), (1001, "not a url\nx", ""), (None, "http://a.b/", "<p>same</p>"), (5, "http://c.d", "<p>é</p>"), (1002, "http://www.ex1.com/p1?q=1", "other")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, first int").repartition(4)
    where = work_dir(spark, "test-warc")
    manifest = warc.write_archives(pages, where)
    got = warc.read_archives(spark, where, manifest, pages).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", 1 << 60))
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = first[h or ""] != i
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None] += 1
    assert Counter(map(tuple, got)) == want
    parts = manifest.collect()
    for i, u, h in rows[:12]:
        found = list(warc.look_up(parts, where, u))
        assert [(x["X-Page-ID"], x["WARC-Type"]) for x, _ in found][0][0] == str(i)
        assert all(p.decode() == h for x, p in found if x["WARC-Type"] == "response" and x["X-Page-ID"] == str(i))
    assert len(warc.look_up(parts, where, rows[1][1])) == 2 and warc.look_up(parts, where, "http://nowhere/") == []


def test_archives_against_sql(spark):
    import duckdb

    small = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{small}/pages.parquet' UNION ALL SELECT page_id + 1000, url, html FROM '{small}/pages.parquet' WHERE page_id % 3 = 0 UNION ALL SELECT 5000, NULL, NULL UNION ALL SELECT 5001, 'x', ''")
    want = sorted(map(str, con.sql(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({queries.WARC_SQL})").fetchall()))
    pages = spark.read.parquet(f"{small}/pages.parquet")
    pages = pages.unionByName(pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 1000)).unionByName(spark.createDataFrame([(5000, None, None), (5001, "x", "")], pages.schema))
    where = work_dir(spark, "test-warc")
    got = warc.read_archives(spark, where, warc.write_archives(pages, where), pages)
    assert sorted(str(tuple(r)) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == want


def test_one_response_of_repeated_pages(spark):
    """Rows of one page_id and payload under several urls, equal rows, and many captures of one key in many parts."""
    pages = [(1, "http://b/", "x"), (1, "http://a/", "x"), (2, "http://a/", "x"), (7, "u", "y"), (7, "u", "y"), (7, "u", "z"), (None, "v", "n"), (None, "v", "n")]
    pages += [(100 + i, "http://hot/", f"p{i % 900}") for i in range(2000)]
    df = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, key string").repartition(3)
    where = work_dir(spark, "test-warc")
    manifest = warc.write_archives(df, where)
    got = warc.read_archives(spark, where, manifest, df).collect()
    assert Counter(r.page_id for r in got) == Counter(p[0] for p in pages)
    assert sorted((r.record_type, r.refers_to) for r in got if r.page_id == 1) == [("response", None), ("revisit", 1)]
    assert sorted((r.record_type, r.refers_to) for r in got if r.page_id == 7) == [("response", None), ("response", None), ("revisit", 7)]
    assert [(r.record_type, r.refers_to) for r in got if r.page_id is None] == [("response", None)] * 2
    first = {}
    for i, _, h in sorted(p for p in pages if p[0] is not None):
        first.setdefault(h, i)
    assert {(r.page_id, r.record_type, r.refers_to) for r in got if (r.page_id or 0) >= 100} == {(i, "response" if first[h] == i else "revisit", None if first[h] == i else first[h]) for i, _, h in pages if (i or 0) >= 100}
    assert len(warc.look_up(manifest.collect(), where, "http://hot/")) == 2000


def test_keys_agree(spark):
    urls = ["http://A.b.C:81/x?y#z", "x", "http://É.Ab/\x00a b\t\x7f~", " é\x1f", "https://u:p@h.org", "", None, "http://h.org?q"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(warc._key("url")).collect()] == [warc.surt(u) for u in urls]


def test_small_payloads_stand_alone(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    where = work_dir(spark, "test-warc")
    got = warc.read_archives(spark, where, warc.write_archives(pages, where, least=3), pages).collect()
    assert {(r.page_id, r.record_type) for r in got} == {(1, "response"), (2, "response"), (3, "response"), (4, "revisit")}
    empty = work_dir(spark, "test-warc")
    assert warc.read_archives(spark, empty, warc.write_archives(pages.where(F.lit(False)), empty), pages).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    good = lambda s: "\n".join(f"It was the {prose(5000 + s * 100 + k, 9)} and that is what it was for the {prose(9000 + s * 100 + k, 6)}." for k in range(8))
    item = prose(77, 40)
    rows = [(i, good(i)) for i in range(1, 12)] + [(20, good(3)), (21, good(4) + " more"), (22, f"{good(40)}\n{item}\n{good(41)}"), (23, "too short"), (24, "BUY!! NOW!! $$$ ### | " * 60), (25, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == list(range(1, 12))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "decontamination", "sentencepiece"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 14))


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Every stage alone and the whole over nulls, repeats, long texts, awkward columns, and nothing."""
    import corpus_pipeline

    good = lambda s: "\n".join(f"It was the {prose(5000 + s * 100 + k, 9)} and that is what it was for the {prose(9000 + s * 100 + k, 6)}." for k in range(8))
    rows = [(1, good(1)), (1, good(1)), (None, good(2)), (None, good(2)), (3, None), (4, ""), (5, "\n".join(f"It was the {' '.join(f'x{k}y{i}' for i in range(9))} of the time." for k in range(700))), (6, "solid" * 9000), (7, good(1))]
    schema = "doc_id long, text string, pieces string, n_pieces string, digest string, __key long, rep int, `a.b` double"
    docs = spark.createDataFrame([(*r, "p", "n", "d", 1, 2, 3.0) for r in rows], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert set(out.columns) >= set(docs.columns), name
        assert stage(spark, docs.where(F.lit(False)), sf).count() == 0
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == sorted(["1", "None", "None", "3", "4", "5", "6"])
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "5", "None", "None"] and all(r.n_pieces == len(r.pieces) // 4 > 0 and r["a.b"] == 3.0 for r in got)
