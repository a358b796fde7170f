"""Token counts, token files and SentencePiece against the libraries."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import bpe, token_counts, token_files
from siltstone.llm import sentencepiece as pieces
from siltstone.llm.shared import work_dir

BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", "  ", "a  b", "don't can't 's 'll 're'x", "abc <|endoftext|> def<|endoftext|>", "\t\n x", "x\t y　z q", "１２3 ½ न्म 😀😀 ́a", "aaaaaaaaaaaaaaaaaaaa" * 9, "\x1c a\x1fb \x85 d", "the<|endoftext|", "   \n\n  x  \n ", "word" * 60 + " , the end", "a", "a", "▁ b ▁▁"]
PARTS = st.lists(st.sampled_from(["the", "ing", " ", "  ", "\n", "'s", "'", "é", "中", "😀", "1", ".", "%", "\t", "x", "▁", ",", "½", "<|endoftext|>", "ſ", "aaaa"]), max_size=25).map("".join)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


@pytest.fixture(scope="module")
def counter():
    return token_counts.CountingTokenizer(BYTE_BPE)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(PIECE_BPE)


@settings(max_examples=300, deadline=None)
@given(text=PARTS, size=st.integers(1, 9))
def test_counts_and_chunk_maps(library, counter, text, size):
    want = len(library.encode(text, add_special_tokens=False).ids)
    assert counter.count(text) == want
    assert counter.total([counter.state_map(text[i : i + size]) for i in range(0, len(text), size)]) == want


def test_pair_rule_equals_plain_merging(counter):
    t = counter.words
    rng = np.random.default_rng(0)
    ids = list(t.names)
    for a, b in rng.choice(ids, (3000, 2)).tolist():
        x, y = t.names[a], t.names[b]
        assert t.allowed(a, b) == (bpe.merge(list(x + y), t.rank) == [x, y])


def test_count_tokens(spark, library):
    rows = [(i, t, "n") for i, t in enumerate(ODD)] + [(None, "null id", "n"), (3, ODD[3], "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    for giant in (1 << 20, 3):  # all whole, most in chunks
        got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, BYTE_BPE, 5, giant, 7).collect())
        n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
        assert got == sorted((str(i), len((t or "").encode()), n(t), n(t) > 5) for i, t, _ in rows)


def test_token_files(spark, library):
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(9, "again"), (9, "again"), (None, "no id"), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    where = work_dir(spark, "test-files")
    manifest = token_files.write_token_files(docs, BYTE_BPE, where)
    got = token_files.read_token_files(spark, where, manifest).orderBy("start").collect()
    ids = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "") if r[0] is not None else (False, 0, r[1] or ""))]
    start = 0
    assert [g.doc_id for g in got] == [i for i, _ in ids]
    for g, (_, x) in zip(got, ids, strict=True):
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        start += len(x)
    part = manifest.orderBy("part").first()
    assert token_files.read_ids(where, part.part, 0, part.width).tolist() == ids[0][1]


def test_units_of_many_texts_are_looked_up_once(library):
    class Counting(token_files.Memo):
        asked = 0

        def get(self, key):
            Counting.asked += 1
            return super().get(key)

    enc = token_files.IdEncoder(BYTE_BPE)
    enc.memo = Counting(1000)
    texts = [*["it's a word, 12,5 é.× ×,y a×, don't!'s  \n two"] * 500, "", "a\tb c, d", " \n", "ö\u3000x,", "a<|endoftext|>b", "<|endoftext|x <|endoftext"]
    for _ in range(2):
        ids, n = enc.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert Counting.asked <= 2 * 40


def test_token_files_of_nothing(spark):
    where = work_dir(spark, "test-files")
    manifest = token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), BYTE_BPE, where)
    assert token_files.read_token_files(spark, where, manifest).count() == 0


@settings(max_examples=300, deadline=None)
@given(text=PARTS, size=st.integers(1, 12))
def test_pieces_and_matrices(model, text, size):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    want = lib.encode(text)
    assert model.encode(text) == want and model.decode(want) == lib.decode(want)
    n = model.normalize(text)
    cuts = range(0, len(n), size)
    left, mid, right = [n[max(0, i - 64) : i] for i in cuts], [n[i : i + size] for i in cuts], [n[i + size : i + size + 64] for i in cuts]
    matrices = [model.matrix(*x) for x in zip(left, mid, right, strict=True)]
    ends = model.boundaries(matrices)
    got = b"".join(model.backtrace(l, m, r, a, z) for l, m, r, a, z in zip(left, mid, right, ends, ends[1:], strict=False))
    assert np.frombuffer(got, "<u4").tolist() == want
    parts = list(model.chunks(n, size))
    assert "".join(c for _, c, _ in parts) == n
    ends = model.boundaries([model.matrix(*x) for x in parts])
    got = b"".join(model.backtrace(*x, a, z) for x, a, z in zip(parts, ends, ends[1:], strict=False))
    assert np.frombuffer(got, "<u4").tolist() == want


def test_encode_documents(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(None, None, "x")], "doc_id long, text string, pieces string")
    for giant in (1 << 20, 5):
        rows = pieces.encode_documents(docs, PIECE_BPE, giant=giant, chunk=7).collect()
        assert len(rows) == len(ODD) + 1
        assert all(np.frombuffer(r.pieces, "<u4").tolist() == lib.encode(r.text or "") for r in rows)
        back = {r.doc_id: r.exact for r in pieces.round_trip(docs, PIECE_BPE, giant, 7).collect()}
        assert all(back[i] for i, t in enumerate(ODD) if "▁" not in (t or ""))
    assert pieces.encode_documents(docs.where(F.lit(False)), PIECE_BPE).count() == 0


def test_giant_texts_in_production(spark, library):
    """Texts over the thresholds of the queries, with blanks and without, twice; and columns of awkward names."""
    r = np.random.default_rng(3)
    words = ["the", "ing", "house", "é", "中文", "x1", "''", "ſ", "😀", "don't", "\t", "end.", "<|endoftext|>"]
    long = " ".join(r.choice(words, 12_000))
    solid = "".join(r.choice(["a", "b", "the", "中", "9"], 20_000))
    texts = [long, solid, long[:40_000] + solid[:3] + " " + solid, "." * 70_000, "a" * 33_000, long, " " * 40_000, "short"]
    docs = spark.createDataFrame([(i, t, "k", b"p") for i, t in enumerate(texts)], "doc_id long, text string, digest string, `__digest` binary")
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    got = {x.doc_id: x for x in pieces.encode_documents(docs, PIECE_BPE, "x.y").collect()}
    assert all(np.frombuffer(got[i]["x.y"], "<u4").tolist() == lib.encode(t) and got[i].digest == "k" for i, t in enumerate(texts))
    assert {x.doc_id: (x.n_pieces, x.exact) for x in pieces.round_trip(docs, PIECE_BPE).collect()} == {i: (len(lib.encode(t)), True) for i, t in enumerate(texts)}
    assert {x.doc_id: x.n_tokens for x in token_counts.count_tokens(docs, BYTE_BPE).collect()} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    where = work_dir(spark, "test-files")
    n = {x.doc_id: x.n_tokens for x in token_files.read_token_files(spark, where, token_files.write_token_files(docs, BYTE_BPE, where)).collect()}
    assert n == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_words_fall_into_parts_that_are_known(monkeypatch):
    m, own = pieces.PieceModel(PIECE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    read, plain = [], m.lattice.last_tokens
    monkeypatch.setattr(m.lattice, "last_tokens", lambda word: read.append(len(word)) or plain(word))
    some = ["as", "rbo", "cion", "eau", "lich", "ment", "Or", "x9", "que", "tion"]
    text = " ".join(f"{a}{odd}{b}" for a in some for b in some for odd in ("ж", "\U0001f600", "\x01", "中é"))
    for t in (text, "  ж a\x02b  \x02", "é\x01\x01 ▁x\x01▁", "\ud800a b\ud800"):
        if "\ud800" not in t:
            assert m.encode(t) == own.encode(t) and m.decode(m.encode(t)) == own.decode(own.encode(t))
        assert all("".join(m._parts(u)) == u for u in pieces.UNIT.findall(t))
    # Each part is read once, however many words it is in.
    assert sum(read) < len(text) / 4
    odd = [m.bytes[b] for b in b"\xe2\x82"] + own.encode("a") + [m.bytes[b] for b in b"\x96\xe2\x96\x81 "] + own.encode("b")
    assert m.decode(odd) == "\ufffd a\ufffd   b"  # each run of bytes is read by itself
    assert m.decode([m.bytes[0xEF], 0, m.bytes[0x9E]]) == "\ufffd\ufffd"


def test_parts_of_many_texts_are_looked_up_once():
    class Counting(pieces.Memo):
        asked = 0

        def get(self, key):
            Counting.asked += 1
            return super().get(key)

    m, own = pieces.PieceModel(PIECE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    m.memo = Counting(1000)
    texts = [*["The words, 12,5 of  \U0001f600 ж a▁text\n"] * 500, "", " ", "▁", "é\x01\x01 ▁x\x01▁", "a" * 100]
    for _ in range(2):
        ids, n = m.encode_many(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [own.encode(t) for t in texts]
    assert m.decode_many(ids, n) == [own.decode(own.encode(t)) for t in texts]
    assert Counting.asked <= 2 * 40
