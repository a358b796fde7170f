"""SentencePiece encoding and decoding by a max-plus scan.

A path's score is 0 if every two neighbouring pieces may stand together in the model's byte-pair encoding, else minus
infinity; exactly one path has score 0, and it is the library's encoding. A word's forward pass runs on a transducer
whose states are the live lattice nodes. Between two characters that no piece has beside each other nothing reaches across
and nothing is joined, so there a word falls into parts whose matrices are single numbers, too: texts are cut into these parts
as arrays, many at once, and each distinct part is read once for a bounded memo. A text of over GIANT characters is dealt out in chunks, each of which gives a
matrix over boundary states, which are the pieces that reach across or end at a cut: (piece, characters before the cut).
Matrices combine by the max-plus product; then the boundary states are known and every chunk is backtraced on its own.
A cut is made before a blank where one is near: no piece reaches across, so there is one state, and a chunk between two
such cuts has a matrix of one row and one column. Elsewhere (a long run without blanks) only the run's ends matter: the
words between a chunk's first and last blank are again matrices of one number.

Defined cases: null and empty texts have no pieces and decode to the empty text; very long texts are encoded whole;
repeated rows and further columns, whatever their names, are kept as they are (a column that has the name of the result
is replaced); ties don't arise, for one path has score 0; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.bpe import UNKNOWN, Transducer
from siltstone.llm.shared import columns_of, distinct, free_name, gathered, hold, joined, map_rows, Memo, runs_of, small_batches

SPACE = "▁"
UNIT = re.compile(" *[^ ]+| +")
#: A character before which no cut is made, and a blank behind it.
BLANK = re.compile(f"[^{SPACE}]{SPACE}")
#: Parts that a worker knows, about; and where it does nothing but the round trip. The pipeline's last stage has a full heap
#: beside it, so there texts are encoded one at a time.
MEMO, MEMO_ALONE = 250_000, 400_000
BYTE, NORMAL = 6, 1
#: Characters of a text that is dealt out, of its chunks, and within which a blank is sought for a cut.
GIANT, CHUNK, NEAR = 1 << 15, 1 << 14, 1 << 12
#: Characters around a chunk that a piece may reach.
AROUND = 64


class PieceModel:
    """A byte-pair model of a sentencepiece .model file with byte fallback and no text normalization."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.trainer_spec.model_type != 2 or not m.trainer_spec.byte_fallback or m.normalizer_spec.name != "identity" or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only byte-pair models with byte fallback and identity normalization are known")
        score = {p.piece: p.score for p in m.pieces if p.type == NORMAL}
        self.prefix = m.normalizer_spec.add_dummy_prefix
        self.bytes = {int(p.piece[3:-1], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.lattice = Transducer({p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}, lambda a, b: -s if (s := score.get(a + b)) is not None else None)
        self.crosses = any(SPACE in p.lstrip(SPACE) for p in score)
        self.memo = Memo(MEMO)
        #: Pairs of characters that stand beside each other in a piece; blanks for space marks.
        self.beside = {pair for t in (p.replace(SPACE, " ") for p in score) for pair in zip(t, t[1:])}
        #: The same by number of the characters, which is 0 for all that stand in no such pair.
        some = sorted({c for pair in self.beside for c in pair})
        self.number = np.zeros(0x110000, np.int32)
        self.number[[*map(ord, some)]] = np.arange(1, len(some) + 1)
        self.cut = np.ones((len(some) + 1, len(some) + 1), bool)
        for a, b in self.beside:
            self.cut[self.number[ord(a)], self.number[ord(b)]] = False
        #: UTF-8 bytes by id.
        self.raw = [p.piece.encode() if p.type == NORMAL else bytes([self.byte_of[i]]) if p.type == BYTE else b"" for i, p in enumerate(m.pieces)]

    def normalize(self, text: str) -> str:
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def ids(self, path: list[tuple[int, str]]) -> list[int]:
        out: list[int] = []
        for i, s in path:
            if i == UNKNOWN:
                out += [self.bytes[b] for b in s.encode("utf-8", "surrogatepass")]
            else:
                out.append(i)
        return out

    def _word(self, word: str) -> bytes:
        """Packed ids of a normalized word: the forward pass, then the backtrace over last pieces."""
        last, at = self.lattice.last_tokens(word), len(word)
        size, out = self.lattice.size, []
        while at:
            t = last[at - 1]
            if t >= 0:
                out.append(t)
                at -= size[t]
            else:
                at -= 1
                out += [self.bytes[b] for b in reversed(word[at].encode("utf-8", "surrogatepass"))]
        out.reverse()
        return array("I", out).tobytes()

    def _parts(self, unit: str) -> list[str]:
        """What lies between the places of a unit where no piece reaches across."""
        inside = [*map(self.beside.__contains__, zip(unit, unit[1:]))]
        out, at = [], 0
        for _ in range(inside.count(False)):
            cut = inside.index(False, at) + 1
            out.append(unit[at:cut])
            at = cut
        out.append(unit[at:])
        return out

    def _unit(self, unit: str) -> bytes:
        """Packed ids of a unit that isn't memoized; its parts are."""
        memo, out = self.memo, []
        for p in self._parts(unit):
            if (got := memo.get(p) or memo.recall(p)) is None:
                got = self._word(p.replace(" ", SPACE))
                if len(p) < 64:
                    memo[p] = got
            out.append(got)
        return b"".join(out)

    def encode_packed(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return self.encode_part(" " + text if self.prefix and text else text)

    def encode_part(self, text: str) -> bytes:
        """Ids of what stands between a text's edge or a cut before a blank, and another. No piece reaches from a word into
        the blank behind it, so that the matrix of a word has one row and one column and words are memoized."""
        if self.crosses:
            return self._word(text.replace(" ", SPACE))
        if SPACE in text:  # a space mark of the text itself can't be told from a blank's
            text = text.replace(SPACE, " ")
        memo = self.memo
        memo.turn()
        units = UNIT.findall(text)
        out = list(map(memo.get, units))
        if None in out:
            for i, got in enumerate(out):
                if got is None:
                    u = units[i]
                    if (got := memo.get(u) or memo.recall(u)) is None:
                        got = self._unit(u)
                        if len(u) < 64:
                            memo[u] = got
                    out[i] = got
        return b"".join(out)

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts in a row, and how many each text has."""
        if self.crosses:
            packed = [self.encode_packed(t) for t in texts.to_pylist()]
            return gathered(packed, np.arange(len(packed)), "<u4")
        data, line = joined(pc.replace_substring(texts, SPACE, " "))
        some = np.diff(line) > 0
        if self.prefix:
            data, line = np.insert(data, line[:-1][some], 32), line + np.append(0, np.cumsum(some))
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        number = self.number[points]
        begins = (data & 0xC0) != 0x80  # a character
        begins[begins] = np.append(True, self.cut[number[:-1], number[1:]])[: len(number)]
        begins[line[:-1][some]] = True
        starts = np.flatnonzero(begins)
        parts, codes = distinct(data, starts)
        memo = self.memo
        memo.turn()
        got = list(map(memo.get, parts))
        for i in [i for i, g in enumerate(got) if g is None]:
            p = parts[i]
            if (ids := memo.recall(p)) is None:
                ids = self._word(p.decode().replace(" ", SPACE))
                if len(p) < 64:
                    memo[p] = ids
            got[i] = ids
        ids, n = gathered(got, codes, "<u4")
        return ids, np.diff(np.append(0, np.cumsum(n))[np.searchsorted(starts, line)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Pieces joined, byte runs read as UTF-8, the dummy prefix taken off."""
        raw = self.raw
        runs = [raw[i] for i in np.asarray(ids).tolist()]
        if b"" in runs:  # a control piece parts the bytes around it
            text = "".join(b"".join(r).decode("utf-8", "replace") for _, r in itertools.groupby(runs, bool))
        else:
            text = b"".join(runs).decode("utf-8", "replace")
        return self._plain(text)

    def decode_many(self, ids: np.ndarray, n: np.ndarray) -> list[str]:
        """The texts of ids in a row, of which each text has n."""
        data, size = gathered(self.raw, ids, np.uint8)
        line = np.append(0, np.cumsum(n))
        if not size.all():  # control pieces
            return [self.decode(ids[a:z]) for a, z in itertools.pairwise(line.tolist())]
        held = data.tobytes()
        return [self._plain(held[a:z].decode("utf-8", "replace")) for a, z in itertools.pairwise(np.append(0, np.cumsum(size))[line].tolist())]

    def _plain(self, text: str) -> str:
        """The dummy prefix taken off, blanks for space marks."""
        if self.prefix and text.startswith(SPACE):
            text = text[1:]
        return text.replace(SPACE, " ")

    # Giant texts. A boundary state is (piece id, its string, characters of it before the cut).

    def entries(self, left: str, right: str) -> list[tuple[int, str, int]]:
        """Every boundary state that fits the text on both sides of a cut; at a text's edge there is one, (-1, "", 0)."""
        if not left or not right:
            return [(-1, "", 0)]
        lat, out = self.lattice, []
        for k in range(1, min(lat.longest, len(left)) + 1):
            node, text = 0, left[-k:] + right[: lat.longest]
            for n, c in enumerate(text, 1):
                node = lat.trie[node].get(c)
                if node is None:
                    break
                if n >= k and lat.token_at[node] >= 0:
                    out.append((lat.token_at[node], text[:n], k))
        if left[-1] not in lat.trie[0] or lat.token_at[lat.trie[0][left[-1]]] < 0:
            out.append((UNKNOWN, left[-1], 1))
        return out

    def chunks(self, text: str, size: int) -> Iterator[tuple[str, str, str]]:
        """(left, chunk, right) of the chunks of a normalized text, with what is around them; nothing beside a cut before
        a blank, where there is one boundary state."""
        at, left = 0, ""
        while at < len(text):
            cut = at + size
            if cut >= len(text):
                yield left, text[at:], ""
                return
            near = cut if self.crosses else text.find(SPACE, cut, cut + NEAR)
            while near > 0 and text[near - 1] == SPACE and not self.crosses:  # a blank that follows another isn't a cut
                near = text.find(SPACE, near + 1, cut + NEAR)
            if near > 0 and not self.crosses:
                yield left, text[at:near], ""
                at, left = near, ""
            else:
                yield left, text[at:cut], text[cut : cut + AROUND]
                at, left = cut, text[max(0, cut - AROUND) : cut]

    def _forward(self, text: str, right: str, entry: tuple[int, str, int]) -> tuple[list[dict], list]:
        """Lattice nodes by position reached from an entry: {piece: (start, piece before)}; and the exits it reaches."""
        lat = self.lattice
        n, begin = len(text), len(entry[1]) - entry[2]
        nodes: list[dict] = [{} for _ in range(n + 1)]
        exits: list[tuple[tuple[int, str, int], int]] = []
        if begin > n:
            return nodes, [((entry[0], entry[1], entry[2] + n), entry[0])] if right else []
        nodes[begin][entry[0]] = (None, None)
        both = text + right[: lat.longest]
        for i in range(begin, n):
            for before in list(nodes[i]):
                node = 0
                for j in range(i, len(both)):
                    node = lat.trie[node].get(both[j])
                    if node is None:
                        break
                    t = lat.token_at[node]
                    if t >= 0 and lat.allowed(before, t):
                        if j + 1 <= n:
                            nodes[j + 1].setdefault(t, (i, before))
                        else:
                            exits.append(((t, both[i : j + 1], n - i), before))
                first = lat.trie[0].get(both[i])
                if first is None or lat.token_at[first] < 0:
                    nodes[i + 1].setdefault(UNKNOWN, (i, before))
        for t in nodes[n]:
            name = lat.names[t] if t >= 0 else text[-1:] if t == UNKNOWN else ""
            exits.append(((t, name, len(name)), t))
        return nodes, exits

    def _inner(self, left: str, text: str, right: str) -> tuple[int, int] | None:
        """Where the words of a chunk begin and end that no boundary state reaches: at its edge where that is a cut before
        a blank, else at its first or last blank; None where it has none."""
        first = BLANK.search(text)
        if self.crosses or not first:
            return None if left or right else (0, len(text))
        last = text.rfind(SPACE)
        while text[last - 1] == SPACE:  # where the last run of blanks begins
            last -= 1
        return first.start() + 1 if left else 0, max(last, first.start() + 1) if right else len(text)

    def matrix(self, left: str, text: str, right: str) -> dict[tuple, list[tuple]]:
        """Transfer matrix of a chunk, its finite entries only: entry state -> exit states of score 0. The words inside
        have one state before and behind them."""
        inner = self._inner(left, text, right)
        if not inner:
            return self._reached(left, text, right)
        edge = (-1, "", 0)
        out = {edge: [edge]}
        if left:
            out = self._reached(left, text[: inner[0]], "")
        return self.product(out, self._reached("", text[inner[1] :], right)) if right else out

    def _reached(self, left: str, text: str, right: str) -> dict[tuple, list[tuple]]:
        out = {}
        for e in self.entries(left, text + right):
            exits = {x for x, _ in self._forward(text, right, e)[1]}
            if not right:
                exits = {(-1, "", 0)} if exits else set()
            if exits:
                out[e] = sorted(exits)
        return out

    @staticmethod
    def product(a: dict, b: dict) -> dict:
        """Max-plus product over scores 0 and minus infinity: a path exists or not. Associative."""
        out = {}
        for e, mids in a.items():
            exits = {x for m in mids for x in b.get(m, ())}
            if exits:
                out[e] = sorted(exits)
        return out

    def boundaries(self, matrices: list[dict]) -> list[tuple]:
        """The state at each cut, from a suffix scan of products: of the exits reached, the one that leads on."""
        if not matrices:
            return []
        after = [None] * len(matrices)
        after[-1] = matrices[-1]
        for i in range(len(matrices) - 2, -1, -1):
            after[i] = self.product(matrices[i], after[i + 1])
        at, out = (-1, "", 0), [(-1, "", 0)]
        for i in range(len(matrices) - 1):
            at = next(x for x in matrices[i][at] if x in after[i + 1])
            out.append(at)
        return [*out, (-1, "", 0)]

    def backtrace(self, left: str, text: str, right: str, entry: tuple, exit_: tuple) -> bytes:
        """Ids of the pieces that begin in a chunk, given its boundary states."""
        inner = self._inner(left, text, right)
        if not inner:
            return self._traced(text, right, entry, exit_)
        a, z = inner
        edge = (-1, "", 0)
        head = self._traced(text[:a], "", entry, edge) if left else b""
        tail = self._traced(text[z:], right, edge, exit_) if right else b""
        return head + self.encode_part(text[a:z]) + tail

    def _traced(self, text: str, right: str, entry: tuple, exit_: tuple) -> bytes:
        nodes, exits = self._forward(text, right, entry)
        path: list[tuple[int, str]] = []
        n = len(text)
        if not right:
            at, piece = n, next(iter(nodes[n]))
        else:
            piece = next(p for x, p in exits if x == exit_)
            reach = exit_[2] if exit_[0] != -1 else 0
            ends_here = exit_[2] == len(exit_[1])
            at = n if ends_here else n - reach
            if not ends_here and at >= 0:
                path.append((exit_[0], exit_[1]))
        both = text + right
        while at >= 0:
            start, before = nodes[at].get(piece, (None, None)) if at <= n else (None, None)
            if start is None:
                break
            path.append((piece, both[start:at]))
            at, piece = start, before
        return np.array(self.ids(path[::-1]), "<u4").tobytes()


_LOADED: dict[str, PieceModel] = {}


def loaded(path: str, most: int = MEMO) -> PieceModel:
    hold("sentencepiece", _LOADED.clear)
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    _LOADED[path].memo.most = most
    return _LOADED[path]


def encode_documents(docs: DataFrame, model: str, into: str = "pieces", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """All columns of docs and `into`, the packed ids (unsigned 32-bit, little-endian) of its text. A column of docs of
    that name is replaced.

    Texts of up to `giant` characters are encoded where they are read. Longer ones are dealt out in chunks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(into)

    def whole(batches, at):
        m = loaded(model)
        for b in batches:
            packed = [m.encode_packed(t or "") for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(packed, pa.binary())], [*b.schema.names, into])

    length = F.coalesce(F.length("text"), F.lit(0))
    short = map_rows(docs.where(length <= giant), whole, T.StructField(into, T.BinaryType()))
    key = free_name(docs, "digest")
    big = docs.where(length > giant).withColumn(key, F.md5(F.col("text").cast("binary")))
    traced = _encode_giant(big.select(F.col(key).alias("digest"), "text"), model, chunk).withColumnsRenamed({"digest": key, "ids": into})
    return short.unionByName(big.join(traced, key).select(*columns_of(short)))


STATE = "struct<id:int,piece:string,cut:int>"
_FIELDS = ("id", "piece", "cut")
_STATE = pa.struct([("id", pa.int32()), ("piece", pa.string()), ("cut", pa.int32())])


def _encode_giant(big: DataFrame, model: str, chunk: int) -> DataFrame:
    """(digest, ids) of the distinct texts of (digest, text). Chunks carry the characters around them that a piece may
    reach; matrices meet, chunk texts don't."""
    texts = big.groupBy("digest").agg(F.first("text").alias("text"))
    row = lambda s: dict(zip(_FIELDS, s, strict=True))
    tup = lambda s: tuple(s[k] for k in _FIELDS)

    def dealt(batches):
        m = loaded(model)
        if m.lattice.longest > AROUND:
            raise ValueError("pieces are longer than the context of a chunk")
        for b in batches:
            for h, t in zip(b.column("digest").to_pylist(), b.column("text").to_pylist(), strict=True):
                some: list[tuple] = []
                for k, c in enumerate(m.chunks(m.normalize(t), chunk)):
                    some.append((h, k, *c))
                    if len(some) == 64:
                        yield _columns(some)
                        some = []
                if some:
                    yield _columns(some)

    def _columns(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], ["digest", "part", "before", "chunk", "behind"])

    def matrices(batches):
        m = loaded(model)
        for b in batches:
            rows = [[{"entry": row(e), "exits": [row(x) for x in xs]} for e, xs in m.matrix(*t).items()] for t in zip(*(b.column(n).to_pylist() for n in ("before", "chunk", "behind")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("part"), pa.array(rows, pa.list_(pa.struct([("entry", _STATE), ("exits", pa.list_(_STATE))])))], ["digest", "part", "matrix"])

    def scan(batches):
        m = loaded(model)
        for b in batches:
            for h, ms in zip(b.column("digest").to_pylist(), b.column("ms").to_pylist(), strict=True):
                ms = sorted(ms, key=lambda x: x["part"])
                cuts = m.boundaries([{tup(r["entry"]): [tup(x) for x in r["exits"]] for r in x["matrix"]} for x in ms])
                as_rows = lambda cs: pa.array([row(c) for c in cs], _STATE)
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(ms), pa.string()), pa.array([x["part"] for x in ms], pa.int32()), as_rows(cuts[:-1]), as_rows(cuts[1:])], ["digest", "part", "entry", "exit"])

    def traced(batches):
        m = loaded(model)
        for b in batches:
            got = [m.backtrace(*t, tup(e), tup(x)) for *t, e, x in zip(*(b.column(n).to_pylist() for n in ("before", "chunk", "behind", "entry", "exit")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("part"), pa.array(got, pa.binary())], ["digest", "part", "ids"])

    parts = texts.mapInArrow(dealt, "digest string, part int, before string, chunk string, behind string").repartition("digest", "part")
    made = parts.mapInArrow(matrices, f"digest string, part int, matrix array<struct<entry:{STATE},exits:array<{STATE}>>>")
    cuts = made.groupBy("digest").agg(F.collect_list(F.struct("part", "matrix")).alias("ms")).mapInArrow(scan, f"digest string, part int, entry {STATE}, exit {STATE}")
    ids = parts.join(cuts, ["digest", "part"]).mapInArrow(traced, "digest string, part int, ids binary")
    whole = ids.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("p"))
    return whole.select("digest", F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))


def _digest(text: str | None, packed: bytes | np.ndarray, back: str) -> tuple:
    return memoryview(packed).nbytes // 4, zlib.crc32(packed), zlib.crc32(back.encode("utf-8", "replace")), back == (text or "")


def round_trip(docs: DataFrame, model: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_crc32, exact (the decoded text equals the text) of each document, encoded as
    by encode_documents and decoded again."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    names = ["doc_id", "n_pieces", "ids_crc32", "decoded_crc32", "exact"]
    schema = f"doc_id {id_type}, n_pieces bigint, ids_crc32 bigint, decoded_crc32 bigint, exact boolean"

    def both(batches):
        m = loaded(model, MEMO_ALONE)
        for run in runs_of(batches):
            texts = run.column("text").combine_chunks().fill_null("")
            ids, n = m.encode_many(texts)
            own = np.split(ids, np.cumsum(n)[:-1])
            got = [*map(_digest, texts.to_pylist(), own, m.decode_many(ids, n))]
            yield pa.RecordBatch.from_arrays([run.column("doc_id").combine_chunks(), *(pa.array([g[i] for g in got], k) for i, k in enumerate(kinds))], names)

    def decoded(batches):
        m = loaded(model)
        for b in batches:
            got = [_digest(t, p, m.decode(np.frombuffer(p, "<u4"))) for t, p in zip(b.column("text").to_pylist(), b.column("ids").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([g[i] for g in got], k) for i, k in enumerate(kinds))], names)

    length = F.coalesce(F.length("text"), F.lit(0))
    big = rows.where(length > giant).withColumn("digest", F.md5(F.col("text").cast("binary")))
    return rows.where(length <= giant).mapInArrow(both, schema).unionByName(big.join(_encode_giant(big.select("digest", "text"), model, chunk), "digest").select("doc_id", "text", "ids").mapInArrow(decoded, schema))
