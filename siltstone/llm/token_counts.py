"""Token counts by a compiled finite-state tokenizer.

A text's state map is (head, count, tail): what stands before its first safe boundary, the tokens between the first
and the last one, and what stands behind it. At a safe boundary every state of the tokenizer goes to the same one, so this
short form is the whole map from any start state: between a character that isn't white space and a blank or line feed,
before a mark behind a letter, and between a Latin letter and a digit. Maps compose associatively, so chunks of one giant
text are counted apart and joined by a scan. What a chunk passes on is at most a run of letters (or digits, or marks).

Defined cases: null and empty texts have 0 tokens; very long texts are counted whole; rows that repeat are counted each;
ties don't arise; an empty table gives no rows; further columns are ignored, whatever their names. Special strings in a
text count one token each, as the tokenizers library does by default.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bpe import Transducer
from siltstone.llm.shared import hold, Memo, small_batches, text_of

#: White space other than blank and line feed, where a chunk isn't cut and units aren't told apart.
ODD_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f]")
#: A word of Latin letters before a blank or a mark ends there whatever follows; else a unit reaches to the next blank.
ODD = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
UNIT = re.compile(r"[ \n]?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[ \n,.;:!?|$%#&*]|\Z)|[ \n]*[^ \n]+|[ \n]+")
#: Safe boundaries of a chunk, none of which lies in a special string.
CUT = re.compile(r"(?<=[^ \n])(?=[ \n])|(?<=[^\W\d_])(?=[.,;:!?。，、；：！？])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
#: Characters of a text that is dealt out, and of its chunks.
GIANT, CHUNK = 1 << 15, 1 << 14
MEMO = 800_000
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies: printable bytes stand for themselves, the others
    follow from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in own}
    rest = [b for b in range(256) if b not in set(own)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class CountingTokenizer:
    """The byte-level tokenizer of a tokenizers .json file, compiled to transducers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without a normalizer can be compiled")
        back = byte_alphabet()
        plain = lambda t: "".join(chr(back[c]) for c in t)
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        if any(CUT.search(t) for t in self.special):
            raise ValueError("a special string holds a boundary")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ranks = {(plain(a), plain(b)): i for i, (a, b) in enumerate(pairs)}
        tokens = {plain(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.words = Transducer(tokens, lambda a, b: ranks.get((a, b)))
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.kinds: dict[str, str] = {" ": "s", "\n": "s"}
        self.memo = Memo(MEMO)
        self.splitter = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def kind(self, c: str) -> str:
        """Letter, number, space or other, as the library's own pre-tokenizer has it."""
        got = self.kinds.get(c)
        if got is None:
            one = lambda x: len(self.pre.pre_tokenize_str(x)) == 1
            got = "L" if one("a" + c) else "N" if one("1" + c) else "o" if one("!" + c) else "s"
            self.kinds[c] = got
        return got

    def pretokens(self, text: str) -> Iterator[str]:
        """The automaton over character kinds: runs of one kind, a blank before them, contractions, white space."""
        kinds = [self.kinds.get(c) or self.kind(c) for c in text]
        i, n = 0, len(text)
        while i < n:
            k = kinds[i]
            if text[i] == "'":
                short = next((x for x in CONTRACTIONS if text.startswith(x, i)), None)
                if short:
                    yield short
                    i += len(short)
                    continue
            j = i + 1
            if k == "s":
                if text[i] == " " and j < n and kinds[j] != "s":
                    k = kinds[j]
                else:
                    while j < n and kinds[j] == "s":
                        j += 1
                    if j < n and j > i + 1:
                        j -= 1  # the last one goes with what follows
                    yield text[i:j]
                    i = j
                    continue
            while j < n and kinds[j] == k:
                j += 1
            yield text[i:j]
            i = j

    def count_piece(self, text: str) -> int:
        """Tokens of a text without special strings, by the transducers alone."""
        count = self.words.count
        return sum(count(w.encode().decode("latin-1")) for w in self.pretokens(text))

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if self.splitter and any(s in text for s in self.special):
            return sum(self.count(x) if x else 0 for x in self.splitter.split(text)) + len(self.splitter.findall(text))
        if any([c in text for c in ODD]):
            return self.count_piece(text)
        memo, units = self.memo, UNIT.findall(text)
        known = list(map(memo.get, units))
        if None not in known:
            return sum(known)
        memo.turn()
        n = 0
        for unit, k in zip(units, known, strict=True):
            if k is None and (k := memo.recall(unit)) is None:
                k = self.count_piece(unit)
                if len(unit) < 64:
                    memo[unit] = k
            n += k
        return n

    def state_map(self, chunk: str) -> tuple[str, int, str] | tuple[str, None, None]:
        """(head, count, tail) of a chunk; count None where it has no safe boundary. Boundaries beside odd white space
        aren't safe, for it joins the blank that follows."""
        cuts = [m.start() for m in CUT.finditer(chunk) if not ODD_SPACE.match(chunk[m.start() - 1])]
        if not cuts:
            return chunk, None, None
        return chunk[: cuts[0]], self.count(chunk[cuts[0] : cuts[-1]]), chunk[cuts[-1] :]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbouring chunks. Associative."""
        if a[1] is None:
            return (a[0] + b[0], b[1], b[2])
        if b[1] is None:
            return self._cut_tail(a[0], a[1], a[2] + b[0])
        return (a[0], a[1] + self.count(a[2] + b[0]) + b[1], b[2])

    def _cut_tail(self, head: str, n: int, tail: str) -> tuple:
        """A joined tail may hold a boundary now; a special string can't, so cutting there is safe."""
        cuts = [m.start() for m in CUT.finditer(tail) if not ODD_SPACE.match(tail[m.start() - 1])]
        return (head, n + self.count(tail[: cuts[-1]]), tail[cuts[-1] :]) if cuts else (head, n, tail)

    def total(self, maps: Iterable[tuple]) -> int:
        """Tree scan over the maps of a text's chunks in order."""
        level = list(maps)
        while len(level) > 1:
            level = [self.compose(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        if not level:
            return 0
        head, n, tail = level[0]
        return self.count(head) if n is None else self.count(head) + n + self.count(tail)


_LOADED: dict[str, CountingTokenizer] = {}


def compiled(path: str) -> CountingTokenizer:
    hold("token_counts", _LOADED.clear)
    if path not in _LOADED:
        _LOADED[path] = CountingTokenizer(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row.

    Texts of up to `giant` characters are counted where they are read, without a shuffle. Longer ones are cut into
    chunks of `chunk` characters that all executors share; only their state maps meet again.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), text_of().alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def whole(batches):
        tok = compiled(tokenizer)
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array([tok.count(t) for t in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    def mapped(batches):
        tok = compiled(tokenizer)
        for b in batches:
            maps = [tok.state_map(t) for t in b.column("text").to_pylist()]
            keep = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), *(pa.array([m[i] for m in maps], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string())))], [*keep, "head", "n", "tail"])

    def joined(batches):
        tok = compiled(tokenizer)
        for b in batches:
            sums = [tok.total((m["head"], m["n"], m["tail"]) for m in sorted(ms, key=lambda m: m["part"])) for ms in b.column("maps").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(sums, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = f"doc_id {id_type}, n_bytes bigint, n_tokens bigint"
    size = F.octet_length("text").cast("long").alias("n_bytes")
    short = rows.where(F.length("text") <= giant).select("doc_id", size, "text").mapInArrow(whole, out)
    parts = rows.where(F.length("text") > giant).select(
        "doc_id", size, F.md5(F.col("text").cast("binary")).alias("digest"),
        F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("int")), lambda i: F.substr("text", i * chunk + 1, F.lit(chunk)))).alias("part", "text"),
    )
    maps = parts.repartition("doc_id", "digest", "part").mapInArrow(mapped, f"doc_id {id_type}, n_bytes bigint, digest string, part int, head string, n bigint, tail string")
    long = maps.groupBy("doc_id", "n_bytes", "digest").agg(F.collect_set(F.struct("part", "head", "n", "tail")).alias("maps"), F.count_if(F.col("part") == 0).cast("int").alias("copies"))
    long = long.select("doc_id", "n_bytes", "maps", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy").mapInArrow(joined, out)
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)
