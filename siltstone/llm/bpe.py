"""Byte-pair encoding as a deterministic finite-state transducer, compiled as far as the input needs it.

In byte-pair encoding the tokens of a text are the only sequence in which every two neighbours, encoded alone, come
out as those two. So the last token of each prefix follows from a bounded window: for every start within reach of the
longest token, the trie node of what follows it, the last token before it, and how many tokens came before it. That
window, with the least count taken out, is the state; what is taken out is the count that the transition emits.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Callable

#: States kept before the table is compiled anew; bounds a worker's memory.
MAX_STATES = 200_000
UNKNOWN = -2


def merge(parts: list[str], rank: Callable[[str, str], float | None], made: dict[str, tuple[str, str]] | None = None) -> list[str]:
    """Plain byte-pair encoding: join the pair of least rank, leftmost first, until no pair has one. made: gets the
    halves of what is joined."""
    parts = list(parts)
    ranks = [rank(a, b) for a, b in zip(parts, parts[1:])]
    while True:
        best, at = None, -1
        for i, r in enumerate(ranks):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if at < 0:
            return parts
        if made is not None:
            made[parts[at] + parts[at + 1]] = (parts[at], parts[at + 1])
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del ranks[at]
        if at < len(ranks):
            ranks[at] = rank(parts[at], parts[at + 1])
        if at:
            ranks[at - 1] = rank(parts[at - 1], parts[at])


def _pack(entries: list[tuple[int, int, int]]) -> bytes:
    return array("Q", [node << 40 | before + 2 << 12 | n for node, before, n in entries]).tobytes()


class Transducer:
    """tokens: string of symbols -> id. rank: of a pair that may be joined, else None."""

    def __init__(self, tokens: dict[str, int], rank: Callable[[str, str], float | None]):
        self.tokens, self.rank = tokens, rank
        self.names = {i: t for t, i in tokens.items()}
        self.size = {i: len(t) for t, i in tokens.items()}
        self.longest = max(self.size.values(), default=1)
        self.trie: list[dict[str, int]] = [{}]
        self.token_at = [-1]
        for t, i in tokens.items():
            node = 0
            for c in t:
                nxt = self.trie[node].get(c)
                if nxt is None:
                    nxt = self.trie[node][c] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = i
        self.pairs: dict[int, bool] = {}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.right: dict[int, list] = {}
        self.left: dict[int, list] = {}
        self._reset()

    def _reset(self) -> None:
        #: A window's entries, eight bytes each: trie node, token before (from 2 on), tokens so far.
        self.windows = [_pack([(0, -1, 0)])]
        self.index = {self.windows[0]: 0}
        #: Of each state: symbol -> (row of the next state, emitted count, last token); "" -> (state, tokens that are
        #: still to count where a word ends here).
        self.rows: list[dict[str, tuple]] = [{"": (0, 0)}]

    def _halves(self, t: str) -> tuple[str, str] | None:
        """The two parts whose joining makes t, if encoding t alone gives t; None for a single symbol or another outcome."""
        if t not in self.halves:
            made: dict[str, tuple[str, str]] = {}
            whole = merge(list(t), self.rank, made) == [t]
            self.halves |= {k: v for k, v in made.items() if k not in self.halves}
            if not whole or t not in made:
                self.halves[t] = None
        return self.halves[t]

    def _edge(self, t: str, side: int) -> list[tuple[str, float, float]]:
        """The parts that stand at t's left (0) or right (1) edge while it is made: string, rank at which it is made,
        rank at which it is joined on."""
        out, until = [], math.inf
        while True:
            halves = self._halves(t)
            since = self.rank(*halves) if halves else -math.inf
            out.append((t, since, until))
            if not halves:
                return out
            t, until = halves[side], since

    def allowed(self, a: int, b: int) -> bool:
        """Whether token b may follow a (-1: nothing, UNKNOWN: a symbol that no token has): b is what encoding it alone
        gives, and no part at a's right edge is joined with one at b's left edge while both stand."""
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is not None:
            return got
        got = self._alone(b)
        if got and a >= 0:
            if a not in self.right:
                self.right[a] = self._edge(self.names[a], 1)
            if b not in self.left:
                self.left[b] = self._edge(self.names[b], 0)
            got = self._alone(a)
            for x, x_since, x_until in self.right[a]:
                for y, y_since, y_until in self.left[b]:
                    if x_since <= y_until and y_since < x_until and (r := self.rank(x, y)) is not None and r < x_until and r <= y_until:
                        got = False
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        self.pairs[key] = got
        return got

    def _alone(self, t: int) -> bool:
        return len(self.names[t]) == 1 or self._halves(self.names[t]) is not None

    def _compile(self, row: dict[str, tuple], c: str) -> tuple:
        state = row[""][0]
        live, found, n = [], None, 0
        for entry in memoryview(self.windows[state]).cast("Q"):
            node, before, n = entry >> 40, (entry >> 12 & 0xFFFFFFF) - 2, entry & 0xFFF
            child = self.trie[node].get(c)
            if child is None:
                continue
            t = self.token_at[child]
            if t >= 0 and found is None and self.allowed(before, t):
                found = (t, n + 1)
            if self.trie[child]:
                live.append((child, before, n))
        if found is None:  # no token has this symbol
            found = (UNKNOWN, n + 1)  # the last entry's count is the prefix's
            live = []
        live.append((0, *found))
        least = min(n for _, _, n in live)
        key = _pack([(a, b, n - least) for a, b, n in live])
        to = self.index.get(key)
        if to is None:
            to = self.index[key] = len(self.windows)
            self.windows.append(key)
            self.rows.append({"": (to, found[1] - least)})
        step = row[c] = (self.rows[to], least, found[0])
        return step

    def _fresh(self) -> None:
        if len(self.windows) > MAX_STATES:
            self._reset()

    def count(self, word: str) -> int:
        """Tokens of one pre-token: the sum of what its transitions emit, and of its last state's rest."""
        self._fresh()
        row, n = self.rows[0], 0
        for c in word:
            row, emitted, _ = row.get(c) or self._compile(row, c)
            n += emitted
        return n + row[""][1]

    def last_tokens(self, word: str) -> list[int]:
        """The last token (or UNKNOWN) of each prefix of one pre-token: the forward pass."""
        self._fresh()
        row, last = self.rows[0], []
        put = last.append
        for c in word:
            step = row.get(c) or self._compile(row, c)
            row = step[0]
            put(step[2])
        return last
