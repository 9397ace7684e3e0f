"""A generalised suffix automaton over the words of test items: the matching statistics of a text against all of them at once."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The longest runs of letters and digits, in lower case."""
    if text.isascii():
        return _WORD.findall(text.lower())
    return [w.lower() for w in _WORD.findall(text)]


class SuffixAutomaton:
    """Of several word sequences. ``seeds`` finds where a text has at least ``least`` successive words of any of them."""

    def __init__(self, texts: Sequence[Sequence[str]], least: int):
        self.least = least
        self.vocabulary: dict[str, int] = {}
        self.texts = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in t], dtype=np.int32) for t in texts]
        self.starts = np.cumsum([0, *[len(t) for t in self.texts]])
        self._next: list[dict[int, int]] = [{}]
        self._link, self._length = [-1], [0]
        ends: list[list[int]] = [[]]
        for n, text in enumerate(self.texts):
            last = 0
            for i, w in enumerate(text.tolist()):
                last = self._extend(last, w, ends)
                ends[last].append(int(self.starts[n]) + i)
        self._ends = ends
        self._below: list[list[int]] = [[] for _ in self._link]
        for state, up in enumerate(self._link):
            if up >= 0:
                self._below[up].append(state)
        self._found: dict[int, np.ndarray] = {}

    def _extend(self, last: int, w: int, ends: list[list[int]]) -> int:
        """The state of the current prefix grown by one word; splits a state where the sequences so far part."""
        nexts, link, length = self._next, self._link, self._length
        if w in nexts[last]:
            q = nexts[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q, ends)
        new = self._state(length[last] + 1, {}, ends)
        p = last
        while p >= 0 and w not in nexts[p]:
            nexts[p][w] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nexts[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q, ends)
        return new

    def _state(self, length: int, nexts: dict[int, int], ends: list[list[int]]) -> int:
        self._next.append(nexts)
        self._link.append(0)
        self._length.append(length)
        ends.append([])
        return len(self._link) - 1

    def _split(self, p: int, w: int, q: int, ends: list[list[int]]) -> int:
        copy = self._state(self._length[p] + 1, dict(self._next[q]), ends)
        self._link[copy], self._link[q] = self._link[q], copy
        while p >= 0 and self._next[p].get(w) == q:
            self._next[p][w] = copy
            p = self._link[p]
        return copy

    def _occurrences(self, state: int) -> np.ndarray:
        """Ends, in the joined sequences, of the words that lead to ``state``."""
        if state not in self._found:
            out, todo = [], [state]
            while todo:
                s = todo.pop()
                out += self._ends[s]
                todo += self._below[s]
            self._found[state] = np.array(sorted(out), dtype=np.int64)
        return self._found[state]

    def ids(self, text: list[str]) -> np.ndarray:
        """The words as numbers, -1 for those that no item has."""
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in text), dtype=np.int32, count=len(text))

    def seeds(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(j, end): the text's words up to j, at least ``least`` of them, are those of the joined sequences up to ``end``.

        Only runs of known words can match, so only those that are long enough are followed.
        """
        known = np.concatenate(([False], ids >= 0, [False]))
        edges = np.flatnonzero(known[1:] != known[:-1])
        js, ends = [], []
        nexts, link, length, least = self._next, self._link, self._length, self.least
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a < least:
                continue
            state = matched = 0
            for j in range(a, b):
                w = int(ids[j])
                while state and w not in nexts[state]:
                    state = link[state]
                    matched = length[state]
                if w in nexts[state]:
                    state = nexts[state][w]
                    matched += 1
                if matched < least:
                    continue
                at = state
                while length[link[at]] >= least:  # the state of the last ``least`` words has all their occurrences
                    at = link[at]
                found = self._occurrences(at)
                js.append(np.full(len(found), j, dtype=np.int64))
                ends.append(found)
        if not js:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(js), np.concatenate(ends)
