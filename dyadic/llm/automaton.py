"""Generalised suffix automaton of token sequences, and the statistics that a stream of tokens has against it.

States stand for sets of substrings with the same end positions; ``length`` is the longest of a state and
``link`` leads to the next shorter ones. A stream keeps the longest suffix that occurs in some sequence.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class SuffixAutomaton:
    def __init__(self, sequences: Iterable[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        #: of each state, one (sequence, position after the last token) where its substrings end
        self.place = [(-1, 0)]
        self.sequences = [list(s) for s in sequences]
        for k, tokens in enumerate(self.sequences):
            at = 0
            for i, token in enumerate(tokens):
                at = self._append(at, token, (k, i + 1))

    def _state(self, length: int, link: int, moves: dict[int, int], place: tuple[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        self.place.append(place)
        return len(self.length) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        """The state reached from ``p`` by ``token`` whose longest substring is one longer than that of ``p``."""
        if self.length[q] == self.length[p] + 1:
            return q
        new = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), self.place[q])
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def _append(self, last: int, token: int, place: tuple[int, int]) -> int:
        if token in self.next[last]:
            return self._split(last, token, self.next[last][token])
        new = self._state(self.length[last] + 1, 0, {}, place)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, token, self.next[p][token])
        return new

    def stream(self, tokens: Iterable[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest match) after each token."""
        moves, link, length = self.next, self.link, self.length
        state = matched = 0
        for token in tokens:
            to = moves[state].get(token)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = moves[state].get(token)
            if to is not None:
                state, matched = to, matched + 1
            yield state, matched

    def ancestor(self, size: int) -> list[int]:
        """For each state, the state on its links whose substrings include the suffix of ``size`` tokens; -1 if too short."""
        out = [-1] * len(self.length)
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            if self.length[v] >= size:
                out[v] = v if self.length[self.link[v]] < size else out[self.link[v]]
        return out
