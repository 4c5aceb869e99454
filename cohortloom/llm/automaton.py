"""A suffix automaton over words, for passages of several documents."""

from __future__ import annotations

from collections.abc import Sequence


class SuffixAutomaton:
    """All substrings of the passages added so far, each state with the first document it came from.

    Passages must be added in ascending order of their document, so a state's first document is the
    least one in which its substrings start.
    """

    def __init__(self) -> None:
        self.step: list[dict] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.first: list = [None]

    def _new(self, step: dict, link: int, length: int, first) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.length) - 1

    def _split(self, p: int, symbol, q: int) -> int:
        """The state of the strings that end by ``symbol`` after p; q if it holds no longer ones."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._new(dict(self.step[q]), self.link[q], self.length[p] + 1, self.first[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(symbol) == q:
            self.step[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, passage: Sequence, doc) -> None:
        last = 0
        for symbol in passage:
            known = self.step[last].get(symbol)
            if known is not None:
                last = self._split(last, symbol, known)
                continue
            state = self._new({}, 0, self.length[last] + 1, doc)
            p = last
            while p >= 0 and symbol not in self.step[p]:
                self.step[p][symbol] = state
                p = self.link[p]
            if p >= 0:
                self.link[state] = self._split(p, symbol, self.step[p][symbol])
            last = state

    def matching(self, passage: Sequence, least: int) -> list[tuple[int, object]]:
        """(end, first document) for every place where the last ``least`` symbols are a known substring.

        This is the matching statistic of the passage, cut at ``least``: the state is kept at the one
        whose strings hold exactly the last ``least`` symbols.
        """
        state, size, out = 0, 0, []
        for end, symbol in enumerate(passage, 1):
            while state and symbol not in self.step[state]:
                state = self.link[state]
                size = self.length[state]
            if symbol in self.step[state]:
                state = self.step[state][symbol]
                size += 1
            if size >= least:
                while self.length[self.link[state]] >= least:
                    state = self.link[state]
                    size = self.length[state]
                out.append((end, self.first[state]))
        return out
