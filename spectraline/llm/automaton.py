"""Suffix automata: the smallest machines that accept every infix of some sequences."""

from __future__ import annotations

from collections.abc import Hashable, Iterable


class SuffixAutomaton:
    """Generalised suffix automaton; each added sequence may carry an owner, states keep the least one."""

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link, self.size, self.owner = [-1], [0], [None]

    def add(self, sequence: Iterable[Hashable], owner=None) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)
            if owner is not None and (self.owner[last] is None or owner < self.owner[last]):
                self.owner[last] = owner

    def _state(self, size: int, arcs: dict, link: int) -> int:
        self.next.append(arcs)
        self.size.append(size)
        self.link.append(link)
        self.owner.append(None)
        return len(self.size) - 1

    def _split(self, p: int, q: int, c: Hashable) -> int:
        """The state for the shorter strings of q that p reaches by c."""
        half = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = half
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = half
            p = self.link[p]
        return half

    def _extend(self, p: int, c: Hashable) -> int:
        q = self.next[p].get(c)
        if q is not None:
            return q if self.size[q] == self.size[p] + 1 else self._split(p, q, c)
        new = self._state(self.size[p] + 1, {}, 0)
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, c)
        return new

    def spread_owners(self) -> None:
        """Give each state the least owner of all places where its strings end; call once after the last add."""
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            o, up = self.owner[s], self.link[s]
            if o is not None and up > 0 and (self.owner[up] is None or o < self.owner[up]):
                self.owner[up] = o

    def owners_of_windows(self, sequence: Iterable[Hashable], length: int) -> list:
        """Matching statistics cut at `length`: for each position the least owner of the `length` symbols that end there, or None."""
        out, s, n = [], 0, 0
        nxt, link, size, owner = self.next, self.link, self.size, self.owner
        for c in sequence:
            while s > 0 and c not in nxt[s]:
                s = link[s]
                n = size[s]
            if c in nxt[s]:
                s, n = nxt[s][c], n + 1
            if n >= length:
                while size[link[s]] >= length:
                    s = link[s]
                n = length
                out.append(owner[s])
            else:
                out.append(None)
        return out
