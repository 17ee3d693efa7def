"""Matching blocks of two sequences, the same as difflib's without its automatic junk, fast on long ones of few distinct elements."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

#: Pairs of equal elements up to which difflib's own search is the faster one. Either finds the same match.
FEW_PAIRS = 2_000


class Matcher(SequenceMatcher):
    """SequenceMatcher(a=a, b=b, autojunk=False) whose longest match comes of a suffix automaton where difflib's search would walk many equal pairs."""

    def __init__(self, a: Sequence, b: Sequence):
        super().__init__(None, a, b, autojunk=False)
        self.share = sum(len(at) ** 2 for at in self.b2j.values()) / max(1, len(b))  # equal elements in b of one of its own

    def find_longest_match(self, alo: int = 0, ahi: int | None = None, blo: int = 0, bhi: int | None = None):
        ahi, bhi = len(self.a) if ahi is None else ahi, len(self.b) if bhi is None else bhi
        if (ahi - alo) * self.share <= FEW_PAIRS or alo == ahi or blo == bhi:
            return super().find_longest_match(alo, ahi, blo, bhi)
        i, j, size = longest(self.a, self.b, alo, ahi, blo, bhi)
        return super().find_longest_match(alo, alo, blo, blo)._replace(a=i, b=j, size=size)


def longest(a: Sequence, b: Sequence, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest block that both ranges have: the first in a, then the first in b; (alo, blo, 0) without one."""
    follow: list[dict] = [{}]  # the suffix automaton of b[blo:bhi]: transitions, suffix link, length, end of the first occurrence
    link, length, first = [-1], [0], [-1]
    last = 0
    for at in range(blo, bhi):
        x, new, p = b[at], len(follow), last
        follow.append({})
        link.append(0)
        length.append(length[last] + 1)
        first.append(at)
        while p >= 0 and x not in follow[p]:
            follow[p][x] = new
            p = link[p]
        if p >= 0:
            q = follow[p][x]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(follow)
                follow.append(follow[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                first.append(first[q])
                while p >= 0 and follow[p].get(x) == q:
                    follow[p][x] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    best, i, j, state, size = 0, alo, blo, 0, 0
    for at in range(alo, ahi):
        x = a[at]
        while state and x not in follow[state]:
            state = link[state]
            size = length[state]
        if x in follow[state]:
            state, size = follow[state][x], size + 1
            if size > best:
                best, i, j = size, at - size + 1, first[state] - size + 1
    return i, j, best
