"""The standard library's similarity ratio of two texts, for whole texts.

The ratio counts the characters of the longest common part (the leftmost one in the first
text, then in the second), and of the parts left and right of it in the same way. The
library finds such a part by going through all equal characters, which grows with the
product of the lengths. Here all common runs of RUN characters or more are found once, by
sorting hashes; each part's longest one is the longest of the runs, cut to the part. A part
whose runs are shorter is searched by doubling the length as long as parts of it are common,
comparing hashes of the parts that are left, in numpy; a short one by a window that grows as
long as the other text has it. Where only a threshold matters, parts are taken largest first and the search stops as
soon as the sum found passes it, or what the letters of the parts to come allow can't reach it.
"""

from __future__ import annotations

from copy import copy
from heapq import heappop, heappush
from itertools import count

import numpy as np

#: Parts whose lengths have a product up to this are searched by windows.
SMALL = 1 << 16
#: Shortest run that is looked up, and places where runs may begin, at most, for each character of both texts; where there are more, runs of twice the length are taken.
RUN, PLACES = 16, 4
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


class _Hashes:
    """Hashes of all parts of a text whose length is a power of two, made as they are asked for."""

    def __init__(self, text: str):
        self.levels = [_mixed((np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)) * _A)]

    def level(self, k: int) -> np.ndarray:
        """Hashes of the parts of length 2**k by their start."""
        while len(self.levels) <= k:
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(_mixed(last[:-step] * _A + last[step:]))
        return self.levels[k]

    def parts(self, starts: np.ndarray, length: int) -> np.ndarray:
        """A hash of each part of a length: those of the two powers of two that cover it."""
        k = length.bit_length() - 1
        level = self.level(k)
        return _mixed(level[starts] * _A + level[starts + (length - (1 << k))])


class _Runs:
    """Every common run of ``least`` characters or more of two parts, as long as it is: starts in a and b, and lengths."""

    def __init__(self, a: _Hashes, b: _Hashes, alo: int, ahi: int, blo: int, bhi: int):
        self.size = ahi - alo + bhi - blo
        self.least, none = RUN, np.zeros(0, np.int64)
        while True:
            x, y = np.arange(alo, ahi - self.least + 1), np.arange(blo, bhi - self.least + 1)
            if not len(x) or not len(y):
                self.i = self.j = self.n = none
                return
            p, q = a.parts(x, self.least), b.parts(y, self.least)
            order = np.argsort(q, kind="stable")
            q = q[order]
            first = np.searchsorted(q, p)
            times = np.searchsorted(q, p, "right") - first
            total = int(times.sum())
            if total <= PLACES * self.size:
                break
            self.least *= 2
        i = np.repeat(x, times)
        j = y[order[np.arange(total) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)]]
        shift = j - i
        by = np.lexsort((i, shift))
        i, shift = i[by], shift[by]
        begins = np.flatnonzero(np.concatenate([np.ones(min(1, total), bool), (np.diff(i) != 1) | (np.diff(shift) != 0)]))
        ends = np.append(begins[1:], total) - 1 if total else begins
        self.i, self.j, self.n = i[begins], i[begins] + shift[begins], i[ends] - i[begins] + self.least

    def within(self, alo: int, ahi: int, blo: int, bhi: int) -> _Runs:
        """The runs cut to a part of the parts, those of ``least`` characters or more."""
        cut = np.maximum(0, np.maximum(alo - self.i, blo - self.j))
        n = np.minimum(self.n, np.minimum(ahi - self.i, bhi - self.j)) - cut
        keep = n >= self.least
        inner = copy(self)
        inner.i, inner.j, inner.n = (self.i + cut)[keep], (self.j + cut)[keep], n[keep]
        return inner

    def longest(self) -> tuple[int, int, int]:
        """The longest run, leftmost in a, then in b; of length 0 if there is none."""
        if not len(self.i):
            return 0, 0, 0
        these = np.flatnonzero(self.n == self.n.max())
        return *min(zip(self.i[these].tolist(), self.j[these].tolist())), int(self.n.max())


def _longest(a: _Hashes, b: _Hashes, alo: int, ahi: int, blo: int, bhi: int, below: int) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest common part, which is shorter than ``below``, leftmost in a, then in b."""
    x, y = np.arange(alo, ahi), np.arange(blo, bhi)  # starts of parts that are common so far

    def common(length: int) -> tuple[np.ndarray, np.ndarray]:
        i, j = x[x <= ahi - length], y[y <= bhi - length]
        p, q = a.parts(i, length), b.parts(j, length)
        i = i[np.isin(p, q)]
        return i, j[np.isin(q, p)] if len(i) else j[:0]

    low, most = 0, min(below - 1, ahi - alo, bhi - blo)
    while max(1, 2 * low) <= most:  # a part of twice the length begins where one of the length does
        i, j = common(max(1, 2 * low))
        if not len(i):
            most = max(1, 2 * low) - 1
            break
        x, y, low = i, j, max(1, 2 * low)
    if not low:
        return alo, blo, 0
    while low < most:  # every shorter length has a common part, too
        middle = (low + most + 1) // 2
        i, j = common(middle)
        if len(i):
            x, y, low = i, j, middle
        else:
            most = middle - 1
    first = int(x[0])
    wanted = a.parts(x[:1], low)[0]
    return first, int(y[(b.parts(y, low) == wanted).argmax()]), low


def _short(a: str, b: str) -> int:
    """Matching characters of two short texts."""
    total, todo = 0, [(a, b)]
    while todo:
        x, y = todo.pop()
        if not x or not y:
            continue
        if x in y or y in x:  # nothing longer can be common
            total += min(len(x), len(y))
            continue
        at, n = 0, 0
        for k in range(len(x)):
            while x[k : k + n + 1] in y and k + n < len(x):
                at, n = k, n + 1
            if k + n >= len(x):
                break
        if n:
            total, to = total + n, y.index(x[at : at + n])
            todo += [(x[:at], y[:to]), (x[at + n :], y[to + n :])]
    return total


#: A part of two texts, from and to in each, and what is known of its runs.
_Part = tuple[int, int, int, int, _Runs | None]


def _pieces(a: str, b: str, ha: _Hashes, hb: _Hashes, part: _Part) -> tuple[int, list[_Part]]:
    """Characters that match for certain between two parts, and the parts that are left to look at."""
    *at, runs = part
    alo, ahi, blo, bhi = at
    if alo == ahi or blo == bhi:
        return 0, []
    if (ahi - alo) * (bhi - blo) <= SMALL:
        return _short(a[alo:ahi], b[blo:bhi]), []
    runs = runs.within(*at) if runs else _Runs(ha, hb, *at)
    if not len(runs.i) and runs.least > RUN and 2 * (ahi - alo + bhi - blo) <= runs.size:  # a smaller part may have few shorter runs
        runs = _Runs(ha, hb, *at)
    i, j, k = runs.longest()
    if not k:
        i, j, k = _longest(ha, hb, *at, runs.least)
    return (k, [(alo, i, blo, j, runs), (i + k, ahi, j + k, bhi, runs)]) if k else (0, [])


def matched(a: str, b: str) -> int:
    """Matching characters of two texts."""
    if a in b or b in a:  # nothing longer can be common
        return min(len(a), len(b))
    ha, hb = _Hashes(a), _Hashes(b)
    total, todo = 0, [(0, len(a), 0, len(b), None)]
    while todo:
        found, more = _pieces(a, b, ha, hb, todo.pop())
        total += found
        todo += more
    return total


def ratio(a: str, b: str) -> float:
    """Twice the matching characters over all characters; 1 for two empty texts."""
    if a == b:
        return 1.0
    return 2.0 * matched(a, b) / (len(a) + len(b))


def _codes(*texts: str) -> list[np.ndarray]:
    """The texts as numbers of their distinct characters."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    _, codes = np.unique(np.concatenate(raw), return_inverse=True)
    return np.split(codes, np.cumsum([len(r) for r in raw])[:-1])


def decided(a: str, b: str, least: float) -> float:
    """A number that is below ``least`` if and only if :func:`ratio` is: the ratio of what is found, or of what could be, when either decides."""
    if a == b:
        return 1.0
    n = len(a) + len(b)
    if a in b or b in a:
        return 2.0 * min(len(a), len(b)) / n
    x, y = _codes(a, b)
    letters = int(max(x.max(initial=0), y.max(initial=0))) + 1

    def bound(alo: int, ahi: int, blo: int, bhi: int, _runs: _Runs | None) -> int:
        return int(np.minimum(np.bincount(x[alo:ahi], minlength=letters), np.bincount(y[blo:bhi], minlength=letters)).sum())

    found, whole, turn = 0, (0, len(a), 0, len(b), None), count()
    open_ = bound(*whole)
    todo = [(-open_, next(turn), whole)]
    ha, hb = _Hashes(a), _Hashes(b)
    while todo and 2.0 * found / n < least <= 2.0 * (found + open_) / n:
        most_here, _, part = heappop(todo)
        open_ += most_here
        more, parts = _pieces(a, b, ha, hb, part)
        found += more
        for p in parts:
            if can := bound(*p):
                open_ += can
                heappush(todo, (-can, next(turn), p))
    return 2.0 * found / n if 2.0 * found / n >= least else 2.0 * (found + open_) / n
