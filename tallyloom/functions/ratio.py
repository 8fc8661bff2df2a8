"""Ratcliff-Obershelp ratios as difflib gives them, over runs of equal elements that are found once.

difflib looks for the longest run of a rectangle anew in each step, element by element. Here the diagonal runs of both
sequences are found by one sort; a rectangle has its own share of them, cut at its edges. Texts are matched many pairs at
once (``text_ratios``): in each round all rectangles of all pairs take their longest run and are cut in two. Where only single
elements are equal the longest run is the first, so one walk over such a rectangle finds its blocks without its pairs of elements.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module

#: Equal pairs of elements that are held at once; difflib itself takes what has more. Runs from which on arrays are faster than lists.
MOST_PAIRS, LONG = 12_000_000, 160
#: Characters and equal pairs of characters of the texts that are matched at once (at most 2**19 characters); a pair of texts with more is matched alone.
CHARACTERS, AT_ONCE = 1 << 18, 1 << 20
#: Runs of so many characters are taken first, shorter ones only where no other is left. Steps of one character before blocks are compared.
GRAMS, STEPS = (2, 1), 32
_PLACE = 20  # bits of a place


def _runs(a: np.ndarray, b: np.ndarray):
    """Starts in both sequences and lengths of the runs of equal elements that are not popular in ``b``; None for too many pairs."""
    values, at, counts = np.unique(b, return_inverse=True, return_counts=True)
    place = np.minimum(np.searchsorted(values, a), len(values) - 1)
    usable = values[place] == a
    if len(b) >= 200:
        usable &= counts[place] <= len(b) // 100 + 1
    i = np.flatnonzero(usable)
    of = place[i]
    n = counts[of]
    total = int(n.sum())
    if total > MOST_PAIRS:
        return None
    if not total:
        return i[:0], i[:0], i[:0]
    ends = np.cumsum(n)
    j = np.argsort(at, kind="stable")[np.arange(total) + np.repeat((np.cumsum(counts) - counts)[of] - (ends - n), n)]
    width = len(a) + 1
    key = (j - np.repeat(i, n) + len(a)) * width + np.repeat(i, n)
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=key[0] - 2) != 1)
    diagonal, i = np.divmod(key[first], width)
    return i, i + diagonal - len(a), np.diff(first, append=total)


def matches(a, b, x: np.ndarray, y: np.ndarray) -> int:
    """Elements in the matching blocks of sequences ``a`` and ``b``, which ``x`` and ``y`` have as numbers."""
    if not len(x) or not len(y):
        return 0
    found = _runs(x, y)
    if found is None:
        from difflib import SequenceMatcher

        return sum(m[2] for m in SequenceMatcher(None, a, b).get_matching_blocks())
    count = 0
    waiting = [(0, len(a), 0, len(b), found)]
    while waiting:
        alo, ahi, blo, bhi, runs = waiting.pop()
        i, j, size = alo, blo, 0
        if isinstance(runs, tuple):
            s, t, k = runs
            skip = np.maximum(np.maximum(alo - s, blo - t), 0)
            k = np.minimum(np.minimum(k, ahi - s), bhi - t) - skip
            keep = np.flatnonzero(k > 0)
            s, t, k = (s + skip)[keep], (t + skip)[keep], k[keep]
            if len(k) > LONG:
                size = int(k.max())
                best = np.flatnonzero(k == size)
                best = best[np.lexsort((t[best], s[best]))[0]] if len(best) < 64 else min(best[s[best] == s[best].min()], key=t.__getitem__)
                i, j, runs = int(s[best]), int(t[best]), (s, t, k)
            else:
                runs = list(zip(s.tolist(), t.tolist(), k.tolist(), strict=True))
        if isinstance(runs, list):
            inside = []
            for run in runs:
                s, t, k = run
                if s < alo or t < blo:
                    skip = max(alo - s, blo - t)
                    s, t, k = s + skip, t + skip, k - skip
                if s + k > ahi or t + k > bhi:
                    k = min(ahi - s, bhi - t)
                if k > 0:
                    inside.append((s, t, k))
                    if k > size or (k == size and (s < i or (s == i and t < j))):
                        i, j, size = s, t, k
            runs = inside
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        count += size
        if size and runs != []:
            if alo < i and blo < j:
                waiting.append((alo, i, blo, j, runs))
            if i + size < ahi and j + size < bhi:
                waiting.append((i + size, ahi, j + size, bhi, runs))
    return count


def _laid(texts: list[str]):
    """Code points of all texts in one array with a gap around each, where each begins, and lengths."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    joined = "\0".join(["", *texts, ""])
    return joined, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<i4"), np.cumsum(sizes + 1) - sizes, sizes


def _inside(codes, popular: int, lo, hi, g: int):
    """Places in the rectangles' sides from which ``g`` elements that are not popular are inside, and whose they are."""
    rare = codes < popular
    at = np.flatnonzero(np.logical_and.reduce([rare[n : len(rare) - g + 1 + n] for n in range(g)]))
    order = np.argsort(lo)
    of = np.searchsorted(lo[order], at, "right") - 1
    keep = (of >= 0) & (at + g <= hi[order][of])
    return at[keep], order[of[keep]]


def _alike(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common beginning."""
    n, at, step = min(len(x), len(y)), 0, 64
    while at < n:
        end = min(at + step, n)
        other = np.flatnonzero(x[at:end] != y[at:end])
        if len(other):
            return at + int(other[0])
        at, step = end, 2 * step
    return n


def _grown(x, y, i, j, size, alo, ahi, blo, bhi):
    """Runs made longer at both ends, within their rectangles, by any equal elements; ``i``, ``j`` and ``size`` are changed."""
    on, steps = np.flatnonzero((i > alo) & (j > blo)), 0
    while len(on) and steps < STEPS:
        on = on[x[i[on] - 1] == y[j[on] - 1]]
        i[on] -= 1
        j[on] -= 1
        size[on] += 1
        on, steps = on[(i[on] > alo[on]) & (j[on] > blo[on])], steps + 1
    for n in on:
        more = _alike(x[alo[n] : i[n]][::-1], y[blo[n] : j[n]][::-1])
        i[n], j[n], size[n] = i[n] - more, j[n] - more, size[n] + more
    on, steps = np.flatnonzero((i + size < ahi) & (j + size < bhi)), 0
    while len(on) and steps < STEPS:
        on = on[x[i[on] + size[on]] == y[j[on] + size[on]]]
        size[on] += 1
        on, steps = on[(i[on] + size[on] < ahi[on]) & (j[on] + size[on] < bhi[on])], steps + 1
    for n in on:
        size[n] += _alike(x[i[n] + size[n] : ahi[n]], y[j[n] + size[n] : bhi[n]])


def _found(x, rare, bits: int, popular: int, rectangles, g: int):
    """Starts in both sequences, lengths and rectangles of the runs of at least ``g`` elements of ``rare`` inside of the rectangles; None for too many pairs."""
    alo, ahi, blo, bhi = rectangles
    gram = lambda codes, at, of: sum((codes[at + n].astype(np.int64) << n * bits for n in range(g)), of << g * bits)
    (i, of), (j, of_j) = _inside(x, popular, alo, ahi, g), _inside(rare, popular, blo, bhi, g)
    key = gram(rare, j, of_j) << _PLACE | j
    key.sort()
    places, key = key & ((1 << _PLACE) - 1), key >> _PLACE
    first = np.flatnonzero(np.diff(key, prepend=-1))
    values, wanted = key[first], gram(x, i, of)
    at = np.searchsorted(values, wanted)
    hit = np.flatnonzero(np.append(values, -1)[at] == wanted)
    at = at[hit]
    n = np.diff(first, append=len(key))[at]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    if total > AT_ONCE:
        return None
    i, r = np.repeat(i[hit], n), np.repeat(of[hit], n)
    j = places[np.arange(total) + np.repeat(first[at] - (ends - n), n)]
    starts = (x[i - 1] != rare[j - 1]) | (i == alo[r]) | (j == blo[r])
    stops = (x[i + g] != rare[j + g]) | (i + g == ahi[r]) | (j + g == bhi[r])
    size = np.full(total, g)
    begin, end = np.flatnonzero(starts & ~stops), np.flatnonzero(stops & ~starts)
    begin, end = (v[np.argsort(((j[v] - i[v]) << _PLACE) + i[v])] for v in (begin, end))
    size[begin] = i[end] - i[begin] + g
    runs = np.flatnonzero(starts)
    return i[runs], j[runs], size[runs], r[runs]


def _rounds(x, y, rectangles, of, count, runs, g: int):
    """Adds elements of matching blocks to ``count`` and gives the rectangles without a run of ``g`` elements (of 1: none); runs come in the order of their rectangles."""
    (alo, ahi, blo, bhi), (s, t, k, r), last, rest = rectangles, runs, (1 << _PLACE) - 1, []
    while len(of):
        skip = np.maximum(np.maximum(alo[r] - s, blo[r] - t), 0)
        k = np.minimum(np.minimum(k, ahi[r] - s), bhi[r] - t) - skip
        inside = np.flatnonzero(k >= g)
        s, t, k, r = (s + skip)[inside], (t + skip)[inside], k[inside], r[inside]
        keep = np.bincount(r, minlength=len(of)) > 0
        if g > 1:
            rest.append([v[~keep] for v in (alo, ahi, blo, bhi, of)])
        else:  # without a run only popular elements at the first corner match
            keep |= x[alo] == y[blo]
        r = (np.cumsum(keep) - 1)[r]
        alo, ahi, blo, bhi, of = (v[keep] for v in (alo, ahi, blo, bhi, of))
        i, j, size = alo.copy(), blo.copy(), np.zeros_like(alo)
        if len(r):
            first = np.flatnonzero(np.diff(r, prepend=-1))
            best, at = np.maximum.reduceat(k << 2 * _PLACE | (last - s) << _PLACE | (last - t), first), r[first]
            i[at], j[at], size[at] = last - (best >> _PLACE & last), last - (best & last), best >> 2 * _PLACE
        _grown(x, y, i, j, size, alo, ahi, blo, bhi)
        np.add.at(count, of, size)
        i2, j2 = i + size, j + size
        left, right = (alo < i) & (blo < j), (i2 < ahi) & (j2 < bhi)
        in_left = np.flatnonzero(left[r] & (s < i[r]) & (t < j[r]))
        in_right = np.flatnonzero(right[r] & (s + k > i2[r]) & (t + k > j2[r]))
        r = np.concatenate([(np.cumsum(left) - 1)[r[in_left]], (np.cumsum(right) - 1 + np.count_nonzero(left))[r[in_right]]])
        s, t, k = (np.concatenate([v[in_left], v[in_right]]) for v in (s, t, k))
        alo, ahi, blo, bhi, of = (np.concatenate([u[left], v[right]]) for u, v in ((alo, i2), (i, ahi), (blo, j2), (j, bhi), (of, of)))
    return [np.concatenate(v) for v in zip(*rest, strict=True)] if rest else [of] * 5


def _ahead(a: str, b: str, i: int, j: int, most: int) -> int:
    """Length of the common beginning of both texts from places on."""
    n = 0
    while n < most and a[i + n] == b[j + n]:
        n += 1
    return n


def _singles(a: str, b: str, places: list[int], alo: int, ahi: int, blo: int, bhi: int) -> int:
    """Elements in the matching blocks of a rectangle without a run of two; ``places`` of ``a`` in it have elements that are not popular.

    All runs are of one element, so difflib takes the first place of ``a`` that has any, at its first one in ``b``, and nothing is left
    before it but what both sides begin with. Elements that do not come again in ``b`` do not come in what is left of it either.
    """
    count, i, j, gone = 0, alo, blo, set()
    for at in places:
        if at < i or a[at] in gone:
            continue
        to = b.find(a[at], j, bhi)
        if to < 0:
            gone.add(a[at])
            continue
        back, most = 0, min(at - i, to - j)
        while back < most and a[at - back - 1] == b[to - back - 1]:
            back += 1
        if i == alo and not count:
            count = _ahead(a, b, i, j, most - back)
        size = 1 + _ahead(a, b, at + 1, to + 1, min(ahi - at, bhi - to) - 1)
        count, i, j = count + back + size, at + size, to + size
        if i == ahi or j == bhi:
            break
    return count or _ahead(a, b, alo, blo, min(ahi - alo, bhi - blo))


def _matches(a: list[str], b: list[str]) -> np.ndarray:
    """``matches`` of each pair of texts; together they have at most 2**19 characters."""
    (text_a, x, x_at, x_n), (text_b, y, y_at, y_n) = _laid(a), _laid(b)
    number = np.cumsum(np.bincount(np.concatenate([x, y])) > 0, dtype=np.int32)
    letters = int(number[-1]) + 3
    x, y = number[x], number[y]
    # the first row is of all short texts, in which no element is popular; elements that a long text has not need no look either
    long = y_n >= 200
    row = np.cumsum(long) * long * letters
    row_x, row_y = (np.append(0, np.repeat(row, n + 1)) + v for n, v in ((x_n, x), (y_n, y)))
    counts = np.bincount(row_y, minlength=(np.count_nonzero(long) + 1) * letters).reshape(-1, letters)
    rare = (counts > 0) & (counts <= np.append(0, y_n[long] // 100 + 1)[:, None])
    rare[0] = True
    rare_x, rare_y = rare.ravel()[row_x], rare.ravel()[row_y]
    for v, u, at, gap in ((x, rare_x, x_at, letters - 1), (y, rare_y, y_at, letters - 2)):
        v[at - 1] = v[-1] = gap  # between texts, another on either side
        u[at - 1] = u[-1] = False
    rare_x, rare_y = np.where(rare_x, x, letters + 1), np.where(rare_y, y, letters)  # popular ones of both sides are not equal
    bits, count, done = (letters + 1).bit_length(), np.zeros(len(a), dtype=np.int64), 0
    *rectangles, of = x_at, x_at + x_n, y_at, y_at + y_n, np.arange(len(a))
    for g in GRAMS:
        if g > 1 and g * bits + len(of).bit_length() + _PLACE > 62:
            continue
        if g == 1 and done == 2:
            places = np.flatnonzero(rare_x < letters)
            ends, places = [np.searchsorted(places, v).tolist() for v in rectangles[:2]], places.tolist()
            found = [_singles(text_a, text_b, places[lo:hi], *r) for lo, hi, *r in zip(*ends, *(v.tolist() for v in rectangles), strict=True)]
            np.add.at(count, of, np.array(found, dtype=np.int64))
            break
        done, runs = g, _found(rare_x, rare_y, bits, letters, rectangles, g)
        if runs is None:
            if len(a) == 1:
                return np.array([matches(a[0], b[0], x[1:-1], y[1:-1])])
            half = len(a) // 2
            return np.concatenate([_matches(a[:half], b[:half]), _matches(a[half:], b[half:])])
        *rectangles, of = _rounds(x, y, rectangles, of, count, runs, g)
    return count


def text_ratios(a: list[str], b: list[str], least: np.ndarray) -> np.ndarray:
    """``text_ratio`` of each pair of texts, or ``least`` where that is more; texts whose lengths allow no more are not matched."""
    found = np.array(least, dtype=np.float64)
    x, y = (np.array([len(t) for t in s], dtype=np.int64) for s in (a, b))
    equal = np.array([u == v for u, v in zip(a, b, strict=True)], dtype=bool)
    found[equal] = 1.0
    possible = 2.0 * np.minimum(x, y) > found * (x + y)
    for n in np.flatnonzero(possible & (x + y > CHARACTERS)):
        if most(a[n], b[n]) > found[n]:
            found[n] = max(found[n], text_ratio(a[n], b[n]))
    at = np.flatnonzero(possible & (x + y <= CHARACTERS))
    part = np.cumsum((x + y)[at]) // CHARACTERS
    for some in np.split(at, np.flatnonzero(np.diff(part)) + 1):
        if len(some):
            found[some] = np.maximum(found[some], 2.0 * _matches([a[n] for n in some], [b[n] for n in some]) / (x + y)[some])
    return found


def text_ratio(a: str, b: str) -> float:
    """SequenceMatcher(None, a, b).ratio() of two texts."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64) for t in (a, b))
    return 2.0 * matches(a, b, x, y) / (len(a) + len(b))


def list_ratio(a: list, b: list) -> float:
    """SequenceMatcher(None, a, b).ratio() of two lists of hashable elements."""
    if a == b:
        return 1.0
    number: dict = {}
    x, y = (np.array([number.setdefault(e, len(number)) for e in s], dtype=np.int64) for s in (a, b))
    return 2.0 * matches(a, b, x, y) / (len(a) + len(b))


def most(a: str, b: str) -> float:
    """What ``text_ratio`` is at most, by the characters of both."""
    from collections import Counter

    return 2.0 * (Counter(a) & Counter(b)).total() / (len(a) + len(b)) if a or b else 1.0
