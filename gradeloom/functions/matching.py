"""Alignment of two sequences by their longest common blocks.

The rule is the usual one of text comparison: the longest common run, the
leftmost in the first sequence and then in the second, then the same on either
side of it. Instead of looking at one run at a time, all runs of the longest
length k of a range are taken in one pass: what lies between them holds only
shorter ones. k is found by search from the longest run that both sides hold
at equal distance from their ends, testing windows of both sides by their
rolling hash; a run counts only after its elements have been compared.
A range costs O(n log n) array work per different k, whatever repeats in it.

Elements that fill over 1 % of a second sequence of 200 or more are popular:
they begin no run, but a run is extended over them, and a range without any
run still matches what both sides begin with. So a file of braces or a text's
blanks don't decide where two sides meet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: two moduli below 2**31, whose hashes make one 62-bit number
MODULI, BASES = (2147483629, 2147483587), (1000003, 998244353)
#: sides whose product is at most this are compared element by element
SMALL = 4096
POPULAR_FROM = 200


class _Hashes:
    """Hashes of all windows of one sequence of symbols."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.sums, self.powers, self.size = [], [], size
        for modulus, base in zip(MODULI, BASES):
            power = np.ones(1, np.int64)
            while len(power) <= size:
                power = np.concatenate([power, power * int(pow(base, len(power), modulus)) % modulus])
            power = power[:size + 1]
            self.powers.append(power)
            self.sums.append(np.concatenate([[0], np.cumsum((symbols + 1) % modulus * power[:len(symbols)] % modulus)]))

    def windows(self, begin: int, end: int, length: int) -> np.ndarray:
        """One number for each window of `length` elements within [begin, end)."""
        at = np.arange(begin, end - length + 1)
        out = np.zeros(len(at), np.int64)
        for sums, power, modulus in zip(self.sums, self.powers, MODULI):
            out = out << 31 | (sums[at + length] - sums[at]) % modulus * power[self.size - at] % modulus
        return out


def _symbols(a: Sequence, b: Sequence) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(a, str) and isinstance(b, str):
        return tuple(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for s in (a, b))
    known: dict = {}
    return tuple(np.fromiter((known.setdefault(x, len(known)) for x in s), np.int64, len(s)) for s in (a, b))


def _hidden(b: np.ndarray) -> np.ndarray:
    """`b` with its popular elements replaced by numbers that match nothing."""
    if len(b) < POPULAR_FROM:
        return b
    _, place, counts = np.unique(b, return_inverse=True, return_counts=True)
    popular = counts[place] > len(b) // 100 + 1
    return np.where(popular, -2 - np.arange(len(b)), b)


def matching_blocks(a: Sequence, b: Sequence) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the blocks, in order; neighbouring blocks may touch."""
    left, right = _symbols(a, b)
    seeds = _hidden(right)
    size = max(len(left), len(right))
    hashes = _Hashes(left, size), _Hashes(seeds, size)
    found, todo = [], [(0, len(left), 0, len(right), size)]
    while todo:
        a0, a1, b0, b1, most = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) <= SMALL:
            found += _plain(left, right, seeds, a0, a1, b0, b1)
            continue
        length = _longest(*hashes, a0, a1, b0, b1, _straight(left, seeds, a0, a1, b0, b1), min(most, a1 - a0, b1 - b0))
        if not length:
            found.append(_extended(left, right, a0, b0, 0, a0, a1, b0, b1))
            continue
        at_a, at_b = a0, b0
        for i, j, n in _runs(left, right, seeds, *hashes, a0, a1, b0, b1, length):
            found.append((i, j, n))
            todo.append((at_a, i, at_b, j, length - 1))
            at_a, at_b = i + n, j + n
        todo.append((at_a, a1, at_b, b1, length - 1))
    return sorted(block for block in found if block[2])


def _straight(left: np.ndarray, seeds: np.ndarray, a0: int, a1: int, b0: int, b1: int) -> int:
    """The longest run that the two sides share at equal distance from their start, or from their end."""
    size, best = min(a1 - a0, b1 - b0), 0
    for a, b in ((a0, b0), (a1 - size, b1 - size)):
        odd = np.flatnonzero(left[a:a + size] != seeds[b:b + size])
        best = max(best, int(np.diff(np.concatenate([[-1], odd, [size]])).max()) - 1)
    return best


def _longest(left: _Hashes, right: _Hashes, a0: int, a1: int, b0: int, b1: int, low: int, high: int) -> int:
    """Length of the longest run, which is known to be between `low` and `high`."""
    step = 1
    while low < high:
        # steps double until one fails: most runs are hardly longer than the least length
        middle = min(low + step, (low + high + 1) // 2) if step else (low + high + 1) // 2
        known = np.sort(right.windows(b0, b1, middle))
        asked = left.windows(a0, a1, middle)
        if (known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked).any():
            low, step = middle, step * 2
        else:
            high, step = middle - 1, 0
    return low


def _extended(left: np.ndarray, right: np.ndarray, i: int, j: int, n: int, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int]:
    while i > a0 and j > b0 and left[i - 1] == right[j - 1]:
        i, j, n = i - 1, j - 1, n + 1
    while i + n < a1 and j + n < b1 and left[i + n] == right[j + n]:
        n += 1
    return i, j, n


def _runs(left, right, seeds, left_hashes, right_hashes, a0: int, a1: int, b0: int, b1: int, length: int) -> Iterator[tuple[int, int, int]]:
    """All blocks of the range that begin as runs of `length`, its longest, from left to right."""
    there = right_hashes.windows(b0, b1, length)
    order = np.argsort(there, kind="stable")
    there, asked = there[order], left_hashes.windows(a0, a1, length)
    first, last = np.searchsorted(there, asked, side="left"), np.searchsorted(there, asked, side="right")
    places, begin, at = np.flatnonzero(last > first), b0, 0
    while at < len(places):
        place = int(places[at])
        i, options = a0 + place, order[first[place]:last[place]] + begin
        for j in options[np.searchsorted(options, b0):].tolist():
            if np.array_equal(left[i:i + length], seeds[j:j + length]):
                block = _extended(left, right, i, j, length, a0, a1, b0, b1)
                yield block
                a0_next, b0 = block[0] + block[2], block[1] + block[2]
                places = places - (a0_next - a0)
                first, last, a0 = first[a0_next - a0:], last[a0_next - a0:], a0_next
                at = int(np.searchsorted(places, 0))
                break
        else:
            at += 1


def _plain(left, right, seeds, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int, int]]:
    """The blocks of a small range, one after another."""
    x, y, found, todo = left[a0:a1].tolist(), seeds[b0:b1].tolist(), [], [(0, a1 - a0, 0, b1 - b0)]
    where: dict[int, list[int]] = {}
    for j, value in enumerate(y):
        where.setdefault(value, []).append(j)
    whole = right[b0:b1].tolist()
    while todo:
        i0, i1, j0, j1 = todo.pop()
        best, runs = (i0, j0, 0), {}
        for i in range(i0, i1):
            now = {}
            for j in where.get(x[i], ()):
                if j0 <= j < j1:
                    n = now[j] = runs.get(j - 1, 0) + 1
                    if n > best[2]:
                        best = i - n + 1, j - n + 1, n
            runs = now
        i, j, n = _extended(x, whole, *best, i0, i1, j0, j1)
        if n:
            found.append((a0 + i, b0 + j, n))
            todo += [(i0, i, j0, j), (i + n, i1, j + n, j1)]
    return found


def matching_ratio(a: Sequence, b: Sequence) -> float:
    """Twice the elements in common blocks over the elements of both; two empty sequences are alike."""
    total = len(a) + len(b)
    return 2.0 * sum(n for _, _, n in matching_blocks(a, b)) / total if total else 1.0


def line_changes(before: str, after: str) -> Iterator[tuple[str, int, str]]:
    """(sign, line number on its own side from 1, line) of all lines outside common blocks: "-" first within a change."""
    old, new = before.split("\n"), after.split("\n")
    at_old, at_new = 0, 0
    for i, j, n in [*matching_blocks(old, new), (len(old), len(new), 0)]:
        yield from (("-", k + 1, old[k]) for k in range(at_old, i))
        yield from (("+", k + 1, new[k]) for k in range(at_new, j))
        at_old, at_new = i + n, j + n
