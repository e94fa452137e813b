"""Shortest edit scripts between sequences: longest common subsequences by divide and conquer over bit vectors.

The lengths of the longest common subsequences of one sequence with every prefix of another come from a
bit-parallel pass (a Python integer holds a row of the table, a bit where the length grows). Halving the
first sequence and meeting the rows of both halves gives a point that a longest one passes, so space stays linear.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np


def _lengths(a: Sequence[int], b: Sequence[int]) -> np.ndarray:
    """The length of the longest common subsequence of a with each prefix of b, the empty one first."""
    places: dict[int, int] = defaultdict(int)
    for j, k in enumerate(b):
        places[k] |= 1 << j
    every = (1 << len(b)) - 1
    row = every
    for k in a:
        if met := row & places.get(k, 0):
            row = (row + met | row - met) & every
    grown = np.unpackbits(np.frombuffer((row ^ every).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(grown)])


def common(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence, ascending."""
    number: dict = {}
    x = [number.setdefault(k, len(number)) for k in a]
    y = [number.setdefault(k, len(number)) for k in b]
    same = next((n for n, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    rest = min(len(x), len(y)) - same
    tail = next((n for n in range(rest) if x[-1 - n] != y[-1 - n]), rest)
    found = [(n, n) for n in range(same)] + [(len(x) - n, len(y) - n) for n in range(1, tail + 1)]
    open_ = [(range(same, len(x) - tail), range(same, len(y) - tail))]
    while open_:
        rows, columns = open_.pop()
        p, q = x[rows.start : rows.stop], y[columns.start : columns.stop]
        if not p or not q:
            continue
        if len(p) == 1:
            found += [(rows.start, columns.start + q.index(p[0]))] if p[0] in q else []
            continue
        half = len(p) // 2
        at = int((_lengths(p[:half], q) + _lengths(p[half:][::-1], q[::-1])[::-1]).argmax())
        open_ += [(rows[:half], columns[:at]), (rows[half:], columns[at:])]
    return sorted(found)


def blocks(a: Sequence, b: Sequence) -> list[tuple[int, int, int, int]]:
    """(start in a, deleted, start in b, inserted) of each difference, fewest deletions and insertions in all."""
    out, i, j = [], 0, 0
    for p, q in [*common(a, b), (len(a), len(b))]:
        if p > i or q > j:
            out.append((i, p - i, j, q - j))
        i, j = p + 1, q + 1
    return out


def inline(a: Sequence[str], b: Sequence[str]) -> list[tuple[str, str, int | None, int | None]]:
    """Unchanged lines, then per block deleted before inserted ones, with line numbers from 1."""
    out, i, j = [], 0, 0
    for p, deleted, q, inserted in [*blocks(a, b), (len(a), 0, len(b), 0)]:
        while i < p:
            out.append(("unchanged", a[i], i + 1, j + 1))
            i, j = i + 1, j + 1
        out += [("deleted", a[p + k], p + k + 1, None) for k in range(deleted)]
        out += [("inserted", b[q + k], None, q + k + 1) for k in range(inserted)]
        i, j = p + deleted, q + inserted
    return out
