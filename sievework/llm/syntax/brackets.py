"""Least-cost pairing of brackets.

Adjacent pairs that match are taken off first, which never costs more than any other reading. Of what
is left, closing brackets in front and opening ones at the end have no partner; for the rest a chart over
intervals finds the fewest insertions, deletions and replacements by a bracket of the same side. Its rows
are filled from the last to the first, each in a few operations on arrays.
"""

from __future__ import annotations

import numpy as np

from sievework.llm.syntax.rules import BASE, CLOSE

#: Numbers that one operation of the chart works on at most.
BLOCK = 4_000_000


def pairing(text: str) -> tuple[dict[int, int], int]:
    """(places of closing brackets -> places of their opening ones, cost). A pair may be of unlike brackets, at a cost of 1; what has no partner costs 1."""
    partner: dict[int, int] = {}
    left: list[int] = []
    for i, c in enumerate(text):
        if c in BASE:
            left.append(i)
        elif c in ")]}":
            if left and CLOSE.get(text[left[-1]]) == c:
                partner[i] = left.pop()
            else:
                left.append(i)
    first, last = 0, len(left)
    while first < last and text[left[first]] not in BASE:
        first += 1
    while first < last and text[left[last - 1]] in BASE:
        last -= 1
    alone, left = len(left) - (last - first), left[first:last]
    n = len(left)
    if not n:
        return partner, alone
    closes = np.array([k for k, i in enumerate(left) if text[i] not in BASE])
    unlike = {b: np.array([text[left[k]] != c for k in closes], np.int32) for b, c in CLOSE.items()}
    best = np.full((n + 1, n + 1), 1 << 24, np.int32)
    best[n, n] = 0

    def paired(i: int, k: np.ndarray, to: slice | int) -> np.ndarray:
        """Costs of the bracket i with each closing bracket ``closes[k]`` as its partner, for intervals that end at ``to``."""
        c = closes[k]
        own = best[i + 1, c] + unlike[text[left[i]]][k]
        return (own[:, None] if isinstance(to, slice) else own) + best[c + 1, to]

    for i in range(n - 1, -1, -1):
        row = best[i + 1] + 1
        if text[left[i]] in BASE:
            after = np.arange(np.searchsorted(closes, i), len(closes))
            step = max(1, BLOCK // (n - i))
            for a in range(0, len(after), step):
                np.minimum(row[i + 1 :], paired(i, after[a : a + step], slice(i + 1, None)).min(0), out=row[i + 1 :])
        best[i] = row
        best[i, i] = 0
    todo = [(0, n)]
    while todo:
        i, j = todo.pop()
        if i < j:
            within = np.arange(np.searchsorted(closes, i), np.searchsorted(closes, j))
            costs = paired(i, within, j) if text[left[i]] in BASE and len(within) else None
            if costs is None or costs.min() > best[i + 1, j]:
                todo.append((i + 1, j))
            else:
                k = int(closes[within[costs.argmin()]])
                partner[left[k]] = left[i]
                todo += [(i + 1, k), (k + 1, j)]
    return partner, alone + int(best[0, n])
