"""Search strategies of the assignment step: each gives what the full search gives, looking at fewer pairs.

They start from the assignment to the codebook before. A pair of point and centroid is skipped only where it cannot win, not
even a tie: a point keeps the lowest centroid of those nearest.
"""

from __future__ import annotations

import numpy as np

from ..plans.engine import distances, nearest

#: full and its aliases look at all pairs; the others skip by what has changed (local), by the triangle inequality (tie) or
#: by the sums of the vectors' elements (mps).
SEARCHES = ("full", "local", "tie", "local_tie", "mps", "local_mps", "wu", "mean", "pca", "traveller")
ALIASES = ("full", "wu", "mean", "pca", "traveller")


def changed(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The numbers of the centroids that moved."""
    return np.flatnonzero((old != new).any(1))


def candidates(x: np.ndarray, c: np.ndarray, old: np.ndarray, of: np.ndarray, how: str) -> tuple[np.ndarray, np.ndarray]:
    """(own, mask): each point's squared distance to its own centroid, and the other centroids that may win. of: the
    assignment to the codebook `old`."""
    own = ((x - c[of]) ** 2).sum(1)
    mask = np.ones((len(x), len(c)), bool)
    if how.startswith("local"):
        moved = np.zeros(len(c), bool)
        moved[changed(old, c)] = True
        worse = moved[of] & (own > ((x - old[of]) ** 2).sum(1))  # its own went away: all others may win
        mask = worse[:, None] | moved[None, :]
    if how.endswith("tie"):
        mask &= distances(c, c)[of] <= 4 * own[:, None]
    if how.endswith("mps"):
        mask &= (x.sum(1)[:, None] - c.sum(1)[None, :]) ** 2 <= x.shape[1] * own[:, None]
    mask[np.arange(len(x)), of] = False
    return own, mask


def reassign(x: np.ndarray, c: np.ndarray, old: np.ndarray, of: np.ndarray, how: str = "local") -> tuple[np.ndarray, np.ndarray, int]:
    """(cid, d2, pairs looked at) of each point."""
    if how not in SEARCHES:
        raise ValueError(f"no search {how!r}")
    if how in ALIASES or not len(x):
        return *nearest(x, c)[:2], x.shape[0] * len(c)
    cid, d2, looked = of.copy(), np.zeros(len(x), np.int64), 0
    step = max(1, 4_000_000 // len(c))
    for i in range(0, len(x), step):
        part = slice(i, i + step)
        own, mask = candidates(x[part], c, old, of[part], how)
        row, j = np.nonzero(mask)
        looked += len(row) + len(own)
        d = ((x[part][row] - c[j]) ** 2).sum(1)
        all_d, all_j, all_row = np.concatenate([own, d]), np.concatenate([of[part], j]), np.concatenate([np.arange(len(own)), row])
        order = np.lexsort((all_j, all_d, all_row))
        first = np.searchsorted(all_row[order], np.arange(len(own)))
        cid[part], d2[part] = all_j[order][first], all_d[order][first]
    return cid, d2, looked
