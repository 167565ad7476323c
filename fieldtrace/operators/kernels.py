"""Small numpy/pandas helpers that run inside Spark tasks on bounded groups."""

from __future__ import annotations

import numpy as np
import pandas as pd


def pav(pdf: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    """Pool adjacent violators over rows (score_to, n, s) sorted by score; keeps the other columns."""
    ends, ns, ss = [], [], []
    for end, n, s in zip(pdf["score_to"], pdf["n"], pdf["s"]):
        ends.append(end), ns.append(n), ss.append(s)
        # equal means are pooled too, so slices and the whole give the same blocks
        while len(ends) > 1 and ss[-2] * ns[-1] >= ss[-1] * ns[-2]:
            s, n, e = ss.pop(), ns.pop(), ends.pop()
            ss[-1] += s
            ns[-1] += n
            ends[-1] = e
    out = pd.DataFrame({"score_to": ends, "n": ns, "s": ss})
    for c in columns:
        if c not in out:
            out[c] = pdf[c].iloc[0] if len(pdf) else None
    return out[columns]


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost complete assignment of the smaller side (shortest augmenting paths)."""
    cost = np.asarray(cost, dtype=float)
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T))
    n, m = cost.shape
    row_dual, col_dual = np.zeros(n), np.zeros(m + 1)
    owner = np.full(m + 1, -1)  # column m is the virtual start
    for r in range(n):
        owner[m] = r
        reach, via, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, dtype=bool)
        col = m
        while owner[col] != -1:
            done[col] = True
            slack = cost[owner[col]] - row_dual[owner[col]] - col_dual[:m]
            open_ = ~done[:m]
            better = open_ & (slack < reach)
            reach[better], via[better] = slack[better], col
            nxt = int(np.where(open_, reach, np.inf).argmin())
            delta = reach[nxt]
            row_dual[owner[done]] += delta
            col_dual[done] -= delta
            reach[open_] -= delta
            col = nxt
        while col != m:
            owner[col] = owner[via[col]]
            col = via[col]
    return sorted((int(owner[c]), c) for c in range(m) if owner[c] != -1)


def _bisect(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, after: bool) -> np.ndarray:
    """Per entry of ``x`` its place in the ascending ``values[lo:hi]``: before equal ones, or ``after`` them."""
    lo, hi = lo.copy(), hi.copy()
    while (todo := np.flatnonzero(lo < hi)).size:
        mid = (lo[todo] + hi[todo]) // 2
        down = values[mid] <= x[todo] if after else values[mid] < x[todo]
        lo[todo] = np.where(down, mid + 1, lo[todo])
        hi[todo] = np.where(down, hi[todo], mid)
    return lo


BESIDE = 16  # neighbours in the order of x on each side that bound a distance
PAIRS = 1 << 18  # pairs that lie in memory at once


def nearest_points(x: np.ndarray, y: np.ndarray, lo: np.ndarray, hi: np.ndarray, px: np.ndarray, py: np.ndarray, rank: np.ndarray,
                   radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Per point the nearest of ``px, py`` in its own range ``lo:hi`` (ascending ``px``) and the distance; -1 beyond ``radius``.

    The least ``rank`` wins among equal distances. The points beside it in x bound the distance, so that only those within the
    bound in x are looked at; pairs are made in blocks.
    """
    found, dist = np.full(len(x), -1), np.full(len(x), np.inf)
    by_rank = np.argsort(rank)

    def look(start, stop):
        count = stop - start
        rows = np.flatnonzero(count > 0)
        ends = np.cumsum(count[rows])
        begin = 0
        while begin < len(rows):
            end = max(int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")), begin + 1)
            r = rows[begin:end]
            n = count[r]
            first = np.cumsum(n) - n
            at = np.repeat(start[r] - first, n) + np.arange(n.sum())
            dx, dy = px[at] - np.repeat(x[r], n), py[at] - np.repeat(y[r], n)
            d = np.sqrt(dx * dx + dy * dy)
            dist[r] = np.minimum.reduceat(d, first)
            found[r] = by_rank[np.minimum.reduceat(np.where(d == np.repeat(dist[r], n), rank[at], len(rank)), first)]
            begin = end

    near = _bisect(px, lo, hi, x, False)
    look(np.maximum(near - BESIDE, lo), np.minimum(near + BESIDE, hi))
    reach = np.minimum(dist, radius)
    reach = reach + (np.abs(x) + reach) * 1e-12  # what rounding could hide
    look(_bisect(px, lo, hi, x - reach, False), _bisect(px, lo, hi, x + reach, True))
    found[dist > radius] = -1
    return found, dist


def diameter(points: np.ndarray) -> float:
    """Largest distance between two points: only corners of the convex hull can be that far apart."""
    pts = np.unique(np.asarray(points, dtype=float), axis=0)
    if len(pts) < 2:
        return 0.0

    def chain(seq):
        edge = []
        for p in seq:
            while len(edge) > 1 and (edge[-1][0] - edge[-2][0]) * (p[1] - edge[-2][1]) <= (edge[-1][1] - edge[-2][1]) * (p[0] - edge[-2][0]):
                edge.pop()
            edge.append(p)
        return edge

    hull = np.array(chain(pts)[:-1] + chain(pts[::-1])[:-1])
    return float(max(np.sqrt(((hull - p) ** 2).sum(axis=1)).max() for p in hull))


def pair_up(prices: dict[tuple[int, int], float], n: int, m: int) -> list[tuple[int, int]]:
    """Most pairs at the least total price; pairs without a price are never made."""
    barred = 1e6
    cost = np.full((n, m), barred)
    for at, price in prices.items():
        cost[at] = price
    return [at for at in assign(cost) if at in prices]
