"""Distances between curves: Euclidean, dynamic time warping (banded or not), move-split-merge and time-warp-edit.

``distances_to`` measures many curves against one, all rows side by side along the anti-diagonals of the dynamic programme. A name may end in
``:channels`` (curves of so many channels end to end, distances added up). ``lower_bounds`` gives what no warping can undercut, from the envelope of the one curve, and
``nearest`` finds nearest neighbours with it: bounds are sorted and only curves whose bound is below the best distance so far are measured.
"""

from __future__ import annotations

import numpy as np

NAMES = ("euclidean", "dtw", "msm", "twe")
#: Penalties: cost of a split or merge; stiffness and penalty of a time-warp edit.
MSM_COST, TWE_NU, TWE_LAMBDA = 1.0, 0.001, 1.0
BAND = 0.1


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(axis=1))


def _programme(n: int, m: int, rows: int, first: np.ndarray, left: np.ndarray, step, band: int | None):
    """D of rows dynamic programmes of n by m cells along anti-diagonals; step(i, j, diagonal, up, side) gives the cells' values.

    first: D along j at i = 0; left: D along i at j = 0 (rows first); cells beyond the band stay infinite.
    """
    before, last = np.full((rows, n + 1), np.inf), np.full((rows, n + 1), np.inf)
    last[:, 0] = first[..., 0]
    for d in range(1, n + m + 1):
        now = np.full((rows, n + 1), np.inf)
        if d <= m:
            now[:, 0] = first[..., d]
        if d <= n:
            now[:, d] = left[..., d]
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        if band is not None:
            i = i[np.abs(2 * i - d) <= band]
        if len(i):
            now[:, i] = step(i, d - i, before[:, i - 1], last[:, i - 1], last[:, i])
        before, last = last, now
    return last[:, n]


def dtw(a: np.ndarray, b: np.ndarray, band: int | None = None) -> np.ndarray:
    """Squared differences along the best warping of each row of a to b, within ``band`` places if given."""
    n, m = a.shape[1], len(b)
    edge = np.full(max(n, m) + 1, np.inf)
    edge[0] = 0.0
    step = lambda i, j, diagonal, up, side: (a[:, i - 1] - b[j - 1]) ** 2 + np.minimum(np.minimum(up, side), diagonal)
    return _programme(n, m, len(a), edge[: m + 1], edge[: n + 1], step, band)


def _split(x: np.ndarray, y: np.ndarray, z: np.ndarray, c: float) -> np.ndarray:
    """Cost of a split or merge that makes x beside y and z: c, and how far x is outside of them."""
    beyond = np.maximum(np.minimum(y, z) - x, x - np.maximum(y, z))
    return np.maximum(beyond, 0.0, out=beyond) + c


#: Rows whose move-split-merge runs together: with 32 points a diagonal of them takes 128 KB.
TOGETHER = 512


def msm(a: np.ndarray, b: np.ndarray, c: float = MSM_COST) -> np.ndarray:
    """Move-split-merge: a metric of moves by their length, and splits and merges at a cost. Rows stand last, so that a diagonal's cells adjoin."""
    return np.concatenate([_msm(np.ascontiguousarray(a[k : k + TOGETHER].T, float), b, c) for k in range(0, len(a), TOGETHER)] or [np.zeros(0)])


def _msm(a: np.ndarray, b: np.ndarray, c: float) -> np.ndarray:
    n, m = len(a), len(b)
    b = np.asarray(b, float)[:, None]
    # the first cell is a move; the first row and column are splits after it
    first = np.abs(a[:1] - b[0])
    left = np.cumsum(np.concatenate([first, _split(a[1:], a[:-1], b[0], c)]), axis=0)
    top = np.cumsum(np.concatenate([first, _split(b[1:], a[0], b[:-1], c)]), axis=0)
    before, last, now, move, up, side, edge = (np.empty_like(left) for _ in range(7))  # diagonals, by i
    last[0] = first

    def split(x: np.ndarray, y: np.ndarray, z: np.ndarray, out: np.ndarray, high: np.ndarray) -> np.ndarray:
        """``_split`` into out."""
        np.subtract(np.minimum(y, z, out=out), x, out=out)
        np.subtract(x, np.maximum(y, z, out=high), out=high)
        np.maximum(np.maximum(out, high, out=out), 0.0, out=out)
        return np.add(out, c, out=out)

    for s in range(1, n + m - 1):
        if s < m:
            now[0] = top[s]
        if s < n:
            now[s] = left[s]
        i, k = max(1, s - m + 1), min(n - 1, s - 1) + 1
        if i < k:
            x, x0 = a[i:k], a[i - 1 : k - 1]
            y, y0 = b[s - i : s - k : -1], b[s - i - 1 : s - k - 1 if s > k else None : -1]
            one, two, three, high = (room[: k - i] for room in (move, up, side, edge))
            np.abs(np.subtract(x, y, out=one), out=one)
            one += before[i - 1 : k - 1]
            split(x, x0, y, two, high)
            two += last[i - 1 : k - 1]
            split(y, x, y0, three, high)
            three += last[i:k]
            np.minimum(two, three, out=two)
            np.minimum(one, two, out=now[i:k])
        before, last, now = last, now, before
    return last[n - 1]


def twe(a: np.ndarray, b: np.ndarray, nu: float = TWE_NU, lam: float = TWE_LAMBDA) -> np.ndarray:
    """Time-warp edit with stiffness nu and penalty lam; both curves start from a 0 before them."""
    n, m = a.shape[1], len(b)
    x, y = np.column_stack([np.zeros(len(a)), a]), np.concatenate([[0.0], b])
    edge = np.full(max(n, m) + 1, np.inf)
    edge[0] = 0.0

    def step(i, j, diagonal, up, side):
        match = diagonal + (x[:, i] - y[j]) ** 2 + (x[:, i - 1] - y[j - 1]) ** 2 + 2 * nu * np.abs(i - j)
        drop_a = up + (x[:, i] - x[:, i - 1]) ** 2 + nu + lam
        drop_b = side + (y[j] - y[j - 1]) ** 2 + nu + lam
        return np.minimum(np.minimum(match, drop_a), drop_b)

    return _programme(n, m, len(a), edge[: m + 1], edge[: n + 1], step, None)


def distances_to(rows: np.ndarray, one: np.ndarray, name: str) -> np.ndarray:
    """Distance of each row to one curve. name: of NAMES, ``dtw@share`` for a band of a share of the length, and ``:channels``."""
    name, _, channels = name.partition(":")
    name, _, share = name.partition("@")
    if name not in NAMES:
        raise ValueError(f"distance is one of {NAMES}")
    parts = int(channels or 1)
    if name == "euclidean":
        return euclidean(rows, one)
    width = len(one) // parts
    band = max(1, round(float(share) * width)) if share else None
    total = np.zeros(len(rows))
    for c in range(parts):
        a, b = rows[:, c * width : (c + 1) * width], one[c * width : (c + 1) * width]
        total += dtw(a, b, band) if name == "dtw" else msm(a, b) if name == "msm" else twe(a, b)
    return total


def envelope(one: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest value of a curve within ``reach`` places."""
    n = len(one)
    window = np.clip(np.arange(n)[:, None] + np.arange(-reach, reach + 1), 0, n - 1)
    return one[window].min(axis=1), one[window].max(axis=1)


def lower_bounds(rows: np.ndarray, one: np.ndarray, reach: int) -> np.ndarray:
    """What banded warping cannot undercut: squared distances to the envelope of the one curve."""
    low, high = envelope(one, reach)
    return (np.maximum(np.maximum(rows - high, low - rows), 0) ** 2).sum(axis=1)


def nearest(rows: np.ndarray, one: np.ndarray, many: int, share: float = BAND, block: int = 64) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and banded warping distances of the ``many`` nearest rows (equal ones by place), and how many rows were measured."""
    reach = max(1, round(share * len(one)))
    bound = lower_bounds(rows, one, reach)
    order = np.argsort(bound, kind="stable")
    found, at, measured = np.zeros(0), np.zeros(0, np.int64), 0
    for i in range(0, len(order), block):
        part = order[i : i + block]
        if len(found) == many:
            part = part[bound[part] <= found[-1]]
            if not len(part):
                break
        measured += len(part)
        found, at = np.concatenate([found, dtw(rows[part], one, reach)]), np.concatenate([at, part])
        best = np.lexsort((at, found))[:many]
        found, at = found[best], at[best]
    return at, found, measured
