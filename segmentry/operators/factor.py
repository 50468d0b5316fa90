"""Matrix factorisations of one dense matrix, data d x n ~ W H, written from their papers.

Every class has factorize(steps) and then W (d x k), H (k x n) and errors (Frobenius norm after each step).
`factorize_tracks` runs one of them on every track of a collection.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans import numeric as N
from ..plans.api import matrix

TINY = 1e-9


def simplex(v: np.ndarray) -> np.ndarray:
    """Euclidean projection of every column on the unit simplex."""
    u = -np.sort(-v, axis=0)
    k = np.arange(1, len(v) + 1)[:, None]
    s = (np.cumsum(u, axis=0) - 1) / k
    rho = (u > s).sum(axis=0) - 1
    return np.maximum(v - s[rho, np.arange(v.shape[1])], 0)


#: Of at most this many basis vectors all sets are tried at once.
FEW = 6


def sets_of(k: int) -> np.ndarray:
    """All sets of k basis vectors, as rows of marks; the empty one is first."""
    return (np.arange(2**k)[:, None] >> np.arange(k)) % 2 == 1


def least_of_sets(gram: np.ndarray, cross: np.ndarray, whole: bool) -> np.ndarray:
    """Columns h >= 0 (whole: of sum 1) of least h' gram h - 2 h' cross, exactly: the best of those of every set of free rows.

    A set whose vectors depend on each other can be left out, for smaller sets reach the same point.
    """
    k, n = cross.shape
    sets = sets_of(k)[1:] if whole else sets_of(k)
    m = np.zeros((len(sets), k + whole, k + whole))
    m[:, :k, :k] = np.where(sets[:, :, None] & sets[:, None], gram, np.eye(k) * ~sets[:, None])
    right = np.ones((len(sets), k + whole, n))
    right[:, :k] = np.where(sets[:, :, None], cross, 0)
    if whole:
        m[:, k, :k] = m[:, :k, k] = sets
    try:
        h = (np.linalg.inv(m) @ right)[:, :k]
    except np.linalg.LinAlgError:
        h = (np.linalg.pinv(m, hermitian=True) @ right)[:, :k]
    right_sum = np.abs(h.sum(axis=1) - 1) < 1e-6 if whole else True
    fits = np.isfinite(h).all(axis=1) & (h.min(axis=1) >= -1e-10 * (1 if whole else max(1.0, float(np.abs(h[-1]).max(initial=0))))) & right_sum
    h = np.maximum(np.where(fits[:, None], h, 0), 0)
    if whole:
        h /= np.maximum(h.sum(axis=1, keepdims=True), TINY)
    value = np.where(fits, (h * (gram @ h - 2 * cross)).sum(axis=1), np.inf)
    return h[value.argmin(axis=0), :, np.arange(n)].T


def nearest_in_hull(points: np.ndarray, target: np.ndarray, start: dict[int, float] | None = None) -> dict[int, float]:
    """Weights by column of the point of the columns' convex hull that is nearest to the target (Wolfe, 1976), from a start of such weights."""
    p = points - target[:, None]
    near = 1e-12 * max(float((p**2).sum(axis=0).max()), 1e-300)
    own = dict(start) if start else {int((p**2).sum(axis=0).argmin()): 1.0}
    own, weights = list(own), np.array(list(own.values()))
    for _ in range(10 * (p.shape[1] + len(p))):
        while len(own) > 1:
            q = p[:, own]
            try:
                a = np.linalg.solve(q.T @ q + 1, np.ones(len(own)))
            except np.linalg.LinAlgError:
                a = np.linalg.lstsq(q.T @ q + 1, np.ones(len(own)), rcond=None)[0]
            a /= a.sum()
            if a.min() > 1e-12:
                weights = a
                break
            out = a <= 1e-12
            share = (weights[out] / np.maximum(weights[out] - a[out], 1e-300)).min()
            weights = weights + min(1.0, share) * (a - weights)
            keep = weights > 1e-12
            keep[np.flatnonzero(out)[(weights[out]).argmin()]] = False
            own, weights = [k for k, ok in zip(own, keep) if ok], weights[keep] / weights[keep].sum()
        if len(own) == 1:
            weights = np.ones(1)
        x = p[:, own] @ weights
        score = x @ p
        k = int(score.argmin())
        if x @ x - score[k] <= near or k in own:
            break
        own, weights = [*own, k], np.append(weights, 0.0)
    return dict(zip(own, weights.tolist()))


def convex_weights(basis: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Columns on the simplex that bring basis @ columns nearest to target."""
    if basis.shape[1] <= FEW:
        return least_of_sets(basis.T @ basis, basis.T @ target, True)
    h = np.zeros((basis.shape[1], target.shape[1]))
    for c in range(target.shape[1]):
        for k, v in nearest_in_hull(basis, target[:, c]).items():
            h[k, c] = v
    return h


def nonnegative_weights(basis: np.ndarray, target: np.ndarray, steps: int = 200) -> np.ndarray:
    """Non-negative least squares of every column, by coordinate descent; exactly for few basis vectors."""
    gram, cross = basis.T @ basis, basis.T @ target
    if len(gram) <= FEW:
        return least_of_sets(gram, cross, False)
    h = np.maximum(np.linalg.lstsq(basis, target, rcond=None)[0], 0)
    for _ in range(steps):
        before = h.copy()
        for k in range(len(h)):
            if gram[k, k] > TINY:
                h[k] = np.maximum(0, h[k] + (cross[k] - gram[k] @ h) / gram[k, k])
        if np.abs(h - before).max() < 1e-10:
            break
    return h


def exact_nonnegative(basis: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Non-negative least squares of every column to the end, by block principal pivoting (Kim and Park, 2011).

    Every column has a set of free rows; rows whose weight (free) or slope (not free) is negative change sides, all at once while
    that helps and else only the last one. Columns of equal sets are solved together.
    """
    gram, cross = basis.T @ basis, basis.T @ target
    k, n = cross.shape
    if k <= FEW:
        return least_of_sets(gram, cross, False)
    near = 1e-10 * max(1.0, float(np.abs(cross).max(initial=0)))
    h, slope, free = np.zeros((k, n)), -cross, np.zeros((k, n), bool)
    fewest, tries = np.full(n, k + 1), np.full(n, 3)
    for _ in range(5 * 2**min(k, 10) + 50):
        wrong = np.where(free, h < -near, slope < -near)
        count = wrong.sum(axis=0)
        open_ = np.flatnonzero(count)
        if not len(open_):
            return np.maximum(h, 0)
        better = count[open_] < fewest[open_]
        fewest[open_[better]], tries[open_[better]] = count[open_[better]], 3
        alone = ~better & (tries[open_] == 0)
        tries[open_[~better & ~alone]] -= 1
        for c in open_[alone]:
            wrong[: np.flatnonzero(wrong[:, c])[-1], c] = False
        free[:, open_] ^= wrong[:, open_]
        sets, of = np.unique(free[:, open_], axis=1, return_inverse=True)
        for g in range(sets.shape[1]):
            rows, own = np.flatnonzero(sets[:, g]), open_[of.ravel() == g]
            h[:, own] = 0
            if len(rows):
                h[np.ix_(rows, own)] = np.linalg.lstsq(gram[np.ix_(rows, rows)], cross[np.ix_(rows, own)], rcond=None)[0]
            slope[:, own] = gram @ h[:, own] - cross[:, own]
            slope[np.ix_(rows, own)] = 0
    return nonnegative_weights(basis, target, 1000)  # dependent columns can turn in a circle


class Factorisation:
    """Alternates update_h and update_w until the error settles."""

    settles = 1e-8

    def __init__(self, data: np.ndarray, rank: int = 4, seed: int = 0):
        self.data, self.rank, self.rng = np.asarray(data, float), rank, np.random.default_rng(seed)
        self.d, self.n = self.data.shape
        self.seed, self.errors = seed, []

    def start(self) -> None:
        self.W = self.rng.random((self.d, self.rank)) + TINY
        self.H = self.rng.random((self.rank, self.n)) + TINY

    def update_h(self) -> None: ...

    def update_w(self) -> None: ...

    def error(self) -> float:
        return float(np.linalg.norm(self.data - self.W @ self.H))

    def factorize(self, steps: int = 100, update_w: bool = True, update_h: bool = True) -> Factorisation:
        self.start()
        for _ in range(steps):
            if update_w:
                self.update_w()
            if update_h:
                self.update_h()
            self.errors.append(self.error())
            if len(self.errors) > 1 and abs(self.errors[-1] - self.errors[-2]) / self.n < self.settles:
                break
        return self


class NMF(Factorisation):
    """Multiplicative updates for the Frobenius norm (Lee and Seung)."""

    def update_h(self):
        self.H *= (self.W.T @ self.data) / (self.W.T @ self.W @ self.H + TINY)

    def update_w(self):
        self.W *= (self.data @ self.H.T) / (self.W @ (self.H @ self.H.T) + TINY)
        self.W /= np.maximum(np.linalg.norm(self.W, axis=0), TINY)


class SNMF(Factorisation):
    """Semi-NMF: W free by least squares, H non-negative by square-root updates (Ding, Li and Jordan)."""

    def update_w(self):
        self.W = self.data @ np.linalg.pinv(self.H)

    def update_h(self):
        c, g = self.W.T @ self.data, self.W.T @ self.W
        up = (np.abs(c) + c) / 2 + (np.abs(g) - g) / 2 @ self.H
        down = (np.abs(c) - c) / 2 + (np.abs(g) + g) / 2 @ self.H
        self.H *= np.sqrt((up + TINY) / (down + TINY))


class CNMF(Factorisation):
    """Convex NMF: W = data G."""

    def factorize(self, steps: int = 100, **_):
        self.W, self.H = N.convex_nmf(self.data, self.rank, steps, self.seed)
        self.errors.append(self.error())
        return self


class BNMF(NMF):
    """Binary NMF: both factors are drawn to 0 and 1 by a penalty that grows."""

    growth = 1.1

    def start(self):
        super().start()
        self.lw = self.lh = 1.0 / self.n

    def update_h(self):
        self.H *= (self.W.T @ self.data + 3 * self.lh * self.H**2) / (self.W.T @ self.W @ self.H + 2 * self.lh * self.H**3 + self.lh * self.H + TINY)
        self.lh *= self.growth

    def update_w(self):
        self.W *= (self.data @ self.H.T + 3 * self.lw * self.W**2) / (self.W @ (self.H @ self.H.T) + 2 * self.lw * self.W**3 + self.lw * self.W + TINY)
        self.lw *= self.growth


class RNMF(NMF):
    """Robust NMF: sparse outliers S take what is over a threshold; data ~ W H + S."""

    threshold = 0.1

    def start(self):
        super().start()
        self.S = np.zeros_like(self.data)

    def update_h(self):
        rest = self.data - self.W @ self.H
        self.S = np.sign(rest) * np.maximum(np.abs(rest) - self.threshold, 0)
        c = self.W.T @ (self.S - self.data)
        self.H *= (np.abs(c) - c) / (2 * (self.W.T @ self.W @ self.H) + TINY)

    def update_w(self):
        c = (self.S - self.data) @ self.H.T
        self.W *= (np.abs(c) - c) / (2 * (self.W @ (self.H @ self.H.T)) + TINY)
        scale = np.maximum(np.linalg.norm(self.W, axis=0), TINY)
        self.W, self.H = self.W / scale, self.H * scale[:, None]

    def error(self):
        return float(np.linalg.norm(self.data - self.W @ self.H - self.S))


class NMFALS(Factorisation):
    """Alternating non-negative least squares."""

    def update_h(self):
        self.H = nonnegative_weights(self.W, self.data)

    def update_w(self):
        self.W = nonnegative_weights(self.H.T, self.data.T).T


class NMFNNLS(NMFALS):
    """The same problem solved to the end in every step."""

    def update_h(self):
        self.H = exact_nonnegative(self.W, self.data)

    def update_w(self):
        self.W = exact_nonnegative(self.H.T, self.data.T).T


class NNDSVD(Factorisation):
    """Non-negative start from the singular vectors (Boutsidis and Gallopoulos), in one step."""

    def factorize(self, steps: int = 1, **_):
        u, s, v = np.linalg.svd(self.data, full_matrices=False)
        k = min(self.rank, len(s))
        self.W, self.H = np.zeros((self.d, self.rank)), np.zeros((self.rank, self.n))
        self.W[:, 0], self.H[0] = np.sqrt(s[0]) * np.abs(u[:, 0]), np.sqrt(s[0]) * np.abs(v[0])
        for j in range(1, k):
            best = max(((np.maximum(sign * u[:, j], 0), np.maximum(sign * v[j], 0)) for sign in (1, -1)), key=lambda p: np.linalg.norm(p[0]) * np.linalg.norm(p[1]))
            a, b = (np.linalg.norm(x) for x in best)
            if a * b > 0:
                self.W[:, j], self.H[j] = np.sqrt(s[j] * a * b) * best[0] / a, np.sqrt(s[j] * a * b) * best[1] / b
        self.errors.append(self.error())
        return self


class AA(Factorisation):
    """Archetypal analysis: archetypes are convex mixtures of the data, and the data of the archetypes (Cutler and Breiman)."""

    def start(self):
        self.beta = simplex(self.rng.random((self.n, self.rank)))
        self.corners = [None] * self.rank
        self.W = self.data @ self.beta
        self.H = convex_weights(self.W, self.data)

    def update_h(self):
        self.H = convex_weights(self.W, self.data)

    def update_w(self):
        # each archetype is the point of the data's hull next to its target, sought from the corners of the step before
        self.corners = [nearest_in_hull(self.data, t, c) for t, c in zip((self.data @ np.linalg.pinv(self.H)).T, self.corners)]
        self.beta = np.zeros((self.n, self.rank))
        for c, own in enumerate(self.corners):
            self.beta[list(own), c] = list(own.values())
        self.W = self.data @ self.beta


def hull_of(points: np.ndarray) -> list[int]:
    """Rows of an n x 2 matrix that are corners of the convex hull, counterclockwise; of equal points the first."""
    _, first = np.unique(points, axis=0, return_index=True)  # rows in order of x, then y
    if len(first) < 3:
        return first.tolist()

    def chain(order):
        out = []
        for k in order:
            while len(out) > 1:
                (ax, ay), (bx, by) = points[out[-1]] - points[out[-2]], points[k] - points[out[-1]]
                if ax * by - ay * bx > 0:
                    break
                out.pop()
            out.append(int(k))
        return out[:-1]

    return chain(first) + chain(first[::-1])


def hull_columns(data: np.ndarray, directions: int = 3, seed: int = 0) -> np.ndarray:
    """Columns that are corners of the hull in a plane of two of some random directions, over all pairs of directions."""
    directions = max(2, min(directions, len(data)))
    views = np.random.default_rng(seed).standard_normal((directions, len(data))) @ data
    return np.array(sorted({k for a in range(directions) for b in range(a) for k in hull_of(views[[b, a]].T)}))


class CHNMF(Factorisation):
    """Convex-hull NMF: archetypes from the hull's corners alone."""

    def factorize(self, steps: int = 50, **_):
        self.select = hull_columns(self.data, seed=self.seed)
        self.W = AA(self.data[:, self.select], min(self.rank, len(self.select)), self.seed).factorize(steps).W
        self.H = convex_weights(self.W, self.data)
        self.errors.append(self.error())
        return self


class Kmeans(Factorisation):
    """H marks the nearest of k centres."""

    def factorize(self, steps: int = 300, **_):
        centres, self.assigned = N.kmeans(self.data.T, self.rank, steps=steps, seed=self.seed)
        self.W = centres.T
        self.H = (self.assigned[None] == np.arange(len(centres))[:, None]).astype(float)
        self.errors.append(self.error())
        return self


class Cmeans(Factorisation):
    """Fuzzy memberships with fuzzifier m."""

    m = 1.75

    def start(self):
        self.W = self.data[:, self.rng.choice(self.n, min(self.rank, self.n), replace=False)]
        self.update_h()

    def update_h(self):
        d = np.maximum(N.euclidean(self.W.T, self.data.T), 1e-12) ** (-2 / (self.m - 1))
        self.H = d / d.sum(axis=0)

    def update_w(self):
        p = self.H**self.m
        self.W = self.data @ p.T / p.sum(axis=1)


class SVD(Factorisation):
    """U, S, V by the eigenvectors of the smaller Gram matrix; directions of eigenvalues under 1e-8 are dropped."""

    def factorize(self, steps: int = 1, **_):
        wide = self.n >= self.d
        values, vectors = np.linalg.eigh(self.data @ self.data.T if wide else self.data.T @ self.data)
        order = np.argsort(values)[::-1]
        order = order[values[order] > 1e-8][: self.rank]
        s, v = np.sqrt(values[order]), vectors[:, order]
        self.U, self.S = (v if wide else self.data @ v / s), np.diag(s)
        self.V = (v.T @ self.data / s[:, None]) if wide else v.T
        self.W, self.H = self.U, self.S @ self.V
        self.errors.append(self.error())
        return self


def pinv(a: np.ndarray) -> np.ndarray:
    """Pseudo-inverse from the same decomposition."""
    m = SVD(a, min(a.shape)).factorize()
    return m.V.T @ np.diag(1 / np.diag(m.S)) @ m.U.T if len(m.S) else np.zeros(a.T.shape)


class PCA(Factorisation):
    """W: principal directions of the centred columns; H: their scores; mean is kept."""

    def factorize(self, steps: int = 1, **_):
        self.mean = self.data.mean(axis=1, keepdims=True)
        m = SVD(self.data - self.mean, self.rank).factorize()
        self.eigenvalues, self.W, self.H = np.diag(m.S) ** 2, m.U, m.S @ m.V
        self.errors.append(self.error())
        return self

    def error(self):
        return float(np.linalg.norm(self.data - self.mean - self.W @ self.H))


class CUR(Factorisation):
    """data ~ C U R of sampled columns and rows, drawn by squared norm; rank counts columns, row_rank rows."""

    def __init__(self, data, rank: int = 4, seed: int = 0, row_rank: int | None = None):
        super().__init__(data, rank, seed)
        self.row_rank = row_rank or rank

    def chances(self, axis: int) -> np.ndarray:
        p = (self.data**2).sum(axis=axis)
        return p / p.sum()

    def draw(self) -> None:
        self.columns = self.rng.choice(self.n, self.rank, p=self.chances(0))
        self.rows = self.rng.choice(self.d, self.row_rank, p=self.chances(1))

    def factorize(self, steps: int = 1, **_):
        self.draw()
        self.C, self.R = self.data[:, self.columns], self.data[self.rows]
        self.U = pinv(self.C) @ self.data @ pinv(self.R)
        self.W, self.H = self.C, self.U @ self.R
        self.errors.append(self.error())
        return self


class CMD(CUR):
    """CUR whose repeated draws are one column or row, scaled by the root of their number."""

    def factorize(self, steps: int = 1, **_):
        self.draw()
        self.columns, many = np.unique(self.columns, return_counts=True)
        self.rows, often = np.unique(self.rows, return_counts=True)
        self.C, self.R = self.data[:, self.columns] * np.sqrt(many), self.data[self.rows] * np.sqrt(often)[:, None]
        self.U = pinv(self.C) @ self.data @ pinv(self.R)
        self.W, self.H = self.C, self.U @ self.R
        self.errors.append(self.error())
        return self


class CURSL(CUR):
    """CUR with chances from the leverage of leading singular vectors."""

    def chances(self, axis):
        m = SVD(self.data, self.rank).factorize()
        p = (m.V**2).sum(axis=0) if axis == 0 else (m.U**2).sum(axis=1)
        return p / p.sum()


class GREEDY(Factorisation):
    """Columns one by one, each that which takes most of the remaining energy."""

    def choose(self) -> list[int]:
        rest, out = self.data.copy(), []
        for _ in range(min(self.rank, self.n)):
            norm = (rest**2).sum(axis=0)
            score = np.where(norm > 1e-12, ((rest.T @ rest) ** 2).sum(axis=1) / np.maximum(norm, 1e-12), -1)
            score[out] = -1
            k = int(score.argmax())
            out.append(k)
            u = rest[:, k] / max(np.linalg.norm(rest[:, k]), 1e-12)
            rest = rest - np.outer(u, u @ rest)
        return out

    def factorize(self, steps: int = 1, **_):
        self.select = self.choose()
        self.W = self.data[:, self.select]
        self.H = pinv(self.W) @ self.data
        self.errors.append(self.error())
        return self


class GREEDYCUR(CUR):
    """CUR with greedily chosen columns and rows."""

    def draw(self):
        self.columns = np.array(GREEDY(self.data, self.rank).choose())
        self.rows = np.array(GREEDY(self.data.T, self.row_rank).choose())


#: Distances of one column to all columns.
DISTANCES = {
    "l2": lambda a, x: np.sqrt(np.maximum(0, ((x - a[:, None]) ** 2).sum(axis=0))),
    "l1": lambda a, x: np.abs(x - a[:, None]).sum(axis=0),
    "cosine": lambda a, x: 1 - (a @ x) / np.maximum(np.linalg.norm(a) * np.linalg.norm(x, axis=0), 1e-12),
    "abs_cosine": lambda a, x: 1 - np.abs(a @ x) / np.maximum(np.linalg.norm(a) * np.linalg.norm(x, axis=0), 1e-12),
    "kl": lambda a, x: (np.maximum(x, TINY) * np.log(np.maximum(x, TINY) / np.maximum(a, TINY)[:, None]) - x + a[:, None]).sum(axis=0),
    "weighted_l2": lambda a, x: np.sqrt((((x - a[:, None]) ** 2) / np.maximum(x.var(axis=1), TINY)[:, None]).sum(axis=0)),
}


def pdist(a: np.ndarray, b: np.ndarray, metric: str = "l2") -> np.ndarray:
    """Distances of the columns of a to those of b."""
    return np.stack([DISTANCES[metric](c, b) for c in a.T])


def vq(centres: np.ndarray, data: np.ndarray, metric: str = "l2") -> np.ndarray:
    return pdist(centres, data, metric).argmin(axis=0)


def cayley_menger(d: np.ndarray) -> float:
    """Volume of the simplex of points with the given distances."""
    from math import factorial

    k = len(d) - 1
    m = np.ones((k + 2, k + 2))
    m[0, 0], m[1:, 1:] = 0, d**2
    return float(np.sqrt(max(0.0, (-1) ** (k + 1) / (2**k * factorial(k) ** 2) * np.linalg.det(m))))


def volumes(d: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """Cayley-Menger volumes of sets of places, a row each, from the matrix of distances."""
    from math import factorial

    k = sets.shape[1] - 1
    m = np.ones((len(sets), k + 2, k + 2))
    m[:, 0, 0], m[:, 1:, 1:] = 0, d[sets[:, :, None], sets[:, None]] ** 2
    return np.sqrt(np.maximum(0.0, (-1) ** (k + 1) / (2**k * factorial(k) ** 2) * np.linalg.det(m)))


def simplex_volume(points: np.ndarray) -> float:
    return cayley_menger(pdist(points, points))


class SIVM(Factorisation):
    """Simplex volume maximisation: corners that are far, and evenly far, from those found."""

    def __init__(self, data, rank: int = 4, seed: int = 0, metric: str = "l2", start: str = "fastmap"):
        super().__init__(data, rank, seed)
        self.metric, self.begin = metric, start

    def distance(self, k: int) -> np.ndarray:
        return DISTANCES[self.metric](self.data[:, k], self.data)

    def first(self) -> int:
        if self.begin == "origin":
            return int((self.data**2).sum(axis=0).argmax())
        k = 0
        for _ in range(3):
            k = int(self.distance(k).argmax())
        return k

    def choose(self) -> list[int]:
        out = [self.first()]
        logs, squares = np.zeros(self.n), np.zeros(self.n)
        products, far = np.zeros(self.n), None
        for step in range(1, min(self.rank, self.n)):
            d = self.distance(out[-1])
            d[out] = 0
            far = far if far is not None else max(d.max(), TINY)
            l = np.log(d + TINY)  # noqa: E741
            products += l * logs
            logs += l
            squares += l**2
            score = np.log(far) * logs + products - step / 2 * squares
            score[out] = -np.inf
            out.append(int(score.argmax()))
        return out

    def factorize(self, steps: int = 1, **_):
        self.select = self.choose()
        self.W = self.data[:, self.select]
        self.H = convex_weights(self.W, self.data)
        self.errors.append(self.error())
        return self


class SIVM_CUR(CUR):
    """CUR with columns and rows by simplex volume."""

    def draw(self):
        self.columns = np.array(SIVM(self.data, self.rank).choose())
        self.rows = np.array(SIVM(self.data.T, self.row_rank).choose())


class SIVM_SEARCH(SIVM):
    """Best-first search over sets of corners, the most promising first, until a whole set comes up.

    A set promises the volume that it had if all distances to the corners it lacks were the largest of the data. No set is
    left out, so the number of sets can grow with the rank-th power of the columns.
    """

    #: So many sets that lack one corner are completed at once.
    together = 32

    def choose(self):
        from heapq import heappop, heappush

        d, rank = pdist(self.data, self.data, self.metric), min(self.rank, self.n)
        if rank == 1:
            return [self.first()]
        squares, every = d**2, np.arange(self.n)
        top = float(squares.max())
        single = self.promises(np.array([[0]]), squares, rank, top)[0]
        seen, turn, best, now = {(k,) for k in range(self.n)}, self.n, None, [(self.first(),)]
        queue = [(-single, k, (k,)) for k in range(self.n)]
        # whole sets are not queued: only the best of them can come up, the first of equal ones
        while True:
            lacking = len(now[0]) + 1 == rank
            if lacking:
                left = np.array([np.delete(every, t) for t in now])
                sets = np.concatenate([np.repeat(np.array(now)[:, None], left.shape[1], axis=1), left[:, :, None]], axis=2).reshape(-1, rank)
                values = self.promises(np.sort(sets, axis=1), squares, rank, top).reshape(left.shape)
            for at, t in enumerate(now):
                if at and best and best[:2] < keys[at]:  # noqa: F821
                    return list(best[2])
                if lacking:
                    k = int(values[at].argmax())
                    if best is None or -values[at, k] < best[0]:
                        best = (-float(values[at, k]), turn + k, tuple(sorted((*t, int(left[at, k])))))
                    turn += self.n
                    continue
                grown = [g for g in (tuple(sorted((*t, k))) for k in range(self.n) if k not in t) if g not in seen]
                seen.update(grown)
                if grown:
                    for v, g in zip(self.promises(np.array(grown), squares, rank, top).tolist(), grown):
                        heappush(queue, (-v, turn, g))
                        turn += 1
            now, keys = [], []
            while queue and len(now) < self.together and (not best or queue[0][:2] < best[:2]) and (not now or len(now[0]) == len(queue[0][2]) == rank - 1):
                *key, t = heappop(queue)
                now.append(t)
                keys.append(tuple(key))
            if not now:
                return list(best[2])

    @staticmethod
    def promises(at: np.ndarray, squares: np.ndarray, rank: int, top: float) -> np.ndarray:
        """Cayley-Menger volumes of sets of one size, without their constant factor; squares of distances, and the largest of them."""
        size = at.shape[1]
        if rank == 3:
            a, b, c = (squares[at[:, i], at[:, j]] if j < size else np.full(len(at), top) for i, j in ((0, 1), (0, 2), (1, 2)))
            return np.maximum(2 * (a * b + b * c + c * a) - (a * a + b * b + c * c), 0)
        m = np.ones((len(at), rank + 1, rank + 1))
        m[:, 1:, 1:] = top
        m[:, 1 : size + 1, 1 : size + 1] = squares[at[:, :, None], at[:, None, :]]
        m[:, np.arange(rank + 1), np.arange(rank + 1)] = 0
        return np.maximum((-1) ** rank * np.linalg.det(m), 0)


class SIVM_SGREEDY(SIVM):
    """Corners one by one, each that of the largest Cayley-Menger volume with those found."""

    def choose(self):
        d = pdist(self.data, self.data, self.metric)
        out = [self.first()]
        for _ in range(1, min(self.rank, self.n)):
            left = np.setdiff1d(np.arange(self.n), out)
            sets = np.concatenate([np.repeat([out], len(left), axis=0), left[:, None]], axis=1)
            out.append(int(left[volumes(d, sets).argmax()]))
        return out


class SIVM_GSAT(SIVM):
    """Online: a new vector takes the place of the corner whose exchange widens the simplex most."""

    def choose(self):
        out, d = list(range(min(self.rank, self.n))), pdist(self.data, self.data)
        for k in range(len(out), self.n):
            sets = np.array([out] * (len(out) + 1))
            sets[np.arange(1, len(sets)), np.arange(len(out))] = k
            volume, *others = volumes(d, sets).tolist()
            for other, v in zip(sets[1:].tolist(), others):
                if v > volume * (1 + 1e-9):
                    out, volume = other, v
        return out


def exchange(data: np.ndarray, corners: list[int], k: int) -> list[int]:
    best, volume = corners, simplex_volume(data[:, corners])
    for at in range(len(corners)):
        other = [*corners[:at], k, *corners[at + 1 :]]
        v = simplex_volume(data[:, other])
        if v > volume * (1 + 1e-9):
            best, volume = other, v
    return best


class GMAP(Factorisation):
    """Geometric map: columns little like those found by angle. Kinds pca, aa and nmf weigh angle and length by the volume found so
    far; kind angle (the default) takes after the longest column the one whose largest cosine is least.

    With robust (Ostrouchov and Samatova, 2005) a pick is not the best column but, of the `near` best, the one next to the centre of
    the largest of `clusters` groups, so that a lone outlier is passed over.
    """

    def __init__(self, data, rank: int = 4, seed: int = 0, kind: str = "angle", robust: bool = False, clusters: int = 3, near: int | None = None):
        super().__init__(data, rank, seed)
        self.kind, self.robust, self.clusters = kind, robust, clusters
        self.near = near or max(1, round(2 * np.log(max(self.n, 1))))

    def pick(self, score: np.ndarray) -> int:
        if not self.robust:
            return int(score.argmax())
        best = np.argsort(-score, kind="stable")[: self.near]
        centres, of = N.kmeans(self.data[:, best].T, min(self.clusters, len(best)), restarts=1, steps=10, seed=self.seed)
        centre = centres[np.bincount(of, minlength=len(centres)).argmax()]
        return int(best[np.linalg.norm(self.data[:, best].T - centre, axis=1).argmin()])

    def choose(self):
        long = np.linalg.norm(self.data, axis=0)
        safe = np.maximum(long, TINY)
        score = 1 - self.data.sum(axis=0) / (np.sqrt(self.d) * safe) if self.kind == "nmf" else long.copy()
        out, like = [self.pick(score)], np.zeros(self.n)
        for _ in range(1, min(self.rank, self.n)):
            cosine = self.data[:, out[-1]] @ self.data / (safe * safe[out[-1]])
            if self.kind == "angle":
                like = np.maximum(like, np.abs(cosine))
                like[out] = np.inf
                out.append(self.pick(-like))
                continue
            apart = (1 - cosine) / 2 if self.kind == "aa" else 1 - np.abs(cosine)
            score = score * apart * (1 if self.kind == "nmf" else long)
            out.append(self.pick(score))
        return out

    factorize = SIVM.factorize


class LAESA(Factorisation):
    """Pivots: each the farthest from all before it."""

    def choose(self):
        out, total = [0], np.zeros(self.n)
        for _ in range(1, min(self.rank, self.n)):
            total += DISTANCES["l2"](self.data[:, out[-1]], self.data)
            masked = total.copy()
            masked[out] = -1
            out.append(int(masked.argmax()))
        return out

    factorize = SIVM.factorize


class SUB(Factorisation):
    """Factorises some columns with another method, then projects all on its basis."""

    def __init__(self, data, rank: int = 4, seed: int = 0, method=NMF, select: str = "rand", size: int = 100):
        super().__init__(data, rank, seed)
        self.method, self.how, self.size = method, select, size

    def columns(self) -> np.ndarray:
        size = min(self.size, self.n)
        if self.how == "cur":
            return np.unique(self.rng.choice(self.n, size, p=(self.data**2).sum(axis=0) / (self.data**2).sum()))
        if self.how == "kmeans":
            centres, _ = N.kmeans(self.data.T, size, restarts=1, seed=self.seed)
            return np.unique(N.euclidean(centres, self.data.T).argmin(axis=1))
        if self.how == "hull":
            return hull_columns(self.data, seed=self.seed)
        if self.how in ("laesa", "sivm"):
            return np.array((LAESA if self.how == "laesa" else SIVM)(self.data, size, self.seed).choose())
        return self.rng.choice(self.n, size, replace=False)

    def factorize(self, steps: int = 50, **_):
        self.select = self.columns()
        inner = self.method(self.data[:, self.select], self.rank, self.seed).factorize(steps)
        self.W = inner.W
        self.H = (nonnegative_weights if (self.data >= 0).all() else convex_weights)(self.W, self.data)
        self.errors.append(self.error())
        return self


METHODS = {c.__name__: c for c in (NMF, CNMF, SNMF, BNMF, RNMF, NMFALS, NMFNNLS, NNDSVD, AA, CHNMF, Kmeans, Cmeans, PCA, SVD, CUR, CMD, CURSL, GREEDY, GREEDYCUR, SIVM, SIVM_CUR, SIVM_SEARCH, SIVM_SGREEDY, SIVM_GSAT, GMAP, LAESA, SUB)}


def factorize_tracks(packed: DataFrame, method: str, rank: int = 3, steps: int = 50, factors: tuple[str, ...] = ("error", "W", "H")) -> DataFrame:
    """(track_id, factor, i, j, v) of W and H of every track (frames are columns), and the last error as factor `error`; or only some of them."""
    make, names = METHODS[method], packed.columns
    schema = pa.schema([("track_id", pa.string()), ("factor", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())])

    def rows_of(track, x):
        m = make(x, min(rank, x.shape[1])).factorize(steps)
        for name, a in (("error", np.array([[m.errors[-1]]])), ("W", m.W), ("H", m.H)):
            if name in factors:
                yield [track] * a.size, [name] * a.size, np.repeat(np.arange(a.shape[0]), a.shape[1]), np.tile(np.arange(a.shape[1]), a.shape[0]), a.ravel()

    def run(batches):
        for batch in batches:
            tracks, x = (batch.column(names.index(c)) for c in ("track_id", "x"))
            parts = [p for t, cell in zip(tracks, x) for p in rows_of(t.as_py(), np.ascontiguousarray(matrix(cell).T))]
            if parts:
                t, f, i, j, v = zip(*parts)
                yield pa.RecordBatch.from_arrays([pa.array([k for p in t for k in p], pa.string()), pa.array([k for p in f for k in p], pa.string()), *[pa.array(np.concatenate(c), kind) for c, kind in ((i, pa.int32()), (j, pa.int32()), (v, pa.float64()))]], schema=schema)

    return packed.mapInArrow(run, "track_id string, factor string, i int, j int, v double")
