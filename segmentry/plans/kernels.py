"""Segmenters of one track: f(x, bounds, config, seed) -> (boundary frames, labels), or a list of levels.

x is frames x dimensions; bounds is None unless a label algorithm is to label given segments. Labels
of -1 mean none. The numbers agree with the relational twins where there are any (relational.py).
"""

from __future__ import annotations

import math

import numpy as np

from . import numeric as N


def no_labels(bounds) -> np.ndarray:
    return np.full(len(bounds) - 1, -1)


def ends(peaks, n: int) -> np.ndarray:
    return np.unique(np.concatenate([[0], np.asarray(peaks, int), [n - 1]]))


def checkerboard(size: int) -> np.ndarray:
    g = np.exp(-0.5 * ((np.arange(size) - (size - 1) / 2) / float(size // 3)) ** 2)
    sign = np.where(np.arange(size) < size // 2, 1, -1)
    return np.outer(g * sign, g * sign)


def foote(x, bounds, c, seed):
    size = c["M_gaussian"] + c["M_gaussian"] % 2
    f = N.median_filter(N.normalise(x, c["bound_norm_feats"]), c["m_median"])
    spread = f.std(axis=0, ddof=1)
    z = np.where(spread > 0, f / np.where(spread > 0, spread, 1), 0)
    d = N.euclidean(z, z)
    s = 1 - d / d.max() if d.max() > 0 else np.ones_like(d)
    n, half, g = len(x), size // 2, checkerboard(size)
    nc = np.zeros(n)
    for i in range(half, n - half + 1):
        nc[i] = (s[i - half : i + half, i - half : i + half] * g).sum()
    nc = nc + (nc.min() if c.get("center", "add") == "add" else -nc.min())
    nc = nc / nc.max() if nc.max() != 0 else np.zeros(n)
    smooth = N.gaussian_filter(nc, 4.0)
    b = ends(N.peaks(smooth, N.median_filter(smooth, c["L_peaks"]) + nc.mean() / 20), n)
    return b, no_labels(b)


def curve_peaks(nc, c) -> np.ndarray:
    """Boundaries inside a track from the distances of successive structural features."""
    nc = nc + abs(nc.min())
    nc = nc / nc.max() if nc.max() > 0 else nc
    return N.peaks(nc, N.median_filter(nc, c["Mp_adaptive"]) + nc.mean() * c["offset_thres"]) + math.ceil(c["m_embedded"] / 2)


def sf(x, bounds, c, seed):
    if (nc := c.get("curve")) is not None:  # of a long track, made by many tasks
        b = ends(curve_peaks(nc, c), len(x))
        return b, no_labels(b)
    f, n, m = N.normalise(x, c["bound_norm_feats"]), len(x), c["m_embedded"]
    found = []
    if n > 20:
        whole, rest = int(m), int((m % 1) * f.shape[1])
        last = n - math.ceil(m)
        e = np.concatenate([f[k : last + k] for k in range(whole)] + [f[whole : last + whole, :rest]], axis=1)
        lag = N.to_lag(N.recurrence(e, int(c["k_nearest"] * n), 1))
        features = N.gaussian_filter(N.gaussian_filter(lag.T, c["M_gaussian"] / 2).T, 0.5).T
        found = curve_peaks(np.append(np.linalg.norm(np.diff(features, axis=0), axis=1), 0), c)
    b = ends(found, n)
    return b, no_labels(b)


def autosimilarity(x, kind: str) -> np.ndarray:
    def unit(a):
        norm = np.linalg.norm(a, axis=1)
        return np.where(norm[:, None] == 0, 1e-10, a / np.where(norm == 0, 1, norm)[:, None])

    if kind == "cosine":
        return unit(x) @ unit(x).T
    if kind in ("covariance", "autocorrelation"):
        y = unit(x - x.mean(axis=0))
        return y @ y.T
    d = N.euclidean(unit(x), unit(x))
    off = d[~np.eye(len(d), dtype=bool)]
    return np.exp(-(d**2) / (2 * off.std()))


def penalty(n: int, kind: str) -> float:
    if kind.startswith("target_deviation_8"):
        return abs(n - 8) ** {"half": 0.5, "one": 1.0, "two": 2.0}[kind.rpartition("_")[2]]
    special = {"modulo8": {8: 0.0}, "modulo4": {}, "modulo8modulo4": {8: 0.0, 4: 0.25}}[kind]
    if n in special:
        return special[n]
    if n % 4 == 0 and kind != "modulo8modulo4":
        return 0.25 if kind == "modulo8" else 0.0
    return 0.5 if n % 2 == 0 else 1.0


def cbm(x, bounds, c, seed):
    s, n, longest, bands = autosimilarity(x, c["ssm"]), len(x), c["max_size"], c["bands_number"]
    band = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    s = np.where((band > 0) & (band <= (bands if bands is not None else n)), s, 0.0)
    corner = np.zeros((n + 1, n + 1))
    corner[1:, 1:] = s.cumsum(axis=0).cumsum(axis=1)
    score = lambda a, b: (corner[b, b] - corner[a, b] - corner[b, a] + corner[a, a]) / (b - a) ** 2
    top = max([0.0, *(score(i - 8, i) for i in range(8, n))])
    best, origin = [0.0], [0]
    for end in range(1, n):
        options = [(best[end - p] + score(end - p, end) * p - penalty(p, c["penalty_func"]) * c["penalty_weight"] * top, p) for p in range(1, min(end, longest) + 1) if p >= c.get("min_size", 1) or p == end]
        value, p = max(options)
        best.append(value)
        origin.append(end - p)
    b = [n - 1]
    while b[0] > 0:
        b.insert(0, origin[b[0]])
    b = ends(b, n)
    return b, no_labels(b)


def runs(labels: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(labels)) + 1


def frame_labels(x, rank, size, steps, seed) -> np.ndarray:
    _, h = N.convex_nmf(x.T, rank, steps, seed)
    return N.median_filter(h.argmax(axis=0) + 1, size)


def cnmf(x, bounds, c, seed):
    n = len(x)
    if n < c["h"]:
        b = ends([], n)
        return b, np.zeros(len(b) - 1, int)
    f = N.median_filter(N.normalise(x, c["norm_feats"]), c["h"])
    if bounds is None:
        rank = c["rank"]
        while True:
            found = runs(frame_labels(f, rank, c["R"], c["niters"], seed))
            # a rank beyond the frames can't find more
            if len(found) > 2 or rank >= n:
                break
            rank += 1
        bounds = ends(found, n)
    labels = frame_labels(f, c["rank_labels"], c["R_labels"], c["niters"], seed)
    return bounds, np.array([np.bincount(labels[a:b]).argmax() if b > a else labels.max() + 1 for a, b in zip(bounds[:-1], bounds[1:])])


def fourier_magnitudes(x, bounds, offset: int) -> np.ndarray:
    """2-D Fourier magnitudes of the segments, padded to the longest; the first half and one more, shifted."""
    parts = [x[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    longest, out = max(map(len, parts)), []
    for p in parts:
        z = np.zeros((longest, x.shape[1]))
        cut = p if len(p) <= offset or offset == 0 else p[offset // 2 : len(p) - offset // 2]
        z[: len(cut)] = cut
        m = np.fft.fftshift(np.abs(np.fft.fft2(z))).ravel()
        out.append(m[: z.size // 2 + 1])
    return np.array(out)


def bic(x, centres, labels, k) -> float:
    """Bayesian information criterion of a clustering of whitened rows."""
    r, m = x.shape
    if r == k:
        return 1.0
    variance = max(np.linalg.norm(x - centres[labels], axis=1).sum() / (r - k), 1e-12)
    likelihood = -r / 2 * math.log(2 * math.pi) - r * m / 2 * math.log(variance) - (r - k) / 2
    return likelihood - ((k - 1) + m * k + variance) / 2 * math.log(r)


def white(x) -> np.ndarray:
    s = x.std(axis=0)
    return x / np.where(s == 0, 1, s)


def knee_k(x, threshold: float = 0.015, most: int = 12, seed: int = 0) -> int:
    """The number of clusters at the knee of the BIC of a sweep."""
    w = white(x)
    counts = np.arange(1, max(2, min(most, len(x))))
    scores = np.array([bic(w, *N.kmeans(w, k, restarts=100, seed=seed), k) for k in counts])
    if len(scores) == 1:
        return 2
    growth = np.diff(scores)
    growth -= growth.min()
    return next((int(k) for k, g in zip(counts[:-1], growth) if g < threshold and k != 1), int(counts[-1]))


def split_k(x, threshold: float = 0.2, most: int = 10, first: int = 2, seed: int = 0) -> int:
    """The number of clusters when clusters are halved as long as the BIC differs enough."""
    k = first
    _, labels = N.kmeans(white(x), k, restarts=100, seed=seed)
    while k < most:
        centres = []
        for c in range(labels.max() + 1):
            own = x[labels == c]
            if len(own) < 2:
                centres += list(own)
                continue
            spread = np.where(own.std(axis=0) == 0, 1, own.std(axis=0))
            w = own / spread
            one, two = bic(w, w.mean(axis=0)[None], np.zeros(len(w), int), 1), bic(w, *N.kmeans(w, 2, restarts=100, seed=seed), 2)
            top = max(abs(one), abs(two)) or 1
            centres += [h * spread for h in N.kmeans(w, 2, restarts=100, seed=seed)[0]] if abs(one - two) / top > threshold else [own.mean(axis=0)]
        if len(centres) <= k:
            return k
        k = min(len(centres), most)
        labels = N.euclidean(x, np.array(centres)).argmin(axis=1)
    return k


def fmc2d(x, bounds, c, seed):
    bounds = ends([], len(x)) if bounds is None else bounds
    m = fourier_magnitudes(N.normalise(x, c["label_norm_feats"], c["label_norm_floor"], c["label_norm_min_db"]), bounds, c["offset"])
    k = knee_k(m, 0.01, 8, seed) if c["xmeans"] else c["k"]
    w = white(np.log1p(m[:, m.shape[1] // 2 :]))
    return bounds, N.kmeans(w, min(k, len(w)), restarts=c.get("fmc2d_restarts", 100), seed=seed)[1]


def spectral_levels(vectors, layers, bounds, seed, by_segment: bool, restarts: int):
    norm = np.sqrt(np.cumsum(vectors**2, axis=1))
    out = []
    for k in layers:
        k = min(k, vectors.shape[1])
        e = vectors[:, :k] / (norm[:, k - 1 : k] + 1e-5)
        _, labels = N.kmeans(e, k, restarts=restarts, seed=seed)
        b = ends(runs(labels), len(e)) if bounds is None else bounds
        if by_segment:
            means = np.array([e[a : max(z, a + 1)].mean(axis=0) for a, z in zip(b[:-1], b[1:])])
            own = N.kmeans(means, min(k, len(means)), restarts=restarts, seed=seed)[1]
        else:
            own = labels[b[:-1]]
        out.append((b, own))
    return out


def scluster(x, bounds, c, seed, second=None):
    """Laplacian clustering: x carries repetition, second (x itself if absent) the local path."""
    y = x if second is None else second
    rec = N.diagonal_median(N.recurrence(x, None, c["rec_width"], "cosine", True, True), c["rec_smooth"])
    step = (np.diff(y, axis=0) ** 2).sum(axis=1)
    path = np.exp(-step / (np.median(step) or 1.0))
    p = np.diag(path, 1) + np.diag(path, -1)
    dp, dr = p.sum(axis=1), rec.sum(axis=1)
    mu = dp @ (dp + dr) / ((dp + dr) ** 2).sum()
    a = mu * rec + (1 - mu) * p
    d = a.sum(axis=1)
    scale = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
    lap = np.diag((d > 0).astype(float)) - scale[:, None] * a * scale[None]
    _, vectors = np.linalg.eigh((lap + lap.T) / 2)
    vectors = N.median_filter(vectors, c["evec_smooth"])
    layers = range(1, c["num_layers"] + 1) if c.get("hier") else [c["scluster_k"]]
    levels = spectral_levels(vectors, layers, bounds, seed, False, c.get("scluster_restarts", 50))
    return levels if c.get("hier") else levels[0]


def factor_oracle(d: list[list[float]], threshold: float) -> tuple[list[int], list[int]]:
    """Suffix links and longest repeated suffixes of the variable Markov oracle from the frames' distances; states 0..n, frames match within threshold."""
    n = len(d)
    moves: list[list[int]] = [[] for _ in range(n + 1)]
    link, lrs = [-1] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        own = d[i - 1]
        moves[i - 1].append(i)
        k, before = link[i - 1], i - 1
        found = -1
        while k > -1:
            near = [s for s in moves[k] if own[s - 1] <= threshold]
            if near:
                found = min(near, key=lambda s: own[s - 1])
                break
            moves[k].append(i)
            before, k = k, link[k]
        if k == -1:
            link[i] = 0
        else:
            link[i] = found
            a, b = before, found - 1
            # the longest suffix that both sides share
            if b == link[a]:
                lrs[i] = lrs[a] + 1
            else:
                while b > 0 and link[b] != link[a] and link[b] > 0:
                    b = link[b]
                lrs[i] = min(lrs[a], lrs[b]) + 1
    return link, lrs


def information_rate(lrs: list[int], bits: list[float]) -> float:
    """Mean gain of coding by repeats over coding each frame as new; bits: log2 of 1, 2, ... as far as there are frames."""
    gains, run, new = np.zeros(len(lrs) - 1), 1, 0
    for i in range(len(lrs) - 1):
        repeat = lrs[i + 1]
        run = run + 1 if i and repeat > lrs[i] else 1
        new += not repeat
        if repeat:
            gains[i] = bits[max(new, 1) - 1] - bits[i] / run
    return float(np.maximum(gains, 0).sum())


def vmo(x, bounds, c, seed):
    top = np.abs(x).max(axis=0)
    y = x / np.where(top == 0, 1, top)
    y = np.concatenate([y, np.vstack([np.zeros((1, y.shape[1])), y[:-1]])], axis=1)
    d = N.euclidean(y, y)
    # every share of the greatest distance, in even steps
    grid = np.arange(c.get("vmo_thresholds", 100)) / c.get("vmo_thresholds", 100) * (d.max() or 1.0)
    n, rows = len(y), d.T.tolist()
    bits = [math.log2(i) for i in range(1, n + 1)]
    threshold = max(grid.tolist(), key=lambda t: (information_rate(factor_oracle(rows, t)[1], bits), -t))
    link, lrs = factor_oracle(rows, threshold)
    m = np.zeros((n, n))
    for i in range(1, n + 1):
        j = link[i]
        # every state of the chain of suffixes is like this one
        while j > 0:
            m[i - 1, j - 1] = m[j - 1, i - 1] = max(m[i - 1, j - 1], float(lrs[i]) if c["connectivity"] == "lrs" else 1.0)
            j = link[j]
    m = N.diagonal_median(m, c["median_filter_width"])
    i = np.arange(n - 1)
    m[i, i + 1] = m[i + 1, i] = 1.0
    np.fill_diagonal(m, 0)
    _, vectors = np.linalg.eigh((m + m.T) / 2)
    vectors = N.median_filter(vectors[:, : c["hier_num_layers"]], 5)
    layers = range(1, min(c["hier_num_layers"], n) + 1) if c.get("hier") else [c["vmo_k"]]
    levels = spectral_levels(vectors, layers, bounds, seed, True, c.get("vmo_restarts", 50))
    return levels if c.get("hier") else levels[0]


def latent_repetition(x, width: int = 3, size: int = 7, keep: int = 32) -> np.ndarray:
    """Repetition of stacked frames, filtered along lags, in a few eigen directions: frames x keep."""
    z = np.concatenate([x, np.vstack([np.zeros((1, x.shape[1])), x[:-1]])], axis=1)
    r = N.recurrence(z, 2 * math.ceil(math.sqrt(len(z))), width, "euclidean", False)
    lag = N.median_filter(N.to_lag(r).T, size, "zero").T
    lag = lag[lag.any(axis=1)]
    if not len(lag):
        return np.zeros((len(x), keep))
    c = lag @ lag.T
    values, vectors = np.linalg.eigh(c)
    top = vectors[:, np.argsort(values)[::-1][:keep]].T @ lag
    out = np.zeros((keep, len(x)))
    out[: len(top)] = top
    out += out.min()
    return (out / out.max() if out.max() else out).T


def olda_features(x, second, ts) -> np.ndarray:
    low = x + (x.min() + 0.1)
    low = 80 * np.log10(np.maximum(low / np.maximum(low.max(axis=1), 1e-9)[:, None], 1e-9))
    n, t = len(x), np.asarray(ts, float)
    dur = max(t[-1], 1e-9)
    return np.column_stack([second, low, latent_repetition(second), latent_repetition(low), t, t / dur, np.arange(n), np.arange(n) / n])


def segment_cost(x, bounds) -> float:
    d, n, total = x.shape[1], len(x), 0.0
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= 2:
            total += -0.5 * d * (b - a) * math.log(2 * math.pi) - 0.5 * (b - a - 1) * x[a:b].var(axis=0, ddof=1).sum()
    return -2 * total / n + 2 * d * (len(bounds) - 1)


def olda(x, bounds, c, seed, second=None, ts=None):
    """Ward on adjacent frames of transformed features; the fewest segments before the cost rises again."""
    y = x if second is None else second
    t = np.arange(len(x), dtype=float) if ts is None else np.asarray(ts, float) - ts[0]
    f = olda_features(x, y, t)
    w = np.eye(f.shape[1]) if c.get("transform") is None else np.asarray(c["transform"])
    z = f @ w.T
    least, most = max(1, int(t[-1] // 45)), max(2, math.ceil(t[-1] / 10))
    most = min(most, len(x) - 1)
    least = min(least, most)
    runs_of = N.adjacent_wards(z, least)
    if c.get("hier"):
        return [(b, no_labels(b)) for b in (ends(runs_of[k], len(x)) for k in range(least, most + 1))]
    best, found = np.inf, ends([], len(x))
    for k in range(most, least, -1):
        b = ends(runs_of[k], len(x))
        cost = segment_cost(z, b)
        if cost >= best:
            break
        best, found = cost, b
    return found, no_labels(found)


def scatter(x, bounds) -> tuple[np.ndarray, np.ndarray]:
    """Ordinal and within-segment scatter sums of one track; they add up over tracks."""
    d = x.shape[1]
    ordinal, within, before = np.zeros((d, d)), np.zeros((d, d)), None
    for a, b in zip(bounds[:-1], bounds[1:]):
        n = b - a
        if n < 2:
            continue
        mean = x[a:b].mean(axis=0)
        within += n * np.cov(x[a:b].T).reshape(d, d)
        if before is not None:
            m, k = before
            joint = (k * m + n * mean) / (k + n)
            ordinal += n * np.outer(mean - joint, mean - joint) + k * np.outer(m - joint, m - joint)
        before = mean, n
    return ordinal, within


def fit_olda(ordinal, within, sigma: float = 1e-4) -> np.ndarray:
    """Rows are the generalised eigenvectors of ordinal against regularised within scatter."""
    w = np.linalg.cholesky(within + sigma * np.eye(len(within)))
    inner = np.linalg.solve(w, np.linalg.solve(w, ordinal).T)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    return np.linalg.solve(w.T, vectors[:, np.argsort(values)[::-1]]).T


def segment_numbers(levels: list[np.ndarray], n: int, step: float) -> np.ndarray:
    """The number of the segment of every sample time in every level; levels are boundary times, coarse first."""
    t = np.arange(n) * step
    return np.array([np.searchsorted(b, t + 1e-9, "right") for b in levels])


def meeting_depths(seg: np.ndarray) -> np.ndarray:
    """Depth of the deepest level where two places are in one segment."""
    out = np.zeros((seg.shape[1], seg.shape[1]), int)
    for depth, s in enumerate(seg, 1):
        out[s[:, None] == s[None]] = depth
    return out


def depths_about(ref: np.ndarray, est: np.ndarray, window: int) -> np.ndarray:
    """counts[q, r, e]: of the samples at most window from q, without q, those that meet q at depth r of one side and e of the other.

    Both sides are the segments' numbers. Neighbours that are in one segment at every level meet others alike, so stretches of them are
    compared, and each counts as often as the window holds its samples: no matrix of all pairs of samples is made.
    """
    both = np.concatenate([ref, est])
    n = both.shape[1]
    first = np.flatnonzero(np.r_[True, (both[:, 1:] != both[:, :-1]).any(axis=0)])
    after, q = np.r_[first[1:], n], np.arange(n)
    held = np.maximum(0, np.minimum(after, q[:, None] + window + 1) - np.maximum(first, q[:, None] - window)).astype(float)
    held[q, np.searchsorted(first, q, "right") - 1] -= 1
    rows, columns = len(ref) + 1, len(est) + 1
    kind = meeting_depths(ref[:, first]) * columns + meeting_depths(est[:, first])
    marks = (kind[:, :, None] == np.arange(rows * columns)).astype(float)
    return np.concatenate([held[a:b] @ m for a, b, m in zip(first, after, marks)]).reshape(n, rows, columns)


def t_recall(counts: np.ndarray, transitive: bool = False) -> float:
    """Mean over query frames of the share of reference-ordered pairs in the window that the estimate orders too; counts of depths_about."""
    size = counts.sum(axis=2)
    if transitive:
        lower, fewer = np.cumsum(counts, axis=1) - counts, np.cumsum(size, axis=1) - size
    else:
        # the next lower depth that comes up in the window
        last = np.maximum.accumulate(np.where(size > 0, np.arange(size.shape[1]), -1), axis=1)
        last = np.concatenate([np.full((len(last), 1), -1), last[:, :-1]], axis=1)
        at = np.arange(len(last))[:, None], np.maximum(last, 0)
        lower, fewer = np.where(last[:, :, None] >= 0, counts[at], 0), np.where(last >= 0, size[at], 0)
    pairs = (size * fewer).sum(axis=1)
    right = (counts * (np.cumsum(lower, axis=2) - lower)).sum(axis=(1, 2))
    return float(np.mean(right[pairs > 0] / pairs[pairs > 0])) if (pairs > 0).any() else 0.0


def t_measures(ref_levels, est_levels, window: float, step: float = 0.1) -> tuple[float, float, float]:
    """(precision, recall, measure)."""
    n = int(round(min(ref_levels[0][-1], est_levels[0][-1]) / step))
    if n < 1:
        return 0.0, 0.0, 0.0
    counts = depths_about(segment_numbers(ref_levels, n, step), segment_numbers(est_levels, n, step), int(round(window / step)))
    recall, precision = t_recall(counts), t_recall(counts.transpose(0, 2, 1))
    return precision, recall, 2 * precision * recall / (precision + recall) if precision + recall else 0.0
