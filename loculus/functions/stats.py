"""Distributions and small statistics that Spark lacks: NumPy on Arrow batches, and window forms where they do."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import zlib
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: Coefficients of the Lanczos approximation of the gamma function for g = 7 and nine terms.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of gamma for x >= 1."""
    z = np.asarray(x, float) - 1
    s = np.full_like(z, LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        s = s + c / (z + i)
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * np.log(t) - t + np.log(s)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz). A row is left out once it has converged, so its value does
    not depend on the others."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h, out, left = d.copy(), np.empty_like(x), np.arange(len(x))
    for m in range(1, 2000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + t / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        more = np.abs(d * c - 1) >= 1e-15
        if not more.all():
            out[left[~more]] = h[~more]
            left, a, b, x, c, d, h = (v[more] for v in (left, a, b, x, c, d, h))
            if not len(left):
                break
    out[left] = h
    return out


def binomial_tail(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X >= k) for X of n trials of chance p."""
    k, n, p = (np.asarray(v, float) for v in (k, n, p))
    out = np.where(k <= 0, 1.0, 0.0)
    out = np.where((k > 0) & (k <= n) & (p >= 1), 1.0, out)
    todo = (k > 0) & (k <= n) & (p > 0) & (p < 1)
    if todo.any():
        a, b, x = k[todo], n[todo] - k[todo] + 1, p[todo]
        front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x))
        low = x < (a + 1) / (a + b + 2)
        first, second, at = np.where(low, a, b), np.where(low, b, a), np.where(low, x, 1 - x)
        value = front * _beta_fraction(first, second, at) / first
        out[todo] = np.clip(np.where(low, value, 1 - value), 0, 1)
    return out


@pandas_udf(DoubleType())
def binomial_tail_udf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(binomial_tail(k.to_numpy(), n.to_numpy(), p.to_numpy()))


def hypergeometric_tail(k: np.ndarray, total: np.ndarray, good: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """P(X >= k) of good ones among drawn from total with good."""
    choose = lambda n, r: lgamma(n + 1) - lgamma(r + 1) - lgamma(n - r + 1)
    out = np.zeros(len(k))
    for i, (a, t, g, d) in enumerate(zip(*(np.asarray(v, int) for v in (k, total, good, drawn)), strict=True)):
        x = np.arange(max(a, 0, d + g - t), min(g, d) + 1)
        if a <= max(0, d + g - t):
            out[i] = 1.0
        elif len(x):
            out[i] = min(1.0, float(np.exp(choose(g + 0 * x, x) + choose(t - g + 0 * x, d - x) - choose(np.array([t]), np.array([d]))).sum()))
    return out


@pandas_udf(DoubleType())
def hypergeometric_tail_udf(k: pd.Series, total: pd.Series, good: pd.Series, drawn: pd.Series) -> pd.Series:
    return pd.Series(hypergeometric_tail(k.to_numpy(), total.to_numpy(), good.to_numpy(), drawn.to_numpy()))


def log_choose(n, r) -> np.ndarray:
    """Logarithm of the binomial coefficient; minus infinity where it is 0."""
    n, r = np.broadcast_arrays(np.asarray(n, float), np.asarray(r, float))
    ok = (r >= 0) & (r <= n)
    safe = lambda v: np.where(ok, v, 0.0) + 1
    return np.where(ok, lgamma(safe(n)) - lgamma(safe(r)) - lgamma(safe(n - r)), -np.inf)


def conditional_tail(gamma: int, lam: int, alpha: int, m: int, n1: int, n2: int, total: int) -> float:
    """P(at least lam of the n2 colocalized cells are of the type, given that alpha of them express the gene most).

    Cells fall into four classes by type (m of them) and by expression (n1, of which gamma are of the type). Given alpha, the
    colocalized cells of the type are a sum of two independent hypergeometric numbers: those among the alpha that express the
    gene, and those among the other n2 - alpha. So the chance is a tail of a convolution of two distributions.
    """
    high = np.arange(0, alpha + 1)
    low = np.arange(0, n2 - alpha + 1)
    of_high = np.exp(log_choose(gamma, high) + log_choose(n1 - gamma, alpha - high) - log_choose(n1, alpha))
    of_low = np.exp(log_choose(m - gamma, low) + log_choose(total - m - n1 + gamma, n2 - alpha - low) - log_choose(total - n1, n2 - alpha))
    return float(min(1.0, np.convolve(of_high, of_low)[max(lam, 0) :].sum()))


#: Trials whose product is worked out term by term before products are joined by transforms; states kept beside the mean.
LEAF, DEVIATIONS = 64, 14


def tilted(p: np.ndarray, tilt: float) -> tuple[np.ndarray, float]:
    """Chances p e^t / (1 - p + p e^t), and the sum of the logarithms of what they were divided by."""
    p = np.asarray(p, float)
    with np.errstate(divide="ignore"):
        up, down = np.log(p) + tilt, np.log1p(-p)
    log_sum = np.logaddexp(up, down)
    return np.exp(up - log_sum), float(log_sum.sum())


def trial_sum(q: np.ndarray) -> tuple[int, np.ndarray]:
    """(first state, chances of it and the next ones) of the sum of independent trials: a product tree of (1 - q + q x).

    States DEVIATIONS from the mean and farther are left out; their chances are below any double's precision beside the others'.
    Products are joined by fast transforms, whose error is small beside the largest chance, so only states that are not rare
    should be looked at; ``tilted`` makes any state such.
    """
    q = np.asarray(q, float)
    n = len(q)
    if not n:
        return 0, np.ones(1)
    blocks = -(-n // LEAF)
    padded = np.zeros(blocks * LEAF)
    padded[:n] = q
    trials = padded.reshape(blocks, LEAF)
    level = np.zeros((blocks, LEAF + 1))
    level[:, 0] = 1.0
    for k in range(LEAF):
        t = trials[:, k : k + 1]
        level[:, 1 : k + 2] = level[:, 1 : k + 2] * (1 - t) + level[:, : k + 1] * t
        level[:, 0] *= 1 - t[:, 0]
    while len(level) > 1:
        if len(level) % 2:
            one = np.zeros((1, level.shape[1]))
            one[0, 0] = 1.0
            level = np.vstack([level, one])
        size = 2 * level.shape[1] - 1
        wide = 1 << (size - 1).bit_length()
        f = np.fft.rfft(level, wide, axis=1)
        level = np.maximum(np.fft.irfft(f[0::2] * f[1::2], wide, axis=1)[:, :size], 0.0)
    return trimmed_states(0, level[0][: n + 1], float(q.sum()), float((q * (1 - q)).sum()))


def trimmed_states(first: int, pmf: np.ndarray, mean: float, variance: float) -> tuple[int, np.ndarray]:
    reach = DEVIATIONS * math.sqrt(max(variance, 0.0)) + 32
    lo, hi = max(0, math.floor(mean - reach) - first), max(1, math.ceil(mean + reach) - first + 1)
    return first + lo, pmf[lo:hi]


def joined_states(parts: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
    """The sum of independent numbers that are given by their states, smaller ones first."""
    parts = sorted(parts, key=lambda x: len(x[1]))
    first, pmf = parts[0]
    for f, other in parts[1:]:
        size = len(pmf) + len(other) - 1
        wide = 1 << (size - 1).bit_length()
        joined = np.fft.irfft(np.fft.rfft(pmf, wide) * np.fft.rfft(other, wide), wide)[:size] if min(len(pmf), len(other)) > 64 else np.convolve(pmf, other)
        first, pmf = first + f, np.maximum(joined, 0.0)
    return first, pmf


def log_odds(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(p) - np.log1p(-p)


def tilt_for(k: int, odds: np.ndarray, count: np.ndarray) -> float:
    """The tilt, 0 at least, under which trials of these log-odds (so many each) have the mean k; it need not be exact."""
    use = np.isfinite(odds)
    odds, count, k = odds[use], count[use], k - float(count[odds == np.inf].sum())
    n = float(count.sum())
    if not len(odds) or k <= 0:
        return 0.0
    goal = min(k, n - 0.5)
    mean = lambda t: float((count / (1 + np.exp(-np.clip(odds + t, -700, 700)))).sum())
    if mean(0.0) >= goal:
        return 0.0
    lo, hi = 0.0, 1.0
    while mean(hi) < goal and hi < 1400:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean(mid) < goal else (lo, mid)
    return (lo + hi) / 2


def tilted_tail(k: int, first: int, pmf: np.ndarray, tilt: float, log_sum: float) -> float:
    """P(X >= k) from the states of the tilted sum."""
    j = np.arange(first, first + len(pmf))
    use = j >= k
    if not use.any():
        return 0.0
    inner = float((pmf[use] * np.exp(-tilt * (j[use] - k)))[::-1].sum())
    return min(1.0, math.exp(log_sum - tilt * k + math.log(inner))) if inner > 0 else 0.0


def poisson_binomial_tail(p: np.ndarray, k: int) -> float:
    """P(X >= k) for the sum of independent trials, with a small relative error however small it is.

    The trials are tilted until k is their mean, the states around it come from a product tree, and the tilt is taken back.
    """
    p = np.asarray(p, float)
    if k <= 0:
        return 1.0
    if k > np.count_nonzero(p):
        return 0.0
    if k == len(p):
        return float(np.exp(np.log(p).sum()))
    t = tilt_for(k, log_odds(p), np.ones(len(p)))
    q, log_sum = tilted(p, t)
    return tilted_tail(k, *trial_sum(q), t, log_sum)


@pandas_udf(DoubleType())
def two_sided_normal(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2)))


def benjamini_hochberg(df: DataFrame, p: str, ties: list[str], out: str = "p_adjusted") -> DataFrame:
    """Adjusted p-values over the whole table, which is one of genes or pairs, not of points."""
    order = Window.orderBy(F.col(p), *ties)
    ranked = df.withColumns({"_k": F.row_number().over(order), "_m": F.count("*").over(Window.partitionBy(F.lit(0)))})
    later = order.rowsBetween(0, Window.unboundedFollowing)
    return ranked.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_k")).over(later))).drop("_k", "_m")


def neglog10(p: Column) -> Column:
    """-log10 of a p-value, 300 where it is 0."""
    return F.when(p > 0, -F.log10(p)).otherwise(F.when(p.isNotNull(), F.lit(300.0)))


def stable_seed(text: str) -> int:
    return zlib.crc32(text.encode())


def pair_distances(u: np.ndarray, v: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((u - v) ** 2).sum(axis=-1))


def pair_angles(u: np.ndarray, v: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Angles at the centre."""
    u, v = u - centre, v - centre
    n = np.sqrt((u**2).sum(axis=-1) * (v**2).sum(axis=-1))
    return np.arccos(np.clip((u * v).sum(axis=-1) / np.where(n == 0, 1, n), -1, 1))


def _pairs(n: int, pairs: tuple[int, ...] | int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of different numbers below n."""
    a = rng.integers(0, n, pairs)
    return a, (a + rng.integers(1, n, pairs)) % n


def observed_pairs(k: int, pairs: int, seed: tuple[int, ...]) -> np.ndarray:
    """(pairs, 2) random pairs of a gene's k points, by their numbers."""
    return np.stack(_pairs(k, pairs, np.random.default_rng([*seed, 1])), axis=1)


def null_pairs(n: int, k: int, iterations: int, pairs: int, seed: tuple[int, ...]) -> np.ndarray:
    """(iterations, pairs, 2) points of n: random pairs out of a random set of k points without repeats, each time anew.

    No more of a set is drawn than its pairs need, so the work does not depend on n or k: pairs are drawn among k labels, and
    each different label gets a point that no other one has.
    """
    rng = np.random.default_rng([*seed, 0])
    a, b = _pairs(k, (iterations, pairs), rng)
    labels = np.stack([a, b], axis=2).reshape(iterations, 2 * pairs)
    points = rng.integers(0, n, labels.shape)
    for s in range(1, 2 * pairs):
        points[:, s] = rng.integers(0, n, iterations)
        same = labels[:, :s] == labels[:, s : s + 1]
        old = same.any(axis=1)
        points[old, s] = points[old, same[old].argmax(axis=1)]
        again = np.flatnonzero(~old & (points[:, :s] == points[:, s : s + 1]).any(axis=1))
        while len(again):
            points[again, s] = rng.integers(0, n, len(again))
            again = again[(points[again, :s] == points[again, s : s + 1]).any(axis=1)]
    return points.reshape(iterations, pairs, 2)


def median_score_variance(m: int, n: int) -> float | None:
    """Variance of (E - median) / (E - 1) for the median of m ranks drawn from 1..n, E = (n + 1) / 2; exact."""
    if n < 2 or m < 1 or m > n:
        return None
    e, total = (n + 1) / 2, math.comb(n, m)
    out = 0.0
    if m % 2:
        h = m // 2
        for r in range(h + 1, n - h + 1):
            out += math.comb(r - 1, h) * math.comb(n - r, h) / total * ((e - r) / (e - 1)) ** 2
    else:
        h = m // 2
        for a in range(h, n - h + 1):
            left = math.comb(a - 1, h - 1)
            for b in range(a + 1, n - h + 2):
                out += left * math.comb(n - b, h - 1) / total * ((e - (a + b) / 2) / (e - 1)) ** 2
    return out


def median_p_value(m: int, n: int, median: float) -> float | None:
    """Two-sided exact chance that the median of m ranks drawn from 1..n lies at least as far from its mean; 1 at most.

    The distribution is symmetric, so this is twice P(median <= s) for the lower s of the two. For odd m that says that more than
    half of the draws are among the first s ranks. For even m it is a sum over the lower middle rank a: the upper one may be
    any of a + 1..2 s - a, and the chances of these telescope to a difference of two binomial coefficients.
    """
    if n < 1 or m < 1 or m > n:
        return None
    s, h = min(float(median), n + 1 - float(median)), m // 2
    if m % 2:
        low = float(hypergeometric_tail(np.array([h + 1]), np.array([n]), np.array([math.floor(s)]), np.array([m]))[0]) if s >= h + 1 else 0.0
    else:
        both = math.floor(2 * s)
        a = np.arange(h, (both - 1) // 2 + 1)
        first = log_choose(a - 1, h - 1) - log_choose(n, m)
        low = float((np.exp(first + log_choose(n - a, h)) - np.exp(first + log_choose(n - (both - a), h))).sum()) if len(a) else 0.0
    return min(1.0, 2 * low)


def ranks(v: np.ndarray) -> np.ndarray:
    """Mean ranks."""
    return pd.Series(v).rank().to_numpy()


def ripley_summary(n: float, area: float, span: float, hist: dict, quarter: float) -> tuple:
    """Features of H from counts of pairs by the first radius that they lie below."""
    k = int(span / 2)
    if n < 2 or k < 1:
        return (None,) * 5
    radii = np.linspace(1, span / 2, k)
    below = np.zeros(k)
    for i, c in hist.items():
        if i is not None and i < k:
            below[int(i)] += c
    h = np.sqrt(2 * area * np.cumsum(below) / (n * (n - 1)) / math.pi) - radii
    smooth = pd.Series(h).rolling(5).mean().dropna().to_numpy()
    slope = np.gradient(smooth) if len(smooth) > 1 else np.zeros(2)
    a, b = ranks(radii), ranks(h)
    rho = float(np.corrcoef(a, b)[0, 1]) if k > 1 and a.std() and b.std() else None
    half = math.sqrt(2 * area * quarter / (n * (n - 1)) / math.pi) - span / 4
    return float(h.max()), float(slope.max()), float(slope.min()), rho, half
