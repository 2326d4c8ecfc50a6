"""The distance model: likelihood of Hamming histograms, its derivatives, and the Gamma null.

For k-mers of length k hashed on h positions, subsampled at rate rho and matched up to hdist differences, v[d] counts
matches at distance d and u misses. Everything here is numpy over arrays of rows; nothing touches Spark.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np

UPPER = 0.99
EPS = 1e-7
#: Rows that are fitted together.
ROWS = 4096


@dataclass(frozen=True)
class Model:
    k: int = 27
    h: int = 11
    rho: float = 1.0
    hdist: int = 4

    @cached_property
    def choose(self) -> np.ndarray:
        return np.array([math.comb(self.k, d) for d in range(self.k + 1)], float)

    @cached_property
    def elude(self) -> np.ndarray:
        """Ways to place d differences with at least one on a hashed position."""
        return np.array([math.comb(self.k, d) - math.comb(self.k - self.h, d) for d in range(self.k + 1)], float)

    @cached_property
    def miss_weights(self) -> np.ndarray:
        d = np.arange(self.k + 1)
        return np.where(d <= self.hdist, self.elude, self.choose)

    def miss(self, D: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(miss | in sketch) and its two derivatives."""
        D = np.clip(np.asarray(D, float), 1e-12, 1 - 1e-12)[..., None]
        d = np.arange(self.k + 1)
        f = self.miss_weights * D**d * (1 - D) ** (self.k - d)
        g = (d - self.k * D) / (D * (1 - D))
        g1 = (d * (2 * D - 1) - self.k * D * D) / (D * D * (1 - D) ** 2)
        return f.sum(-1), (f * g).sum(-1), (f * (g * g + g1)).sum(-1)

    def missed(self, D: np.ndarray) -> np.ndarray:
        """P(miss | in sketch) alone, by Horner's rule."""
        rest, w = 1 - D, self.miss_weights
        out, power = np.full(np.shape(D), w[-1]), rest
        for d in range(self.k - 1, -1, -1):
            out = out * D + w[d] * power
            power = power * rest
        return out

    def _totals(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hits, differences of all hits)."""
        each = range(self.hdist + 1)
        return sum(v[..., d] for d in each), sum(d * v[..., d] for d in each)

    def _nll(self, D: np.ndarray, hits: np.ndarray, differences: np.ndarray, u: np.ndarray) -> np.ndarray:
        D = np.clip(np.asarray(D, float), 1e-12, 1 - 1e-12)
        return -(hits * (self.k * np.log1p(-D)) + differences * np.log(D / (1 - D))) - u * np.log(self.rho * self.missed(D) + 1 - self.rho)

    def nll(self, D: np.ndarray, v: np.ndarray, u: np.ndarray) -> np.ndarray:
        return self._nll(D, *self._totals(v), u)

    @cached_property
    def _grid(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distances to begin with, and at each the log-likelihood of a hit, of a difference and of a miss."""
        grid = np.concatenate((np.geomspace(1e-7, 0.01, 30)[:-1], np.linspace(0.01, UPPER, 99)))
        return grid, self.k * np.log1p(-grid), np.log(grid / (1 - grid)), np.log(self.rho * self.missed(grid) + 1 - self.rho)

    def mle(self, v: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The distance in [0, UPPER] of least negative log-likelihood, by a grid and golden sections, for many rows at once. A
        row's distance does not depend on the rows beside it."""
        v, u = np.atleast_2d(np.asarray(v, float)), np.atleast_1d(np.asarray(u, float))
        parts = [self._mle(v[i : i + ROWS], u[i : i + ROWS]) for i in range(0, len(v), ROWS)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _mle(self, v: np.ndarray, u: np.ndarray) -> np.ndarray:
        hits, differences = self._totals(v)
        grid, hit, difference, miss = self._grid
        best = (hits[:, None] * hit + differences[:, None] * difference + u[:, None] * miss).argmax(1)
        a, b = grid[np.maximum(best - 1, 0)], grid[np.minimum(best + 1, len(grid) - 1)]
        a = np.where(best == 0, 0.0, a)
        ratio = (math.sqrt(5) - 1) / 2
        c, e = b - ratio * (b - a), a + ratio * (b - a)
        at_c, at_e = self._nll(c, hits, differences, u), self._nll(e, hits, differences, u)
        for _ in range(45):
            left = at_c < at_e
            a, b = np.where(left, a, c), np.where(left, e, b)
            new = np.where(left, b - ratio * (b - a), a + ratio * (b - a))
            value = self._nll(new, hits, differences, u)
            c, e, at_c, at_e = np.where(left, new, e), np.where(left, c, new), np.where(left, value, at_e), np.where(left, at_c, value)
        return (a + b) / 2

    def score(self, D: float) -> np.ndarray:
        """Derivative of the log-likelihood for a hit at 0..hdist differences, and for a miss (last)."""
        d = np.arange(self.hdist + 1)
        p, p1, _ = self.miss(D)
        return np.append((d - self.k * D) / (D * (1 - D)), self.rho * p1 / (1 - self.rho + self.rho * p))

    def curvature(self, D: float) -> np.ndarray:
        d = np.arange(self.hdist + 1)
        p, p1, p2 = self.miss(D)
        base = 1 - self.rho + self.rho * p
        return np.append((d * (2 * D - 1) - self.k * D * D) / (D * D * (1 - D) ** 2), (base * self.rho * p2 - (self.rho * p1) ** 2) / base**2)

    def fisher(self, D: float, v: np.ndarray, u: float) -> float:
        c = self.curvature(min(max(D, 1e-9), 1 - 1e-9))
        return float(-(np.asarray(v)[: self.hdist + 1] * c[:-1]).sum() - u * c[-1])

    def informations(self, D: np.ndarray, v: np.ndarray, u: np.ndarray) -> np.ndarray:
        """fisher of many rows."""
        D, out, d = np.clip(np.asarray(D, float), 1e-9, 1 - 1e-9), np.zeros(len(D)), np.arange(self.hdist + 1)
        for i in range(0, len(D), ROWS):
            x, at = D[i : i + ROWS, None], slice(i, i + ROWS)
            p, p1, p2 = self.miss(D[at])
            base = 1 - self.rho + self.rho * p
            out[at] = -(v[at, : self.hdist + 1] * ((d * (2 * x - 1) - self.k * x * x) / (x * x * (1 - x) ** 2))).sum(1) - u[at] * ((base * self.rho * p2 - (self.rho * p1) ** 2) / base**2)
        return out

    def probabilities(self, D: float, d: int) -> dict[str, float]:
        """Helper probabilities; `collide` is the share of placements that touch a hashed position, as the reference
        behaviour has it, although the likelihood treats these as misses."""
        elude = self.elude[d] / self.choose[d]
        mutate = self.choose[d] * D**d * (1 - D) ** (self.k - d)
        p = float(self.miss(D)[0])
        return {"collide": elude, "elude": 1 - elude, "mutate": mutate, "miss": 1 - self.rho + self.rho * p, "hit": self.rho * (1 - p)}


def valid_distance(d: np.ndarray) -> np.ndarray:
    d = np.asarray(d, float)
    return np.where(np.isnan(d) | (d >= 1 - EPS) | (d < 0), np.nan, d)


def gammainc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: a series for small x, a continued fraction beyond."""
    if not (a > 0 and x > 0):
        return 0.0
    head = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * head)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return max(0.0, 1 - h * head)


@dataclass(frozen=True)
class Gamma:
    shape: float = 1.0
    scale: float = 1.0

    def cdf(self, x: float) -> float:
        return gammainc(self.shape, x / self.scale) if x > 0 else 0.0

    def pdf(self, x: float) -> float:
        if x <= 0:
            return 0.0
        return math.exp((self.shape - 1) * math.log(x) - x / self.scale - math.lgamma(self.shape) - self.shape * math.log(self.scale))

    def median(self, low: float = 1e-5, high: float = 1 - 1e-5) -> float:
        """By 40 bisections within bounds; NaN if half the mass lies above."""
        if self.cdf(high) < 0.5:
            return math.nan
        for _ in range(40):
            mid = (low + high) / 2
            low, high = (mid, high) if self.cdf(mid) < 0.5 else (low, mid)
        return (low + high) / 2


def medians(laws: list[Gamma], low: float = 1e-5, high: float = 1 - 1e-5) -> list[float]:
    """Gamma.median of many laws, all bisected together."""
    shape, scale = (np.array([getattr(g, n) for g in laws], float) for n in ("shape", "scale"))
    below = lambda x: gamma_cdfs(shape, x / scale) < 0.5
    a, b = np.full(len(laws), low), np.full(len(laws), high)
    none = below(b)
    for _ in range(40):
        mid = (a + b) / 2
        less = below(mid)
        a, b = np.where(less, mid, a), np.where(less, b, mid)
    return np.where(none, np.nan, (a + b) / 2).tolist()


def quantiles(x: np.ndarray, q: tuple[float, ...] = (0.2, 0.4, 0.6)) -> np.ndarray:
    return np.quantile(np.asarray(x, float), q)  # linear between neighbours at q (n - 1)


def moments(x: np.ndarray) -> Gamma:
    mean, var = float(np.mean(x)), max(float(np.var(x)), 1e-6)
    return Gamma(max(mean * mean / var, 1e-2), max(var / mean, 1e-6)) if mean > 0 else Gamma()


def gamma_cdfs(shape: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function of arrays: series and continued fraction, as in gammainc."""
    shape, x = np.broadcast_arrays(np.asarray(shape, float), np.asarray(x, float))
    out, good = np.zeros(x.shape), (x > 0) & (shape > 0) & np.isfinite(x) & np.isfinite(shape)
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    low, high = good & (x < shape + 1), good & (x >= shape + 1)
    for part, of in ((low, _series), (high, _fraction)):
        if part.any():
            a, y = shape[part], x[part]
            out[part] = of(a, y, np.exp(-y + a * np.log(y) - log_gamma(a)))
    return out


def _series(a: np.ndarray, x: np.ndarray, head: np.ndarray) -> np.ndarray:
    term = 1 / a
    total, n = term.copy(), a.copy()
    while (np.abs(term) > np.abs(total) * 1e-15).any():
        n = n + 1
        term = term * x / n
        total = total + term
    return np.minimum(1.0, total * head)


def _fraction(a: np.ndarray, x: np.ndarray, head: np.ndarray) -> np.ndarray:
    b, c = x + 1 - a, np.full(len(x), 1e300)
    d = 1 / b
    h = d.copy()
    for i in range(1, 500):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(d == 0, 1e-300, d)
        c = b + an / c
        c = np.where(c == 0, 1e-300, c)
        h = h * d * c
        if (np.abs(d * c - 1) < 1e-14).all():
            break
    return np.maximum(0.0, 1 - h * head)


def fit_gammas(samples: list[np.ndarray], most: int = 200) -> list[Gamma]:
    """Quantile matching at 0.2, 0.4 and 0.6 by a simplex in the logs of shape and scale, from the moments; one simplex for
    each list of samples, all stepped together. No samples: shape and scale 1."""
    out, some = [Gamma()] * len(samples), [i for i, x in enumerate(samples) if len(x)]
    if not some:
        return out
    at, want = np.array([quantiles(samples[i]) for i in some]), np.array([0.2, 0.4, 0.6])
    start = [moments(np.asarray(samples[i], float)) for i in some]
    first = np.log([[g.shape, g.scale] for g in start])

    def loss(p: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return ((gamma_cdfs(np.exp(p[:, :1]), at[rows] / np.exp(p[:, 1:])) - want) ** 2).sum(1)

    every = np.arange(len(some))
    points = np.stack([first, first + [0.5, 0], first + [0, 0.5]], axis=1)  # a simplex a row
    values = np.stack([loss(points[:, j], every) for j in range(3)], axis=1)
    open_ = every
    for step in range(most):
        order = np.argsort(values[open_], axis=1, kind="stable")
        values[open_], points[open_] = np.take_along_axis(values[open_], order, 1), np.take_along_axis(points[open_], order[..., None], 1)
        if step > 5:
            flat = values[open_, 2] - values[open_, 0] < 1e-6
            near = np.abs(points[open_] - points[open_, :1]).max(axis=(1, 2)) < 1e-6
            open_ = open_[~(flat & near)]
        if not len(open_):
            break
        best, middle, worst = points[open_, 0], points[open_, :2].mean(1), points[open_, 2]
        v = values[open_]
        trial = middle + (middle - worst)
        of_trial = loss(trial, open_)
        grow = of_trial < v[:, 0]
        inner = ~grow & (of_trial >= v[:, 1])
        factor = np.where(grow, 2.0, np.where(of_trial < v[:, 2], 0.5, -0.5))
        other = middle + factor[:, None] * (middle - worst)
        of_other = np.where(grow | inner, loss(other, open_), np.inf)
        better = of_other < np.where(inner, np.minimum(of_trial, v[:, 2]), of_trial)
        shrink = inner & ~better
        take = np.where(((grow | inner) & better)[:, None], other, trial)
        of_take = np.where((grow | inner) & better, of_other, of_trial)
        keep = ~shrink
        points[open_[keep], 2], values[open_[keep], 2] = take[keep], of_take[keep]
        for j in (1, 2):
            rows = open_[shrink]
            if len(rows):
                points[rows, j] = best[shrink] + 0.5 * (points[rows, j] - best[shrink])
                values[rows, j] = loss(points[rows, j], rows)
    chosen = points[every, values.argmin(1)]
    for i, (shape, scale) in zip(some, np.exp(chosen), strict=True):
        out[i] = Gamma(float(shape), float(scale))
    return out


def fit_gamma(x: np.ndarray, most: int = 200) -> Gamma:
    return fit_gammas([np.asarray(x, float)], most)[0]


def score_samples(x: float, samples: np.ndarray, law: Gamma | None = None, median: float | None = None) -> tuple[float, float]:
    """(cumulative probability of x, median) under the Gamma law fitted to samples, both NaN if x or the fit is unusable; the
    median is NaN as well where half the mass lies above 1 - 1e-5 or it is not above EPS."""
    if not math.isfinite(x) or len(samples) < 8:
        return math.nan, math.nan
    law = law or fit_gamma(samples)
    if not (math.isfinite(law.shape) and math.isfinite(law.scale) and law.shape > 0 and law.scale > 0):
        return math.nan, math.nan
    median = law.median() if median is None else median
    return law.cdf(x), median if math.isfinite(median) and median > EPS else math.nan


def signs(thresholds: list[float]) -> tuple[int, int]:
    """Bits of the positive and of the negative thresholds, the first lowest."""
    positive = sum(1 << i for i, t in enumerate(thresholds) if t >= 0)
    return positive, (1 << len(thresholds)) - 1 - positive


def metropolis_hastings(start: float, density, seed: int = 0, keep: int = 20, burn_in: int = 100, step: float = 0.05) -> np.ndarray:
    """Draws from a density on (EPS, 1 - EPS) by reflected normal steps."""
    rng = np.random.default_rng(seed)
    out, x, p = [], start, density(start)
    for i in range(burn_in + keep):
        y = x + step * rng.standard_normal()
        y = abs(y - EPS) + EPS
        y = (1 - EPS) - abs((1 - EPS) - y)
        q = density(y)
        if q >= p or rng.random() * p < q:
            x, p = y, q
        if i >= burn_in:
            out.append(x)
    return np.array(out)
