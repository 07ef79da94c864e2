"""Dense work within one date: covariances as axes, and constrained mean-variance weights by two solvers, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axes:
    """A covariance of n names: base times the identity, and g more along each of the k orthonormal columns of v.

    k is at most the lesser of names and observations, so n * k numbers stand for n * n, and products, quadratic forms
    and inverses need no matrix of names by names.
    """

    base: float
    g: np.ndarray
    v: np.ndarray

    @staticmethod
    def of(s) -> Axes:
        """s itself, or the axes of a symmetric matrix."""
        if isinstance(s, Axes):
            return s
        values, vectors = np.linalg.eigh((s + s.T) / 2)
        return Axes(float(values[0]), values[:0:-1] - values[0], vectors[:, :0:-1])

    @staticmethod
    def of_rows(base: float, rows: np.ndarray) -> Axes:
        """The axes of base times the identity plus rows' rows."""
        _, s, vt = np.linalg.svd(rows, full_matrices=False)
        return Axes(base, s * s, vt.T)

    def rows(self) -> np.ndarray:
        """The rows of of_rows()."""
        return (self.v * np.sqrt(self.g)).T

    def dense(self) -> np.ndarray:
        return self.base * np.eye(len(self.v)) + (self.v * self.g) @ self.v.T

    def times(self, w: np.ndarray) -> np.ndarray:
        return self.base * w + self.v @ (self.g * (self.v.T @ w))

    def quad(self, w: np.ndarray) -> float:
        return float(self.base * (w @ w) + self.g @ (self.v.T @ w) ** 2)

    def solve(self, a: float, c: float, m: np.ndarray) -> np.ndarray:
        """(a S + c I)^-1 m for this covariance S."""
        low = a * self.base + c
        return m / low - self.v @ ((a * self.g / (low * (low + a * self.g)))[:, None] * (self.v.T @ m.reshape(len(self.v), -1))).reshape(-1, *m.shape[1:])

    def floored(self, share: float, least: float) -> Axes:
        """With eigenvalues of at least max(share * mean, least); the mean is taken before."""
        n, k = self.v.shape
        floor = max(share * (self.base + self.g.sum() / n), least)
        values = np.maximum(self.base + self.g, floor)
        base = max(self.base, floor) if k < n else values.min(initial=floor if n == 0 else np.inf)
        return Axes(float(base), values - base, self.v)


def eigen_floor(s: np.ndarray, share: float = 1e-6, least: float = 1e-12) -> np.ndarray:
    """The symmetric part of s with eigenvalues of at least max(share * mean, least)."""
    return Axes.of(s).floored(share, least).dense()


def shrunk_axes(x: np.ndarray) -> Axes:
    """Covariance of dates by names shrunk towards a multiple of the identity by the published optimal intensity."""
    n, p = x.shape
    if n < 2:
        return Axes(1e-8, np.zeros(0), np.zeros((p, 0)))
    x = x - x.mean(0)
    s = Axes.of_rows(0.0, x / np.sqrt(n))
    mean, norm2 = s.g.sum() / p, (s.g**2).sum()
    spread = norm2 / p - mean**2
    noise = min(spread, (((x**2).sum(1) ** 2).sum() / n - norm2) / (n * p))
    rho = noise / spread if spread > 0 else 0.0
    return Axes(rho * mean, (1 - rho) * s.g, s.v)


def shrunk(x: np.ndarray) -> np.ndarray:
    """shrunk_axes() as a matrix."""
    return shrunk_axes(x).dense()


def shrink_to_l1(v: np.ndarray, most: float) -> np.ndarray:
    """The point nearest to v whose absolute values sum to most or less."""
    a = np.abs(v)
    if a.sum() <= most:
        return v
    down = np.sort(a)[::-1]
    sums = np.cumsum(down) - most
    k = np.flatnonzero(down - sums / np.arange(1, len(v) + 1) > 0)[-1]
    return np.sign(v) * np.maximum(a - sums[k] / (k + 1), 0)


def into_slab(v: np.ndarray, row: np.ndarray, cap: float) -> np.ndarray:
    x, size = row @ v, row @ row
    return v - row * (x - np.clip(x, -cap, cap)) / size if size > 0 else v


def into_ellipsoid(v: np.ndarray, sigma: Axes, most: float) -> np.ndarray:
    """The point nearest to v of variance most or less: its multiplier by bisection in the axes of the covariance."""
    if sigma.quad(v) <= most:
        return v
    y = sigma.v.T @ v
    values, rest = sigma.base + sigma.g, max(0.0, v @ v - y @ y)
    low, high = 0.0, 1.0
    at = lambda m: (values * (y / (1 + m * values)) ** 2).sum() + sigma.base * rest / (1 + m * sigma.base) ** 2
    while at(high) > most:
        high *= 4
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if at(middle) > most else (low, middle)
    return v / (1 + high * sigma.base) + sigma.v @ (y / (1 + high * values) - y / (1 + high * sigma.base))


def mean_variance_status(mu, sigma, beta=None, aversion=5.0, bound=0.1, gross=2.0, beta_limit=0.02, rounds=20000, *, neutral=True, long_only=False, budget=None, hard=(), soft=()):
    """(w, residual): maximise mu w - aversion w' sigma w, by ADMM; residual is the largest violation of any constraint.

    Long only: 0 <= w <= bound, sum 1. Else |w| <= bound, |w|_1 <= gross, sum 0 if neutral, rows of hard at 0 and those of
    soft(row, cap) within their caps. Always: |beta w| <= beta_limit and w' sigma w <= budget squared, where given.
    Each set has its own copy of w, projected on alone; w itself is a linear solve that holds all equalities.
    """
    sigma, n = Axes.of(sigma), len(mu)
    size = max(1e-12, np.abs(mu).max())
    project = [lambda v: np.clip(v, 0.0 if long_only else -bound, bound)]
    if gross is not None and not long_only:
        project.append(lambda v: shrink_to_l1(v, gross))
    if beta is not None and beta_limit is not None:
        project.append(lambda v: into_slab(v, beta, beta_limit))
    if budget is not None:
        project.append(lambda v: into_ellipsoid(v, sigma, budget**2))
    for row, cap in [] if long_only else soft:
        project.append(lambda v, row=row, cap=cap: into_slab(v, row, cap))
    equal, goal = _equalities(n, neutral, long_only, hard)
    sets, rho = len(project), 2.0
    solved = lambda m: sigma.solve(2 * aversion / size, rho * sets, m)
    across = solved(equal.T)
    lift = across @ np.linalg.pinv(equal @ across)
    z, u, w, off = np.zeros((sets, n)), np.zeros((sets, n)), np.zeros(n), np.inf
    for step in range(rounds):
        w = solved(mu / size + rho * (z - u).sum(0))
        w = w - lift @ (equal @ w - goal)
        before = z.copy()
        for k in range(sets):
            z[k] = project[k](w + u[k])
            u[k] += w - z[k]
        off = np.abs(w - z).max()
        # feasible isn't optimal yet while the copies still move
        if off < 1e-6 and np.abs(z - before).max() < 1e-6 and step:
            break
    return w, float(max(off, np.abs(equal @ w - goal).max(initial=0.0)))


def _equalities(n: int, neutral: bool, long_only: bool, hard) -> tuple[np.ndarray, np.ndarray]:
    equal = np.array(([np.ones(n)] if neutral or long_only else []) + ([] if long_only else list(hard))).reshape(-1, n)
    goal = np.zeros(len(equal))
    if long_only:
        goal[0] = 1.0
    return equal, goal


def violation(w, sigma, beta=None, bound=0.1, gross=2.0, beta_limit=0.02, *, neutral=True, long_only=False, budget=None, hard=(), soft=()) -> float:
    """The largest violation of any constraint of mean_variance_status() by w; a variance counts by its root."""
    equal, goal = _equalities(len(w), neutral, long_only, hard)
    off = [np.abs(equal @ w - goal).max(initial=0.0), (np.abs(w) - bound).max(initial=0.0)]
    if long_only:
        off.append(-w.min(initial=0.0))
    else:
        off += [np.abs(w).sum() - gross] if gross is not None else []
        off += [abs(row @ w) - cap for row, cap in soft]
    if beta is not None and beta_limit is not None:
        off.append(abs(beta @ w) - beta_limit)
    if budget is not None:
        off.append(np.sqrt(Axes.of(sigma).quad(w)) - budget)
    return float(max(0.0, *off))


def _free(equal: np.ndarray) -> np.ndarray:
    """Orthonormal columns of all directions that keep equal @ z."""
    _, s, vt = np.linalg.svd(equal, full_matrices=True)
    return vt[(s > 1e-10).sum() :].T


def _centre(t, q, p, rows, caps, quad, free, z, stop=None):
    """Newton's method for t * (z' p z - q z) less the logarithms of what z leaves of all caps; z is within them, and moves
    along the columns of free.

    quad is (m, c) for the constraint z' m z < 1 + c z, or None. Ends at once where stop(z) holds.
    """
    slack = lambda x: np.append(caps - rows @ x, [] if quad is None else 1 + quad[1] @ x - x @ quad[0] @ x)
    value = lambda x, left: t * (x @ p @ x - q @ x) - np.log(left).sum()
    for _ in range(60):
        left = slack(z)
        grad, hess = t * (2 * p @ z - q), 2 * t * p
        inverse = 1 / left[: len(caps)]
        grad, hess = grad + rows.T @ inverse, hess + (rows * (inverse**2)[:, None]).T @ rows
        if quad is not None:
            pull = (2 * quad[0] @ z - quad[1]) / left[-1]
            grad, hess = grad + pull, hess + 2 * quad[0] / left[-1] + np.outer(pull, pull)
        inner, down = free.T @ hess @ free, -free.T @ grad
        scale = 1 / np.sqrt(np.maximum(np.diag(inner), 1e-300))
        step = free @ (scale * np.linalg.solve(inner * scale * scale[:, None] + 1e-13 * np.eye(len(scale)), scale * down))
        fall, size, now = -grad @ step, 1.0, value(z, left)
        while size > 1e-12:
            new = z + size * step
            after = slack(new)
            if after.min() > 0 and value(new, after) <= now - 0.1 * size * fall + 1e-9 * abs(now):
                break
            size /= 2
        else:
            return z
        z = new
        if fall < 2e-9 or (stop is not None and stop(z)):
            return z
    return z


def interior_point(mu, sigma, beta=None, aversion=5.0, bound=0.1, gross=2.0, beta_limit=0.02, *, neutral=True, long_only=False, budget=None, hard=(), soft=(), gap: float = 1e-7):
    """Weights of the program of mean_variance_status() by a barrier method, or None where no weights are feasible.

    Gross exposure is a sum of bounds on each name's size, so the program is smooth in names and bounds. A point within
    all constraints is found first, by the same steps for the largest violation. For when the projections converge too
    slowly: its systems are dense in the names.
    """
    n, sigma = len(mu), Axes.of(sigma)
    sized = gross is not None and not long_only
    width = 2 * n if sized else n
    wide = lambda r: np.pad(np.atleast_2d(r), ((0, 0), (0, width - n)))
    eye, one = np.eye(n), np.ones(n)
    rows, caps = [wide(eye), wide(-eye)], [bound * one, (0.0 if long_only else bound) * one]
    for row, cap in ([(beta, beta_limit)] if beta is not None and beta_limit is not None else []) + ([] if long_only else list(soft)):
        rows += [wide(row), wide(-row)]
        caps += [np.full(1, cap)] * 2
    if sized:
        rows += [np.hstack([eye, -eye]), np.hstack([-eye, -eye]), np.append(np.zeros(n), one)[None, :]]
        caps += [np.zeros(n), np.zeros(n), np.full(1, gross)]
    rows, caps = np.vstack(rows), np.concatenate(caps)
    equal, goal = _equalities(n, neutral, long_only, hard)
    equal = wide(equal) if len(equal) else np.zeros((0, width))
    whole = np.zeros((width, width))
    whole[:n, :n] = sigma.dense()
    form = None if budget is None else whole / budget**2
    z = np.zeros(width)
    z[:n] = 1 / n if long_only else 0.0
    z[n:] = gross / (4 * n) if sized else 0.0
    worst = max((rows @ z - caps).max(), -1.0 if form is None else z @ form @ z - 1)
    if worst >= 0:
        # one more unknown stands for the largest violation; it falls until a point within all constraints is reached
        last = np.append(np.zeros(width), 1.0)
        grown = np.vstack([np.hstack([rows, -np.ones((len(rows), 1))]), -last])
        lifted = None if form is None else (np.pad(form, (0, 1)), last)
        tied = _free(np.hstack([equal, np.zeros((len(equal), 1))]))
        x, t, inside = np.append(z, worst + 1), 1.0, lambda x: x[-1] < -1e-6
        while t < 1e9 and not inside(x):
            x, t = _centre(t, -last, np.zeros((width + 1, width + 1)), grown, np.append(caps, 1.0), lifted, tied, x, inside), 8 * t
        if not inside(x):
            return None
        z = x[:-1]
    if np.abs(equal @ z - goal).max(initial=0.0) > 1e-6:
        return None
    quad, free = None if form is None else (form, np.zeros(width)), _free(equal)
    t, q = 1.0, np.pad(mu / max(1e-12, np.abs(mu).max()), (0, width - n))
    p = aversion * whole / max(1e-12, np.abs(mu).max())
    while (len(caps) + (quad is not None)) / t > gap:
        z = _centre(t, q, p, rows, caps, quad, free, z)
        t *= 8
    return z[:n]


#: Violations above which the projections are given up for the other solver, and above which a solve has failed.
CLOSE, FAILED = 1e-5, 1e-3


def cascade(mu, sigma, beta=None, aversion=5.0, bound=0.1, gross=2.0, beta_limit=0.02, rounds=20000, **options):
    """(w, status, residual, first_residual): the projections' weights, else the barrier method's, else the projections' again.

    status is solved, fallback or failed; residual is what the weights violate, first_residual what the projections left.
    """
    sigma = Axes.of(sigma)
    w, first = mean_variance_status(mu, sigma, beta, aversion, bound, gross, beta_limit, rounds, **options)
    if first <= CLOSE:
        return w, "solved", first, first
    other = interior_point(mu, sigma, beta, aversion, bound, gross, beta_limit, **options)
    off = np.inf if other is None else violation(other, sigma, beta, bound, gross, beta_limit, **options)
    if off <= FAILED:
        return other, "fallback", off, first
    return w, "solved" if first <= FAILED else "failed", first, first


def mean_variance(mu, sigma, beta, **options) -> np.ndarray:
    """Weights of mean_variance_status alone."""
    return mean_variance_status(mu, sigma, beta, **options)[0]


def principal_rows(sigma, k: int, equalize: bool = False) -> np.ndarray:
    """The k leading eigenvectors as rows, times the roots of their eigenvalues if asked."""
    s = Axes.of(sigma)
    if len(s.g) < min(k, len(s.v)):  # the axes leave some directions open: those of equal variance
        s = Axes.of(s.dense())
    order = np.argsort(-s.g, kind="stable")[:k]
    lead = s.v[:, order].T
    if len(lead) < min(k, len(s.v)):
        lead = np.linalg.eigh(s.dense())[1][:, ::-1][:, :k].T
    values = np.array([s.quad(r) for r in lead])
    return lead * np.sqrt(np.maximum(values, 1e-12))[:, None] if equalize else lead


def sector_rows(sectors: list[str], unit: bool = False) -> np.ndarray:
    """A 0/1 row for each sector of two names or more, of unit length if asked; none unless there are two such rows."""
    named = np.array(sectors, dtype=object)
    rows = [(named == s).astype(float) for s in sorted(set(sectors)) if (named == s).sum() >= 2]
    rows = rows if len(rows) >= 2 else []
    return np.array([r / np.linalg.norm(r) if unit else r for r in rows]).reshape(-1, len(sectors))


def kernel_ages(count: int, kind: str, scale: float) -> np.ndarray:
    """Normalised weights of count observations, highest at the last."""
    x = np.arange(count - 1, -1, -1.0) / max(1e-6, scale)
    r3, r5 = 3.0**0.5 * x, 5.0**0.5 * x
    kind = {"m32": "matern32", "m52": "matern52"}.get(kind, kind)
    forms = {"rbf": np.exp(-x * x / 2), "exp": np.exp(-x), "matern32": (1 + r3) * np.exp(-r3), "matern52": (1 + r5 + r5 * r5 / 3) * np.exp(-r5)}
    if kind not in forms:
        raise ValueError(f"unknown kernel {kind}")
    return forms[kind] / forms[kind].sum()


def covariance_of(x: np.ndarray, model: str, decay: float = 0.97) -> Axes:
    """Risk model of dates by names, repaired twice: relative to the mean eigenvalue, then to max(1, mean).

    gp_kernel[:kind] weighs dates by a kernel of their age, whose length is that of the decay: -1 / ln(decay), 1 at least.
    """
    model, (t, n) = model.lower(), x.shape
    tiny = Axes(1e-8, np.zeros(0), np.zeros((n, 0)))
    if model in ("sample", "sample_cov", "cov"):
        s = Axes.of_rows(0.0, (x - x.mean(0)) / np.sqrt(t - 1)) if t > 1 else tiny
    elif model in ("ewma", "ewma_cov"):
        s = Axes.of_rows(0.0, x * np.sqrt((1 - decay) * decay ** np.arange(t - 1, -1, -1.0))[:, None])
    elif model in ("lw", "ledoit_wolf", "ledoit-wolf"):
        s = shrunk_axes(x)
    elif model.startswith("gp_kernel"):
        kind = (model.split(":") + [""])[1].strip() or "rbf"
        scale = max(1.0, -1.0 / np.log(decay)) if 0 < decay < 1 else 32.0
        s = Axes.of_rows(0.0, x * np.sqrt(kernel_ages(t, kind, scale))[:, None]) if t > 1 else tiny
    else:
        raise ValueError(f"unknown risk model {model}")
    return s.floored(1e-6, 1e-12).floored(0.0, 1e-6 * max(1.0, _mean_value(s.floored(1e-6, 1e-12))))


def _mean_value(s: Axes) -> float:
    return s.base + s.g.sum() / max(1, len(s.v))


WEIGHTS = "date date, ticker string, weight double, status string, residual double, first_residual double"


def optimal_weights(alpha: DataFrame, loads: DataFrame, betas: DataFrame, base: float = 0.0) -> DataFrame:
    """date, ticker, weight, status and both residuals: one solve for each date of alpha(date, ticker, weight), in parallel.

    The covariance comes as axes: loads(k, g, ticker, v) of gram.axes(). They travel with the names, k numbers each, so a
    date's task holds names times axes and nothing is collected. Names without loads are left out.
    """
    own = loads.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("k", (F.col("v") * F.sqrt("g")).alias("load")))).alias("l")).select("ticker", F.col("l.load").alias("loads"))
    rows = alpha.join(own, "ticker").join(betas, "ticker", "left").withColumn("beta", F.coalesce("beta", F.lit(0.0)))
    dates = rows.groupBy("date").agg(F.sort_array(F.collect_list(F.struct("ticker", "weight", "beta", "loads"))).alias("names"))

    def run(parts):
        import pandas as pd

        for part in parts:
            out = []
            for date, names in zip(part["date"], part["names"]):
                sigma = Axes.of_rows(base, np.array([list(x["loads"]) for x in names]).T).floored(1e-6, 1e-12)
                w, status, off, first = cascade(np.array([x["weight"] for x in names]), sigma, np.array([x["beta"] for x in names]))
                out += [(date, x["ticker"], float(v), status, off, first) for x, v in zip(names, w)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in WEIGHTS.split(", ")])

    return dates.mapInPandas(run, WEIGHTS)
