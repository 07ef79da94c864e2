"""Models of the cross-section on small training sets, in numpy: a Gaussian process and Nyström ridge regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Scale:
    """Column means and deviations of a training set; constant columns are only centred."""

    mean: np.ndarray
    sd: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Scale:
        sd = x.std(0)
        return cls(x.mean(0), np.where(sd > 0, sd, 1.0))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.sd


def balanced_rows(y: np.ndarray, most: int | None, tail: float = 0.25, seed: int = 42) -> np.ndarray:
    """Row numbers, in order: the 2 * tail * most largest |y| and a random draw of the rest; all rows if they are few."""
    n = len(y)
    if most is None or n <= most:
        return np.arange(n)
    by_size = np.argsort(-np.abs(y), kind="stable")
    cut = min(2 * max(int(tail * most), 1), n)
    drawn = np.random.default_rng(seed).permutation(by_size[cut:])[: max(0, most - cut)]
    return np.sort(np.concatenate([by_size[:cut], drawn]))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0.0)


def median_gamma(x: np.ndarray, most: int = 200) -> float:
    """1 / (2 * median squared distance) of at most most rows; 1 if that isn't positive."""
    if len(x) <= 2:
        return 1.0
    some = x[np.random.default_rng(0).permutation(len(x))[:most]]
    d = squared_distances(some, some)
    d = d[d > 1e-12]
    return float(1 / (2 * np.median(d))) if len(d) else 1.0


def _kernel(kind: str, gamma: float):
    known = {
        "rbf": lambda a, b: np.exp(-gamma * squared_distances(a, b)),
        "laplacian": lambda a, b: np.exp(-gamma * np.abs(a[:, None] - b[None]).sum(-1)),
        "linear": lambda a, b: a @ b.T,
    }
    if kind not in known:
        raise ValueError(f"unknown kernel {kind}")
    return known[kind]


class Nystrom:
    """Ridge regression on Nyström features of random landmarks, rows weighed by age; predicts a mean and a spread."""

    def __init__(self, x, y, age=None, kernel="rbf", components=200, alpha=1e-2, gamma=None, seed=0, half_life=None):
        self.scale = Scale.of(x)
        x = self.scale(x)
        count = min(components, max(1, len(x) - 1))
        self.landmarks = x[np.random.default_rng(seed).permutation(len(x))[:count]]
        self.kernel = _kernel(kernel, gamma if gamma is not None else median_gamma(x))
        values, vectors = np.linalg.eigh(self.kernel(self.landmarks, self.landmarks))
        self.root = vectors / np.sqrt(np.maximum(values, 1e-12)) @ vectors.T
        phi = self._map(x)
        weight = np.ones(len(x)) if age is None or not half_life or half_life <= 0 else np.clip(0.5 ** (age / half_life), 1e-3, 1.0)
        normal = phi.T @ (phi * weight[:, None]) + alpha * np.eye(count)
        self.factor = np.linalg.cholesky(normal)
        self.coef = np.linalg.solve(normal, phi.T @ (y * weight))
        left = max(1.0, weight.sum() - count)
        self.noise = np.sqrt(max(1e-12, (weight * (y - phi @ self.coef) ** 2).sum() / left))

    def _map(self, scaled):
        return self.kernel(scaled, self.landmarks) @ self.root

    def predict(self, x):
        phi = self._map(self.scale(x))
        lever = (np.linalg.solve(self.factor, phi.T) ** 2).sum(0)
        return phi @ self.coef, self.noise * np.sqrt(np.maximum(lever, 1e-12))


class GaussianProcess:
    """c * (linear + Matérn 3/2 with a length a feature) + noise; parameters maximise the marginal likelihood."""

    LOW, HIGH = np.log(1e-5), np.log(1e5)

    def __init__(self, x, y, jitter=1e-6, restarts=0, steps=120):
        self.scale, self.jitter = Scale.of(x), jitter
        self.x, self.y = self.scale(x), np.asarray(y, float)
        start = np.zeros(3 + x.shape[1])  # log of c, of the linear offset, of the noise and of the lengths
        start[2] = np.log(max(jitter, 1e-5))
        rng = np.random.default_rng(0)
        tries = [self._ascend(p, steps) for p in [start] + [rng.normal(0, 1.5, len(start)) for _ in range(restarts)]]
        self.likelihood, self.theta = max(tries, key=lambda t: t[0])
        k, _ = self._gram(self.theta)
        self.factor = np.linalg.cholesky(k)
        self.dual = np.linalg.solve(k, self.y)

    def _parts(self, a, b, theta):
        gaps = (a[:, None] - b[None]) ** 2 / np.exp(2 * theta[3:])
        r = np.sqrt(3 * gaps.sum(-1))
        return np.exp(2 * theta[1]) + a @ b.T + (1 + r) * np.exp(-r), gaps, r

    def _gram(self, theta):
        base, gaps, r = self._parts(self.x, self.x, theta)
        c, noise, eye = np.exp(theta[0]), np.exp(theta[2]), np.eye(len(self.x))
        slopes = [c * base, np.full_like(base, 2 * c * np.exp(2 * theta[1])), noise * eye]
        slopes += [3 * c * np.exp(-r) * gaps[..., d] for d in range(gaps.shape[-1])]
        return c * base + (noise + self.jitter) * eye, slopes

    def _ascend(self, theta, steps):
        """Sign-based ascent with a step size a parameter, which needs no line search."""
        size, before, best = np.full(len(theta), 0.1), np.zeros(len(theta)), (-np.inf, theta)
        for _ in range(steps):
            k, slopes = self._gram(theta)
            try:
                low = np.linalg.cholesky(k)
            except np.linalg.LinAlgError:
                break
            inverse = np.linalg.inv(k)
            dual = inverse @ self.y
            value = -0.5 * self.y @ dual - np.log(np.diag(low)).sum()
            if value > best[0]:
                best = (value, theta.copy())
            pull = np.outer(dual, dual) - inverse
            slope = np.array([0.5 * (pull * s).sum() for s in slopes])
            size = np.clip(np.where(slope * before > 0, size * 1.2, size * 0.5), 1e-4, 0.5)
            theta = np.clip(theta + np.sign(slope) * size, self.LOW, self.HIGH)
            before = slope
            if size.max() <= 1e-3:
                break
        return best

    def predict(self, x):
        x = self.scale(x)
        c, noise = np.exp(self.theta[0]), np.exp(self.theta[2])
        cross = c * self._parts(x, self.x, self.theta)[0]
        own = c * (np.exp(2 * self.theta[1]) + (x * x).sum(1) + 1) + noise
        return cross @ self.dual, np.sqrt(np.maximum(own - (np.linalg.solve(self.factor, cross.T) ** 2).sum(0), 0.0))
