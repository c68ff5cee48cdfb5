"""The small linear algebra of one model, in numpy."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

#: Prior precision of an intercept, and of anything without a stated prior.
LOOSE = 1e-12
#: Bounds of a penalty weight, updates of the weights in a round, and the change of their logarithm that settles them.
WEIGHTS, UPDATES, SETTLED = (1e-3, 1e8), 40, 1e-3
#: Power of an update: a plain one goes part of the way, from the same side each time, so a power under two gets there sooner.
EAGER = 1.7
#: Bounds of the share of a step that is taken where the dispersion is estimated along with a curved response.
PACES = (0.05, 2.0)


@dataclass(frozen=True)
class Layout:
    """The parameters of a model: shared coefficients, and own ones of each category.

    The coefficients of a category are the shared ones plus its own.  All but the
    last (the covariate) have own parts: without a spline in every category but the
    first, which is the reference; with one, every category has its own curve, which
    its penalty tells from the shared one, and all but the first an own intercept.
    ``used`` says which own parameters (category x coefficient) there are.
    """

    cats: list[str]
    q: int
    k: int | None
    used: np.ndarray

    @property
    def labels(self) -> list[str]:
        time = ["var"] if self.k is None else [f"s(var).{i + 1}" for i in range(self.q - 2)]
        return ["(Intercept)", *time, "use_cov"]

    def own_names(self) -> list[tuple[int, int, str]]:
        """Category, coefficient and name of the own parameters."""
        labels = self.labels
        return [(c, i, f"cat{cat}" if i == 0 else f"{labels[i]}:cat{cat}") for c, cat in enumerate(self.cats) for i in range(self.q - 1) if self.used[c, i]]


def layout(cats: list[str], q: int, k: int | None) -> Layout:
    used = np.full((len(cats), q - 1), len(cats) > 1)
    used[0, 0] = False
    if k is None:
        used[0] = False
    return Layout(cats, q, k, used)


def curvature(knots: np.ndarray) -> np.ndarray:
    """Integrated squared second derivative of the spline basis, with a small weight on the straight line."""
    k = len(knots)
    span = knots[-1] - knots[0]
    at = (knots - knots[0]) / span if span > 0 else np.linspace(0, 1, k)

    def second(x: np.ndarray) -> np.ndarray:
        part = [6 * (np.maximum(x - a, 0) - np.maximum(x - at[-1], 0)) / (at[-1] - a) for a in at[:-1]]
        return np.array([np.zeros_like(x), *[p - part[-1] for p in part[:-1]]])

    # Second derivatives are straight between knots, so Simpson's rule is exact.
    total = np.zeros((k - 1, k - 1))
    for low, high in zip(at[:-1], at[1:]):
        values = second(np.array([low, (low + high) / 2, high - 1e-12]))
        total += (values * (np.array([1, 4, 1]) * (high - low) / 6)) @ values.T
    total *= (k - 1) / max(np.trace(total), 1e-12)
    total[0, 0] += 0.1
    return total + 1e-3 * np.eye(k - 1)


@dataclass(frozen=True)
class Equations:
    """Normal equations of all categories: blocks ``h`` (category x q x q), right sides ``g``, and blocks between categories.

    Blocks between categories come from random levels that occur in several.
    """

    h: np.ndarray
    g: np.ndarray
    between: dict[tuple[int, int], np.ndarray]

    def inner(self, one: np.ndarray, two: np.ndarray) -> float:
        """Product of two steps of the coefficients (category x q), in squared standard errors."""
        return float(np.einsum("ci,cij,cj->", one, self.h, two) + sum(one[a] @ block @ two[b] for (a, b), block in self.between.items()))

    def length(self, step: np.ndarray) -> float:
        """Size of a step of the coefficients in standard errors."""
        return float(np.sqrt(max(self.inner(step, step), 0.0)))


def gather(cats: list[str], q: int, rows) -> Equations:
    """Equations from rows ``(cat_a, cat_b, h, g)``."""
    place = {c: i for i, c in enumerate(cats)}
    h, g, between = np.zeros((len(cats), q, q)), np.zeros((len(cats), q)), {}
    for a, b, block, side in rows:
        i, j = place[a], place[b]
        if i == j:
            h[i] += np.asarray(block, float).reshape(q, q)
            g[i] += np.asarray(side, float)
        else:
            between[i, j] = between.get((i, j), 0) + np.asarray(block, float).reshape(q, q)
    if not (np.isfinite(h).all() and np.isfinite(g).all() and all(np.isfinite(x).all() for x in between.values())):
        raise ValueError("normal equations are not finite")
    return Equations(h, g, between)


@dataclass(frozen=True)
class Weights:
    """Penalty weights: of the shared curve, and of the own curve of each category."""

    shared: float
    own: np.ndarray


class Solution:
    """Estimates of a model with what is needed of their covariance.

    The matrix of the shared parameters and those of the categories is bordered block
    diagonal: one small block for each category, joined by the shared ones.  It is
    factored by blocks, so neither time nor memory grow faster than the number of
    categories, and only the blocks of the inverse that are asked for are made.
    With random levels in several categories there are blocks between categories, and
    the matrix is taken as a whole.
    """

    def __init__(self, equations: Equations, shape: Layout, bend: np.ndarray | None, weights: Weights, prior_scale: float | None):
        self.shape, q, used = shape, shape.q, shape.used
        m = q - 1
        shared, own = prior(shape, bend, weights, prior_scale)
        both = used[:, :, None] & used[:, None, :]
        alone = np.eye(m) * ~used[:, :, None]  # parameters there are not stay at zero
        self.data = equations.h.sum(axis=0) + sum(equations.between.values(), np.zeros((q, q)))
        self.border = equations.h[:, :, :m] * used[:, None, :]
        for (a, b), block in equations.between.items():
            self.border[b] += block[:, :m] * used[b]
        self.inner = equations.h[:, :m, :m] * both
        top, right = self.data + shared, equations.g.sum(axis=0)
        blocks, side = self.inner + own * both + alone, equations.g[:, :m] * used
        self.whole = None
        if equations.between:
            self._solve_whole(equations, top, blocks, right, side)
            return
        self.low = np.linalg.cholesky(blocks)
        self.back = np.linalg.solve(blocks, self.border.transpose(0, 2, 1))
        rest = np.linalg.solve(blocks, side[:, :, None])[:, :, 0]
        self.core = np.linalg.cholesky(top - np.einsum("cij,cjk->ik", self.border, self.back))
        self.shared = _by_factor(self.core, right - np.einsum("cij,cj->i", self.border, rest))
        self.own = rest - self.back @ self.shared
        self.cov = _by_factor(self.core, np.eye(q))
        self.cov_across = -self.back @ self.cov
        self.cov_own = np.linalg.inv(blocks) + self.back @ self.cov @ self.back.transpose(0, 2, 1)

    def _solve_whole(self, equations: Equations, top, blocks, right, side) -> None:
        q, used = self.shape.q, self.shape.used
        m, n = q - 1, len(used)
        full = np.zeros((q + n * m,) * 2)
        full[:q, :q] = top
        for c in range(n):
            at = slice(q + c * m, q + (c + 1) * m)
            full[at, at], full[:q, at], full[at, :q] = blocks[c], self.border[c], self.border[c].T
        for (a, b), block in equations.between.items():
            full[q + a * m : q + (a + 1) * m, q + b * m : q + (b + 1) * m] += block[:m, :m] * used[a][:, None] * used[b]
        self.whole = np.linalg.cholesky(full)
        theta, cov = _by_factor(self.whole, np.r_[right, side.ravel()]), _by_factor(self.whole, np.eye(len(full)))
        self.shared, self.own, self.cov = theta[:q], theta[q:].reshape(n, m), cov[:q, :q]
        self.cov_across = cov[q:, :q].reshape(n, m, q)
        own = cov[q:, q:].reshape(n, m, n, m)
        self.cov_own = own[np.arange(n), :, np.arange(n)]
        self.between = {(a, b): own[a, :, b] for a, b in equations.between}

    @property
    def beta(self) -> np.ndarray:
        """Coefficients of each category."""
        out = np.repeat(self.shared[None], len(self.own), axis=0)
        out[:, :-1] += self.own
        return out

    def degrees(self, equations: Equations) -> float:
        """Parameters that the data determine, penalised ones in part."""
        m = self.shape.q - 1
        total = np.sum(self.cov * self.data) + 2 * np.sum(self.cov_across * self.border.transpose(0, 2, 1)) + np.sum(self.cov_own * self.inner)
        if self.whole is not None:
            used = self.shape.used
            total += sum(np.sum(self.between[a, b] * (block[:m, :m] * used[a][:, None] * used[b])) for (a, b), block in equations.between.items())
        return float(total)

    def draws(self, noise: np.ndarray) -> np.ndarray:
        """Draws of the coefficients (category x q x draw) from standard normals (parameter x draw)."""
        q, n = self.shape.q, len(self.own)
        m = q - 1
        if self.whole is not None:
            moved = np.linalg.solve(self.whole.T, noise)
            shared, own = moved[:q], moved[q:].reshape(n, m, -1)
        else:
            shared = np.linalg.solve(self.core.T, noise[:q])
            own = np.linalg.solve(self.low.transpose(0, 2, 1), noise[q:].reshape(n, m, -1)) - self.back @ shared
        out = self.beta[:, :, None] + shared[None]
        out[:, :-1] += own * self.shape.used[:, :, None]
        return out

    def parameters(self) -> int:
        return self.shape.q + self.own.size


def _by_factor(low: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.linalg.solve(low.T, np.linalg.solve(low, right))


def prior(shape: Layout, bend: np.ndarray | None, weights: Weights, prior_scale: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Prior precisions of the shared parameters and of those of each category: weak normals, and penalties on curves."""
    q, n = shape.q, len(shape.cats)
    weak = LOOSE if prior_scale is None else prior_scale**-2
    shared, own = np.diag([LOOSE, *[weak] * (q - 1)]), np.repeat(weak * np.eye(q - 1)[None], n, axis=0)
    if bend is not None:
        shared[1:-1, 1:-1] = weights.shared * bend
        own[:, 1:, 1:] = weights.own[:, None, None] * bend
    return shared, own


def solve_with_weights(equations: Equations, shape: Layout, bend: np.ndarray | None, weights: Weights, prior_scale: float | None, update: bool) -> tuple[Solution, Weights, bool]:
    """Solution with penalty weights of the largest restricted likelihood of the working model.

    Every curve has a weight of its own.  The fixed point of the restricted likelihood
    sets a weight to the parameters that its curve uses over the size of its bends; it
    raises the likelihood each time.  Also says whether the weights have settled.
    """
    solution = Solution(equations, shape, bend, weights, prior_scale)
    if bend is None or not update:
        return solution, weights, True
    many, size = len(shape.cats) > 1, len(bend)

    def better(weight, cov, curve):
        used = size - weight * np.sum(cov * bend, axis=(-2, -1))
        bent = np.einsum("...i,ij,...j->...", curve, bend, curve)
        factor = np.maximum(used, 1e-10) / np.maximum(weight * bent, 1e-300)
        return np.clip(weight * factor**EAGER, *WEIGHTS)

    for _ in range(UPDATES):
        new = Weights(
            float(better(weights.shared, solution.cov[1:-1, 1:-1], solution.shared[1:-1])),
            better(weights.own, solution.cov_own[:, 1:, 1:], solution.own[:, 1:]) if many else weights.own,
        )
        change = max(abs(np.log(new.shared / weights.shared)), float(np.abs(np.log(new.own / weights.own)).max()))
        weights, solution = new, Solution(equations, shape, bend, new, prior_scale)
        if change < SETTLED:
            return solution, weights, True
    return solution, weights, False


def next_pace(pace: float, step: tuple[np.ndarray, float], last: tuple[np.ndarray, float], equations: Equations, n_data: float) -> float:
    """Share of a step to take, given the step before; steps are of the coefficients and of the log dispersion.

    Steps that turn back jump over their aim: half the share ends that.  Steps that go
    on in one direction fall short of it and get a larger share.
    """
    product = lambda a, b: equations.inner(a[0], b[0]) + n_data / 2 * a[1] * b[1]
    cosine = product(step, last) / max(np.sqrt(max(product(step, step) * product(last, last), 0.0)), 1e-300)
    return float(np.clip(pace * (0.5 if cosine < -0.2 else 1.3 if cosine > 0.3 else 1.0), *PACES))


def nearest_covariance(wanted: np.ndarray, information: np.ndarray) -> np.ndarray:
    """The covariance (s00, s01, s11) closest to ``wanted`` in the metric of ``information``; ``wanted`` itself if it is one."""
    if wanted[0] >= 0 and wanted[2] >= 0 and wanted[0] * wanted[2] >= wanted[1] ** 2:
        return wanted

    def along(angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rays = np.stack([np.cos(angles) ** 2, np.cos(angles) * np.sin(angles), np.sin(angles) ** 2], axis=1)
        pull = rays @ information @ wanted
        norm = np.einsum("ni,ij,nj->n", rays, information, rays)
        return np.maximum(pull, 0) ** 2 / norm, rays * (np.maximum(pull, 0) / norm)[:, None]

    low, high = 0.0, np.pi
    for _ in range(8):  # the best covariance of one direction, ever more narrowly
        angles = np.linspace(low, high, 91)
        gain, found = along(angles)
        i = int(gain.argmax())
        step = angles[1] - angles[0]
        low, high = angles[i] - step, angles[i] + step
    return found[i]


def normals(seed: int, key: str, shape: tuple[int, ...]) -> np.ndarray:
    """Standard normals that depend on nothing but the seed and the key."""
    own = int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "little")
    return np.random.Generator(np.random.Philox(key=[seed, own])).standard_normal(shape)
