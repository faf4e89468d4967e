"""A small convex solver: half a quadratic form plus simple functions of linear maps, by ADMM.

minimise 1/2 x'Px + q'x + sum_j g_j(A_j x)

Each map is given by its products and Gram matrix, so differences cost no dense matrix;
each g_j by its proximal operator.  Daily signals have some thousand entries at most,
so one dense factorisation is kept for all iterations at one step size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

Array = np.ndarray


@dataclass
class Term:
    """g(A x) by A, A', A'A and prox(v, 1/rho)."""

    apply: Callable[[Array], Array]
    adjoint: Callable[[Array], Array]
    gram: Array
    prox: Callable[[Array, float], Array]
    size: int


def dense_term(a: Array, prox: Callable[[Array, float], Array]) -> Term:
    return Term(lambda x: a @ x, lambda z: a.T @ z, a.T @ a, prox, a.shape[0])


def difference_gram(n: int, order: int, weights: Array | None = None) -> Array:
    """D'W²D of the differences of an order, built from its bands."""
    coefficients = {1: (-1.0, 1.0), 2: (1.0, -2.0, 1.0)}[order]
    w = np.ones(n - order) if weights is None else np.asarray(weights, float) ** 2
    i = np.arange(n - order)
    out = np.zeros((n, n))
    for k, c in enumerate(coefficients):
        for l, d in enumerate(coefficients):
            out[i + k, i + l] += c * d * w
    return out


def difference_term(n: int, order: int, at: int, total: int, prox, weights: Array | None = None) -> Term:
    """Differences of the ``n`` entries from ``at`` on, of ``total`` unknowns."""
    gram = np.zeros((total, total))
    gram[at : at + n, at : at + n] = difference_gram(n, order, weights)
    w = np.ones(n - order) if weights is None else weights

    def apply(x: Array) -> Array:
        return w * np.diff(x[at : at + n], order)

    def adjoint(z: Array) -> Array:
        out = np.zeros(total)
        z = w * z
        if order == 1:
            out[at : at + n - 1] -= z
            out[at + 1 : at + n] += z
        else:
            out[at : at + n - 2] += z
            out[at + 1 : at + n - 1] -= 2 * z
            out[at + 2 : at + n] += z
        return out

    return Term(apply, adjoint, gram, prox, n - order)


def soft(weight: float | Array) -> Callable[[Array, float], Array]:
    """Prox of weight * |v|."""
    return lambda v, t: np.sign(v) * np.maximum(np.abs(v) - t * weight, 0)


def pinball(tau: float, weight: float | Array, centre: Array) -> Callable[[Array, float], Array]:
    """Prox of weight * (tau max(r, 0) + (1 - tau) max(-r, 0)) with r = centre - v."""

    def prox(v: Array, t: float) -> Array:
        r = centre - v
        up, down = t * weight * tau, t * weight * (1 - tau)
        return centre - np.where(r > up, r - up, np.where(r < -down, r + down, 0.0))

    return prox


def at_most(bound: float | Array) -> Callable[[Array, float], Array]:
    return lambda v, t: np.minimum(v, bound)


def within(low: float | Array, high: float | Array) -> Callable[[Array, float], Array]:
    return lambda v, t: np.clip(v, low, high)


def norm2(weight: float) -> Callable[[Array, float], Array]:
    """Prox of weight * ||v||."""

    def prox(v: Array, t: float) -> Array:
        n = np.sqrt(v @ v)
        return v * max(0.0, 1 - t * weight / n) if n > 0 else v

    return prox


def solve(p: Array, q: Array, terms: list[Term], rho: float = 1.0, iterations: int = 4000, tolerance: float = 1e-6, x0: Array | None = None, factors: dict[float, Array] | None = None) -> Array:
    """The minimiser, by over-relaxed ADMM with a step size that follows the residuals.

    ``factors`` keeps the inverse for each step size, for problems that differ in q and in
    the proximal operators only.
    """
    n = len(q)
    gram = sum((t.gram for t in terms), np.zeros((n, n)))
    first = rho
    factors = {} if factors is None else factors

    def inverse(rho: float) -> Array:
        if rho not in factors:
            factors[rho] = np.linalg.inv(p + rho * gram + 1e-12 * np.eye(n))
        return factors[rho]

    x = np.zeros(n) if x0 is None else x0.copy()
    z = [t.apply(x) for t in terms]
    u = [np.zeros(t.size) for t in terms]
    factor = inverse(rho)
    for k in range(iterations):
        rhs = -q + rho * sum((t.adjoint(zi - ui) for t, zi, ui in zip(terms, z, u)), np.zeros(n))
        x = factor @ rhs
        primal = dual = scale_p = scale_d = 0.0
        change = np.zeros(n)
        multipliers = np.zeros(n)
        for j, t in enumerate(terms):
            ax = t.apply(x)
            relaxed = 1.6 * ax - 0.6 * z[j]
            new = t.prox(relaxed + u[j], 1 / rho)
            u[j] = u[j] + relaxed - new
            change += t.adjoint(new - z[j])
            multipliers += t.adjoint(u[j])
            primal += ((ax - new) ** 2).sum()
            scale_p += max((ax**2).sum(), (new**2).sum())
            z[j] = new
        dual, scale_d = rho * np.sqrt(change @ change), rho * np.sqrt(multipliers @ multipliers)
        primal, scale_p = np.sqrt(primal), np.sqrt(scale_p)
        if primal <= tolerance * (np.sqrt(n) * 1e-2 + scale_p) and dual <= tolerance * (np.sqrt(n) * 1e-2 + scale_d):
            break
        if k in (20, 60, 150, 350, 800, 1600):
            ratio = np.sqrt((primal / max(scale_p, 1e-12)) / max(dual / max(scale_d, 1e-12), 1e-12))
            if ratio > 2 or ratio < 0.5:
                # Too far from the quadratic form the inverse loses its digits.
                new_rho = float(np.clip(rho * np.clip(ratio, 0.05, 20), 1e-3 * first, 1e3 * first))
                ratio, rho = new_rho / rho, new_rho
                u = [ui / ratio for ui in u]
                factor = inverse(rho)
    return x


def smooth_pinball(a: Array, y: Array, tau: float, p: Array, x0: Array, weight: float = 1.0, least: float = 1e-9) -> Array:
    """Minimiser of weight * pinball(y - A x) + 1/2 x'Px for few unknowns, by Newton steps on a smoothed pinball.

    |r| is replaced by sqrt(r^2 + e^2) with e going down to ``least`` times the spread of y.
    """
    x = x0.astype(float).copy()
    r = y - a @ x
    e = float(np.abs(r).mean()) or 1.0
    end = least * (float(np.abs(y - np.median(y)).mean()) or 1.0)

    def value(r: Array, x: Array, e: float) -> float:
        return weight * float((0.5 * np.sqrt(r * r + e * e) + (tau - 0.5) * r).sum()) + 0.5 * float(x @ p @ x)

    while True:
        for _ in range(25):
            root = np.sqrt(r * r + e * e)
            slope = 0.5 * r / root + (tau - 0.5)
            gradient = -weight * (a.T @ slope) + p @ x
            curve = 0.5 * weight * e * e / root**3
            h = (a * curve[:, None]).T @ a + p
            move = -np.linalg.solve(h + 1e-14 * np.trace(h) * np.eye(len(x)) / len(x), gradient)
            decrease = -float(gradient @ move)
            if decrease <= 1e-10 * weight * e * len(y):
                break
            now, step = value(r, x, e), 1.0
            change = a @ move
            while step > 1e-6 and value(r - step * change, x + step * move, e) > now - 0.25 * step * decrease:
                step *= 0.5
            x, r = x + step * move, r - step * change
        if e <= end:
            return x
        e = max(e * 0.25, end)
