"""Fits of many systems at once.

A system's analysis is a generator that yields the fits that it waits for, as (solver,
arguments); ``together`` runs many and gives all waiting fits of a solver to one call.  The
solvers work on arrays of days by problems, so what NumPy costs a call is shared by
hundreds of short series.  Each problem stops for itself; how many others there are
doesn't matter to it.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterable

import numpy as np

#: Problems of one call times their days, and steps of the interior point at most.
CELLS, STEPS = 60_000, 80


def together(jobs: Iterable[Generator]) -> list[object]:
    """What each generator returns, or the exception that ended it."""
    jobs = list(jobs)
    out: list[object] = [None] * len(jobs)
    answers: dict[int, object] = {i: None for i in range(len(jobs))}
    while answers:
        waiting: dict[Callable, list[tuple[int, tuple]]] = {}
        for i, answer in answers.items():
            try:
                solver, args = jobs[i].throw(answer) if isinstance(answer, Exception) else jobs[i].send(answer)
                waiting.setdefault(solver, []).append((i, args))
            except StopIteration as e:
                out[i] = e.value
            except Exception as e:  # noqa: BLE001 - one job's failure must not end the others
                out[i] = e
        answers = {}
        for solver, asked in waiting.items():
            for (i, _), found in zip(asked, _answers(solver, [args for _, args in asked])):
                answers[i] = found
    return out


def _answers(solver: Callable, asked: list[tuple]) -> list[object]:
    """The solver's results; a call that fails is halved, so that only those that fail by themselves get an exception."""
    try:
        return solver(asked)
    except Exception as e:  # noqa: BLE001
        half = len(asked) // 2
        return _answers(solver, asked[:half]) + _answers(solver, asked[half:]) if half else [e]


def each(asked: list[list[Generator]]) -> list[list[object]]:
    """A solver whose requests are lists of generators: what each of them returns; an exception of one is the request's."""
    found = iter(together([job for jobs in asked for job in jobs]))
    out = []
    for jobs in asked:
        mine = [next(found) for _ in jobs]
        out.append(next((x for x in mine if isinstance(x, Exception)), mine))
    return out


def alone(job: Generator) -> object:
    """What one generator returns; its exception is raised."""
    out = together([job])[0]
    if isinstance(out, Exception):
        raise out
    return out


def chunks(lengths: list[int]) -> list[list[int]]:
    """Numbers of problems of about equal length, each list for one call."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        if out and len(out[-1]) * lengths[i] < CELLS and lengths[i] <= 1.5 * lengths[out[-1][0]] + 4:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def network(c: np.ndarray, g: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of (diag(c) + D'diag(g)D) x = right, D the differences over the first axis, by odd-even reduction without a subtraction.

    c is (n, problems), g (n - 1, problems), right (n, problems, k).
    """
    if len(c) == 1:
        return right / c[..., None]
    a, b = g[0::2], g[1::2]
    odd = c[1::2]
    total = odd + a
    total[: len(b)] += b
    left, down = a / total, b / total[: len(b)]
    even, r, one = c[0::2].copy(), right[0::2].copy(), right[1::2]
    even[: len(odd)] += left * odd
    even[1 : len(b) + 1] += down * odd[: len(b)]
    r[: len(odd)] += left[..., None] * one
    r[1 : len(b) + 1] += down[..., None] * one[: len(b)]
    x = np.empty_like(right)
    x[0::2] = network(even, left[: len(b)] * b, r)
    rest = one / total[..., None] + left[..., None] * x[0::2][: len(odd)]
    rest[: len(b)] += down[..., None] * x[0::2][1 : len(b) + 1]
    x[1::2] = rest
    return x


def _down(b: np.ndarray) -> np.ndarray:
    """D'b."""
    out = np.zeros((len(b) + 1, *b.shape[1:]))
    out[1:] += b
    out[:-1] -= b
    return out


def _solved(h: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solution of each small system; those that are singular get a small ridge, those that aren't numbers NaN."""
    lost = ~np.isfinite(h).all(axis=(1, 2))
    h = np.where(lost[:, None, None], np.eye(h.shape[1]), h)
    try:
        x = np.linalg.solve(h, right[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        x = np.linalg.solve(h + (1e-12 * np.abs(h).max(axis=(1, 2)) + 1e-300)[:, None, None] * np.eye(h.shape[1]), right[:, :, None])[:, :, 0]
    return np.where(lost[:, None], np.nan, x)


class _Sided:
    """high * max(v, 0) + low * min(v, 0) for entries v of the unknowns: the parts above and below 0, and the multiplier between low and high."""

    def __init__(self, v: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray):
        self.on = high > low
        self.low, self.high = np.where(self.on, low, -1.0), np.where(self.on, high, 1.0)
        self.up, self.down = np.maximum(v, 0) + size, np.maximum(-v, 0) + size
        self.dual = np.where(self.on, (self.low + self.high) / 2, 0.0)

    def gap(self) -> np.ndarray:
        return np.where(self.on, self.up * (self.high - self.dual) + self.down * (self.dual - self.low), 0.0).sum(axis=0)

    def newton(self, v: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.above, self.below = self.high - self.dual, self.dual - self.low
        self.theta = np.where(self.on, 1 / (self.up / self.above + self.down / self.below), 0.0)
        self.target = target
        self.shift = v - target / self.above + target / self.below
        return self.theta, np.where(self.on, self.dual + self.theta * self.shift, 0.0)

    def moves(self, dv: np.ndarray) -> np.ndarray:
        """Sets the moves for a move of the unknowns; the longest step (of each problem) that keeps all inside."""
        self.d_dual = self.theta * (dv + self.shift)
        self.d_up = self.target / self.above - self.up + self.up / self.above * self.d_dual
        self.d_down = self.target / self.below - self.down - self.down / self.below * self.d_dual
        most = np.maximum(np.maximum(-self.d_up / self.up, -self.d_down / self.down), np.maximum(self.d_dual / self.above, -self.d_dual / self.below))
        return np.where(self.on, most, 0.0).max(axis=0, initial=0.0)

    def step(self, a: np.ndarray) -> None:
        on = self.on & (a > 0)
        self.up, self.down, self.dual = (x + np.where(on, a * d, 0.0) for x, d in ((self.up, self.d_up), (self.down, self.d_down), (self.dual, self.d_dual)))

    def keep(self, at: np.ndarray) -> None:
        for k in ("on", "low", "high", "up", "down", "dual"):
            setattr(self, k, getattr(self, k)[:, at])


class Dense:
    """A matrix (n, k) of the columns that all problems of a call share."""

    def __init__(self, a: np.ndarray):
        self.a, self.shape, self.top = a, a.shape, np.abs(a).max(axis=1)
        self.squares = (a[:, :, None] * a[:, None, :]).reshape(len(a), -1)

    def times(self, z: np.ndarray) -> np.ndarray:
        """(n, problems) of (problems, k)."""
        return self.a @ z.T

    def back(self, v: np.ndarray) -> np.ndarray:
        """(problems, k) of (n, problems)."""
        return v.T @ self.a

    def gram(self, c: np.ndarray) -> np.ndarray:
        """(problems, k, k): A'diag(c)A of each problem."""
        return (c.T @ self.squares).reshape(c.shape[1], self.shape[1], self.shape[1])


class Products(Dense):
    """The columns first[k, i] * second[k, d, j] over the rows (k, d), of all i and j but (0, 1), (0, 2), ...; never written out.

    Sums run over d for each k and then over k, so a Gram matrix costs a row the pairs of j only.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second
        (self.points, self.i), (_, self.days, self.j) = first.shape, second.shape
        self.kept = np.r_[0, self.j : self.i * self.j]
        self.shape = (self.points * self.days, len(self.kept))
        self.top = (np.abs(first).max(axis=1)[:, None] * np.abs(second).max(axis=2)).ravel()
        i, j = np.triu_indices(self.i), np.triu_indices(self.j)
        self.first_pairs = (first[:, i[0]] * first[:, i[1]]).T.copy()
        self.second_pairs = (second[:, :, j[0]] * second[:, :, j[1]]).transpose(0, 2, 1).copy()
        self.second_back = second.transpose(0, 2, 1).copy()
        # Where the product of two columns is among the pairs.
        of_i, of_j = np.zeros((self.i, self.i), int), np.zeros((self.j, self.j), int)
        of_i[i] = of_i[i[::-1]] = np.arange(len(i[0]))
        of_j[j] = of_j[j[::-1]] = np.arange(len(j[0]))
        a, b = self.kept // self.j, self.kept % self.j
        self.at = of_i[a[:, None], a[None, :]] * len(j[0]) + of_j[b[:, None], b[None, :]]

    def times(self, z: np.ndarray) -> np.ndarray:
        whole = np.zeros((self.i * self.j, len(z)))
        whole[self.kept] = z.T
        by_point = (self.first @ whole.reshape(self.i, -1)).reshape(self.points, self.j, -1)
        return np.matmul(self.second, by_point).reshape(self.shape[0], -1)

    def back(self, v: np.ndarray) -> np.ndarray:
        by_point = np.matmul(self.second_back, v.reshape(self.points, self.days, -1))
        return (self.first.T @ by_point.reshape(self.points, -1)).reshape(self.i * self.j, -1)[self.kept].T

    def gram(self, c: np.ndarray) -> np.ndarray:
        by_point = np.matmul(self.second_pairs, c.reshape(self.points, self.days, -1))
        pairs = (self.first_pairs @ by_point.reshape(self.points, -1)).reshape(-1, c.shape[1])
        return pairs.T[:, self.at]


def solve(y: np.ndarray, ok: np.ndarray, wide: np.ndarray | Dense, p: np.ndarray, tv: np.ndarray | None = None, low: np.ndarray | None = None, high: np.ndarray | None = None, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Minimisers (s, z), (n, problems) and (problems, k), of each f(y - s - wide z) + |tv * differences of s|_1 + 1/2 z'diag(p)z.

    f sums high * max(r, 0) + low * min(r, 0) (low and high one a problem) over the known days, without them r^2.
    Without ``tv`` there is no s (it is 0); only then ``wide`` may be ``Products``.  An interior point on all problems at once; a problem that is settled leaves.
    """
    wide = wide if isinstance(wide, Dense) else Dense(wide)
    (n, size), k = y.shape, wide.shape[1]
    y = np.where(ok, y, 0.0)
    count = np.maximum(ok.sum(axis=0), 1)
    level = y.sum(axis=0) / count
    size_of = 1 + np.abs(y).max(axis=0)
    spread = np.maximum((np.abs(y - level) * ok).sum(axis=0) / count, 1e-6 * size_of)
    near = 1e-8 * spread + 1e-13 * size_of
    s, z = np.zeros((n, size)) if tv is None else np.tile(level, (n, 1)), np.zeros((size, k))
    out_s, out_z, at = np.zeros((n, size)), np.zeros((size, k)), np.arange(size)
    first = None if low is None else _Sided(y - s, np.where(ok, low, 0.0), np.where(ok, high, 0.0), spread)
    steps = None if tv is None else _Sided(np.zeros((n - 1, size)), -tv, tv, spread)
    # Days after a series' end hang on nothing.
    loose = np.zeros((n, size)) if tv is None else np.where(ok, 0.0, (np.r_[np.zeros((1, size)), tv] + np.r_[tv, np.zeros((1, size))]) <= 0) * 1.0
    sides = [x for x in (first, steps) if x is not None]
    cells = sum((x.on.sum(axis=0) for x in sides), np.zeros(size)) * 2
    full = spread * (count * (1.0 if low is None else np.maximum(high, -low)) + (0 if tv is None else tv.max(axis=0, initial=0.0)))
    last, lost = np.zeros(size), np.zeros(size, bool)
    for turn in range(STEPS):
        r = y - s - wide.times(z)
        gap = sum(x.gap() for x in sides)
        mu = gap / np.maximum(cells, 1)
        target = mu * np.clip((1 - last) ** 2, 0.02, 0.5)
        if first is None:
            c, a = 2.0 * ok, 2.0 * ok * r
        else:
            c, a = first.newton(r, target)
        b = 0.0
        if steps is not None:
            g, b = steps.newton(np.diff(s, axis=0), target)
        # What the multipliers leave of the stationarity.
        force = 2.0 * ok * r if first is None else np.where(first.on, first.dual, 0.0)
        rest = np.abs(wide.back(force) - p * z).max(axis=1, initial=0.0) / (1 + wide.top @ np.abs(force))
        primal = 0.0
        if first is not None:
            primal = np.where(first.on, np.abs(r - first.up + first.down), 0.0).max(axis=0)
        if steps is not None:
            rest = np.maximum(rest, np.abs(force - _down(np.where(steps.on, steps.dual, 0.0))).max(axis=0) / (1 + np.abs(force).max(axis=0)))
            primal = np.maximum(primal, np.where(steps.on, np.abs(np.diff(s, axis=0) - steps.up + steps.down), 0.0).max(axis=0))
        done = (gap <= tolerance * full) & (primal <= near) & (rest <= 1e-7) | lost | (turn == STEPS - 1)
        if done.any():
            out_s[:, at[done]], out_z[at[done]] = s[:, done], z[done]
            left = np.flatnonzero(~done)
            if len(left) == 0:
                break
            y, ok, s, z, p, at, last, cells, full, near, loose, c, a, r = y[:, left], ok[:, left], s[:, left], z[left], p[left], at[left], last[left], cells[left], full[left], near[left], loose[:, left], c[:, left], a[:, left], r[:, left]
            target = target[left]
            for x in sides:
                x.keep(left)
            if first is not None:
                c, a = first.newton(r, target)
            if steps is not None:
                g, b = steps.newton(np.diff(s, axis=0), target)
        h = wide.gram(c)
        to_z = wide.back(a) - p * z
        if steps is not None:
            right = np.concatenate([c[:, :, None] * wide.a[:, None, :], (a - _down(b))[:, :, None]], axis=2)
            solved = network(c + loose, g, right)
            cross = np.matmul(wide.a.T, (c[:, :, None] * solved).reshape(n, -1)).reshape(k, -1, k + 1).transpose(1, 0, 2)
            h, to_z = h - cross[:, :, :k], to_z - cross[:, :, k]
        h[:, np.arange(k), np.arange(k)] += p + 1e-14 * np.einsum("bii->b", h)[:, None] / k
        dz = _solved(h, to_z)
        ds = solved[:, :, k] - np.einsum("nbk,bk->nb", solved[:, :, :k], dz) if steps is not None else np.zeros_like(s)
        most = np.zeros(len(at))
        if first is not None:
            most = np.maximum(most, first.moves(-ds - wide.times(dz)))
        if steps is not None:
            most = np.maximum(most, steps.moves(np.diff(ds, axis=0)))
        last = np.minimum(1.0, 0.995 / np.maximum(most, 1e-300))
        # A problem whose numbers are used up stays where it is.
        lost = ~(np.isfinite(ds).all(axis=0) & np.isfinite(dz).all(axis=1) & np.isfinite(most))
        last = np.where(lost, 0.0, last)
        for x in sides:
            x.step(last)
        s, z = s + np.where(lost, 0.0, last * ds), z + np.where(lost[:, None], 0.0, last[:, None] * dz)
    return out_s, out_z


def columns(rows: list[np.ndarray], fill: float | bool = 0.0) -> np.ndarray:
    """(longest, rows): the rows as columns, their ends filled."""
    out = np.full((max(map(len, rows)), len(rows)), fill)
    for i, x in enumerate(rows):
        out[: len(x), i] = x
    return out
