"""Sequential helper models on one ordered series, as NumPy: volatility, tails, hidden states, isolation."""

from __future__ import annotations

import math

import numpy as np


def garch_fit(r: np.ndarray) -> tuple[float, float, float, float]:
    """omega, alpha, beta and log-likelihood of GARCH(1,1) on demeaned returns, by a grid with the long-run variance targeted.

    Fewer than 30 returns, or ones that don't vary, give alpha 0.1, beta 0.85 and likelihood 0.
    """
    e = r - r.mean() if len(r) else r
    var = float((e * e).mean()) if len(r) else 0.0
    if len(r) < 30 or var <= 1e-10:
        return 0.05 * max(var, 1e-10), 0.1, 0.85, 0.0
    grid = np.array([(a, b) for a in (0.02, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3) for b in (0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.94) if a + b < 0.999])
    alpha, beta = grid.T
    omega = var * (1 - alpha - beta)
    v, ll = np.full(len(grid), var), np.zeros(len(grid))
    for before, x in zip(e[:-1], e[1:], strict=True):
        v = omega + alpha * before * before + beta * v
        ll -= 0.5 * (math.log(2 * math.pi) + np.log(v) + x * x / v)
    i = int(ll.argmax())
    return float(omega[i]), float(alpha[i]), float(beta[i]), float(ll[i])


def pareto(excess: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a generalised Pareto distribution by probability-weighted moments; (0, 1) from fewer than 5 values."""
    n = len(excess)
    if n < 5:
        return 0.0, 1.0
    x = np.sort(excess)
    a0, a1 = x.mean(), (np.arange(n) / (n - 1) * x).mean()
    d = a0 - 2 * a1
    if abs(d) < 1e-10:
        return 0.0, float(a0)
    return float(np.clip(2 - a0 / d, -0.5, 1.0)), float(max(2 * a0 * a1 / d, 1e-10))


def at_risk(u: float, shape: float, scale: float, rate: float, p: float) -> float:
    """Value at risk at level p from the tail beyond u, which holds the share ``rate``; the threshold where p lies below it."""
    if not 0 < rate < 1 or 1 - p >= rate:
        return u
    q = rate / (1 - p)
    return float(np.clip(u + (scale * math.log(q) if abs(shape) < 1e-10 else scale / shape * (q**shape - 1)), 0, 10))


def beyond(u: float, shape: float, scale: float, rate: float, x: float) -> float:
    """Probability of a value above x."""
    if x <= u:
        return rate
    y = x - u
    left = math.exp(-y / scale) if abs(shape) < 1e-10 else max(0.0, 1 + shape * y / scale) ** (-1 / shape) if 1 + shape * y / scale > 0 else 0.0
    return float(np.clip(rate * left, 0, 1))


TAIL = ("shape", "scale", "exceedance_rate", "var95", "var99", "es95", "p_2std", "p_3std", "fat_tail")


def tail_risk(r: np.ndarray, window: int = 200, level: float = 0.9, least: int = 10) -> np.ndarray:
    """Peaks over threshold of the losses of the last ``window`` rows before each row, one row of ``TAIL`` a reading.

    The rows before the first full window take its values (rate 0, probabilities 5 % and 1 %), as the helper is defined: they look
    ahead. Fewer rows than a window give NaN.
    """
    out = np.full((len(r), len(TAIL)), np.nan)
    for t in range(window, len(r)):
        w = r[t - window : t]
        w = w[np.isfinite(w)]
        if len(w) < 50:
            out[t] = (0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.05, 0.01, 0.0)
            continue
        losses = -w
        u = float(np.quantile(losses, level))
        u = u if u > 0 else 1e-8
        excess = losses[losses > u] - u
        rate = len(excess) / len(losses)
        shape, scale = pareto(excess) if len(excess) >= least else (0.0, 1.0)
        v95, v99 = at_risk(u, shape, scale, rate, 0.95), at_risk(u, shape, scale, rate, 0.99)
        es = v95 * 1.5 if shape >= 1 else float(np.clip((v95 + scale - shape * u) / (1 - shape), 0, 20))
        sd = max(float(w.std()), 1e-8)
        out[t] = (shape, scale, rate, v95, v99, es, beyond(u, shape, scale, rate, 2 * sd), beyond(u, shape, scale, rate, 3 * sd), float(shape > 0.2))
    if window < len(r):
        out[:window] = out[window]
        out[:window, 2], out[:window, 6], out[:window, 7] = 0.0, 0.05, 0.01
    return out


def forward_backward(like: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of states, expected moves and log-likelihood of a hidden Markov chain (scaled recursions)."""
    n, k = like.shape
    alpha, beta, scale = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
    for t in range(n):
        alpha[t] = (start if t == 0 else alpha[t - 1] @ move) * like[t]
        scale[t] = alpha[t].sum()
        alpha[t] /= scale[t]
    for t in range(n - 2, -1, -1):
        beta[t] = move @ (like[t + 1] * beta[t + 1]) / scale[t + 1]
    post = alpha * beta
    moves = np.einsum("ti,ij,tj->ij", alpha[:-1], move, like[1:] * beta[1:] / scale[1:, None]) if n > 1 else np.zeros((k, k))
    return post / post.sum(axis=1, keepdims=True), moves, float(np.log(scale).sum())


def gaussian(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * (x[:, None] - mean) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300


def baum_welch(x: np.ndarray, states: int = 2, rounds: int = 15, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """start, moves, means and variances of a Gaussian hidden Markov model, states in order of variance, and the log-likelihoods of the rounds."""
    sd = float(x.std()) or 1.0
    mean, var = np.zeros(states), np.geomspace(0.25, 2.0, states) * sd**2
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95)
    start, seen = np.full(states, 1.0 / states), []
    for _ in range(rounds):
        post, moves, ll = forward_backward(gaussian(x, mean, var), start, move)
        seen.append(ll)
        weight = post.sum(axis=0) + 1e-300
        start, mean = post[0], (post * x[:, None]).sum(axis=0) / weight
        var = np.maximum((post * (x[:, None] - mean) ** 2).sum(axis=0) / weight, 1e-6)
        if len(x) > 1:
            move = moves / np.maximum(moves.sum(axis=1, keepdims=True), 1e-300)
        if len(seen) > 1 and abs(seen[-1] - seen[-2]) < tol:
            break
    order = np.argsort(var)
    return start[order], move[np.ix_(order, order)], mean[order], var[order], seen


def viterbi(like: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The likeliest path of states."""
    n, k = like.shape
    with np.errstate(divide="ignore"):
        score, logs = np.log(start) + np.log(like[0]), np.log(move)
        back = np.zeros((n, k), dtype=np.int64)
        for t in range(1, n):
            step = score[:, None] + logs
            back[t] = step.argmax(axis=0)
            score = step.max(axis=0) + np.log(like[t])
    path = np.zeros(n, dtype=np.int64)
    path[-1] = int(score.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


STATES = ("state", "p_volatile", "entropy", "confidence", "duration", "changed")


def hidden_states(x: np.ndarray) -> np.ndarray:
    """Columns ``STATES`` a row: Viterbi state, posterior of the volatile state, its entropy, the highest posterior, rows since the state began, whether it began here."""
    if not len(x):
        return np.zeros((0, len(STATES)))
    start, move, mean, var, _ = baum_welch(x)
    like = gaussian(x, mean, var)
    post, _, _ = forward_backward(like, start, move)
    path = viterbi(like, start, move)
    changed = np.r_[0, (np.diff(path) != 0).astype(int)]
    since = np.arange(len(x)) - np.maximum.accumulate(np.where(np.r_[True, changed[1:] == 1], np.arange(len(x)), 0)) + 1
    entropy = -(post * np.log(np.maximum(post, 1e-12))).sum(axis=1)
    return np.column_stack([path, post[:, -1], entropy, post.max(axis=1), since, changed])


def isolation_scores(x: np.ndarray, trees: int = 64, sample: int = 128, seed: int = 7) -> np.ndarray:
    """Scores of a plain isolation forest: 2 ** -(mean depth / mean depth of an unsuccessful search)."""
    n = len(x)
    if n < 2:
        return np.full(n, 0.5)
    rng, size = np.random.default_rng(seed), min(sample, n)
    usual = lambda m: 0.0 if m <= 1 else 1.0 if m == 2 else 2 * (math.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m
    total = np.zeros(n)
    for _ in range(trees):
        todo = [(rng.choice(n, size, replace=False), np.arange(n), 0)]
        while todo:
            drawn, rows, depth = todo.pop()
            lo, hi = (x[drawn].min(axis=0), x[drawn].max(axis=0)) if len(drawn) else (None, None)
            if len(drawn) <= 1 or depth >= math.ceil(math.log2(size)) or not (hi > lo).any():
                total[rows] += depth + usual(len(drawn))
                continue
            f = int(rng.choice(np.flatnonzero(hi > lo)))
            at = rng.uniform(lo[f], hi[f])
            for side in (True, False):
                part = rows[(x[rows, f] <= at) == side]
                if len(part):
                    todo.append((drawn[(x[drawn, f] <= at) == side], part, depth + 1))
    return np.power(2.0, -total / trees / usual(size))
