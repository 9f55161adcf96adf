"""Pure folds for ``scan`` and for stateful streams: (state, row) -> (state, outputs). State is a plain dict of numbers and lists."""

from __future__ import annotations

import math

#: Shocks an EGARCH filter keeps for their mean.
SHOCKS = 5


def cooldown(bars: int):
    """Let a flag through only if more than ``bars`` rows have passed since it was last let through."""

    def fold(s: dict, row: dict) -> tuple[dict, dict]:
        i, last = s["i"], s["last"]
        emit = bool(row["flag"]) and (last is None or i - last > bars)
        return {"i": i + 1, "last": i if emit else last}, {"emitted": int(emit)}

    return fold, lambda: {"i": 0, "last": None}


def supertrend(multiplier: float):
    """Trend direction that flips where close crosses the band of the other side; bands only tighten while it holds."""

    def fold(s: dict, row: dict) -> tuple[dict, dict]:
        atr = row["atr"]
        if atr is None or atr != atr:
            return s | {"close": row["close"]}, {"direction": 1}
        mid = (row["high"] + row["low"]) / 2
        upper, lower = mid + multiplier * atr, mid - multiplier * atr
        if s["upper"] is not None:
            upper = upper if upper < s["upper"] or s["close"] > s["upper"] else s["upper"]
            lower = lower if lower > s["lower"] or s["close"] < s["lower"] else s["lower"]
            d = -1 if s["d"] == 1 and row["close"] < lower else 1 if s["d"] == -1 and row["close"] > upper else s["d"]
        else:
            d = 1
        return {"upper": upper, "lower": lower, "close": row["close"], "d": d}, {"direction": d}

    return fold, lambda: {"upper": None, "lower": None, "close": None, "d": 1}


def kalman(q: float = 1e-4, r: float = 1e-2):
    """Constant-velocity filter: filtered level and slope of a series, and the standardised innovation."""

    def fold(s: dict, row: dict) -> tuple[dict, dict]:
        z = row["value"]
        if z is None or z != z:
            return s, {"level": s["x"], "slope": s["v"], "innovation": None}
        if s["x"] is None:
            return {"x": z, "v": 0.0, "p": [1.0, 0.0, 1.0]}, {"level": z, "slope": 0.0, "innovation": 0.0}
        a, b, c = s["p"]
        x, v = s["x"] + s["v"], s["v"]
        a, b, c = a + 2 * b + c + q / 4, b + c + q / 2, c + q
        e, var = z - x, a + r
        k, m = a / var, b / var
        return {"x": x + k * e, "v": v + m * e, "p": [a * (1 - k), b * (1 - k), c - m * b]}, {"level": x + k * e, "slope": v + m * e, "innovation": e / math.sqrt(var)}

    return fold, lambda: {"x": None, "v": None, "p": None}


def _running(s: dict, key: str, value: float) -> float:
    """Distance of a value from the mean of all up to it, in standard deviations; moments are kept in the state."""
    n, a, b = s.get(key) or (0, 0.0, 0.0)
    n, a, b = n + 1, a + value, b + value * value
    s[key] = (n, a, b)
    return (value - a / n) / math.sqrt(max(b / n - (a / n) ** 2, 1e-10))


def kalman_acceleration(q: float = 1e-4, r: float = 1e-2):
    """Constant-acceleration filter (level, velocity, acceleration) with running distances of innovation and velocity.

    Gives deviation of the filtered level, velocity, acceleration, remaining error, innovation, its running z, and the regime of
    velocity (2 above one standard deviation, 0 below minus one). A row without a value changes nothing.
    """
    noise = ((q / 20, q / 8, q / 6), (q / 8, q / 3, q / 2), (q / 6, q / 2, q))
    move = ((1.0, 1.0, 0.5), (0.0, 1.0, 1.0), (0.0, 0.0, 1.0))
    k3 = range(3)

    def fold(s: dict, row: dict) -> tuple[dict, dict]:
        z = row["value"]
        if z is None or z != z:
            return s, {}
        x = s["x"] or [z, 0.0, 0.0]
        p = s["p"] or [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
        x = [sum(move[i][k] * x[k] for k in k3) for i in k3]
        fp = [[sum(move[i][k] * p[k][j] for k in k3) for j in k3] for i in k3]
        p = [[sum(fp[i][k] * move[j][k] for k in k3) + noise[i][j] for j in k3] for i in k3]
        innovation = z - x[0]
        gain = [p[i][0] / (p[0][0] + r) for i in k3]
        x = [x[i] + gain[i] * innovation for i in k3]
        p = [[p[i][j] - gain[i] * p[0][j] for j in k3] for i in k3]
        s = s | {"x": x, "p": p}
        zscore = _running(s, "of_innovation", innovation)
        speed = _running(s, "of_velocity", x[1])
        return s, {"filtered_dev": x[0] - z, "velocity": x[1], "acceleration": x[2], "pred_error": z - x[0], "innovation": innovation, "zscore": zscore, "regime": 2 if speed > 1 else 0 if speed < -1 else 1}

    return fold, lambda: {"x": None, "p": None, "of_innovation": None, "of_velocity": None}


def cusum(threshold: float, drift: float, spacing: int):
    """Change points: cumulative sums of standardised values beyond ``drift``, reset on an alarm, alarms ``spacing`` rows apart."""

    def fold(s: dict, row: dict) -> tuple[dict, dict]:
        z, i = row["value"], s["i"]
        up, down = s["up"], s["down"]
        if z is not None and z == z:
            up, down = max(0.0, up + z - drift), max(0.0, down - z - drift)
        hit = (up > threshold or down > threshold) and i - s["last"] >= spacing
        if hit:
            up = down = 0.0
        last = i if hit else s["last"]
        return {"i": i + 1, "up": up, "down": down, "last": last}, {"change": int(hit), "since": min(i - last, 1_000_000)}

    return fold, lambda: {"i": 0, "up": 0.0, "down": 0.0, "last": -1_000_000}


def egarch(omega: float, alpha: float, gamma: float, beta: float):
    """Log-variance recursion with an asymmetric response to the standardised return, held within [-20, 10]."""
    mean_abs = math.sqrt(2 / math.pi)

    def fold(s: dict, row: dict) -> tuple[dict, dict]:
        ret, lv = row["value"], s["lv"]
        if ret is None or ret != ret:
            return s, {"volatility": None, "shock": None}
        shock = ret / math.exp(lv / 2)
        nxt = min(10.0, max(-20.0, omega + beta * lv + alpha * (abs(shock) - mean_abs) + gamma * shock))
        s = s | {"lv": nxt, "shocks": [*s.get("shocks", ()), shock][-SHOCKS:]}
        z = _running(s, "of_volatility", math.exp(lv / 2))
        return s, {"volatility": math.exp(lv / 2), "shock": shock, "zscore": z, "shock_mean": sum(s["shocks"]) / len(s["shocks"])}

    return fold, lambda: {"lv": omega / (1 - beta), "shocks": [], "of_volatility": None}


def bocpd(hazard: float = 0.01, cap: int = 100, mu: float = 0.0, kappa: float = 1.0, alpha: float = 1.0, beta: float = 1.0):
    """Online change points: run-length posterior with a Student-t predictive, run lengths up to ``cap``."""

    def fold(s: dict, row: dict) -> tuple[dict, dict]:
        x = row["value"]
        if x is None or x != x:
            return s, {"change_probability": None, "run_length": None}
        p, runs = s["p"], s["runs"]
        like = []
        for m, k, a, b in runs:
            scale, df = b * (k + 1) / (a * k), 2 * a
            like.append(math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi * scale) - (df + 1) / 2 * math.log1p((x - m) ** 2 / (df * scale))))
        joint = [w * f for w, f in zip(p, like, strict=True)]
        grown = [sum(joint) * hazard, *(j * (1 - hazard) for j in joint)]
        new = [(mu, kappa, alpha, beta), *((( k * m + x) / (k + 1), k + 1, a + 0.5, b + k * (x - m) ** 2 / (2 * (k + 1))) for m, k, a, b in runs)]
        grown, new = grown[:cap], new[:cap]
        total = sum(grown) or 1.0
        grown = [g / total for g in grown]
        return {"p": grown, "runs": new}, {"change_probability": grown[0], "run_length": max(range(len(grown)), key=grown.__getitem__)}

    return fold, lambda: {"p": [1.0], "runs": [(mu, kappa, alpha, beta)]}


def adaptive_level(target: float, gamma: float):
    """Adaptive conformal level: moves towards the target by the miss of each batch, held within [0.001, 0.999]."""

    def fold(s: dict, row: dict) -> tuple[dict, dict]:
        a = s["a"]
        err = row["error_rate"]
        nxt = a if err is None or err != err else min(0.999, max(0.001, a + gamma * (target - err)))
        return {"a": nxt}, {"level": a, "next_level": nxt}

    return fold, lambda: {"a": target}


def discounted_weights(gamma: float, eta: float, floor: float):
    """Discounted model averaging over an array of losses: weights before the update are reported, then w**gamma * exp(-eta * loss), floored."""

    def fold(s: dict, row: dict) -> tuple[dict, dict]:
        losses = list(row["losses"])
        w = s["w"] or [1.0 / len(losses)] * len(losses)
        new = [x**gamma * math.exp(-eta * loss) for x, loss in zip(w, losses, strict=True)]
        total = sum(new)
        new = [max(floor, x / total) for x in new]
        total = sum(new)
        return {"w": [x / total for x in new]}, {"weights": w}

    return fold, lambda: {"w": None}


def rolling_coverage(window: int, target: float, patience: int):
    """Coverage of the last ``window`` rows and an alert once it has been below target for ``patience`` rows in a row."""

    def fold(s: dict, row: dict) -> tuple[dict, dict]:
        seen = [*s["seen"], int(row["covered"])][-window:]
        cov = sum(seen) / len(seen)
        below = s["below"] + 1 if cov < target else 0
        return {"seen": seen, "below": below}, {"coverage": cov, "alert": int(below >= patience)}

    return fold, lambda: {"seen": [], "below": 0}


def ranked_buffer(window: int):
    """Rank of a value among the last ``window`` known values before it, from the second known value on; NULL rows don't advance it."""

    def fold(s: dict, row: dict) -> tuple[dict, dict]:
        x, buf = row["value"], s["buf"]
        if x is None or x != x:
            return s, {"rank": None}
        rank = sum(b <= x for b in buf) / len(buf) if buf else None
        return {"buf": [*buf, x][-window:]}, {"rank": rank}

    return fold, lambda: {"buf": []}
