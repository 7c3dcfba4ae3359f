"""Seatings of Chinese restaurants in a Pitman-Yor process, sampled by Gibbs for all dishes at once.

Of a seating, all that later steps use are the customers and tables of each dish in each
restaurant, so table sizes are summed out. With discount ``d``, strength ``s``, ``T`` tables in the
restaurant and ``p`` the dish's weight one level up, ``t`` tables for ``c`` customers weigh

    S(c, t) * p**t * (s) (s + d) ... (s + (T - 1) d),     S generalised Stirling numbers.

The last product ties the dishes of a restaurant together. It is an integral over a gamma variable:
given a draw ``x`` of shape ``s / d + T`` for the restaurant, dishes are independent, each with
weights ``S(c, t) * (d * x * p)**t``. So a sweep draws ``x`` for each restaurant and then seats all
customers of all dishes anew, whatever their number.

Randomness is a hash of what is drawn, so results do not depend on order or partitions.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Up to so many customers the Stirling numbers are exact; beyond, they come from the saddle point.
EXACT = 1024
#: Points at which the weights of large dishes are taken.
POINTS = 129


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """Well mixed 64-bit hashes of hashes."""
    z = keys.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """A number between 0 and 1, neither included, for each key."""
    return ((mixed(keys, salt) >> np.uint64(12)).astype(float) + 0.5) / 2.0**52


def gamma(shape: np.ndarray, keys: np.ndarray, salt: int) -> np.ndarray:
    """A gamma variable for each key, by rejection from a cubed normal; its mean in the one of
    10**20 cases where sixteen tries fail."""
    small = shape < 1
    d = np.where(small, shape + 1, shape) - 1 / 3
    c = 1 / np.sqrt(9 * d)
    result = d.copy()
    open_ = np.arange(len(result))
    for attempt in range(16):
        k, at = keys[open_], salt * 64 + attempt * 4
        normal = np.sqrt(-2 * np.log(uniform(k, at))) * np.cos(2 * np.pi * uniform(k, at + 1))
        v = (1 + c[open_] * normal) ** 3
        ok = v > 0
        logs = np.log(np.where(ok, v, 1.0))
        ok &= np.log(uniform(k, at + 2)) < 0.5 * normal**2 + d[open_] * (1 - v + logs)
        result[open_[ok]] = (d[open_] * v)[ok]
        open_ = open_[~ok]
        if not len(open_):
            break
    power = uniform(keys, salt * 64 + 3) ** (1 / np.maximum(shape, 1e-9))
    return np.where(small, result * power, result)


@lru_cache(maxsize=4)
def stirling(discount: float) -> np.ndarray:
    """Logarithms of S(c, t), rows by ``c`` and columns by ``t``, up to ``EXACT``."""
    logs = np.full((EXACT + 1, EXACT + 1), -np.inf)
    logs[0, 0] = 0.0
    t = np.arange(EXACT + 1)
    for c in range(EXACT):
        with np.errstate(divide="ignore"):
            stay = logs[c] + np.log(np.maximum(c - t * discount, 0))
        logs[c + 1] = stay
        logs[c + 1, 1:] = np.logaddexp(stay[1:], logs[c, :-1])
    return logs


def _bisected(rising, low: float, size: int) -> np.ndarray:
    """Where a function of log(y) that rises from below zero to above passes it, ``low < log y < 0``."""
    a, b = np.full(size, low), np.full(size, -1e-12)
    for _ in range(60):
        middle = (a + b) / 2
        above = rising(middle) > 0
        a, b = np.where(above, a, middle), np.where(above, middle, b)
    return (a + b) / 2


def _factorial(n: np.ndarray) -> np.ndarray:
    """log(n!) for n of 1 or more, by Stirling's series (exact to 1e-9 after the shift by 8)."""
    n = np.asarray(n, float)
    shift = sum(np.log(n + i) for i in range(1, 9))
    m = n + 8
    return m * np.log(m) - m + 0.5 * np.log(2 * np.pi * m) + 1 / (12 * m) - 1 / (360 * m**3) - shift


def saddle(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log S(c, t) up to a term of ``c``: S is c! / (d**t t!) times the coefficient of x**c in
    (1 - (1 - x)**d)**t."""
    shape = np.broadcast(c, t).shape
    c, t = (np.broadcast_to(v, shape).ravel().astype(float) for v in (c, t))
    ratio, d = np.maximum(c / t, 1 + 1e-9), discount

    def mean(log_y):
        y = np.exp(log_y)
        return (1 - y) * d * np.exp((d - 1) * log_y) / -np.expm1(d * log_y)

    log_y = _bisected(lambda v: ratio - mean(v), -600.0, len(t))
    y = np.exp(log_y)
    x, f = -np.expm1(log_y), -np.expm1(d * log_y)
    # The variance of the tilted variable: x m'(x) with m the mean.
    m = mean(log_y)
    spread = m * (1 + (1 - d) * x / y - m)
    # Near x = 0 (t close to c) it is (1 - d) x / 2, which the formula loses to rounding.
    spread = np.where(x < 1e-4, (1 - d) * x / 2, spread)
    logs = t * np.log(f) - c * np.log(np.maximum(x, 1e-300)) - 0.5 * np.log(np.maximum(t * spread, 0.16))
    return (logs - t * np.log(d) - _factorial(t)).reshape(shape)


@lru_cache(maxsize=4)
def _correction(discount: float) -> np.ndarray:
    """What the saddle point misses by number of tables; it hardly depends on the customers."""
    t = np.arange(1, EXACT // 4)
    off = stirling(discount)[EXACT, 1 : EXACT // 4] - saddle(np.array(EXACT), t, discount)
    return off - off[-1]


def tables(customers: np.ndarray, weight: np.ndarray, discount: float, keys: np.ndarray, salt: int) -> np.ndarray:
    """Tables for each dish, drawn with weights S(c, t) * weight**t; none for no customer."""
    result = np.minimum(customers, 1)
    at_random = uniform(keys, salt)
    logs = np.log(weight)
    exact = stirling(discount)
    seated = np.flatnonzero((customers > 1) & (customers <= EXACT))
    seated = seated[np.argsort(customers[seated], kind="stable")]
    sizes, starts = np.unique(customers[seated], return_index=True)
    ends = np.append(starts, len(seated))[1:]
    for c, begin, end in zip(sizes.tolist(), starts.tolist(), ends.tolist(), strict=True):
        t = np.arange(1, c + 1)
        step = max(1, 1_000_000 // c)
        for first in range(begin, end, step):
            who = seated[first : min(first + step, end)]
            result[who] = 1 + _drawn(exact[c, 1 : c + 1] + logs[who, None] * t, at_random[who])[0]
    large = np.flatnonzero(customers > EXACT)
    for first in range(0, len(large), 2000):
        who = large[first : first + 2000]
        result[who] = _large(customers[who], logs[who], discount, at_random[who])
    return result


def _drawn(logs: np.ndarray, at_random: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A column for each row of log weights, and the place in it (0 to 1)."""
    weights = np.exp(logs - logs.max(1, keepdims=True))
    sums = np.cumsum(weights, 1)
    goal = at_random * sums[:, -1]
    column = np.minimum((sums < goal[:, None]).sum(1), logs.shape[1] - 1)
    rows = np.arange(len(logs))
    before = sums[rows, column] - weights[rows, column]
    return column, np.clip((goal - before) / np.maximum(weights[rows, column], 1e-300), 0, 1)


def _large(c: np.ndarray, logs: np.ndarray, discount: float, at_random: np.ndarray) -> np.ndarray:
    """Tables of dishes with many customers: weights at ``POINTS`` places around the mode."""
    d, log_a = discount, logs - np.log(discount)
    # At the mode t = A f(x) and c = A x f'(x), with A the weight over the discount.
    goal = np.log(c) - log_a - np.log(d)
    log_y = _bisected(lambda v: goal - np.log(-np.expm1(v)) - (d - 1) * v, -600.0, len(c))
    mode = np.clip(np.exp(log_a) * -np.expm1(d * log_y), 1, c)
    low = np.maximum(1, np.floor(mode - 8 * np.sqrt(mode) - 8))
    high = np.minimum(c, np.ceil(mode + 8 * np.sqrt(mode) + 8))
    step = np.maximum(1.0, (high - low) / (POINTS - 1))
    t = low[:, None] + np.arange(POINTS) * step[:, None]
    inside = t <= high[:, None] + 1e-6
    t = np.minimum(t, c[:, None])
    off = _correction(d)
    value = saddle(c[:, None], t, d) + t * logs[:, None]
    value += np.where(t < len(off), off[np.minimum(t.astype(np.int64) - 1, len(off) - 1)], 0.0)
    column, inner = _drawn(np.where(inside, value, -np.inf), at_random)
    drawn = low + column * step + np.where(step > 1, (inner - 0.5) * step, 0.0)
    return np.clip(np.rint(drawn), 1, c).astype(np.int64)
