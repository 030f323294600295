"""The cutting-stock problem by column generation, for a histogram of lengths.

The master program minimises the number of stocks over the patterns known so far, solved by a revised simplex; its duals price
the lengths, and an unbounded knapsack by dynamic programming finds the pattern of most value. Generation ends when Farley's bound
shows the program within GAP of its optimum. The patterns are rounded down and the rest is filled first-fit decreasing. All of
this works on the histogram alone, so neither its time nor its memory depends on how many documents there are.
"""

from __future__ import annotations

import numpy as np

GAP = 5e-4


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most value of whole items of sizes 1, 2, ... within capacity (values[s - 1] is that of size s), and how many of each size."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        top = min(c, len(values))
        v = best[c - top : c][::-1] + values[:top]
        k = int(v.argmax())
        if v[k] > best[c - 1] + 1e-15:
            best[c], took[c] = v[k], k + 1
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(values), np.int64), capacity
    while c > 0:
        if took[c]:
            counts[took[c] - 1] += 1
            c -= took[c]
        else:
            c -= 1
    return float(best[capacity]), counts


def relaxed(demand: np.ndarray, capacity: int, gap: float = GAP, most: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used in a nearly optimal solution of the linear program. demand[s - 1]: pieces of size s.

    It ends once the objective is within the gap, or a quarter of a stock, of the best bound, or hasn't fallen for as many rounds as
    there are sizes: a degenerate basis can turn without end.
    """
    sizes = np.nonzero(demand)[0] + 1
    n = len(sizes)
    if not n:
        return []
    b = demand[sizes - 1].astype(np.float64)
    per = capacity // sizes
    columns, costs = np.diag(per.astype(np.float64)), np.ones(n)
    inverse, x = np.diag(1.0 / per), b / per
    bound, lowest, stale = 0.0, np.inf, 0
    for turn in range(1, most + 1):
        objective = float(costs @ x)
        lowest, stale = (objective, 0) if objective < lowest * (1 - 1e-7) else (lowest, stale + 1)
        if stale > n + 20:
            break
        duals = costs @ inverse
        down = int(duals.argmin())
        if duals[down] < -1e-9:
            entering, cost = np.zeros(n), 0.0
            entering[down] = -1.0
        else:
            values = np.zeros(capacity)
            values[sizes - 1] = np.maximum(duals, 0)
            value, counts = knapsack(values, capacity)
            bound = max(bound, objective / value)
            if value <= 1 + 1e-9 or objective - bound <= max(gap * objective, 0.25):
                break
            entering, cost = counts[sizes - 1].astype(np.float64), 1.0
        d = inverse @ entering
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 1e-10, x / d, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        theta = ratio[out]
        x = np.maximum(x - theta * d, 0)
        x[out] = theta
        row = inverse[out] / d[out]
        inverse = inverse - np.outer(d, row)
        inverse[out] = row
        columns[:, out], costs[out] = entering, cost
        if turn % 500 == 0:
            inverse = np.linalg.inv(columns)
            x = np.maximum(inverse @ b, 0)
    patterns = []
    for k in range(n):
        if costs[k] and x[k] > 1e-9:
            counts = np.zeros(capacity, np.int64)
            counts[sizes - 1] = np.rint(columns[:, k]).astype(np.int64)
            patterns.append((counts, float(x[k])))
    return patterns


def solve(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole patterns (pieces of each size) with the number of stocks cut so; together they hold exactly the demand."""
    left = demand.astype(np.int64).copy()
    plan: list[tuple[np.ndarray, int]] = []
    for counts, x in sorted(relaxed(demand, capacity), key=lambda p: (-p[1], p[0].tolist())):
        some = counts > 0
        times = min(int(x + 1e-6), int((left[some] // counts[some]).min()))
        if times:
            plan.append((counts, times))
            left -= counts * times
    while left.any():
        counts, room = np.zeros_like(left), capacity
        while room:
            fits = np.nonzero((left - counts)[:room])[0]
            if not len(fits):
                break
            s = int(fits[-1]) + 1
            k = min(room // s, int(left[s - 1] - counts[s - 1]))
            counts[s - 1] += k
            room -= k * s
        some = counts > 0
        times = int((left[some] // counts[some]).min())
        plan.append((counts, times))
        left -= counts * times
    return plan
