"""Mean time to loss of a stripe, by elimination on the chain of its lost chunks, and the choice of a scheme."""

from __future__ import annotations

import math

import numpy as np

#: Fixed values: (data, parity) of the erasure codes, copies being (1, n - 1).
CODES = [(2, 1), (3, 2), (4, 2), (6, 3), (8, 4), (10, 4), (9, 6)]
SCHEMES = [(1, 0), (1, 1), (1, 2), *CODES]
YEAR = 8766.0  # hours
TERMS = 40  # of the series over a short stretch


def chain(data: int, parity: int, failure: float, repair: float, bursts: tuple[tuple[float, float], ...] = ()) -> np.ndarray:
    """Rates between numbers of lost chunks; the last state is loss. Chunks fail alone, repairs go one at a time, a burst
    destroys each surviving chunk with its own probability."""
    width, states = data + parity, parity + 2
    q = np.zeros((states, states))
    for lost in range(parity + 1):
        alive = width - lost
        q[lost, lost + 1] += alive * failure
        if lost:
            q[lost, lost - 1] += repair
        for rate, share in bursts:
            for hit in range(1, alive + 1):
                q[lost, min(states - 1, lost + hit)] += rate * math.comb(alive, hit) * share**hit * (1 - share) ** (alive - hit)
    return q


def mean_time_to_loss(q: np.ndarray) -> float:
    """Mean time from state 0 to the last: the states between are folded into those that lead to them, one after the other."""
    q = q.copy()
    last = len(q) - 1
    hold = np.zeros(last)
    for t in range(last):
        total = q[t].sum() - q[t, t]
        if total <= 0:
            return math.inf
        hold[t] = 1 / total
        q[t] /= total
        q[t, t] = 0
    for m in range(last - 1, 0, -1):
        to = [*range(m), last]
        leave = q[m, to].sum()
        if leave <= 0:
            return math.inf
        for i in range(m):
            via = q[i, m] / leave
            q[i, to] += via * q[m, to]
            hold[i] += via * hold[m]
    return float(hold[0] / q[0, last]) if q[0, last] > 0 else math.inf


def loss_upper(q: np.ndarray, hours: float) -> float:
    """An upper end of the probability of loss within a time: the computed one, its rounding and the cut series added.

    All terms are sums of products of what isn't negative, so the relative error grows by a few units in the last place
    with each operation, and twofold with each squaring.
    """
    rate = max(float((q.sum(axis=1) - np.diag(q)).max()), 1e-300)
    squarings = max(0, math.ceil(math.log2(max(rate * hours, 1e-300) / 0.5)))
    relative = 4 * len(q) * (TERMS + 2) * 2.0**squarings * np.finfo(float).eps
    cut = 2.0**squarings * 0.5**TERMS / math.factorial(TERMS)
    return min(1.0, math.nextafter(loss_within(q, hours) * (1 + relative) + cut, 2.0))


def loss_within(q: np.ndarray, hours: float) -> float:
    """Probability of loss within a time from state 0: the chain at a common rate of events, over a stretch short enough for
    half an event, whose matrix is then squared up to the whole time."""
    rate = max(float((q.sum(axis=1) - np.diag(q)).max()), 1e-300)
    squarings = max(0, math.ceil(math.log2(max(rate * hours, 1e-300) / 0.5)))
    tau = rate * hours / 2.0**squarings
    jump = q / rate
    np.fill_diagonal(jump, 1 - (q.sum(axis=1) - np.diag(q)) / rate)
    term, total = np.eye(len(q)), np.zeros_like(q)
    weight = math.exp(-tau)
    for n in range(TERMS):
        total += weight * term
        term = term @ jump
        weight *= tau / (n + 1)
    for _ in range(squarings):
        total = total @ total
    return float(min(1.0, total[0, -1]))


def choose(domains: int, failure: float, repair: float, target: float, bursts: tuple[tuple[float, float], ...] = ()) -> tuple[int, int, float, bool] | None:
    """(data, parity, annual loss, meets): the cheapest scheme within the domains whose loss is surely within the target, of equal cost the narrower, else the safest."""
    fits = [(d, p, loss_upper(chain(d, p, failure, repair, bursts), YEAR)) for d, p in SCHEMES if d + p <= domains]
    meets = [x for x in fits if x[2] <= target]
    if meets:
        d, p, loss = min(meets, key=lambda x: ((x[0] + x[1]) / x[0], x[0] + x[1]))
        return d, p, loss, True
    return (*min(fits, key=lambda x: x[2]), False) if fits else None
