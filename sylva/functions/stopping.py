"""Overfitting detectors: fed the eval metric (larger is better) after every tree."""

from __future__ import annotations

import math
from collections import deque

#: Fixed values of the method.
FORGET, SCALE, HISTORY, EPS = 0.99, 0.5, 2000, 1e-10


class Detector:
    """Never stops."""

    stopped = False

    def add(self, value: float) -> None:
        pass


class Iter(Detector):
    """Stops ``wait`` trees after the best value."""

    def __init__(self, wait: int):
        self.wait, self.best, self.since = wait, None, 0

    def add(self, value: float) -> None:
        if self.best is None or value > self.best:
            self.best, self.since = value, 0
        else:
            self.since += 1
        self.stopped = self.since >= self.wait


class PValue(Detector):
    """Stops when ``p_value`` falls below the limit."""

    def __init__(self, limit: float, wait: int):
        self.limit, self.wait, self.best, self.last, self.p_value = limit, wait, None, None, 1.0

    def add(self, value: float) -> None:
        better = self.best is None or value > self.best
        if better:
            self.best = value
        self.p_value = self.judged(value, better)
        self.last = value
        self.stopped = self.p_value < self.limit


class IncToDec(PValue):
    """Compares the fall since the best value with the rise that the recent past lets expect."""

    def __init__(self, limit: float, wait: int):
        super().__init__(limit, wait)
        self.past, self.rise, self.since = deque(maxlen=HISTORY), 0.0, 0

    def judged(self, value: float, better: bool) -> float:
        self.since = 0 if better else self.since + 1
        self.past.appendleft(value)
        self.rise = max([self.rise * FORGET, *(FORGET**k * (value - v) for k, v in enumerate(self.past))])
        if self.since < self.wait:
            return 1.0
        return math.exp(-SCALE / max(self.rise / max(self.best - value, EPS), EPS))


class Wilcoxon(PValue):
    """Signed ranks of the steps since the best value."""

    def __init__(self, limit: float, wait: int):
        super().__init__(limit, wait)
        self.steps: list[float] = []

    def judged(self, value: float, better: bool) -> float:
        if better:
            self.steps = []
        else:
            self.steps.append(self.last - value)
        return wilcoxon(self.steps) if len(self.steps) >= self.wait else 1.0


def wilcoxon(steps: list[float]) -> float:
    """Two-sided p-value of the signed-rank test by the normal law, ties at mean rank; 0.5 without a step other than 0."""
    v = sorted((s for s in steps if s), key=abs)
    n = len(v)
    spread, positive, i = n * (n + 1) * (2 * n + 1), 0.0, 0
    while i < n:
        j = i
        while j + 1 < n and abs(v[j + 1] - v[i]) < 16 * 2.0**-52 * max(abs(v[j + 1]), abs(v[i])):
            j += 1
        size = j - i + 1
        positive += (i + j + 2) / 2 * sum(x > 0 for x in v[i : j + 1])
        spread -= size * (size - 1) * (size + 1) / 2
        i = j + 1
    if not n or spread <= 0:
        return 0.5
    z = (positive - n * (n + 1) / 4) / math.sqrt(spread / 24)
    return math.erfc(abs(z) / math.sqrt(2))


def detector(kind: str, p_value: float, wait: int) -> Detector:
    return {"None": Detector, "Iter": lambda: Iter(wait), "IncToDec": lambda: IncToDec(p_value, wait), "Wilcoxon": lambda: Wilcoxon(p_value, wait)}[kind]()
