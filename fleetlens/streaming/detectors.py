"""The four sequential drift detectors, one small object per key. State goes to and from plain lists."""

from __future__ import annotations

import math

import numpy as np

from fleetlens import settings as S


class Adwin:
    """Adaptive windowing on an exponential histogram (Bifet & Gavalda 2007) with a grace period.

    ``rows[i]`` holds at most five buckets of 2^i values each, newest row first, as (sum, squared deviation).
    """

    CLOCK, MOST, SHORTEST, WARM = 32, 5, 5, 10

    def __init__(self, delta: float, grace: int = 0) -> None:
        self.delta, self.grace = delta, grace
        self.seen, self.total, self.spread, self.width = 0, 0.0, 0.0, 0
        self.rows: list[list[tuple[float, float]]] = [[]]

    def update(self, x: float) -> bool:
        self.seen += 1
        if self.width:
            self.spread += self.width * (x - self.total / self.width) ** 2 / (self.width + 1)
        self.width += 1
        self.total += x
        self.rows[0].append((x, 0.0))
        self._compress()
        shrunk = self.seen % self.CLOCK == 0 and self.width > self.WARM and self._shrink()
        return shrunk and self.seen > self.grace

    def _compress(self) -> None:
        for level, row in enumerate(self.rows):
            if len(row) <= self.MOST:
                return
            (s0, v0), (s1, v1) = row.pop(0), row.pop(0)
            size = 2**level
            gap = s0 / size - s1 / size
            if level + 1 == len(self.rows):
                self.rows.append([])
            self.rows[level + 1].append((s0 + s1, v0 + v1 + size / 2 * gap * gap))

    def _shrink(self) -> bool:
        """Drops old buckets while an older and a newer part of the window differ too much."""
        changed = False
        while self._cut_exists():
            changed = True
            level = len(self.rows) - 1
            s, v = self.rows[level].pop(0)
            size = 2**level
            self.width -= size
            self.total -= s
            gap = s / size - self.total / self.width
            self.spread -= v + size * self.width * gap * gap / (size + self.width)
            while len(self.rows) > 1 and not self.rows[-1]:
                self.rows.pop()
        return changed

    def _cut_exists(self) -> bool:
        if self.width <= self.WARM:
            return False
        variance = max(self.spread, 0.0) / self.width
        strictness = math.log(2 * math.log(self.width) / self.delta)
        n0, s0 = 0, 0.0
        for level in range(len(self.rows) - 1, -1, -1):
            for s, _ in self.rows[level]:
                n0 += 2**level
                s0 += s
                n1 = self.width - n0
                if n1 < self.SHORTEST:
                    return False
                if n0 < self.SHORTEST:
                    continue
                m = 1 / (n0 - self.SHORTEST + 1) + 1 / (n1 - self.SHORTEST + 1)
                bound = math.sqrt(2 * m * variance * strictness) + 2 / 3 * strictness * m
                if abs(s0 / n0 - (self.total - s0) / n1) > bound:
                    return True
        return False

    def dump(self) -> list:
        return [self.delta, self.grace, self.seen, self.total, self.spread, self.width, self.rows]

    @classmethod
    def restore(cls, state: list) -> Adwin:
        d = cls(state[0], state[1])
        d.seen, d.total, d.spread, d.width = state[2:6]
        d.rows = [[tuple(b) for b in row] for row in state[6]]
        return d


class PageHinkley:
    """Two-sided Page-Hinkley test with a forgetting factor."""

    def __init__(self, delta: float, threshold: float, least: int = 1, keep: float = S.PAGE_HINKLEY_KEEP) -> None:
        self.delta, self.threshold, self.least, self.keep = delta, threshold, least, keep
        self.n, self.mean, self.up, self.down, self.low, self.high = 0, 0.0, 0.0, 0.0, math.inf, -math.inf

    def update(self, x: float) -> bool:
        self.n += 1
        self.mean += (x - self.mean) / self.n
        gap = x - self.mean
        self.up = self.keep * self.up + gap - self.delta
        self.down = self.keep * self.down + gap + self.delta
        self.low, self.high = min(self.low, self.up), max(self.high, self.down)
        return self.n >= self.least and max(self.up - self.low, self.high - self.down) > self.threshold

    def dump(self) -> list:
        return [
            self.delta, self.threshold, self.least, self.keep, self.n, self.mean, self.up, self.down, self.low, self.high
        ]

    @classmethod
    def restore(cls, state: list) -> PageHinkley:
        d = cls(*state[:4])
        d.n, d.mean, d.up, d.down, d.low, d.high = state[4:]
        return d


def ks_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Largest gap between two empirical distribution functions."""
    a, b = np.sort(a), np.sort(b)
    values = np.concatenate([a, b])
    gap = np.searchsorted(a, values, "right") / len(a) - np.searchsorted(b, values, "right") / len(b)
    return float(np.abs(gap).max())


def sliding_distances(values: np.ndarray, ends: np.ndarray, size: int, stat: int, at_once: int = 64) -> np.ndarray:
    """Distances of the last ``stat`` values of the windows that end at ``ends`` from the values before them.

    Windows that follow each other share one order of their values: a value adds 1 / n to the gap of the distribution
    functions where it is of the older part, takes 1 / m where it is of the newer, and running sums give the gap.
    """
    out = np.empty(len(ends))
    for i in range(0, len(ends), at_once):
        part = ends[i : i + at_once]
        begin = part[0] - size + 1
        held = values[begin : part[-1] + 1]
        order = np.argsort(held, kind="stable")
        last = np.append(np.diff(held[order]) != 0, True)  # of equal values, the last sees them all
        age = (part - begin)[:, None] - order[None, :]  # 0 for the newest value of a window
        gap = np.where((age >= stat) & (age < size), 1 / (size - stat), 0.0) - np.where((age >= 0) & (age < stat), 1 / stat, 0.0)
        out[i : i + at_once] = np.abs(np.cumsum(gap, axis=1)[:, last]).max(axis=1)
    return out


def ks_p_value(distance: float, n: int, m: int) -> float:
    """Asymptotic two-sided p-value."""
    size = math.sqrt(n * m / (n + m))
    level = (size + 0.12 + 0.11 / size) * distance
    if level < 0.2:
        return 1.0
    total = sum((-1) ** (j - 1) * math.exp(-2 * j * j * level * level) for j in range(1, 101))
    return min(1.0, max(0.0, 2 * total))


def ks_p_values(distances: np.ndarray, n: int, m: int) -> np.ndarray:
    """The p-values of many distances at once."""
    size = math.sqrt(n * m / (n + m))
    level = (size + 0.12 + 0.11 / size) * distances
    total = np.zeros(len(level))
    for j in range(1, 101):
        total += (-1) ** (j - 1) * np.exp(-2 * j * j * level * level)
    return np.where(level < 0.2, 1.0, np.clip(2 * total, 0.0, 1.0))


class Kswin:
    """Two-sample Kolmogorov-Smirnov test of the newest values against a sample of the older ones."""

    def __init__(self, alpha: float, size: int, stat: int, seed: int = 42) -> None:
        self.alpha, self.size, self.stat, self.seed = alpha, size, stat, seed
        self.window: list[float] = []
        self.tests = 0

    def update(self, x: float) -> bool:
        self.window.append(x)
        if len(self.window) > self.size:
            self.window.pop(0)
        if len(self.window) < self.size:
            return False
        values = np.asarray(self.window)
        older, recent = values[: self.size - self.stat], values[-self.stat :]
        if len(older) > self.stat:
            older = np.random.default_rng([self.seed, self.tests]).choice(older, self.stat, replace=False)
        self.tests += 1
        distance = ks_distance(older, recent)
        fired = distance > S.KSWIN_LEAST and ks_p_value(distance, len(older), len(recent)) <= self.alpha
        if fired:
            self.window = self.window[-self.stat :]
        return fired

    def dump(self) -> list:
        return [self.alpha, self.size, self.stat, self.seed, self.tests, self.window]

    @classmethod
    def restore(cls, state: list) -> Kswin:
        d = cls(*state[:4])
        d.tests, d.window = state[4], list(state[5])
        return d


class Spc:
    """Fires after ``needed`` consecutive values above the threshold, past a grace period."""

    def __init__(self, threshold: float, needed: int, grace: int = 0) -> None:
        self.threshold, self.needed, self.grace = threshold, needed, grace
        self.seen, self.run = 0, 0

    def update(self, x: float) -> bool:
        self.seen += 1
        if self.seen <= self.grace:
            return False
        self.run = self.run + 1 if x > self.threshold else 0
        return self.run >= self.needed

    def dump(self) -> list:
        return [self.threshold, self.needed, self.grace, self.seen, self.run]

    @classmethod
    def restore(cls, state: list) -> Spc:
        d = cls(*state[:3])
        d.seen, d.run = state[3:]
        return d


KINDS = {"ADWIN": Adwin, "PAGE_HINKLEY": PageHinkley, "KSWIN": Kswin, "SPC": Spc}


def smooth(errors: np.ndarray, samples: int) -> np.ndarray:
    """Rolling mean of the last ``samples`` values, of fewer at the start."""
    sums = np.concatenate([[0.0], np.cumsum(errors)])
    upto = np.arange(1, len(errors) + 1)
    start = np.maximum(upto - samples, 0)
    return (sums[upto] - sums[start]) / (upto - start)


def fires(detector, values) -> bool:
    return any(detector.update(float(v)) for v in values)


def longest_run(flags: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(int), [0]])))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0
