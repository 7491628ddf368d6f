"""Searches over settings, batch by batch: each batch of trials is one job over all symbols.

``density_search`` models where good trials lie: the best share of what was tried
and the rest each get a density, a mixture of bells of which every trial is a centre;
from many draws of the good one those are tried next that are likeliest under the good
density against the other. ``front_search`` has two aims: a generation is ranked by
how many layers of better trials lie above it and, within a layer, by how lonely a
trial is; parents are chosen by lots of two, crossed and changed a little. Both draw
from a seed alone, so a search can be repeated.

The history of trials is as long as there are trials: it lives on the driver; the
bars never do.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass

Point = dict[str, float]


@dataclass(frozen=True)
class Setting:
    """One dimension of a space: a range of numbers, whole or not."""

    name: str
    low: float
    high: float
    whole: bool = False
    digits: int = 6

    def shape(self, x: float) -> float:
        """The nearest value that the setting can take."""
        x = min(self.high, max(self.low, x))
        return int(round(x)) if self.whole else round(x, self.digits)

    def draw(self, r: random.Random) -> float:
        return self.shape(r.uniform(self.low - 0.5, self.high + 0.5) if self.whole else r.uniform(self.low, self.high))


def _bell_mass(s: Setting, centre: float, width: float) -> float:
    """The share of a bell that lies in the range, for densities that are cut off there."""
    side = lambda x: math.erf((x - centre) / (width * math.sqrt(2)))
    return max(1e-12, (side(s.high) - side(s.low)) / 2)


def _mixture(s: Setting, values: Sequence[float], tried: int) -> list[tuple[float, float]]:
    """(centre, width) of each bell: as wide as the gap to its farther neighbour, narrower the more was tried; one wide bell stands for the unknown."""
    span, marks = s.high - s.low, sorted(values)
    least, out = span / min(100.0, 1.0 + tried), []
    for k, x in enumerate(marks):
        gaps = [x - marks[k - 1] if k else x - s.low, marks[k + 1] - x if k + 1 < len(marks) else s.high - x]
        out.append((x, min(span, max(least, *gaps))))
    return [*out, ((s.low + s.high) / 2, span)]


def _log_density(s: Setting, bells: list[tuple[float, float]], x: float) -> float:
    half = 0.5 if s.whole else 0.0
    total = 0.0
    for centre, width in bells:
        if s.whole:
            share = (math.erf((x + half - centre) / (width * math.sqrt(2))) - math.erf((x - half - centre) / (width * math.sqrt(2)))) / 2
        else:
            share = math.exp(-(((x - centre) / width) ** 2) / 2) / (width * math.sqrt(2 * math.pi))
        total += share / _bell_mass(s, centre, width)
    return math.log(max(1e-300, total / len(bells)))


def propose(space: Sequence[Setting], tried: Sequence[tuple[Point, float]], n: int, r: random.Random, share: float = 0.2, draws: int = 32) -> list[Point]:
    """n points to try next, given (point, gain) of those tried; each of them counts as tried, and bad, for the following ones."""
    ranked = sorted(tried, key=lambda t: -t[1])
    cut = min(25, max(2, math.ceil(2 * share * math.sqrt(len(ranked)))))
    good, bad = [p for p, _ in ranked[:cut]], [p for p, _ in ranked[cut:]]
    out: list[Point] = []
    for _ in range(n):
        point: Point = {}
        for s in space:
            near, far = _mixture(s, [p[s.name] for p in good], len(tried)), _mixture(s, [p[s.name] for p in bad], len(tried))
            found = []
            for _ in range(draws):
                centre, width = r.choice(near)
                x = r.gauss(centre, width)
                while not s.low - 0.5 * s.whole <= x <= s.high + 0.5 * s.whole:
                    x = r.gauss(centre, width)
                x = s.shape(x)
                found.append((_log_density(s, near, x) - _log_density(s, far, x), x))
            point[s.name] = max(found)[1]
        out.append(point)
        bad.append(point)
    return out


def density_search(space: Sequence[Setting], judge: Callable[[list[Point]], list[float]], trials: int = 50, first: int = 10, batch: int = 5, seed: int = 0) -> list[tuple[Point, float]]:
    """(point, gain) of all trials in order: ``first`` at random, the others in batches by the densities of those before. A gain that is no number counts as the worst."""
    r = random.Random(f"{seed}/density")
    told: list[tuple[Point, float]] = []
    while len(told) < trials:
        n = min(trials - len(told), first if not told else batch)
        points = [{s.name: s.draw(r) for s in space} for _ in range(n)] if not told else propose(space, told, n, r)
        told += [(p, -math.inf if g is None or math.isnan(g) else g) for p, g in zip(points, judge(points), strict=True)]
    return told


def layers(aims: Sequence[tuple[float, float]]) -> list[int]:
    """The layer of each (gain, cost): 0 where no other has at least as much gain and at most as much cost, one of them strictly; layer k where that holds without the layers before."""
    order = sorted(range(len(aims)), key=lambda i: (-aims[i][0], aims[i][1]))
    out = [0] * len(aims)
    tops: list[tuple[float, float]] = []  # of each layer the last taken (gain, cost): the cheapest of it so far
    for i in order:
        gain, cost = aims[i]
        k = 0
        while k < len(tops) and tops[k][1] <= cost and tops[k] != (gain, cost):
            k += 1
        if k == len(tops):
            tops.append((gain, cost))
        else:
            tops[k] = (gain, cost)
        out[i] = k
    return out


def loneliness(aims: Sequence[tuple[float, float]], layer: Sequence[int]) -> list[float]:
    """The room that each trial has in its layer: the sides of the box between its neighbours, in shares of the layer's extent; ends have no end of it."""
    out = [0.0] * len(aims)
    for k in set(layer):
        own = [i for i in range(len(aims)) if layer[i] == k]
        for aim in (0, 1):
            row = sorted(own, key=lambda i: aims[i][aim])
            extent = aims[row[-1]][aim] - aims[row[0]][aim]
            out[row[0]] = out[row[-1]] = math.inf
            for a, i, b in zip(row[:-2], row[1:-1], row[2:], strict=True):
                out[i] += (aims[b][aim] - aims[a][aim]) / extent if extent else 0.0
    return out


def _child(space: Sequence[Setting], a: Point, b: Point, r: random.Random, spread: float = 15.0) -> Point:
    """Between or just beyond its parents, each setting changed with a chance of one in as many as there are."""
    out: Point = {}
    for s in space:
        x, y = a[s.name], b[s.name]
        if r.random() < 0.9 and x != y:
            u = r.random()
            beta = (2 * u) ** (1 / (spread + 1)) if u <= 0.5 else (1 / (2 * (1 - u))) ** (1 / (spread + 1))
            x = ((1 + beta) * x + (1 - beta) * y) / 2 if r.random() < 0.5 else ((1 - beta) * x + (1 + beta) * y) / 2
        elif r.random() < 0.5:
            x = y
        if r.random() < 1 / len(space):
            x += r.gauss(0, (s.high - s.low) / 10)
        out[s.name] = s.shape(x)
    return out


def front_search(space: Sequence[Setting], judge: Callable[[list[Point]], list[tuple[float, float]]], trials: int = 80, size: int = 16, seed: int = 0) -> list[tuple[Point, tuple[float, float]]]:
    """(point, (gain, cost)) of all trials in order, ``size`` a generation; what is no number counts as the worst."""
    r = random.Random(f"{seed}/front")
    sound = lambda g, c: (-math.inf if g is None or math.isnan(g) else g, math.inf if c is None or math.isnan(c) else c)
    told: list[tuple[Point, tuple[float, float]]] = []
    alive: list[tuple[Point, tuple[float, float]]] = []
    while len(told) < trials:
        n = min(size, trials - len(told))
        if not alive:
            points = [{s.name: s.draw(r) for s in space} for _ in range(n)]
        else:
            layer = layers([a for _, a in alive])
            room = loneliness([a for _, a in alive], layer)
            better = lambda: min((r.randrange(len(alive)) for _ in "ab"), key=lambda i: (layer[i], -room[i]))  # noqa: B023, E731
            points, seen = [], {tuple(p.values()) for p, _ in told}
            while len(points) < n:
                child = _child(space, alive[better()][0], alive[better()][0], r)
                for _ in range(20):  # what was tried is not tried again, if the space has more
                    if tuple(child.values()) not in seen:
                        break
                    child = {s.name: s.shape(child[s.name] + r.gauss(0, (s.high - s.low) / 10)) for s in space}
                seen.add(tuple(child.values()))
                points.append(child)
        new = [(p, sound(*a)) for p, a in zip(points, judge(points), strict=True)]
        told += new
        pool = alive + new
        layer = layers([a for _, a in pool])
        room = loneliness([a for _, a in pool], layer)
        alive = [pool[i] for i in sorted(range(len(pool)), key=lambda i: (layer[i], -room[i], i))[:size]]
    return told
