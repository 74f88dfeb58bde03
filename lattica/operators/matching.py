"""Weighted matching in general graphs, a component in a task: Edmonds' blossoms with dual values.

Vertices are numbered from 1, blossoms from n + 1, zero is none. A cell (x, y) of the tables names the real edge that
stands for the best one between two vertices or blossoms.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.errors import SizeLimitError
from lattica.operators.kernels import Local, per_component
from lattica.operators.model import Graph

#: Nodes of a component: its tables take the square, its time the cube.
NODE_LIMIT = 2_000
_FREE, _EVEN, _ODD = -1, 0, 1


class Blossoms:
    """Grows alternating trees from all free vertices until no augmenting path gains."""

    def __init__(self, n: int, edges: list[tuple[int, int, float]]):
        size = 2 * n + 2
        self.n, self.top = n, n
        # the real ends and weight of the edge in each cell; weight 0 is no edge
        self.eu, self.ev = (np.broadcast_to(np.arange(size)[:, None], (size, size)).copy(), np.broadcast_to(np.arange(size)[None], (size, size)).copy())
        self.w = np.zeros((size, size))
        for u, v, x in edges:
            if u != v and x > self.w[u, v]:
                self.w[u, v] = self.w[v, u] = x
        most = self.w.max() if n else 0.0
        self.eps = 1e-10 * max(1.0, most)
        self.dual = np.zeros(size)
        self.dual[1 : n + 1] = most
        self.mate, self.parent, self.slack, self.kind = ([0] * size for _ in range(4))
        self.base = list(range(size))  # the outermost blossom of each
        for k in range(n + 1, size):
            self.base[k] = 0
        self.inside: list[list[int]] = [[] for _ in range(size)]
        self.through = np.zeros((size, n + 1), np.int64)  # the child of a blossom that holds a vertex
        for k in range(1, n + 1):
            self.through[k, k] = k
        self.mark, self.now, self.queue = [0] * size, 0, []

    def gap(self, x: int, y: int) -> float:
        u, v = self.eu[x, y], self.ev[x, y]
        return self.dual[u] + self.dual[v] - 2 * self.w[u, v]

    def better(self, u: int, x: int) -> None:
        if not self.slack[x] or self.gap(u, x) < self.gap(self.slack[x], x):
            self.slack[x] = u

    def reslack(self, x: int) -> None:
        self.slack[x] = 0
        for u in np.nonzero(self.w[1 : self.n + 1, x] > 0)[0] + 1:
            if self.base[u] != x and self.kind[self.base[u]] == _EVEN:
                self.better(int(u), x)

    def push(self, x: int) -> None:
        if x <= self.n:
            self.queue.append(x)
        else:
            for c in self.inside[x]:
                self.push(c)

    def rebase(self, x: int, b: int) -> None:
        self.base[x] = b
        if x > self.n:
            for c in self.inside[x]:
                self.rebase(c, b)

    def even_place(self, b: int, child: int) -> int:
        """The child's place at an even distance from the blossom's base, its cycle turned round if it must be."""
        ring = self.inside[b]
        at = ring.index(child)
        if at % 2 == 0:
            return at
        ring[1:] = ring[:0:-1]
        return len(ring) - at

    def join(self, x: int, y: int) -> None:
        self.mate[x] = int(self.ev[x, y])
        if x > self.n:
            child = int(self.through[x, self.eu[x, y]])
            at = self.even_place(x, child)
            for k in range(at):
                self.join(self.inside[x][k], self.inside[x][k ^ 1])
            self.join(child, y)
            self.inside[x] = self.inside[x][at:] + self.inside[x][:at]

    def augment(self, x: int, y: int) -> None:
        while True:
            after = self.base[self.mate[x]]
            self.join(x, y)
            if not after:
                return
            before = self.base[self.parent[after]]
            self.join(after, before)
            x, y = before, after

    def meeting(self, x: int, y: int) -> int:
        self.now += 1
        while x or y:
            if x:
                if self.mark[x] == self.now:
                    return x
                self.mark[x] = self.now
                x = self.base[self.mate[x]]
                if x:
                    x = self.base[self.parent[x]]
            x, y = y, x
        return 0

    def shrink(self, x: int, root: int, y: int) -> None:
        b = next((k for k in range(self.n + 1, self.top + 1) if not self.base[k]), self.top + 1)
        self.top = max(self.top, b)
        self.dual[b], self.kind[b], self.mate[b] = 0.0, _EVEN, self.mate[root]
        sides = []
        for start in (x, y):
            way = []
            while start != root:
                odd = self.base[self.mate[start]]
                way += [start, odd]
                self.push(odd)
                start = self.base[self.parent[odd]]
            sides.append(way)
        ring = [root, *reversed(sides[0]), *sides[1]]
        self.inside[b] = ring
        self.rebase(b, b)
        self.w[b, :], self.w[:, b] = 0, 0
        self.through[b, :] = 0
        for c in ring:
            for z in range(1, self.top + 1):
                if self.w[c, z] > 0 and (self.w[b, z] == 0 or self.gap(c, z) < self.gap(b, z)):
                    self.w[b, z], self.eu[b, z], self.ev[b, z] = self.w[c, z], self.eu[c, z], self.ev[c, z]
                    self.w[z, b], self.eu[z, b], self.ev[z, b] = self.w[z, c], self.eu[z, c], self.ev[z, c]
            held = self.through[c] > 0
            self.through[b][held] = c
        self.reslack(b)

    def expand(self, b: int) -> None:
        for c in self.inside[b]:
            self.rebase(c, c)
        child = int(self.through[b, self.eu[b, self.parent[b]]])
        at = self.even_place(b, child)
        ring = self.inside[b]
        for k in range(0, at, 2):
            odd, even = ring[k], ring[k + 1]
            self.parent[odd] = int(self.eu[even, odd])
            self.kind[odd], self.kind[even] = _ODD, _EVEN
            self.slack[odd] = 0
            self.reslack(even)
            self.push(even)
        self.kind[child], self.parent[child] = _ODD, self.parent[b]
        for c in ring[at + 1 :]:
            self.kind[c] = _FREE
            self.reslack(c)
        self.base[b] = 0

    def tight(self, x: int, y: int) -> bool:
        """A tight edge between trees, or to a free vertex; whether it augmented the matching."""
        u, v = int(self.eu[x, y]), int(self.ev[x, y])
        a, b = self.base[u], self.base[v]
        if self.kind[b] == _FREE:
            self.parent[b], self.kind[b] = u, _ODD
            after = self.base[self.mate[b]]
            self.slack[b] = self.slack[after] = 0
            self.kind[after] = _EVEN
            self.push(after)
        elif self.kind[b] == _EVEN:
            root = self.meeting(a, b)
            if not root:
                self.augment(a, b)
                self.augment(b, a)
                return True
            self.shrink(a, root, b)
        return False

    def phase(self) -> bool:
        for x in range(1, self.top + 1):
            self.kind[x], self.slack[x] = _FREE, 0
        self.queue = []
        for x in range(1, self.top + 1):
            if self.base[x] == x and not self.mate[x]:
                self.parent[x], self.kind[x] = 0, _EVEN
                self.push(x)
        if not self.queue:
            return False
        while True:
            while self.queue:
                u = self.queue.pop()
                if self.kind[self.base[u]] == _ODD:
                    continue
                for v in np.nonzero(self.w[u, 1 : self.n + 1] > 0)[0] + 1:
                    v = int(v)
                    if self.base[u] != self.base[v]:
                        if self.gap(u, v) <= self.eps:
                            if self.tight(u, v):
                                return True
                        else:
                            self.better(u, self.base[v])
            tops = [x for x in range(1, self.top + 1) if self.base[x] == x]
            d = min((self.dual[x] / 2 for x in tops if x > self.n and self.kind[x] == _ODD), default=np.inf)
            for x in tops:
                if self.slack[x] and self.kind[x] != _ODD:
                    d = min(d, self.gap(self.slack[x], x) / (2 if self.kind[x] == _EVEN else 1))
            for u in range(1, self.n + 1):
                if self.kind[self.base[u]] == _EVEN:
                    if self.dual[u] <= d + self.eps:
                        return False
                    self.dual[u] -= d
                elif self.kind[self.base[u]] == _ODD:
                    self.dual[u] += d
            for x in tops:
                if x > self.n and self.kind[x] != _FREE:
                    self.dual[x] += 2 * d if self.kind[x] == _EVEN else -2 * d
            for x in tops:
                if self.base[x] == x and self.slack[x] and self.base[self.slack[x]] != x and self.gap(self.slack[x], x) <= self.eps:
                    if self.tight(self.slack[x], x):
                        return True
            for x in range(self.n + 1, self.top + 1):
                if self.base[x] == x and self.kind[x] == _ODD and self.dual[x] <= self.eps:
                    self.expand(x)

    def run(self) -> list[tuple[int, int]]:
        while self.phase():
            pass
        return [(u, self.mate[u]) for u in range(1, self.n + 1) if u < self.mate[u]]


def _matching(g: Graph, weight, weigh) -> DataFrame:
    """Matchings of all components; weigh(weights) gives the positive weights to maximise, 0 leaves an edge out."""
    def f(lo: Local):
        if len(lo.nodes) > NODE_LIMIT:
            raise SizeLimitError(f"a component has {len(lo.nodes)} nodes; the limit is {NODE_LIMIT}")
        edges = [(u, v, x) for u, v, x in lo.edges if u != v]
        if edges:
            at = lo.at
            weights = weigh(np.array([x for _, _, x in edges]), len(lo.nodes))
            for a, b in Blossoms(len(lo.nodes), [(at[u] + 1, at[v] + 1, float(x)) for (u, v, _), x in zip(edges, weights)]).run():
                yield lo.nodes[a - 1], lo.nodes[b - 1]

    return per_component(g.need(False), f, "src ID, dst ID", weight)


def max_weight_matching(g: Graph, weight: str | None = "w", maxcardinality: bool = False) -> DataFrame:
    """(src, dst) of a matching of the largest weight; maxcardinality: among those of the most edges.

    Edges that weigh nothing or less are only taken for the sake of cardinality.
    """
    w = weight if weight in g.edges.columns else None

    def weigh(x: np.ndarray, n: int) -> np.ndarray:
        # a constant that outweighs all else makes the number of edges count first
        return x - min(0.0, x.min()) + (np.abs(x).max() + 1) * n if maxcardinality else np.maximum(x, 0)

    return _matching(g, w, weigh)


def min_weight_matching(g: Graph, weight: str | None = "w") -> DataFrame:
    """(src, dst) of a matching of the smallest weight among those of the most edges."""
    w = weight if weight in g.edges.columns else None
    return _matching(g, w, lambda x, n: x.max() - x + (np.abs(x).max() + 1) * n)


def matching_weight(g: Graph, matching: DataFrame, weight: str | None = "w") -> DataFrame:
    """One row: a matching's edges and weight."""
    m = matching.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    value = F.col(weight).cast("double") if weight in g.edges.columns else F.lit(1.0)
    return g.edges.join(m, ["src", "dst"], "left_semi").agg(F.count("*").alias("edges"), F.coalesce(F.sum(value), F.lit(0.0)).alias("weight"))
