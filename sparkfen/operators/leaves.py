"""The best order of a dendrogram's leaves, without a square matrix of distances or of costs where the tree allows it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

#: Pairs of leaves whose costs are kept (8 bytes each), and those that are looked at at once.
MOST_PAIRS, AT_ONCE = 120_000_000, 4_000_000
#: What a call costs, in single sums, and how much a distance costs more than a sum.
CALL, DISTANCE = 20_000, 4


def _least_plus(p: np.ndarray, q: np.ndarray, rows: int = 16, columns: int = 1024) -> np.ndarray:
    """The least p[i, k] + q[k, j] over k, in tiles."""
    if p.size * q.shape[1] <= 100_000:
        return (p[:, :, None] + q[None]).min(1)
    out = np.empty((len(p), q.shape[1]))
    for c in range(0, q.shape[1], columns):
        some = np.ascontiguousarray(q[:, c : c + columns])
        for i in range(0, len(p), rows):
            part = np.ascontiguousarray(p[i : i + rows].T)[:, :, None]
            best = some[0] + part[0]
            sums = np.empty_like(best)
            for k in range(1, len(some)):
                np.minimum(best, np.add(some[k], part[k], out=sums), out=best)
            out[i : i + rows, c : c + columns] = best
    return out


class _Tree:
    """A dendrogram whose leaves are numbered so that each part is a run of places.

    What is asked of a part is the least cost to pass all its leaves and end at each one, given a cost of entering at each. It
    follows from the same question to its two parts, twice each, and the distances between them; so the work is the square of
    the leaves times the depth where the tree is balanced. Deep in the tree, or where it is one-sided, the number of questions
    exceeds that of leaves; there the costs of all pairs of outermost leaves are made once and kept. Which is
    cheaper is reckoned for each part.
    """

    def __init__(self, steps: Sequence[tuple[int, int, float]], distances: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        n = len(steps) + 1
        self.n, self.root, self.kids = n, 2 * n - 2, np.zeros((2 * n - 1, 2), np.int64)
        size, above, top = np.ones(2 * n - 1, np.int64), list(range(n)), list(range(n))
        for node, (x, y, _) in enumerate(steps, n):
            ends = []
            for leaf in (int(x), int(y)):
                while above[leaf] != leaf:
                    above[leaf] = above[above[leaf]]
                    leaf = above[leaf]
                ends.append(leaf)
            a, b = top[ends[0]], top[ends[1]]
            self.kids[node], size[node] = (a, b), size[a] + size[b]
            heavy, light = ends if size[a] >= size[b] else ends[::-1]
            above[light], top[heavy] = heavy, node
        self.lo, depth = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int64)
        for node in range(self.root, n - 1, -1):
            a, b = self.kids[node]
            self.lo[a], self.lo[b] = self.lo[node], self.lo[node] + size[a]
            depth[a] = depth[b] = depth[node] + 1
        self.hi = self.lo + size
        self.leaf = np.empty(n, np.int64)
        self.leaf[self.lo[:n]] = np.arange(n)
        self.between = lambda a0, a1, b0, b1: distances(self.leaf[a0:a1], self.leaf[b0:b1])
        self._choose(size, depth)
        self._costs(size)

    def _choose(self, size: np.ndarray, depth: np.ndarray) -> None:
        work, table, pairs = np.zeros(len(size)), np.zeros(len(size)), np.zeros(len(size))
        self.kept = np.zeros(len(size), bool)
        for node in range(self.n, len(size)):
            a, b = self.kids[node]
            here, calls = float(size[a] * size[b]), 2.0 ** min(int(depth[node]), 500)
            pairs[node] = here
            table[node] = table[a] + table[b] + 2 * max(pairs[a], 1) * size[b] + 2 * max(pairs[b], 1) * size[a] + 5 * CALL
            split, whole = calls * (2 * DISTANCE * here + 2 * CALL) + work[a] + work[b], calls * (2 * here + CALL) + table[node]
            self.kept[node], work[node] = whole <= split, min(whole, split)
        for node in range(self.root, self.n - 1, -1):  # a part of one whose costs are kept has its own kept
            self.kept[self.kids[node]] |= self.kept[node]
        self.kept[: self.n] = False
        if pairs[self.kept].sum() > MOST_PAIRS:
            raise ValueError(f"a dendrogram so one-sided that {pairs[self.kept].sum():.0f} costs would be kept; the bound is {MOST_PAIRS}")

    def _costs(self, size: np.ndarray) -> None:
        """For each part that is to keep them, the least costs from each leaf of its first part to each of its second."""
        self.cost: dict[int, np.ndarray] = {}
        for node in np.flatnonzero(self.kept).tolist():
            a, b = self.kids[node].tolist()
            left, right = self.lo[b], self.hi[b]
            if a < self.n:
                t = self.between(self.lo[a], self.hi[a], left, right)
            else:
                x, y = self.kids[a]
                t = np.concatenate([_least_plus(self.cost[a], self.between(self.lo[y], self.hi[y], left, right)), _least_plus(self.cost[a].T, self.between(self.lo[x], self.hi[x], left, right))])
            if b >= self.n:
                k = size[self.kids[b][0]]
                t = np.concatenate([_least_plus(t[:, k:], self.cost[b].T), _least_plus(t[:, :k], self.cost[b])], 1)
            self.cost[node] = t

    def _meet(self, a: int, ends: np.ndarray, b: int) -> np.ndarray:
        """The least cost to enter each leaf of b from one of a."""
        out, width = None, max(1, AT_ONCE // int(self.hi[b] - self.lo[b]))
        for i in range(0, len(ends), width):
            d = self.between(self.lo[a] + i, min(self.lo[a] + i + width, self.hi[a]), self.lo[b], self.hi[b])
            d += ends[i : i + width, None]
            out = d.min(0) if out is None else np.minimum(out, d.min(0))
        return out

    def ends(self, node: int, enter: np.ndarray) -> np.ndarray:
        """The least cost to pass all leaves of a part and end at each one, by the cost of entering at each."""
        if node < self.n:
            return enter
        a, b = self.kids[node].tolist()
        k = int(self.hi[a] - self.lo[a])
        if not self.kept[node]:
            over, back = self._meet(a, self.ends(a, enter[:k]), b), self._meet(b, self.ends(b, enter[k:]), a)
            return np.r_[self.ends(a, back), self.ends(b, over)]
        c, first, second, width = self.cost[node], np.empty(k), None, max(1, AT_ONCE // (len(enter) - k))
        for i in range(0, k, width):
            some = c[i : i + width]
            first[i : i + width] = (some + enter[None, k:]).min(1)
            least = (some + enter[i : min(i + width, k), None]).min(0)
            second = least if second is None else np.minimum(second, least)
        return np.r_[first, second]

    def path(self, node: int, enter: np.ndarray, end: int) -> list[int]:
        """The places of a best path through a part that ends at the place `end`."""
        if node < self.n:
            return [end]
        a, b = self.kids[node].tolist()
        if self.kept[node]:
            places, costs = self._across(node, end)
            return self._between_ends(node, int(places[(costs + enter[places - self.lo[node]]).argmin()]), end)
        k = int(self.hi[a] - self.lo[a])
        (x, at_x), (y, _) = ((a, enter[:k]), (b, None)) if end >= self.lo[b] else ((b, enter[k:]), (a, None))
        ends = self.ends(x, at_x)
        second = self.path(y, self._meet(x, ends, y), end)
        last = ends + self.between(self.lo[x], self.hi[x], second[0], second[0] + 1)[:, 0]
        return self.path(x, at_x, int(self.lo[x] + last.argmin())) + second

    def _across(self, node: int, place: int) -> tuple[np.ndarray, np.ndarray]:
        """The places at which a path through a part may begin that ends at this one, and their costs."""
        if node < self.n:
            return np.array([place]), np.zeros(1)
        a, b = self.kids[node].tolist()
        if place < self.hi[a]:
            return np.arange(self.lo[b], self.hi[b]), self.cost[node][place - self.lo[a]]
        return np.arange(self.lo[a], self.hi[a]), self.cost[node][:, place - self.lo[b]]

    def _between_ends(self, node: int, first: int, last: int) -> list[int]:
        out, todo = [], [(node, first, last)]
        while todo:
            node, first, last = todo.pop()
            if node < self.n:
                out.append(first)
                continue
            x, y = self.kids[node].tolist() if first < self.lo[self.kids[node][1]] else self.kids[node][::-1].tolist()
            (p, before), (q, after) = self._across(x, first), self._across(y, last)
            sums = self.between(p[0], p[-1] + 1, q[0], q[-1] + 1) + before[:, None] + after[None, :]
            i, j = divmod(int(sums.argmin()), len(q))
            todo += [(y, int(q[j]), last), (x, first, int(p[i]))]
        return out


def optimal_order(steps: Sequence[tuple[int, int, float]], d: np.ndarray | Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[int]:
    """The leaves of a dendrogram, of all orders that flips of its nodes allow the one with the least sum of distances between neighbours.

    d: a matrix of distances, or a function that gives those of some leaves to some others. The smaller outermost leaf comes first.
    """
    if not len(steps):
        return list(range(1 if callable(d) else len(d)))
    tree = _Tree(steps, d if callable(d) else lambda a, b: d[np.ix_(a, b)])
    none = np.zeros(tree.n)
    if tree.kept[tree.root]:
        end = int(tree.ends(tree.root, none).argmin())
    else:  # of a path and its reverse one ends in the second part
        a, b = tree.kids[tree.root].tolist()
        end = int(tree.lo[b] + tree.ends(b, tree._meet(a, tree.ends(a, none[: tree.lo[b]]), b)).argmin())
    out = tree.leaf[tree.path(tree.root, none, end)].tolist()
    return out if out[0] < out[-1] else out[::-1]
