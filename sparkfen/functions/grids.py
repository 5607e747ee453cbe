"""The best columns of a grid: neighbouring clumps joined so that the rows are as certain as possible in each, exactly and in bounded memory.

A column of clumps s to t costs count * entropy of its rows. Joining two columns never costs less than both do alone. Nothing as
large as the square of the clumps is held.
"""

from __future__ import annotations

import numpy as np


def plogp_to(n: int) -> np.ndarray:
    """p * log2(p) of 0 to n."""
    out = np.arange(n + 1, dtype=float)
    out[1:] *= np.log2(out[1:])
    return out


class Columns:
    """Clumps (counts by clump and row), and what columns made of them cost."""

    def __init__(self, cells: np.ndarray, plogp: np.ndarray | None = None) -> None:
        self.total = np.r_[np.zeros((1, cells.shape[1]), np.int64), cells.cumsum(0)]
        self.ends, self.k = self.total.sum(1), len(cells)
        self.plogp = plogp_to(int(self.ends[-1])) if plogp is None else plogp

    def cost(self, s: np.ndarray | slice, t: int) -> np.ndarray:
        """Of the columns that hold the clumps from each of s up to, without, t."""
        return self.plogp[self.ends[t] - self.ends[s]] - self.plogp[self.total[t] - self.total[s]].sum(1)

    def apart(self) -> float:
        """The cost with every clump a column."""
        return float((self.plogp[np.diff(self.ends)] - self.plogp[np.diff(self.total, axis=0)].sum(1)).sum())

    def layers(self, most: int) -> np.ndarray:
        """The least cost of 1 to `most` columns (at most; fewer if there are fewer clumps)."""
        most = min(most, self.k)
        best = np.full((most, self.k + 1), np.inf)  # columns - 1, clumps that they hold
        if most == 1:
            return np.array([self.cost(slice(0, 1), self.k)[0]])
        for t in range(1, self.k):
            c = self.cost(slice(0, t), t)
            best[0, t] = c[0]
            if most > 2:
                for j in range(1, most - 1):
                    best[j, t] = min(best[j - 1, t], (best[j - 1, 1:t] + c[1:]).min(initial=np.inf))
        c, out = self.cost(slice(0, self.k), self.k), []
        for j in range(most):
            least = c[0] if j == 0 else min(out[-1], float((best[j - 1, 1 : self.k] + c[1:]).min(initial=np.inf)))
            out.append(float(least))
        return np.array(out)

    def _penalised(self, price: float, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """For each number of clumps the least cost of columns that each cost `price` more, and where the last of them begins.

        A beginning is dropped once it is worse than the best by the price: no later end can make up for it.
        """
        f, back = np.zeros(self.k + 1), np.zeros(self.k + 1, np.int64)
        left = np.zeros(1, np.int64)
        for t in range(1, self.k + 1):
            v = f[left] + self.cost(left, t)
            i = int(v.argmin())
            f[t], back[t] = v[i] + price, left[i]
            left = np.append(left[v < f[t] + slack], t)
        return f, back

    def _cuts(self, back: np.ndarray) -> np.ndarray:
        out = [self.k]
        while out[-1]:
            out.append(int(back[out[-1]]))
        return np.array(out[::-1])

    def _of(self, cuts: np.ndarray) -> float:
        parts, counts = np.diff(self.total[cuts], axis=0), np.diff(self.ends[cuts])
        return float((self.plogp[counts] - self.plogp[parts].sum(1)).sum())

    def least(self, most: int, enough: float = np.inf) -> float:
        """The least cost of at most `most` columns; inf as soon as it is known to be `enough` or more.

        Columns are priced: the price at which the best number of them passes `most` gives a bound from below, and
        what is best on both sides of it one from above. Only columns whose priced cost lies between both can be part of the answer; they
        are few, and are searched by number.
        """
        if most >= self.k:
            return self.apart()
        few, many = np.array([0, self.k]), np.arange(self.k + 1)
        c_few, c_many = self._of(few), self.apart()
        if most == 1:
            return c_few
        while True:
            price = (c_few - c_many) / (len(many) - len(few))
            f, back = self._penalised(price)
            bound = f[-1] - price * most  # no choice of `most` columns costs less
            if bound >= enough:
                return np.inf
            cuts = self._cuts(back)
            c = self._of(cuts)
            on_edge = f[-1] >= c_few + price * (len(few) - 1) - 1e-9 * max(1.0, c_few)
            if on_edge or len(cuts) in (len(few), len(many)):
                break
            if len(cuts) - 1 <= most:
                few, c_few = cuts, c
            else:
                many, c_many = cuts, c
            if len(few) - 1 == most:
                return c_few
        upper = min(c_few, self._joined(many, most))
        room = upper - bound
        return self._between(price, most, upper, room) if room > 1e-9 * max(1.0, upper) else upper

    def _joined(self, cuts: np.ndarray, most: int) -> float:
        """The cost after the neighbours that lose least are joined until `most` columns are left."""
        cuts = cuts.tolist()
        single = lambda s, t: float(self.cost(np.array([s]), t)[0])
        loss = [single(a, c) - single(a, b) - single(b, c) for a, b, c in zip(cuts, cuts[1:], cuts[2:])]
        while len(cuts) - 1 > most:
            i = int(np.argmin(loss))
            del cuts[i + 1], loss[i]
            for j in (i - 1, i):
                if 0 <= j < len(loss):
                    a, b, c = cuts[j : j + 3]
                    loss[j] = single(a, c) - single(a, b) - single(b, c)
        return self._of(np.array(cuts))

    def _between(self, price: float, most: int, upper: float, room: float) -> float:
        """The least cost of at most `most` columns, given a bound from above that lies `room` above that of the price."""
        room += 1e-9 * max(1.0, upper)
        turned = Columns.__new__(Columns)
        turned.total, turned.ends, turned.k, turned.plogp = self.total[-1] - self.total[::-1], self.ends[-1] - self.ends[::-1], self.k, self.plogp
        rest = turned._penalised(price)[0][::-1]  # of the clumps from each on
        f, left = np.zeros(self.k + 1), np.zeros(1, np.int64)
        limit = upper + price * most + 1e-9 * max(1.0, upper)
        found: list[dict[int, float]] = [{} for _ in range(self.k + 1)]
        found[0][0] = 0.0
        for t in range(1, self.k + 1):
            c = self.cost(left, t)
            v = f[left] + c
            f[t] = v.min() + price
            if f[t] + rest[t] <= limit:
                own = found[t]
                for i in np.flatnonzero(v + price + rest[t] <= limit).tolist():
                    for m, w in found[left[i]].items():
                        w += c[i]
                        if m < most and w + price * (m + 1) + rest[t] <= limit and w < own.get(m + 1, np.inf):
                            own[m + 1] = w
            left = np.append(left[v < f[t] + room], t)
        return min([upper, *found[-1].values()])
