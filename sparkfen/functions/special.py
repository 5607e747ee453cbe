"""Tail probabilities for arrays of statistics, with numpy only."""

from __future__ import annotations

import math

import numpy as np

from sparkfen.functions.grids import Columns, plogp_to


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    out = d
    for i in range(1, 1000):
        b += 2
        d = 1 / (b - i * (i - a) * d)
        c = b - i * (i - a) / c
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out * front


def p_of_r(r: float, n: int) -> float:
    """Two-sided p of a correlation of n pairs."""
    if r is None or n is None or n < 3 or math.isnan(r):
        return math.nan
    return beta_inc(n / 2 - 1, 0.5, max(0.0, 1 - min(1.0, r * r)))


def p_of_chi2(x: float, dof: int) -> float:
    """Upper tail of chi squared."""
    return math.nan if x is None or not dof or dof < 1 else gamma_q(dof / 2, x / 2)


def p_of_z(z: float) -> float:
    """Two-sided p of a normal score."""
    return math.nan if z is None else math.erfc(abs(z) / math.sqrt(2))


def fisher_exact(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """Odds ratio and two-sided p of a 2 x 2 table."""
    n, row, col = a + b + c + d, a + b, a + c
    lo, hi = max(0, row + col - n), min(row, col)
    k = np.arange(lo, hi + 1)
    lg = np.vectorize(math.lgamma, otypes=[float])
    logs = lg(row + 1.0) - lg(k + 1.0) - lg(row - k + 1.0) + lg(n - row + 1.0) - lg(col - k + 1.0) - lg(n - row - col + k + 1.0) - (lg(n + 1.0) - lg(col + 1.0) - lg(n - col + 1.0))
    p = np.exp(logs)
    odds = math.inf if b * c == 0 and a * d else math.nan if b * c == 0 else a * d / (b * c)
    return odds, float(min(1.0, p[p <= p[a - lo] * (1 + 1e-7)].sum()))


def dominated(ranks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each row, the sums of the weights (n, k) of earlier rows with a smaller rank; bit by bit, without comparing pairs."""
    n, out, order = len(ranks), np.zeros_like(weights), np.arange(len(ranks))
    for b in reversed(range(int(ranks.max(initial=0)).bit_length())):
        r = ranks[order]
        high, bit = r >> (b + 1), (r >> b & 1).astype(bool)
        low = np.where(bit[:, None], 0, weights[order])
        sums = low.cumsum(0)
        first = np.maximum.accumulate(np.where(np.r_[True, high[1:] != high[:-1]], np.arange(n), 0))
        out[order] += np.where(bit[:, None], sums - (sums - low)[first], 0)
        order = order[np.argsort(r >> b, kind="stable")]
    return out


def kendall_tau_b(x: np.ndarray, y: np.ndarray) -> float:
    """Tie-corrected tau of all pairs, by counting inversions."""
    n = len(x)
    if n < 2:
        return math.nan
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    ties = lambda *c: sum(m * (m - 1) // 2 for m in np.unique(np.stack(c, 1), axis=0, return_counts=True)[1].tolist())
    total, tx, ty, both = n * (n - 1) // 2, ties(x), ties(y), ties(x, y)
    ranks = np.unique(y, return_inverse=True)[1]
    swaps = int(dominated(ranks.max() - ranks, np.ones((n, 1), np.int64)).sum())
    bottom = math.sqrt((total - tx) * (total - ty))
    return math.nan if not bottom else (total - tx - ty + both - 2 * swaps) / bottom


def p_of_tau(x: np.ndarray, y: np.ndarray) -> float:
    """Two-sided p of tau-b by its normal approximation with ties."""
    n = len(x)
    tau = kendall_tau_b(x, y)
    if n < 3 or math.isnan(tau):
        return math.nan
    runs = [np.unique(v, return_counts=True)[1].astype(float) for v in (x, y)]
    (p1, p2, p3), (q1, q2, q3) = ((float((t * (t - 1)).sum()), float((t * (t - 1) * (t - 2)).sum()), float((t * (t - 1) * (2 * t + 5)).sum())) for t in runs)
    pairs = n * (n - 1.0)
    spread = (pairs * (2 * n + 5) - p3 - q3) / 18 + p1 * q1 / (2 * pairs) + p2 * q2 / (9 * pairs * (n - 2))
    score = tau * math.sqrt((pairs - p1) / 2 * ((pairs - q1) / 2))
    return p_of_z(score / math.sqrt(spread)) if spread > 0 else math.nan


def distance_correlation(x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> float:
    """Of two samples, as from centred distance matrices, which are not built: sums over pairs come from sorts and prefix sums.
    times: how often each pair occurs (once)."""
    m = np.ones(len(x)) if times is None else np.asarray(times, float)
    n = float(m.sum())
    if n < 2:
        return math.nan
    order = np.lexsort((y, x))
    x, y, m = x[order].astype(float), y[order].astype(float), m[order]
    x, y = x - (m @ x) / n, y - (m @ y) / n
    sx, sy = (math.sqrt((m * v) @ v / n) if v.min() < v.max() else 0.0 for v in (x, y))
    if not sx or not sy:
        return math.nan
    x, y = x / sx, y / sy

    def row_sums(v: np.ndarray) -> np.ndarray:
        by = np.argsort(v, kind="stable")
        w, k, out = v[by], m[by], np.empty(len(v))
        before, smaller = (k * w).cumsum() - k * w, k.cumsum() - k
        out[by] = smaller * w - before + ((k * w).sum() - before - k * w) - (n - smaller - k) * w
        return out

    def covariance(products: float, a: np.ndarray, b: np.ndarray) -> float:
        return products / n / n - 2 * float((m * a) @ b) / n**3 + float(m @ a) / n * float(m @ b) / n / n / n

    rank = np.unique(y, return_inverse=True)[1]
    # Column by column, so that a task holds few arrays of this length.
    c, tx, ty, txy = (2 * dominated(rank, v[:, None])[:, 0] - (v.cumsum() - v) for v in (m, m * x, m * y, m * x * y))
    products = 2 * float((m * (c * x * y - x * ty - y * tx + txy)).sum())
    a, b = row_sums(x), row_sums(y)
    spread = covariance(2 * n * float((m * x) @ x), a, a) * covariance(2 * n * float((m * y) @ y), b, b)
    return math.nan if spread <= 0 else math.sqrt(max(0.0, covariance(products, a, b)) / math.sqrt(spread))


def equal_rows(ends: np.ndarray, rows: int) -> np.ndarray:
    """The row of each run of equal values, given the runs' ends in sorted order: rows of about equal size that divide no run."""
    n, out, h, first = int(ends[-1]), np.zeros(len(ends), np.int64), 0, 0
    for row in range(rows):
        if first == len(ends):
            break
        goal = h + (n - h) / (rows - row)
        last = min(int(np.searchsorted(ends, goal)), len(ends) - 1)
        if last > first and ends[last] - goal >= goal - ends[last - 1]:
            last -= 1
        if row == rows - 1:
            last = len(ends) - 1
        out[first : last + 1] = row
        first, h = last + 1, int(ends[last])
    return out


def column_entropies(cells: np.ndarray, most: int) -> np.ndarray:
    """For 1 to `most` columns, the least sum of count * entropy of the rows in each column, over all ways to join neighbouring
    clumps into that many columns. cells: counts by clump and row."""
    total = np.r_[np.zeros((1, cells.shape[1]), np.int64), cells.cumsum(0)]
    k, ends = len(cells), total.sum(1)
    plogp = np.arange(ends[-1] + 1, dtype=float)
    plogp[1:] *= np.log2(plogp[1:])
    cost = np.full((k, k), np.inf)  # clumps s..t as one column
    for t in range(k):
        part = total[t + 1] - total[: t + 1]
        cost[: t + 1, t] = plogp[ends[t + 1] - ends[: t + 1]] - plogp[part].sum(1)
    now, out = cost[0].copy(), [cost[0, -1]]
    for _ in range(1, min(most, k)):
        new = np.full(k, np.inf)
        for a in range(0, k, 256):  # tiles that a core's cache holds
            b = min(k, a + 256)
            for s in range(0, b - 1, 128):
                e = min(b - 1, s + 128)
                np.minimum(new[a:b], (now[s:e, None] + cost[s + 1 : e + 1, a:b]).min(0), out=new[a:b])
        now = np.minimum(now, new)
        out.append(now[-1])
    return np.array(out)


def maximal_information(x: np.ndarray, y: np.ndarray, alpha: float = 0.6, clumps: float = 15) -> float:
    """The maximal information coefficient by the approximate search of Reshef and others (2011); null below 50 points.

    One axis is cut into rows of about equal size, the other into columns by dynamic programming over clumps, which are runs of
    points in one row; at most `clumps` times as many clumps as columns are tried. Both orientations are searched, grids
    have at most n ** alpha cells. Equal values share a row and a column, so ties carry no information of their own.
    """
    return max(information_along(x, y, alpha, clumps), information_along(y, x, alpha, clumps))


def information_along(u: np.ndarray, v: np.ndarray, alpha: float = 0.6, clumps: float = 15, times: np.ndarray | None = None) -> float:
    """maximal_information() of one orientation: columns of u, rows of v. times: how often each pair occurs (once).

    Numbers of rows are tried from the largest, whose grids have few columns. With every clump a column the information is an upper
    bound of that of any columns, which leaves out numbers of columns that cannot exceed the best so far. Up to the number
    of rows they are tried one by one; beyond it only the largest counts, as more columns never have less information.
    """
    n, best = len(u) if times is None else int(times.sum()), 0.0
    if n < 50:
        return math.nan
    limit = max(n**alpha, 4.0)
    order = np.argsort(u, kind="stable")
    u, v = np.asarray(u)[order], np.asarray(v)[order]
    times = np.ones(len(u), np.int64) if times is None else np.asarray(times)[order]
    values, place = np.unique(v, return_inverse=True)
    place = place.astype(np.int32)
    ends = np.bincount(place, times).astype(np.int64).cumsum()
    starts = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
    if len(values) < 2 or len(starts) < 2:
        return best
    del order, u, v, values
    single, each, held = len(starts) == len(place), np.add.reduceat(times, starts), np.diff(np.r_[starts, len(place)])
    plogp = plogp_to(n)
    for rows in range(int(limit / 2), 1, -1):
        columns = int(limit / rows)
        row = equal_rows(ends, rows).astype(np.int32)[place]
        if single:
            changed = row[1:] != row[:-1]
        else:
            low, high = np.minimum.reduceat(row, starts), np.maximum.reduceat(row, starts)
            changed = (low[1:] != high[1:]) | (low[:-1] != high[:-1]) | (low[1:] != low[:-1])
        clump, most = np.cumsum(np.r_[False, changed], dtype=np.int32), max(1, int(clumps * columns))
        if clump[-1] + 1 > most:
            clump = equal_rows(np.bincount(clump, each).astype(np.int64).cumsum(), most).astype(np.int32)[clump]
        of_pair = clump if single else np.repeat(clump, held)
        cells = np.bincount(of_pair.astype(np.int64) * rows + row, times, minlength=(int(clump[-1]) + 1) * rows).astype(np.int64).reshape(-1, rows)
        share = cells.sum(0) / n
        share = share[share > 0]
        whole = -float((share * np.log2(share)).sum())
        grid = Columns(cells, plogp)
        most_information = whole - grid.apart() / n
        reach = lambda k: most_information > best * math.log2(min(k, rows)) + 1e-13
        tried = [k for k in range(2, min(rows, columns) + 1) if reach(k)]
        if tried:
            for k, left in enumerate(grid.layers(max(tried))[1:], 2):
                best = max(best, (whole - left / n) / math.log2(min(k, rows)))
        if columns > rows and reach(columns):
            left = grid.least(columns, n * (whole - best * math.log2(rows)))
            best = max(best, (whole - left / n) / math.log2(rows))
    return best
