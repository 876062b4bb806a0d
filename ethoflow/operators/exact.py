"""Exact null laws of small samples: rank sums, signed ranks, relabellings, bootstrap medians.

These take one group or pair of groups, whose ranks and counts Spark has made.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np

#: Up to these sizes, without ties, rank tests take the exact law, as their users know them.
RANK_SUM_MOST, SIGNED_MOST = 8, 50
#: Values of two groups together that all relabellings are counted for by halves.
RELABEL_MOST = 44


@lru_cache(maxsize=512)
def rank_sum_counts(n: int, m: int) -> np.ndarray:
    """How many of the ways to choose n of n + m ranks give each U from 0 to n * m, as exact integers.

    The counts are the coefficients of a Gaussian binomial: each factor is a
    shift and a subtraction, each divisor a running sum by steps.
    """
    n, m = min(n, m), max(n, m)
    size = n * m + 1
    # Modulo 2^64 all steps are exact as long as the counts are below.
    kind = np.uint64 if math.comb(n + m, n) < 1 << 63 else object
    out = np.zeros(size, dtype=kind)
    out[0] = 1
    with np.errstate(over="ignore"):
        for i in range(1, n + 1):
            up = m + i
            if up < size:
                out[up:] = out[up:] - out[: size - up].copy()
            for at in range(i):
                out[at::i] = np.cumsum(out[at::i], dtype=None if kind is object else kind)
    return out


def rank_sum_p(u: float, n: int, m: int) -> float:
    """Two-sided p of U (of either group) without ties."""
    counts = rank_sum_counts(n, m)
    far = int(round(max(u, n * m - u)))
    return min(1.0, 2 * float(sum(map(int, counts[far:].tolist()))) / math.comb(n + m, n))


@lru_cache(maxsize=64)
def signed_rank_counts(n: int) -> np.ndarray:
    """How many of the 2^n signs give each sum of positive ranks."""
    out = np.zeros(n * (n + 1) // 2 + 1, dtype=np.int64)
    out[0] = 1
    for r in range(1, n + 1):
        out[r:] = out[r:] + out[:-r].copy()
    return out


def signed_rank_p(w: float, n: int) -> float:
    """Two-sided p of either rank sum, without ties and zeros."""
    counts = signed_rank_counts(n)
    low = int(round(min(w, n * (n + 1) / 2 - w)))
    return min(1.0, 2 * int(counts[: low + 1].sum()) / 2**n)


def _sums_by_size(values: np.ndarray) -> list[np.ndarray]:
    """The sums of all subsets, by how many values they have."""
    out = [np.zeros(1)]
    for v in values:
        out = [np.concatenate([same, less + v]) for same, less in zip([*out, np.zeros(0)], [np.zeros(0), *out])]
    return out


def relabelled_share(a: np.ndarray, b: np.ndarray, statistic: str = "meanDiff") -> float:
    """The share of all relabellings whose statistic is at least as far from zero as the observed one.

    A relabelling is a subset of the size of a; its sum tells both the difference
    of means and of sums.  Sums of subsets of either half of the values, sorted,
    meet in the middle, so 2^(n/2) sums are held instead of all relabellings.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return float("nan")
    values = np.concatenate([a, b]).astype(float)
    total, slack = values.sum(), 1e-9 * max(1.0, float(np.abs(values).sum()))
    if statistic == "medianDiff":
        if math.comb(n + m, n) > 1 << 20:
            raise ValueError("too many relabellings of medians to count; give a number of draws")
        seen = abs(np.median(a) - np.median(b)) - slack
        hits = 0
        for chosen in combinations(range(n + m), n):
            mask = np.zeros(n + m, dtype=bool)
            mask[list(chosen)] = True
            hits += abs(np.median(values[mask]) - np.median(values[~mask])) >= seen
        return hits / math.comb(n + m, n)
    if n + m > RELABEL_MOST:
        raise ValueError(f"over {RELABEL_MOST} values; give a number of draws")
    # The sums that are as far as the observed one lie outside (low, high).
    middle = total * n / (n + m) if statistic == "meanDiff" else total / 2
    far = abs(a.sum() - middle) - slack
    left, right = _sums_by_size(values[: (n + m) // 2]), _sums_by_size(values[(n + m) // 2 :])
    hits = 0
    for i, sums in enumerate(left):
        if 0 <= n - i < len(right):
            others = np.sort(right[n - i])
            above = len(others) - np.searchsorted(others, middle + far - sums, side="left")
            below = np.searchsorted(others, middle - far - sums, side="right")
            hits += int(np.minimum(above + below, len(others)).sum())
    return hits / math.comb(n + m, n)


def median_law(xs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, probabilities) of the median of a bootstrap sample of sorted values, in ascending order.

    The k-th smallest of n draws is at most the i-th value with the binomial tail
    P(Bin(n, i/n) >= k).  With an even n the median is the mean of two middle
    draws, whose joint law is a product of powers; draws far from the middle,
    whose probability is below the last digit, are left out.
    """
    from ethoflow.operators.stats import beta_tail

    n = len(xs)
    m = (n + 1) // 2

    def at_most(k: int, i: int) -> float:
        return 0.0 if i <= 0 else 1.0 if i >= n else beta_tail(k, n - k + 1, i / n)

    wide = int(8 * math.sqrt(n)) + 2
    first, last = max(1, m - wide), min(n, m + 1 + wide)
    places = np.arange(first, last + 1)
    tails = np.array([at_most(m, int(i)) for i in places])
    own = np.diff(np.concatenate([[at_most(m, first - 1)], tails]))
    if n % 2:
        return xs[places - 1], own
    if n >= 1000:
        return _banded_law(xs, places, own)
    with np.errstate(all="ignore"):  # pairs out of order, which do not count, may overflow
        # Exactly m draws up to i, the largest of them i; the others from j on, the smallest of them j.
        low = (places / n) ** m - ((places - 1) / n) ** m
        high = ((n - places + 1) / n) ** m - ((n - places) / n) ** m
        joint = math.exp(math.lgamma(n + 1) - 2 * math.lgamma(m + 1)) * low[:, None] * high[None, :]
    joint = np.triu(joint, 1)
    joint[np.diag_indices(len(places))] = np.maximum(0.0, own - joint.sum(axis=1))
    values = (xs[places - 1][:, None] + xs[places - 1][None, :]) / 2
    upper = np.triu_indices(len(places))
    values, joint = values[upper], joint[upper]
    by = np.argsort(values, kind="stable")
    return values[by], joint[by]


#: Places between the two middle draws of a large sample; a further place is there with a chance below exp(-80).
BAND = 128


def _banded_law(xs: np.ndarray, places: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``median_law`` of an even number of values, a thousand or more: only middle draws near each other are paired."""
    n = len(xs)
    m = n // 2
    with np.errstate(all="ignore"):
        log = lambda x: np.log(np.maximum(x, 0) / n)
        a, b = m * log(places), m * log(n - places + 1)  # the powers alone would vanish
        low, high = -np.expm1(m * (log(places - 1) - log(places))), -np.expm1(m * (log(n - places) - log(n - places + 1)))
    i = np.arange(len(places))[:, None]
    j = i + np.arange(1, BAND + 1)
    there = j < len(places)
    j = np.minimum(j, len(places) - 1)
    joint = np.where(there, np.exp(np.minimum(math.lgamma(n + 1) - 2 * math.lgamma(m + 1) + a[i] + b[j], 0.0)) * low[i] * high[j], 0.0)
    x = xs[places - 1]
    values = np.concatenate([x, ((x[i] + x[j]) / 2)[there]])
    shares = np.concatenate([np.maximum(0.0, own - joint.sum(axis=1)), joint[there]])
    by = np.argsort(values, kind="stable")
    return values[by], shares[by]


def median_interval(xs: np.ndarray, alpha: float = 0.05) -> tuple[float, float]:
    """The bootstrap interval of the median of sorted values; for under three their range."""
    if len(xs) < 3:
        return (float(xs[0]), float(xs[-1])) if len(xs) else (float("nan"), float("nan"))
    values, shares = median_law(xs)
    up = np.cumsum(shares)
    low, high = (int(np.searchsorted(up, q - 1e-9)) for q in (alpha / 2, 1 - alpha / 2))
    return float(values[min(low, len(values) - 1)]), float(values[min(high, len(values) - 1)])
