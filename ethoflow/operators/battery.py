"""The older test battery: a normality gate, a test by design, and its pairwise follow-up.

Works on animal-level tables; each key (a label column and label, say) is one
group of tens to thousands of rows and one task's work.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethoflow.operators import stats

_Z = NormalDist()


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """(W, p) after Royston (1995), for 3 to 5,000 values; NaN outside or without spread."""
    x = np.sort(np.asarray(x, dtype=float))
    n = len(x)
    if n < 3 or n > 5000 or np.ptp(x) == 0:
        return float("nan"), float("nan")
    m = np.array([_Z.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    # Royston's published polynomials.
    c, u = m / math.sqrt(m @ m), 1 / math.sqrt(n)
    a = c.copy()
    if n == 3:
        a[:] = (-math.sqrt(0.5), 0, math.sqrt(0.5))
    else:
        last = c[-1] + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0], u)
        if n > 5:
            second = c[-2] + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
            phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = m / math.sqrt(phi)
            a[-2], a[1] = second, -second
        else:
            a = m / math.sqrt((m @ m - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[-1], a[0] = last, -last
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return w, 0.0
        y, mu, sigma = -math.log(g - y), np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        k = math.log(n)
        mu, sigma = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], k), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], k))
    return w, stats.normal_tail((y - mu) / sigma)


def range_tail(q: float, k: int, df: float = math.inf) -> float:
    """P(studentised range of k means > q), by numerical integration."""
    if q <= 0:
        return 1.0
    z = np.linspace(-8, 8, 801)
    cdf = lambda v: 0.5 * (1 + np.vectorize(math.erf)(v / math.sqrt(2)))
    density, here = np.exp(-z * z / 2) / math.sqrt(2 * math.pi), cdf(z)

    def below(r: float) -> float:
        return float(k * np.trapezoid(density * (here - cdf(z - r)) ** (k - 1), z))

    if math.isinf(df):
        return max(0.0, 1 - below(q))
    s = np.linspace(1e-3, 1 + 8 / math.sqrt(2 * df) + 1, 200)  # the pooled deviation over its true value
    log_f = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    return max(0.0, 1 - float(np.trapezoid(np.exp(log_f) * np.array([below(q * v) for v in s]), s)))


def repeated_anova(table: np.ndarray) -> tuple[float, float]:
    """(F, p) of one-way repeated measures [subject, condition]."""
    n, k = table.shape
    grand = table.mean()
    between = n * ((table.mean(axis=0) - grand) ** 2).sum()
    error = ((table - table.mean(axis=1, keepdims=True) - table.mean(axis=0) + grand) ** 2).sum()
    d1, d2 = k - 1, (k - 1) * (n - 1)
    f = (between / d1) / (error / d2) if error else 0.0
    return float(f), stats.f_tail(f, d1, d2)


def tukey(samples: Sequence[np.ndarray]) -> dict[tuple[int, int], float]:
    n, k = sum(map(len, samples)), len(samples)
    mse = sum(((s - s.mean()) ** 2).sum() for s in samples) / (n - k)
    return {(i, j): range_tail(abs(samples[i].mean() - samples[j].mean()) / math.sqrt(mse / 2 * (1 / len(samples[i]) + 1 / len(samples[j]))), k, n - k) if mse else 1.0 for i, j in combinations(range(k), 2)}


def dunn(samples: Sequence[np.ndarray]) -> dict[tuple[int, int], float]:
    """Rank comparisons after Kruskal-Wallis, Bonferroni-corrected."""
    both, k = np.concatenate(samples), len(samples)
    n, r = len(both), stats.ranks(both)
    ends = np.cumsum([len(s) for s in samples])
    mean = [r[e - len(s) : e].mean() for s, e in zip(samples, ends)]
    t = np.unique(both, return_counts=True)[1]
    var = n * (n + 1) / 12 - (t**3 - t).sum() / (12 * (n - 1))
    pairs = k * (k - 1) / 2
    return {(i, j): min(1.0, pairs * 2 * stats.normal_tail(abs(mean[i] - mean[j]) / math.sqrt(var * (1 / len(samples[i]) + 1 / len(samples[j]))))) if var > 0 else 1.0 for i, j in combinations(range(k), 2)}


def nemenyi(table: np.ndarray) -> dict[tuple[int, int], float]:
    """Rank comparisons after Friedman."""
    n, k = table.shape
    mean = np.array([stats.ranks(row) for row in table]).mean(axis=0)
    return {(i, j): range_tail(abs(mean[i] - mean[j]) / math.sqrt(k * (k + 1) / (6 * n)) * math.sqrt(2), k) for i, j in combinations(range(k), 2)}


def paired_bonferroni(table: np.ndarray) -> dict[tuple[int, int], float]:
    k = table.shape[1]
    return {(i, j): min(1.0, k * (k - 1) / 2 * stats.paired_t(table[:, i], table[:, j])[1]) for i, j in combinations(range(k), 2)}


def run_battery(df: DataFrame, value: str, group: str, keys: Sequence[str], subject: str | None = None, alpha: float = 0.05) -> DataFrame:
    """Rows (keys, test, statistic, p, group_a, group_b, p_pair, sig): one for each pair of groups.

    With a subject column the design is paired: only subjects with a value in
    every group count. Groups of under three values are not normal.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        head = [frame[k].iloc[0] for k in keys]
        columns = [*keys, "test", "statistic", "p", "group_a", "group_b", "p_pair"]
        if subject:
            wide = frame.pivot_table(index=subject, columns=group, values=value, aggfunc="mean").dropna()
            names, table = list(wide.columns), wide.to_numpy(dtype=float)
            samples = list(table.T)
        else:
            parts = {g: x[value].dropna().to_numpy(dtype=float) for g, x in frame.groupby(group)}
            names, table = sorted(g for g, x in parts.items() if len(x)), None
            samples = [parts[g] for g in names]
        if len(samples) < 2 or min(map(len, samples)) < 2:
            return pd.DataFrame([], columns=columns)
        normal = all(shapiro_wilk(s)[1] > 0.05 for s in samples)  # NaN is not above
        name = stats.choose_test(len(samples), bool(subject), normal)
        single = {"welch": stats.welch, "mann_whitney": stats.mann_whitney, "paired_t": stats.paired_t, "wilcoxon": lambda a, b: stats.wilcoxon(a - b)}
        if name in single:
            stat, p = single[name](*samples)
            pairs = {(0, 1): p}
        elif subject:
            stat, p = repeated_anova(table) if name == "rm_anova" else stats.friedman(table)
            pairs = paired_bonferroni(table) if name == "rm_anova" else nemenyi(table)
        else:
            stat, p = stats.anova(*samples) if name == "anova" else stats.kruskal(*samples)
            pairs = tukey(samples) if name == "anova" else dunn(samples)
        return pd.DataFrame([[*head, name, stat, p, str(names[i]), str(names[j]), q] for (i, j), q in pairs.items()], columns=columns)

    schema = "".join(f"{k} {kinds[k]}, " for k in keys) + "test string, statistic double, p double, group_a string, group_b string, p_pair double"
    rows = df.select(*keys, group, value, *([subject] if subject else []))
    from ethoflow.functions.numeric import stars

    return rows.groupBy(*keys).applyInPandas(one, schema).withColumn("sig", stars(F.col("p_pair"))).withColumn("significant", F.col("p") < alpha)


def multinomial_intervals(df: DataFrame, label: str, keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Pooled shares of labels with simultaneous intervals."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        ci = stats.goodman(frame["n"].tolist(), alpha)
        return frame.assign(share=frame["n"] / frame["n"].sum(), ci_low=[c[0] for c in ci], ci_high=[c[1] for c in ci])

    return counts.groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in (*keys, label)) + ", n long, share double, ci_low double, ci_high double")
