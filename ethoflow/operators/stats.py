"""Resampling, rank and interval statistics on animal-level tables.

Groups here hold one row an animal (tens to thousands), so a group or pair of
groups is one task's work; frames are aggregated before.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ethoflow.operators import exact, ranges


def false_discovery(df: DataFrame, p: str = "p", out: str = "p_adj", keys: Sequence[str] = ("cluster",)) -> DataFrame:
    """Benjamini-Hochberg correction within each key's tests; without keys over the whole table, whose order is dealt to ranges."""
    order = [F.col(p).asc_nulls_last()]
    if keys:
        w = Window.partitionBy(*keys)
        ranked = df.withColumns({"__rank": F.row_number().over(w.orderBy(*order)), "__m": F.count(p).over(w)})
    else:
        tests = F.broadcast(df.agg(F.count(p).alias("__m")))  # one row
        ranked = ranges.row_index(df, order, "__rank").withColumn("__rank", F.col("__rank") + 1).crossJoin(tests)
    raw = ranked.withColumn("__raw", F.col(p) * F.col("__m") / F.col("__rank"))
    if keys:
        held = raw.withColumn("__least", F.min("__raw").over(w.orderBy("__rank").rowsBetween(0, Window.unboundedFollowing)))
    else:
        held = ranges.least_from_here(raw, ["__rank"], "__raw", "__least")
    return held.withColumn(out, F.greatest(F.col(p), F.least(F.lit(1.0), "__least"))).drop("__rank", "__m", "__raw", "__least")


STATISTICS = {"meanDiff": lambda a, b: a.mean(axis=-1) - b.mean(axis=-1), "medianDiff": lambda a, b: np.median(a, axis=-1) - np.median(b, axis=-1), "sumDiff": lambda a, b: a.sum(axis=-1) - b.sum(axis=-1)}


#: Random relabellings are drawn as counts of distinct values where a value is there so many times on average.
FEW_VALUES = 8
#: Numbers held at once for random relabellings.
DRAWN_AT_ONCE = 1 << 22


def permutation_p(a: np.ndarray, b: np.ndarray, n: int | str = 10_000, seed: int = 0, statistic: str = "meanDiff") -> float:
    """Two-sided p-value of a difference under relabelling.

    "all", or a number of draws that all relabellings do not exceed: the share of
    all of them; else that of random ones, the observed arrangement counted. Means and sums depend only on how often
    each value is in a group: with few distinct values those counts are drawn, from the same law.
    """
    if len(a) == 0 or len(b) == 0:
        return float("nan")
    ways = math.lgamma(len(a) + len(b) + 1) - math.lgamma(len(a) + 1) - math.lgamma(len(b) + 1)  # the count itself has as many digits as there are values
    if n == "all" or (ways < math.log(max(n, 1)) + 1 and math.comb(len(a) + len(b), len(a)) <= n):
        return exact.relabelled_share(a, b, statistic)
    f, both, rng = STATISTICS[statistic], np.concatenate([a, b]), np.random.default_rng(seed)
    seen, hits, done = abs(float(f(a, b))), 0, 0
    values, counts = np.unique(both, return_counts=True)
    few = statistic != "medianDiff" and len(values) * FEW_VALUES <= len(both)
    rows = max(1, min(2000, DRAWN_AT_ONCE // (len(values) if few else len(both))))
    if few:
        total, parts = float(counts @ values), (len(a), len(b)) if statistic == "meanDiff" else (1, 1)
    while done < n:
        size = min(rows, n - done)
        if few:
            drawn = rng.multivariate_hypergeometric(counts, len(a), size=size) @ values
            hits += int((np.abs(drawn / parts[0] - (total - drawn) / parts[1]) >= seen - 1e-12 * max(1.0, abs(total) / min(parts))).sum())
            done += size
            continue
        mixed = rng.permuted(np.broadcast_to(both, (size, len(both))), axis=1)
        hits += int((np.abs(f(mixed[:, : len(a)], mixed[:, len(a) :])) >= seen - 1e-12).sum())
        done += size
    return (hits + 1) / (n + 1)


def paired_rows(df: DataFrame, value: str, group: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, group_a, group_b, first, value): each animal once for every pair of groups it is in; first: in group_a."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value) & F.col(group).isNotNull()).select(*keys, F.col(group).cast("string").alias("__g"), F.col(value).cast("double").alias("value"))
    sets = rows.groupBy(*keys).agg(F.collect_set("__g").alias("__all"))  # the groups of a key are few
    met = rows.join(sets, [*keys]) if keys else rows.crossJoin(F.broadcast(sets))
    pairs = met.withColumn("__o", F.explode(F.filter("__all", lambda o: o != F.col("__g"))))
    return pairs.select(*keys, F.least("__g", "__o").alias("group_a"), F.greatest("__g", "__o").alias("group_b"), (F.col("__g") < F.col("__o")).alias("first"), "value")


def _judged(tests: DataFrame, keys: Sequence[str], alpha: float) -> DataFrame:
    from ethoflow.functions.numeric import stars

    if keys:
        corrected = false_discovery(tests, "p", "p_adj", keys)
    else:  # the pairs of one set of groups are few
        corrected = false_discovery(tests.withColumn("__one", F.lit(0)), "p", "p_adj", ("__one",)).drop("__one")
    return corrected.withColumn("sig", stars(F.col("p_adj"))).withColumn("significant", F.col("p_adj") < alpha)


def compare_groups(df: DataFrame, value: str, group: str, keys: Sequence[str] = (), n: int | str = 10_000, seed: int = 0, statistic: str = "meanDiff", alpha: float = 0.05) -> DataFrame:
    """All pairs of groups within each key: permutation p, its correction and stars.  n: draws, or "all" relabellings.

    A pair of groups is one task's work.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = (frame.loc[frame["first"] == side, "value"].to_numpy() for side in (True, False))
        head = [frame[c].iloc[0] for c in (*keys, "group_a", "group_b")]
        return pd.DataFrame([[*head, len(x), len(y), float(x.mean() - y.mean()), permutation_p(x, y, n, seed, statistic)]], columns=[*keys, "group_a", "group_b", "n_a", "n_b", "difference", "p"])

    schema = "".join(f"{k} {kinds[k]}, " for k in keys) + "group_a string, group_b string, n_a long, n_b long, difference double, p double"
    tests = paired_rows(df, value, group, keys).groupBy(*keys, "group_a", "group_b").applyInPandas(one, schema)
    return _judged(tests, keys, alpha)


def rank_tests(df: DataFrame, value: str, group: str, keys: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """All pairs of groups within each key by the rank sum test: rows (keys, group_a, group_b, n_a, n_b, u, p, p_adj, sig, significant).

    Ranks, sums and ties come from windows and aggregates; only the tail of each
    pair's row is computed in Python.
    """
    pair = (*keys, "group_a", "group_b")
    w = Window.partitionBy(*pair)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*pair, "value"))
    ranked = paired_rows(df, value, group, keys).withColumns({"__r": F.rank().over(w.orderBy("value")) + (ties - 1) / 2, "__t": ties * ties - 1})
    sums = ranked.groupBy(*pair).agg(F.count_if("first").alias("n_a"), F.count_if(~F.col("first")).alias("n_b"), F.sum(F.when(F.col("first"), F.col("__r"))).alias("__s"), F.sum("__t").cast("double").alias("__ties"))
    tests = sums.withColumn("u", F.col("__s") - F.col("n_a") * (F.col("n_a") + 1) / 2)
    return _judged(tests.select(*pair, "n_a", "n_b", "u", rank_sum_tail("u", "n_a", "n_b", "__ties").alias("p")), keys, alpha)


def signed_rank_tests(df: DataFrame, difference: str, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, n, w, p) of the signed rank test of each key's differences; p and w are NaN for under three or no difference."""
    rows = df.where(F.col(difference).isNotNull() & ~F.isnan(difference)).select(*keys, F.col(difference).cast("double").alias("__d"))
    size, ties = F.abs("__d"), F.count(F.lit(1)).over(Window.partitionBy(*keys, F.abs("__d")))
    w = Window.partitionBy(*keys)
    # Zeros come first in the order of sizes and do not count.
    zeros = F.count_if(F.col("__d") == 0).over(w)
    ranked = rows.withColumns({"__r": F.rank().over(w.orderBy(size)) + (ties - 1) / 2 - zeros, "__t": ties * ties - 1})
    moved = F.col("__d") != 0
    sums = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__all"), F.count_if(moved).alias("n"), F.coalesce(F.sum(F.when(F.col("__d") > 0, F.col("__r"))), F.lit(0.0)).alias("__up"),
        F.coalesce(F.sum(F.when(F.col("__d") < 0, F.col("__r"))), F.lit(0.0)).alias("__down"), F.coalesce(F.sum(F.when(moved, F.col("__t"))), F.lit(0)).cast("double").alias("__ties"),
    )
    few = (F.col("__all") < 3) | (F.col("n") == 0)
    least = sums.withColumn("w", F.when(few, F.lit(float("nan"))).otherwise(F.least("__up", "__down")))
    return least.select(*keys, "n", "w", signed_rank_tail("w", "n", "__ties", F.col("__all") - F.col("n")).alias("p"))


@F.pandas_udf(T.DoubleType())
def rank_sum_tail(u: pd.Series, n: pd.Series, m: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([mann_whitney_p(*row) for row in zip(u.tolist(), n.tolist(), m.tolist(), ties.tolist())], dtype=float)


@F.pandas_udf(T.DoubleType())
def signed_rank_tail(w: pd.Series, n: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
    return pd.Series([wilcoxon_p(*row) for row in zip(w.tolist(), n.tolist(), ties.tolist(), zeros.tolist())], dtype=float)


def bootstrap_median(values: np.ndarray, n: int = 10_000, seed: int = 0) -> tuple[float, float]:
    """95 % interval of the median by random draws; for under three values their range.  ``exact.median_interval`` is its limit."""
    if len(values) < 3:
        return (float(np.min(values)), float(np.max(values))) if len(values) else (float("nan"), float("nan"))
    rng = np.random.default_rng(seed)
    medians = np.concatenate([np.median(rng.choice(values, (min(1000, n - i), len(values))), axis=1) for i in range(0, n, 1000)])
    low, high = np.percentile(medians, [2.5, 97.5])
    return float(low), float(high)


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def _median_interval(values: pd.Series) -> pd.DataFrame:
    found = [exact.median_interval(np.asarray(v, dtype=float)) for v in values]
    return pd.DataFrame({"low": [f[0] for f in found], "high": [f[1] for f in found]})


def bootstrap_interval(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, ci_low, ci_high): the 95 % bootstrap interval of each key's median, from its law instead of draws.

    A key's values, one an animal, are one array.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    sets = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("__xs"))
    return sets.withColumn("__ci", _median_interval("__xs")).select(*keys, F.col("__ci.low").alias("ci_low"), F.col("__ci.high").alias("ci_high"))


def fold_changes(df: DataFrame, columns: Sequence[str], group: str, control: str) -> DataFrame:
    """log2 of each value against the control group's mean."""
    from ethoflow.functions.numeric import log2_change

    means = df.where(F.col(group) == control).agg(*(F.avg(c).alias(f"__c_{c}") for c in columns))
    out = df.crossJoin(F.broadcast(means))  # one row
    return out.withColumns({c: log2_change(F.col(c), F.col(f"__c_{c}")) for c in columns}).drop(*(f"__c_{c}" for c in columns))


def reverse_inference(df: DataFrame, columns: Sequence[str], group: str, order: Sequence[str], id_col: str) -> DataFrame:
    """Rows (id, truth, predicted) over animals of the listed groups; the first group is the control.

    Each animal is told by the group medians without it: by correlation, or by distance if one side is constant. A median
    without one value follows from that value's rank, so the medians of all animals come from one sorted array a group
    and column.
    """
    some = fold_changes(df.where(F.col(group).isin(*order)), columns, group, order[0])
    long = some.select(id_col, F.col(group).alias("truth"), F.posexplode(F.array(*columns)).alias("c", "x"))
    w = Window.partitionBy("truth", "c").orderBy("x", id_col)
    ranked = long.withColumn("r", F.row_number().over(w) - 1)
    sets = long.groupBy(F.col("truth").alias("g"), "c").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # a row a group and column
    rows = ranked.join(F.broadcast(sets), "c")
    own, size = F.col("g") == F.col("truth"), F.size("xs")
    m = size - F.when(own, 1).otherwise(0)  # values that the median is of

    def kept(i: Column) -> Column:
        return F.get("xs", (i + F.when(own & (i >= F.col("r")), 1).otherwise(0)).cast("int"))

    median = F.when(m > 0, (kept(F.floor((m - 1) / 2)) + kept(F.floor(m / 2))) / 2)
    rows = rows.withColumn("m", median).where("m is not null")
    even = (F.max("x") == F.min("x")) | (F.max("m") == F.min("m"))
    score = F.when(even, -F.sqrt(F.sum(F.pow(F.col("x") - F.col("m"), 2)))).otherwise(F.corr("x", "m"))
    scored = rows.groupBy(id_col, "truth", "g").agg(score.alias("score"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("g"))
    best = scored.groupBy(id_col, "truth").agg(F.max_by("g", F.struct(F.round("score", 12), -place)).alias("predicted"))
    return best.select(id_col, "truth", "predicted")


def confusion(predictions: DataFrame) -> DataFrame:
    """Rows (truth, predicted, n, share of the truth)."""
    n = predictions.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth")))


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("accuracy"))


def ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties share their mean."""
    order = np.argsort(x, kind="stable")
    out = np.empty(len(x))
    out[order] = np.arange(1, len(x) + 1)
    _, back, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.bincount(back, out) / n)[back]


def rank_sums(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """One row (u, n_a, n_b): the rank sum statistic of the first group, ties sharing their mean rank.

    Equal values are counted first, so the running count is over distinct values.
    """
    some = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull() & ~F.isnan(value))
    n = some.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(group) == a).alias("n_a"))
    ranked = ranges.running_sums(n, [value], {"__before": "n"}).withColumn("rank", F.col("__before") + (F.col("n") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("rank") * F.col("n_a")).alias("r"), F.sum("n_a").alias("n_a"), F.sum("n").alias("n"))
    return sums.select((F.col("r") - F.col("n_a") * (F.col("n_a") + 1) / 2).alias("u"), "n_a", (F.col("n") - F.col("n_a")).alias("n_b"))


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def mann_whitney_p(u: float, n: int, m: int, ties: float) -> float:
    """Two-sided p; exact without ties if a side has eight values or fewer, else by the normal law with tie and continuity corrections.

    ties: the sum of t^3 - t over values that stand t times.
    """
    if not n or not m:
        return float("nan")
    if not ties and min(n, m) <= exact.RANK_SUM_MOST:
        return exact.rank_sum_p(u, n, m)
    s2 = n * m / 12 * (n + m + 1 - ties / max((n + m) * (n + m - 1), 1))
    return 1.0 if s2 <= 0 else min(1.0, 2 * normal_tail((abs(u - n * m / 2) - 0.5) / math.sqrt(s2)))


def mann_whitney(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(U of a, two-sided p)."""
    n, m = len(a), len(b)
    if not n or not m:
        return float("nan"), float("nan")
    both = np.concatenate([a, b])
    t = np.unique(both, return_counts=True)[1]
    u = float(ranks(both)[:n].sum() - n * (n + 1) / 2)
    return u, mann_whitney_p(u, n, m, float((t**3 - t).sum()))


def wilcoxon_p(w: float, n: int, ties: float, zeros: int) -> float:
    """Two-sided p of a rank sum of n differences; exact for fifty or fewer without ties and zeros, else by the normal law."""
    if math.isnan(w):
        return w
    if not ties and not zeros and n <= exact.SIGNED_MOST:
        return exact.signed_rank_p(w, n)
    s2 = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return min(1.0, 2 * normal_tail(abs(w - n * (n + 1) / 4) / math.sqrt(s2))) if s2 > 0 else 1.0


def wilcoxon(differences: np.ndarray) -> tuple[float, float]:
    """(smaller rank sum, two-sided p); NaN for under three pairs or no difference."""
    d = differences[differences != 0]
    if len(differences) < 3 or not len(d):
        return float("nan"), float("nan")
    r, t = ranks(np.abs(d)), np.unique(np.abs(d), return_counts=True)[1]
    w = float(min(r[d > 0].sum(), r[d < 0].sum()))
    return w, wilcoxon_p(w, len(d), float((t**3 - t).sum()), len(differences) - len(d))


def gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h, i = d, 0
    while i < 10_000:
        i += 1
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b)
        c = b + num / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi_square_tail(x: float, df: int) -> float:
    return gamma_tail(df / 2, x / 2)


def chi_square_quantile(q: float, df: int) -> float:
    low, high = 0.0, 1.0
    while 1 - chi_square_tail(high, df) < q:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - chi_square_tail(mid, df) < q else (low, mid)
    return (low + high) / 2


def kruskal(*samples: np.ndarray) -> tuple[float, float]:
    """(H corrected for ties, p)."""
    both = np.concatenate(samples)
    n, r = len(both), ranks(both)
    ends = np.cumsum([len(s) for s in samples])
    h = 12 / (n * (n + 1)) * sum(r[e - len(s) : e].sum() ** 2 / len(s) for s, e in zip(samples, ends)) - 3 * (n + 1)
    t = np.unique(both, return_counts=True)[1]
    fix = 1 - (t**3 - t).sum() / (n**3 - n)
    h = h / fix if fix > 0 else 0.0
    return float(h), chi_square_tail(h, len(samples) - 1)


def friedman(table: np.ndarray) -> tuple[float, float]:
    """(statistic, p) of repeated measures [subject, condition]."""
    n, k = table.shape
    r = np.array([ranks(row) for row in table])
    ties = sum((t**3 - t).sum() for t in (np.unique(row, return_counts=True)[1] for row in table))
    q = (12 / (n * k * (k + 1)) * (r.sum(axis=0) ** 2).sum() - 3 * n * (k + 1)) / (1 - ties / (n * (k**3 - k)))
    return float(q), chi_square_tail(q, k - 1)


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d if abs(1 + num * d) > tiny else tiny)
            c = 1 + num / c if abs(1 + num / c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def t_tail(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return beta_tail(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def welch(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    if va + vb == 0:
        return 0.0, 1.0
    t = (a.mean() - b.mean()) / math.sqrt(va + vb)
    df = (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1))
    return float(t), t_tail(t, df)


def paired_t(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    d = a - b
    s = d.std(ddof=1)
    if s == 0:
        return 0.0, 1.0
    t = d.mean() / (s / math.sqrt(len(d)))
    return float(t), t_tail(t, len(d) - 1)


def anova(*samples: np.ndarray) -> tuple[float, float]:
    both = np.concatenate(samples)
    between = sum(len(s) * (s.mean() - both.mean()) ** 2 for s in samples)
    inside = sum(((s - s.mean()) ** 2).sum() for s in samples)
    d1, d2 = len(samples) - 1, len(both) - len(samples)
    f = (between / d1) / (inside / d2) if inside else 0.0
    return float(f), f_tail(f, d1, d2)


def choose_test(groups: int, paired: bool, normal: bool) -> str:
    """The test for so many groups, paired or not, normal or not."""
    if groups > 2:
        return ("rm_anova" if normal else "friedman") if paired else ("anova" if normal else "kruskal")
    return ("paired_t" if normal else "wilcoxon") if paired else ("welch" if normal else "mann_whitney")


def goodman(counts: Sequence[int], alpha: float = 0.05) -> list[tuple[float, float]]:
    """Simultaneous intervals of multinomial shares (Goodman 1965), clipped to 0..1."""
    n = sum(counts)
    if n == 0:
        return [(0.0, 1.0) for _ in counts]
    q = chi_square_quantile(1 - alpha / len(counts), 1)
    out = []
    for c in counts:
        root = math.sqrt(q * (q + 4 * c * (n - c) / n))
        out.append((max(0.0, (q + 2 * c - root) / (2 * (n + q))), min(1.0, (q + 2 * c + root) / (2 * (n + q)))))
    return out
