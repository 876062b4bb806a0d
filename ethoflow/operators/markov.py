"""Transitions between labels, and motifs of consecutive labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ethoflow.operators.sequence import by, changed_only


def transitions(df: DataFrame, keys: Sequence[str] = ("trial_id",), label: str = "label", order: str = "frame_number", groups: Sequence[str] = ()) -> DataFrame:
    """Counts of (from, to) between consecutive rows of a recording, self-transitions included."""
    after = df.withColumn("to_label", F.lead(label).over(by(keys, order)))
    return after.where(F.col(label).isNotNull() & F.col("to_label").isNotNull()).groupBy(*groups, F.col(label).alias("from_label"), "to_label").agg(F.count(F.lit(1)).alias("n"))


def probabilities(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Without self-transitions: each row's share, and the share of its origin in all transitions."""
    off = counts.where("from_label <> to_label")
    row = F.sum("n").over(Window.partitionBy(*groups, "from_label"))
    if groups:
        total = F.sum("n").over(Window.partitionBy(*groups))
        return off.withColumns({"row_total": row, "probability": F.try_divide(F.col("n"), row), "apriori": F.try_divide(row, total)})
    total = off.agg(F.sum("n").alias("all_n"))  # one row: joined, so that the edges are not gathered in one task
    return off.crossJoin(F.broadcast(total)).withColumns({"row_total": row, "probability": F.try_divide(F.col("n"), row), "apriori": F.try_divide(row, F.col("all_n"))}).drop("all_n")


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k), by the incomplete beta function: no sum over n."""
    from ethoflow.operators.stats import beta_tail

    if k < 0:
        return 0.0
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    return min(1.0, max(0.0, beta_tail(n - k, k + 1, 1 - p)))


def binomial_quantile(q: float, n: int, p: float) -> int:
    """The least k with P(X <= k) >= q, by bisection."""
    if n == 0 or p <= 0:
        return 0
    if p >= 1:
        return n
    low, high = 0, n
    while low < high:
        middle = (low + high) // 2
        if binomial_cdf(middle, n, p) >= q - 1e-12:
            high = middle
        else:
            low = middle + 1
    return low


def preferred(counts: DataFrame, alpha: float = 0.05, two_sided: bool = False) -> DataFrame:
    """All cells of the transition matrix against the a-priori level of their origin.

    counts: from ``transitions``.  The verdict is ``above``, ``below`` or
    ``within`` by the binomial interval of the cell's probability, with
    ``(significant)`` if the corrected p is under alpha; ``N/A`` on the diagonal.
    Cells without transitions, the diagonal among them, take part in the
    correction; rows without any have no p.  The default p is the lower tail.
    """
    off = counts.where("from_label <> to_label")
    states = off.select(F.explode(F.array("from_label", "to_label")).alias("to_label")).distinct()
    rows = states.select(F.col("to_label").alias("from_label")).crossJoin(F.broadcast(states)).join(off, ["from_label", "to_label"], "left").na.fill(0, ["n"])  # a row for each pair of labels
    total = rows.groupBy("from_label").agg(F.sum("n").alias("row_total"))
    rows = rows.join(F.broadcast(total), "from_label").crossJoin(F.broadcast(off.agg(F.sum("n").alias("all_n"))))
    rows = rows.withColumns({"probability": F.coalesce(F.try_divide("n", "row_total"), F.lit(0.0)), "level": F.coalesce(F.try_divide("row_total", "all_n"), F.lit(0.0))}).drop("all_n")

    @F.pandas_udf("low double, high double, p_value double")
    def exact(n: pd.Series, total: pd.Series, share: pd.Series, level: pd.Series) -> pd.DataFrame:  # a row for each pair of labels
        out = []
        for k, size, own, apriori in zip(n.tolist(), total.tolist(), share.tolist(), level.tolist()):
            if not size:
                out.append((0.0, 0.0, None))
                continue
            p = binomial_cdf(k, size, apriori)
            if two_sided:
                p = min(1.0, 2 * min(p, 1 - binomial_cdf(k - 1, size, apriori)))
            out.append((*(binomial_quantile(q, size, own) / size for q in (0.025, 0.975)), p))
        return pd.DataFrame(out, columns=["low", "high", "p_value"]).astype("float64")

    rows = rows.withColumn("e", exact("n", "row_total", "probability", "level")).select(*rows.columns, "e.low", "e.high", F.when(F.col("row_total") > 0, F.col("e.p_value")).alias("p_value"))
    from ethoflow.operators.stats import false_discovery

    rows = false_discovery(rows, "p_value", "p_adjusted", ())
    verdict = F.when(F.col("high") < F.col("level"), "below").when(F.col("low") > F.col("level"), "above").otherwise("within")
    marked = F.concat(verdict, F.when(F.col("p_adjusted") < alpha, " (significant)").otherwise(""))
    return rows.withColumn("verdict", F.when(F.col("from_label") == F.col("to_label"), "N/A").otherwise(marked))


def motifs(df: DataFrame, n: int, keys: Sequence[str] = ("trial_id",), label: str = "label", order: str = "frame_number", labels: Sequence[int] | None = None, distinct: bool = True) -> DataFrame:
    """Counts of n consecutive labels after runs are reduced to one row; by default all labels of a motif differ."""
    short = changed_only(df.where(F.col(label).isNotNull()), keys, label, order)
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, n - 1)
    grams = short.select(F.collect_list(label).over(ahead).alias("motif")).where(F.size("motif") == n)
    if distinct:
        grams = grams.where(F.size(F.array_distinct("motif")) == n)
    if labels is not None:
        allowed = F.array(*(F.lit(x) for x in labels))
        grams = grams.where(F.forall("motif", lambda x: F.array_contains(allowed, x)))
    return grams.groupBy("motif").agg(F.count(F.lit(1)).alias("n"))


def motif_significance(counts: DataFrame, n: int, labels: int) -> DataFrame:
    """Flags counts above binomial quantiles under equal odds of all arrangements of n labels."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    chance = 1 / math.perm(labels, n)
    limits = {f"above_{str(q)[2:]}": binomial_quantile(q, total, chance) for q in (0.95, 0.99, 0.999)}
    return counts.withColumns({name: F.col("n") > limit for name, limit in limits.items()})


def significant_edges(cells: DataFrame) -> DataFrame:
    """The cells of ``preferred`` whose verdict is above their origin's level."""
    return cells.where(F.col("verdict").contains("above"))


def strong_edges(probs: DataFrame, least: float = 0.14) -> DataFrame:
    return probs.where(F.col("probability") >= least)
