"""Prototypes against their frames: postures before and after, typical rows, scales, histograms and the plate's wells."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethoflow.functions.numeric import real
from ethoflow.operators.sequence import by


def posture_around(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("trial_id",), label: str = "label") -> DataFrame:
    """Mean posture of each label's frames and of the frames that follow them in the recording."""
    w = by(keys)
    df = df.withColumns({f"__{c}": F.lead(c).over(w) for c in columns})
    means = [a for c in columns for a in (F.avg(c).alias(f"{c}_before"), F.avg(f"__{c}").alias(f"{c}_after"))]
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(*means)


def first_examples(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("trial_id",), order: str = "frame_number", label: str = "label") -> DataFrame:
    """The first row of each label in the order of recordings and frames, and what the columns are in the next frame."""
    w = by(keys, order)
    df = df.withColumns({f"{c}_after": F.lead(c).over(w) for c in columns})
    row = F.struct(*keys, order, *(c for c in columns), *(f"{c}_after" for c in columns))
    # One row a label is kept in each task before the shuffle.
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.min_by(row, F.struct(*keys, order)).alias("r")).select(label, "r.*")


def upper_percentiles(df: DataFrame, columns: Sequence[str], share: float = 0.95) -> DataFrame:
    """One row with each column's percentile, by linear interpolation."""
    return df.agg(*(F.percentile(real(F.col(c)), F.lit(share)).alias(c) for c in columns))


def scaled_to(df: DataFrame, scales: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns divided by the one-row table's values; a zero leaves a column as it is."""
    named = scales.select(*(F.col(c).alias(f"__s_{c}") for c in columns))
    out = df.crossJoin(F.broadcast(named))
    return out.withColumns({c: F.when(F.col(f"__s_{c}") == 0, F.col(c)).otherwise(F.col(c) / F.col(f"__s_{c}")) for c in columns}).drop(*named.columns)


def max_abs_scaled(centroids: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column divided by its largest absolute value."""
    return scaled_to(centroids, centroids.agg(*(F.max(F.abs(c)).alias(c) for c in columns)), columns)


def divided(df: DataFrame, columns: Sequence[str], k: float) -> DataFrame:
    if k == 0:
        raise ValueError("the divisor is zero")
    return df.withColumns({c: F.col(c) / k for c in columns})


def with_and_without(df: DataFrame, k: int, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """The rows of one label, and all others."""
    own = F.coalesce(F.col(label) == k, F.lit(False))
    return df.where(own), df.where(~own)


def spread_histogram(df: DataFrame, x: str, bins: int, keys: Sequence[str] = (), zeros: bool = True) -> DataFrame:
    """Rows (keys, bin, low, n, density) in equal bins from a group's least to its greatest value, the last one closed."""
    v = real(F.col(x)) if zeros else F.nullif(real(F.col(x)), F.lit(0.0))
    rows = df.select(*keys, v.alias("__x")).where("__x is not null")
    ends = rows.groupBy(*keys).agg(F.min("__x").alias("__low"), F.max("__x").alias("__high"), F.count(F.lit(1)).alias("__all"))
    rows = rows.join(ends, list(keys)) if keys else rows.crossJoin(F.broadcast(ends))
    width = (F.col("__high") - F.col("__low")) / bins
    rows = rows.withColumn("__w", F.when(width == 0, 1.0 / bins).otherwise(width))
    at = F.least(F.floor((F.col("__x") - F.col("__low")) / F.col("__w")).cast("int"), F.lit(bins - 1))
    n = rows.groupBy(*keys, at.alias("bin"), "__low", "__w", "__all").agg(F.count(F.lit(1)).alias("n"))
    return n.select(*keys, "bin", (F.col("__low") + F.col("bin") * F.col("__w")).alias("low"), "n", (F.col("n") / (F.col("__all") * F.col("__w"))).alias("density"))


def mean_change(df: DataFrame, columns: Sequence[str], group: str, control: str, floor: float = 1e-4) -> DataFrame:
    """Rows (group, column, change): log2 of each group's mean against the control's mean."""
    means = df.groupBy(group).agg(*(F.avg(c).alias(c) for c in columns))
    base = means.where(F.col(group) == control).select(*(F.col(c).alias(f"__{c}") for c in columns))
    rows = F.explode(F.array(*(
        F.struct(F.lit(c).alias("column"), F.log2((F.col(c) + floor) / (F.col(f"__{c}") + floor)).alias("change")) for c in columns
    )))
    return means.where(F.col(group) != control).crossJoin(F.broadcast(base)).select(group, rows.alias("r")).select(group, "r.*")


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "internal_id") -> DataFrame:
    """Numbers the rows of each group from 1 in the given order."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def shifted_index(index: Column, n: int, percent: float) -> Column:
    """Where a row goes when the table is rotated back by a share of its length."""
    shift = int(n * percent / 100)
    return F.pmod(index - shift, F.lit(n)) if n else index


def drift_corrected(centres: DataFrame, keys: Sequence[str] = ("video_id",), head: int = 20) -> DataFrame:
    """Well centres without the camera's drift: rows (keys, frame_number, well, x, y).

    Each well starts at the median of its first frames; all wells then move by the mean step of all wells.
    """
    rows = centres.repartition(*keys)  # one shuffle serves all that follows
    w = Window.partitionBy(*keys, "well").orderBy("frame_number")
    anchor = rows.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= head).groupBy(*keys, "well").agg(F.median("x").alias("ax"), F.median("y").alias("ay"))
    steps = rows.withColumns({f"__d{c}": F.col(c) - F.lag(c).over(w) for c in "xy"})
    mean = steps.groupBy(*keys, "frame_number").agg(F.coalesce(F.avg("__dx"), F.lit(0.0)).alias("dx"), F.coalesce(F.avg("__dy"), F.lit(0.0)).alias("dy"))
    so_far = Window.partitionBy(*keys).orderBy("frame_number").rowsBetween(Window.unboundedPreceding, 0)
    path = mean.withColumns({c: F.sum(f"d{c}").over(so_far) for c in "xy"})
    # Both sides grow with the recordings, which sizes guessed from the source do not tell: no broadcast.
    return path.hint("merge").join(anchor, list(keys)).select(*keys, "frame_number", "well", (F.col("ax") + F.col("x")).alias("x"), (F.col("ay") + F.col("y")).alias("y"))


def gaussian_smoothed(df: DataFrame, columns: Sequence[str], sigma: float, keys: Sequence[str], order: str = "frame_number") -> DataFrame:
    """Columns convolved with a normal curve cut at four deviations; beyond the ends the first and last values go on.

    A frame collects its neighbours in a window of bounded length; the weights are literals.
    """
    radius = int(4.0 * sigma + 0.5)
    weights = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    total = sum(weights)
    w = Window.partitionBy(*keys).orderBy(order)
    near, all_rows = w.rowsBetween(-radius, radius), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns({"__at": F.row_number().over(w), "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    curve = F.array(*(F.lit(x / total) for x in weights))
    new = {}
    for c in columns:
        held = F.collect_list(F.col(c)).over(near)
        before = F.greatest(F.lit(radius) - (F.col("__at") - 1), F.lit(0))
        after = F.greatest(F.lit(radius) - (F.col("__n") - F.col("__at")), F.lit(0)).cast("int")
        full = F.concat(F.array_repeat(F.first(c).over(all_rows), before.cast("int")), held, F.array_repeat(F.last(c).over(all_rows), after))
        new[f"__full_{c}"] = full
    df = df.withColumns(new)
    product = {c: F.aggregate(F.zip_with(f"__full_{c}", curve, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for c in columns}
    return df.withColumns(product).drop("__at", "__n", *new)


def closest_radii(circles: DataFrame, keys: Sequence[str], keep: int = 24, ties: Sequence[str] = ()) -> DataFrame:
    """Of each plate's circles those whose radius is nearest to the median radius; ties: columns that decide between equal circles."""
    middle = F.median("radius").over(Window.partitionBy(*keys))
    df = circles.withColumn("__off", F.abs(F.col("radius") - middle))
    w = Window.partitionBy(*keys).orderBy("__off", "cx", "cy", *ties)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= keep).drop("__off", "__r")


def grid_order(circles: DataFrame, keys: Sequence[str], columns: int = 6, out: str = "well_number", ties: Sequence[str] = ()) -> DataFrame:
    """Numbers each plate's circles row by row from 1: by y into rows of so many, then by x; ties: columns that decide between equal places."""
    down = Window.partitionBy(*keys).orderBy("cy", "cx", *ties)
    df = circles.withColumn("__row", F.floor((F.row_number().over(down) - 1) / columns))
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy("__row", "cx", "cy", *ties))).drop("__row")


def decades(df: DataFrame, value: str, out: str = "decade") -> DataFrame:
    """The power of ten below a share; tiny shares count as 1e-10."""
    return df.withColumn(out, F.floor(F.log10(F.col(value) + 1e-10)).cast("int"))


def in_display_order(df: DataFrame, cluster_map: DataFrame, label: str = "label") -> DataFrame:
    """Rows of a small table in the order of the display ids."""
    m = cluster_map.select(F.col("raw_id").alias(label), "display_id")
    return df.join(m, label).orderBy("display_id")


def landmark_points(positions: DataFrame, key: str, column: str = "positions") -> DataFrame:
    """Rows (key, part, x, y) of prototypes' 13 positions: the frons is the origin, the tail base lies on the axis."""
    from ethoflow.operators.build import POSTURE

    at = {c: F.get(F.col(column), F.lit(i)) for i, c in enumerate(POSTURE)}
    parts = [("frons", F.lit(0.0), F.lit(0.0))]
    for p in dict.fromkeys(c.rsplit("_", 1)[0] for c in POSTURE):
        parts.append((p, at[f"{p}_x"], at.get(f"{p}_y", F.lit(0.0))))
    rows = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), x.alias("x"), y.alias("y")) for p, x, y in parts)))
    return positions.select(key, rows.alias("r")).select(key, "r.*")


def directions(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Rows (label, and one column a comparison): the sign of the difference of means where it is significant, else 0.

    pairs: label, comparison, difference, p. The comparisons are few; they become columns.
    """
    sign = F.when(F.col("p") < alpha, F.signum("difference").cast("int")).otherwise(0)
    return pairs.withColumn("sign", sign).groupBy("label").pivot("comparison").agg(F.first("sign"))


def significant(pairs: DataFrame, columns: Sequence[str], alpha: float = 0.05, p: str = "p") -> DataFrame:
    """The comparisons with p below alpha, the smallest first; the needed columns must be there."""
    missing = [c for c in (*columns, p) if c not in pairs.columns]
    if missing:
        raise KeyError(f"the comparisons lack {missing}")
    return pairs.where(F.col(p) < alpha).select(*columns, p).orderBy(p, *columns)


def control_pairs(pairs: DataFrame, control: str) -> DataFrame:
    """Rows (group, p) of the pairs that the control is one of, whichever stands first."""
    other = F.when(F.col("group_a") == control, F.col("group_b")).when(F.col("group_b") == control, F.col("group_a"))
    return pairs.select(*(c for c in pairs.columns if c not in ("group_a", "group_b")), other.alias("group")).where("group is not null")


def matching_names(df: DataFrame, names: str, column: str = "name") -> DataFrame:
    """Rows whose name holds any of the comma-separated parts; all rows without parts."""
    parts = [p.strip() for p in names.split(",") if p.strip()]
    if not parts:
        return df
    hit = F.lit(False)
    for p in parts:
        hit = hit | F.col(column).contains(p)
    return df.where(hit)
