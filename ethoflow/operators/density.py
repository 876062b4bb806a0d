"""Kernel densities and box statistics of groups, as the data behind half violins and boxes.

Values are counted in bins before anything is shuffled, so a group of any size
sends a row a bin; the kernel is laid over the bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a group's range; a kernel spans many of them.
BINS = 512
#: Places at which a density is given.
POINTS = 200


def _known(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    return df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("__x"))


def kernel_density(df: DataFrame, value: str, keys: Sequence[str], points: int = POINTS, bins: int = BINS, log: bool = False) -> DataFrame:
    """Rows (keys, point, x, density, relative): normal kernels of Scott's width over each group, from its least to its greatest value.

    log: on decimal logarithms (x is given back as a value; those of 0 and less do not count). relative: to the group's
    highest density. Groups of under three values, or of equal values, have no density.
    """
    rows = _known(df, value, keys)
    if log:
        rows = rows.where("__x > 0").withColumn("__x", F.log10("__x"))
    about = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__low"), F.max("__x").alias("__high"), F.stddev_samp("__x").alias("__sd"))
    about = about.where("__n >= 3 and __high > __low").withColumn("__wide", F.col("__sd") * F.pow(F.col("__n"), F.lit(-0.2)))
    step = (F.col("__high") - F.col("__low")) / bins
    place = F.least(F.lit(bins - 1), F.floor((F.col("__x") - F.col("__low")) / step)).cast("int")
    counts = rows.join(about, [*keys]).groupBy(*keys, place.alias("__bin")).agg(F.count(F.lit(1)).alias("__c"))
    at = F.col("__low") + F.col("point") / (points - 1) * (F.col("__high") - F.col("__low"))
    centre = F.col("__low") + (F.col("__bin") + 0.5) * step
    z = (at - centre) / F.col("__wide")
    laid = counts.join(about, [*keys]).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    summed = laid.groupBy(*keys, "point").agg(F.max(at).alias("x"), F.sum(F.col("__c") * F.exp(-z * z / 2) / (F.col("__n") * F.col("__wide") * 2.5066282746310002)).alias("density"))
    most = summed.groupBy(*keys).agg(F.max("density").alias("__most"))
    return summed.join(most, [*keys]).select(*keys, "point", (F.pow(F.lit(10.0), "x") if log else F.col("x")).alias("x"), "density", (F.col("density") / F.col("__most")).alias("relative"))


def box_statistics(df: DataFrame, value: str, keys: Sequence[str], reach: float = 1.5) -> DataFrame:
    """Rows (keys, n, q1, median, q3, low, high, n_outside): quartiles, and the farthest values within so many interquartile ranges of them."""
    rows = _known(df, value, keys)
    q = F.percentile("__x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    boxes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"))
    span = reach * (F.col("q3") - F.col("q1"))
    inside = (F.col("__x") >= F.col("q1") - span) & (F.col("__x") <= F.col("q3") + span)
    return rows.join(boxes, [*keys]).groupBy(*keys, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("__x"))).alias("low"), F.max(F.when(inside, F.col("__x"))).alias("high"), F.count_if(~inside).alias("n_outside")
    )
