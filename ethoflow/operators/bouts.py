"""Bouts: maximal stretches of one label in one recording."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ethoflow.operators.sequence import runs, with_runs

ANIMAL = ("trial_id", "well_number")


def smoothed(df: DataFrame, minimum: int, keys: Sequence[str] = ANIMAL, label: str = "label", order: str = "frame_number") -> DataFrame:
    """Labels in runs shorter than a minimum take the last long run's label before, else the next one's, else stay.

    Nothing crosses a gap in the frames or an animal's border.
    """
    if minimum <= 1:
        return df
    df = with_runs(df, keys, (), order, out="__segment")
    seg = [*keys, "__segment"]
    df = with_runs(df, seg, (label,), order, out="__run")
    df = df.withColumn("__long", F.when(F.count(F.lit(1)).over(Window.partitionBy(*seg, "__run")) >= minimum, F.col(label)))
    w = Window.partitionBy(*seg).orderBy(order)
    before = F.last("__long", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("__long", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(label, F.coalesce("__long", before, after, label)).drop("__segment", "__run", "__long")


def segments(df: DataFrame, fps: float, keys: Sequence[str] = ANIMAL, label: str = "label", order: str = "frame_number") -> DataFrame:
    """One row a bout with its length in frames and milliseconds."""
    return runs(df, keys, (label,), order).withColumn("duration_ms", F.col("n_frames") / fps * 1000)


def long_enough(bouts: DataFrame, frames: int, fps: float) -> DataFrame:
    return bouts.where(F.col("duration_ms") >= frames / fps * 1000 - 1e-6)


def per_animal(bouts: DataFrame, keys: Sequence[str] = ANIMAL, label: str = "label") -> DataFrame:
    return bouts.groupBy(label, *keys).agg(F.avg("duration_ms").alias("mean_ms"), F.median("duration_ms").alias("median_ms"), F.count(F.lit(1)).alias("n_bouts"))


def across_animals(animals: DataFrame, labels: DataFrame | None = None, label: str = "label") -> DataFrame:
    """Animals, not bouts, are the sample: one row a label; labels without a bout give zeros if listed."""
    quart = F.percentile("median_ms", F.array(F.lit(0.25), F.lit(0.75)))
    out = animals.groupBy(label).agg(
        F.count(F.lit(1)).alias("n_animals"), F.sum("n_bouts").alias("n_bouts"), F.avg("mean_ms").alias("mean_ms"),
        F.coalesce(F.stddev_samp("mean_ms"), F.lit(0.0)).alias("sd_ms"), F.coalesce(F.stddev_samp("mean_ms") / F.sqrt(F.count(F.lit(1))), F.lit(0.0)).alias("sem_ms"),
        F.median("median_ms").alias("median_ms"), quart[0].alias("q1_ms"), quart[1].alias("q3_ms"),
    )
    return out if labels is None else labels.join(out, label, "left").na.fill(0)


def with_interval(summary: DataFrame, samples: DataFrame, value: str = "median_ms", label: str = "label") -> DataFrame:
    """The summary with the bootstrap interval of each label's median over the samples; labels without any get zeros."""
    from ethoflow.operators.stats import bootstrap_interval

    return summary.join(bootstrap_interval(samples, value, (label,)), label, "left").na.fill(0.0, ["ci_low", "ci_high"])


def animal_lists(animals: DataFrame, labels: DataFrame, label: str = "label", keys: Sequence[str] = ANIMAL) -> DataFrame:
    """Per label (all of the listed ones) its animals' means, medians and numbers of bouts, in the order of the means."""
    row = F.struct("mean_ms", *keys, "median_ms", "n_bouts")
    lists = animals.groupBy(label).agg(F.count(F.lit(1)).alias("n_animals"), F.array_sort(F.collect_list(row)).alias("rows"))
    out = labels.join(lists, label, "left")
    part = lambda c, kind: F.coalesce(F.transform("rows", lambda r: r[c]), F.array().cast(f"array<{kind}>"))
    return out.select(label, F.coalesce("n_animals", F.lit(0)).alias("n_animals"), part("mean_ms", "double").alias("means"), part("median_ms", "double").alias("medians"), part("n_bouts", "bigint").alias("bouts"))


def one_animal(bouts: DataFrame, label: str = "label") -> DataFrame:
    """Bouts as the sample: for a single animal."""
    d = "duration_ms"
    quart = F.percentile(d, F.array(F.lit(0.25), F.lit(0.75)))
    return bouts.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_ms"), F.median(d).alias("median_ms"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("sd_ms"),
        F.coalesce(F.stddev_samp(d) / F.sqrt(F.count(F.lit(1))), F.lit(0.0)).alias("sem_ms"), quart[0].alias("q1_ms"), quart[1].alias("q3_ms"),
    )


def durations(df: DataFrame, fps: float, smooth: int = 1, shortest: int = 1) -> DataFrame:
    """Smooth, segment, filter, then the two levels of aggregation."""
    return across_animals(per_animal(long_enough(segments(smoothed(df, smooth), fps), shortest, fps)))


def maxima(summary: DataFrame) -> DataFrame:
    return summary.agg(F.max("mean_ms").alias("max_mean_ms"), F.max("median_ms").alias("max_median_ms"))
