"""Locomotion metrics of one animal a recording, for all recordings at once.

Everything is keyed by the recording, so one shuffle by its keys serves the windows
and the aggregates.  NaN, infinite and null values are no measurements: they take no
part in counts, means and fractions, and end a run.  Without any measurement a
fraction or mean is null.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethoflow.functions.geometry import speed
from ethoflow.functions.numeric import real
from ethoflow.operators.sequence import by, gradient, turning


@dataclass(frozen=True)
class Limits:
    """Thresholds of the detectors (mm, mm/s, rad/s, ms), shares of the well's radius."""

    fps: float = 50.0
    # darting
    burst_speed: float = 8.0
    saccade: float = 6.0
    burst_ms: float = 60.0
    chain_ms: float = 400.0
    bursts: int = 2
    # circling
    wall_share: float = 0.70
    turning: float = 0.5
    circling_speed: float = 3.0
    circling_ms: float = 800.0
    radial_share: float = 0.6  # of the radius, a second
    same_sign: float = 0.8
    # mobility
    moving: float = 2.0
    immobile_ms: float = 500.0
    # thigmotaxis and turns
    centre_share: float = 0.5
    sharp_turn: float = 6.0
    well_radius: float = 7.8

    def frames(self, ms: float) -> int:
        return max(1, round(ms * 1e-3 * self.fps))  # Python's round: halves to even


#: Bins of a velocity histogram, and each channel's range.
HISTOGRAM_BINS = 60
HISTOGRAM_RANGES = {
    "thrust": (-40.0, 40.0),
    "slip": (-30.0, 30.0),
    "yaw": (-20.0, 20.0),
    "abs_translational": (0.0, 50.0),
    "speed": (0.0, 50.0),
}
CHANNELS = tuple(HISTOGRAM_RANGES)


#: Frames of a task of the operators that sort by runs: they hold a frame once for each sort, some 2 KB in all for a whole summary.
TASK_FRAMES = 1 << 17


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows by their recordings, in so many tasks that each gets some TASK_FRAMES, or one recording.

    An exchange without a number of tasks would be merged by its bytes, which are few for narrow frames, so that a task's
    rows and the memory of its sorts would grow with the table.
    """
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-df.count() // TASK_FRAMES))
    return df.repartition(tasks, *keys)


def measured(x: Column) -> Column:
    """Whether a value is a finite number; never null."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < math.inf), F.lit(False))


def above(x: Column, limit: float | Column) -> Column:
    """Whether a measured value lies above; Spark orders NaN above all numbers, so it is tested apart."""
    return measured(x) & F.coalesce(x > limit, F.lit(False))


def ground_speed(w, fps: float) -> Column:
    dx, dy = gradient("x", w), gradient("y", w)
    return F.sqrt(dx * dx + dy * dy) * fps  # correctly rounded steps, so that an exact length falls on the edge of a bin


def with_channels(df: DataFrame, limits: Limits = Limits(), keys: Sequence[str] = ("trial_id",)) -> DataFrame:
    """Adds the five velocity channels under their names."""
    return df.withColumns({
        "thrust": F.col("thrust_mm_s"), "slip": F.col("slip_mm_s"), "yaw": F.col("yaw_rad_s"),
        "abs_translational": speed(), "speed": ground_speed(by(keys), limits.fps),
    })


def path_step(keys: Sequence[str] = ("trial_id",)) -> Column:
    w = by(keys)
    return real(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))


def path_length(df: DataFrame, keys: Sequence[str] = ("trial_id",)) -> DataFrame:
    rows = df.withColumn("__step", path_step(keys))
    return rows.groupBy(*keys).agg(F.coalesce(F.sum("__step"), F.lit(0.0)).alias("path_mm"))


def channel_aggregates(channels: Sequence[str]) -> list[Column]:
    """Mean, median and population deviation over measured values."""
    out = []
    for c in channels:
        x = real(F.col(c))
        out += [F.avg(x).alias(f"{c}_mean"), F.median(x).alias(f"{c}_median"), F.stddev_pop(x).alias(f"{c}_sd")]
    return out


def channel_stats(df: DataFrame, channels: Sequence[str], keys: Sequence[str] = ("trial_id",)) -> DataFrame:
    return df.groupBy(*keys).agg(*channel_aggregates(channels))


def bin_of(x: Column, low: float, high: float, bins: int) -> Column:
    """The bin (from 0) of a value in [low, high], the last one closed; else null."""
    inside = measured(x) & x.between(low, high)
    # Places in whole bin widths: a value on an edge between bins lies in the upper one.
    return F.when(inside, F.least(F.floor((x - float(low)) / ((high - low) / bins)), F.lit(bins - 1)).cast("int"))


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int = HISTOGRAM_BINS, keys: Sequence[str] = ()) -> DataFrame:
    """Density in equal bins over [low, high]; other values do not count."""
    binned = df.withColumn("bin", bin_of(F.col(x), low, high, bins)).where("bin is not null")
    n = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    width = (high - low) / bins
    if keys:
        total = F.sum("n").over(Window.partitionBy(*keys))
        return n.withColumn("density", F.col("n") / (total * width))
    total = n.agg(F.sum("n").alias("total"))  # one row
    return n.crossJoin(F.broadcast(total)).withColumn("density", F.col("n") / (F.col("total") * width)).drop("total")


def channel_histograms(df: DataFrame, keys: Sequence[str] = ("trial_id",), bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Rows (keys, channel, bin, n, density) of all five channels over their ranges, from one pass."""
    binned = F.array(*(
        F.struct(F.lit(c).alias("channel"), F.lit((high - low) / bins).alias("width"), bin_of(F.col(c), low, high, bins).alias("bin"))
        for c, (low, high) in HISTOGRAM_RANGES.items()
    ))
    rows = df.select(*keys, F.explode(binned).alias("b")).select(*keys, "b.*").where("bin is not null")
    n = rows.groupBy(*keys, "channel", "width", "bin").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys, "channel"))
    return n.withColumn("density", F.col("n") / (total * F.col("width"))).drop("width")


def mean_histogram(histograms: DataFrame, groups: Sequence[str]) -> DataFrame:
    return histograms.groupBy(*groups, "bin").agg(F.avg("density").alias("density"))


def _starts(on: str, keys: Sequence[str]) -> Column:
    """Whether a run of a flag starts here."""
    return F.col(on) & ~F.coalesce(F.lag(on).over(by(keys)), F.lit(False))


def with_sharp_turns(df: DataFrame, limits: Limits, keys: Sequence[str]) -> DataFrame:
    df = df.withColumn("__sharp", above(F.abs("yaw_rad_s"), limits.sharp_turn))
    return df.withColumn("__sharp_start", _starts("__sharp", keys))


def turn_aggregates(limits: Limits) -> list[Column]:
    a = real(F.abs("yaw_rad_s"))
    return [
        (F.coalesce(F.sum(a), F.lit(0.0)) / limits.fps).alias("rotation_rad"),
        F.count_if("__sharp_start").alias("sharp_turns"), F.avg(a).alias("mean_abs_yaw"),
    ]


def turns(df: DataFrame, limits: Limits = Limits(), keys: Sequence[str] = ("trial_id",)) -> DataFrame:
    """Total rotation, number of sharp turns (runs of fast yaw) and mean absolute yaw."""
    return with_sharp_turns(df, limits, keys).groupBy(*keys).agg(*turn_aggregates(limits))


def with_well(df: DataFrame, keys: Sequence[str] = ("trial_id",), default_radius: float = Limits.well_radius) -> DataFrame:
    """Adds cx, cy and radius of the recording's well: median centre and 99th percentile of the distance from it.

    Under ten positions the radius is the default.
    """
    all_rows = Window.partitionBy(*keys)
    here = measured(F.col("x")) & measured(F.col("y"))
    df = df.withColumns({
        "cx": F.median(F.when(here, F.col("x"))).over(all_rows), "cy": F.median(F.when(here, F.col("y"))).over(all_rows),
        "__points": F.count_if(here).over(all_rows),
    })
    r = F.when(here, F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")))
    far = F.percentile(r, F.lit(0.99)).over(all_rows)
    return df.withColumn("radius", F.when(F.col("__points") < 10, default_radius).otherwise(far)).drop("__points")


def well_geometry(df: DataFrame, keys: Sequence[str] = ("trial_id",), default_radius: float = Limits.well_radius) -> DataFrame:
    """Rows (keys, cx, cy, radius)."""
    return with_well(df, keys, default_radius).groupBy(*keys).agg(*(F.first(c).alias(c) for c in ("cx", "cy", "radius")))


def with_zone(df: DataFrame, limits: Limits, keys: Sequence[str]) -> DataFrame:
    df = df.withColumn("__r", real(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))))
    df = df.withColumn("__in", F.coalesce(F.col("__r") < limits.centre_share * F.col("radius"), F.lit(False)))
    return df.withColumn("__enter", _starts("__in", keys))


def zone_aggregates() -> list[Column]:
    inside = F.when(F.col("__r").isNotNull(), F.col("__in").cast("double"))
    return [
        F.avg(inside).alias("centre_share"), F.avg(1 - inside).alias("periphery_share"),
        F.count_if("__enter").alias("centre_entries"), F.avg("__r").alias("mean_radial_mm"),
    ]


def thigmotaxis(df: DataFrame, limits: Limits = Limits(), keys: Sequence[str] = ("trial_id",)) -> DataFrame:
    """Shares of frames in the centre and at the periphery, runs in the centre and mean distance; needs cx, cy, radius."""
    return with_zone(df, limits, keys).groupBy(*keys).agg(*zone_aggregates())


def with_long_runs(df: DataFrame, on: str, keys: Sequence[str], least: int, name: str, share: Column | None = None, at_least: float = 0.0) -> DataFrame:
    """Adds ``name`` (in a run of the flag of so many frames) and ``name``_start.

    With a share (0 or 1 for each frame), the larger side's part of the run must also reach ``at_least``.
    """
    w = by(keys)
    df = df.withColumn("__new", F.coalesce(F.col(on) != F.lag(on).over(w), F.lit(True)).cast("long"))
    df = df.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*keys, "__run")
    good = F.col(on) & (F.count(F.lit(1)).over(run) >= least)
    if share is not None:
        left, right = (F.avg((share == s).cast("double")).over(run) for s in (1, -1))
        good = good & (F.greatest(left, right) >= at_least)
    df = df.withColumn(name, good)
    return df.withColumn(f"{name}_start", F.col(name) & (F.col("__new") == 1)).drop("__new", "__run")


def with_mobility(df: DataFrame, limits: Limits, keys: Sequence[str], value: str) -> DataFrame:
    x = F.col(value)
    df = df.withColumns({"__measured": measured(x), "__slow": measured(x) & ~above(x, limits.moving)})
    return with_long_runs(df, "__slow", keys, limits.frames(limits.immobile_ms), "__still")


def mobility_aggregates(limits: Limits) -> list[Column]:
    frames, still = F.count_if("__measured"), F.count_if("__still")
    return [
        ((frames - still) / limits.fps).alias("mobile_s"), (still / limits.fps).alias("immobile_s"),
        F.try_divide(frames - still, frames).alias("mobile_share"), F.count_if("__still_start").alias("immobile_bouts"),
    ]


def mobility(df: DataFrame, limits: Limits = Limits(), keys: Sequence[str] = ("trial_id",), value: str = "speed") -> DataFrame:
    """Mobile and immobile time; pauses shorter than ``immobile_ms`` count as mobile."""
    return with_mobility(dealt(df, keys), limits, keys, value).groupBy(*keys).agg(*mobility_aggregates(limits))


def with_darting(df: DataFrame, limits: Limits, keys: Sequence[str], value: str) -> DataFrame:
    """Adds bursts and the episodes they chain into.

    Two bursts chain if their gap is short and holds a saccade, which depends on that pair alone; so a running count
    of the bursts that do not chain numbers the episodes.
    """
    w = by(keys)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(value)
    df = df.withColumns({"__fast": above(x, limits.burst_speed), "__seen": measured(x), "__at": F.row_number().over(w)})
    df = with_long_runs(df, "__fast", keys, limits.frames(limits.burst_ms), "__burst")
    jerk = above(F.abs("yaw_rad_s"), limits.saccade).cast("long")
    df = df.withColumn("__jerks", F.sum(jerk).over(so_far))  # up to and with this frame
    last = F.when(F.col("__burst"), F.struct(F.col("__at").alias("at"), F.col("__jerks").alias("jerks")))
    df = df.withColumns({"__last": F.last(last, ignorenulls=True).over(before), "__jerks_before": F.lag("__jerks").over(w)})
    gap = F.col("__at") - F.col("__last.at") - 1
    chained = (gap <= limits.frames(limits.chain_ms)) & (F.col("__jerks_before") > F.col("__last.jerks"))
    new = F.col("__burst_start") & ~F.coalesce(chained, F.lit(False))
    df = df.withColumn("__episode", F.sum(new.cast("long")).over(so_far))
    episode = Window.partitionBy(*keys, "__episode")
    bursting = F.when(F.col("__burst"), F.col("__at"))
    df = df.withColumns({
        "__chain": F.count_if("__burst_start").over(episode), "__from": F.min(bursting).over(episode), "__to": F.max(bursting).over(episode),
    })
    df = df.withColumn("__dart", (F.col("__chain") >= limits.bursts) & F.col("__at").between(F.col("__from"), F.col("__to")))
    return df.withColumn("__dart", F.coalesce("__dart", F.lit(False))).withColumn("__dart_start", F.col("__dart") & (F.col("__at") == F.col("__from")))


def darting_aggregates(limits: Limits) -> list[Column]:
    frames = F.count_if("__dart")
    return [
        F.count_if("__dart_start").alias("episodes"), F.count_if("__burst_start").alias("bursts"),
        (frames / limits.fps).alias("darting_s"), F.try_divide(frames, F.count_if("__seen")).alias("darting_share"),
    ]


def darting(df: DataFrame, limits: Limits = Limits(), keys: Sequence[str] = ("trial_id",), value: str = "abs_translational") -> DataFrame:
    """Episodes of bursts that follow each other closely with a saccade between; ``bursts`` counts all of them."""
    return with_darting(dealt(df, keys), limits, keys, value).groupBy(*keys).agg(*darting_aggregates(limits))


def with_circling(df: DataFrame, limits: Limits, keys: Sequence[str], value: str) -> DataFrame:
    """Adds the frames of long, steady turning round the centre near the wall; needs cx, cy, radius.

    A position that is not measured leaves its neighbours without an angle, and no others.
    """
    w = by(keys)
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    df = df.withColumns({"__theta": F.atan2(dy, dx), "__d": F.hypot(dx, dy)})
    df = df.withColumns({"__turn": turning("__theta", w), "__out": gradient("__d", w)})
    seen = measured(F.col("__d")) & measured(F.col(value))
    calm = measured(F.col("__out")) & (F.abs("__out") * limits.fps < limits.radial_share * F.col("radius"))
    on = seen & above(F.col("__d"), limits.wall_share * F.col("radius")) & above(F.abs("__turn") * limits.fps, limits.turning)
    on = on & above(F.col(value), limits.circling_speed) & F.coalesce(calm, F.lit(False))
    df = df.withColumns({"__valid": seen, "__on": on, "__side": F.when(above(F.col("__turn"), 0.0), 1).when(above(-F.col("__turn"), 0.0), -1).otherwise(0)})
    return with_long_runs(df, "__on", keys, limits.frames(limits.circling_ms), "__circle", F.col("__side"), limits.same_sign)


def circling_aggregates(limits: Limits) -> list[Column]:
    frames = F.count_if("__circle")
    return [
        F.count_if("__circle_start").alias("circling_bouts"), (frames / limits.fps).alias("circling_s"),
        F.try_divide(frames, F.count_if("__valid")).alias("circling_share"),
    ]


def circling(df: DataFrame, limits: Limits = Limits(), keys: Sequence[str] = ("trial_id",), value: str = "abs_translational") -> DataFrame:
    """Bouts, time and share of circling; needs cx, cy, radius."""
    return with_circling(dealt(df, keys), limits, keys, value).groupBy(*keys).agg(*circling_aggregates(limits))


def animal_summary(df: DataFrame, limits: Limits = Limits(), keys: Sequence[str] = ("trial_id",)) -> DataFrame:
    """One row an animal with all metrics: one shuffle by the keys, then windows and one aggregate in place."""
    df = with_well(with_channels(dealt(df, keys), limits, keys), keys, limits.well_radius).withColumn("__step", path_step(keys))
    df = with_zone(with_sharp_turns(df, limits, keys), limits, keys)
    df = with_mobility(df, limits, keys, "speed")
    df = with_darting(df, limits, keys, "abs_translational")
    df = with_circling(df, limits, keys, "abs_translational")
    valid = measured(F.col("thrust")) & measured(F.col("yaw"))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_frames"), F.avg(valid.cast("double")).alias("valid_share"),
        *channel_aggregates(CHANNELS), *(F.first(c).alias(c) for c in ("cx", "cy", "radius")),
        F.coalesce(F.sum("__step"), F.lit(0.0)).alias("path_mm"), *turn_aggregates(limits), *zone_aggregates(),
        *mobility_aggregates(limits), *darting_aggregates(limits), *circling_aggregates(limits),
    ).withColumn("fps", F.lit(limits.fps))
