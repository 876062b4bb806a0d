"""Tracks to features: repair, velocity, posture and dynamics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethoflow.functions.geometry import DEFAULT_FPS, WELL_DIAMETER_MM, aligned, per_second, to_body_frame, with_body_axis
from ethoflow.operators.sequence import backward_difference, by, forward_difference, interpolate, repaired_eyes

#: The tracked landmarks, and the parts that get an aligned posture.
PARTS = ("left_eye", "right_eye", "tail_base", "tail_1", "tail_2", "tail_3", "tail_end")
POSTURE_PARTS = ("frons", "right_eye", "left_eye", "tail_base", "tail_1", "tail_2", "tail_3", "tail_end")


def velocity(df: DataFrame, keys: Sequence[str] = ("trial_id",), fps: float = DEFAULT_FPS, diameter_px: float | None = None) -> DataFrame:
    """Adds thrust, slip and yaw speed; without a known scale thrust and slip stay in pixels a frame, yaw is per second always."""
    w = by(keys)
    df = df.withColumns({f"__d{c}": backward_difference(c if c == "yaw" else f"com_{c}", w) for c in ("x", "y", "yaw")})
    thrust, slip = to_body_frame(F.col("__dx"), F.col("__dy"), F.col("yaw"))
    if diameter_px:
        thrust, slip = (per_second(v, WELL_DIAMETER_MM, diameter_px, fps) for v in (thrust, slip))
    return df.withColumns({"thrust_mm_s": thrust, "slip_mm_s": slip, "yaw_rad_s": F.col("__dyaw") * fps}).drop("__dx", "__dy", "__dyaw")


def sure_positions(df: DataFrame, parts: Sequence[str], keys: Sequence[str] = ("trial_id",), threshold: float = 0.5) -> DataFrame:
    """Positions under the likelihood threshold are interpolated."""
    return interpolate(df, {f"{p}_{a}": F.when((F.col(f"{p}_likelihood") >= threshold) & ~F.isnan(f"{p}_{a}"), F.col(f"{p}_{a}")) for p in parts for a in "xy"}, keys)


def dynamics(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("trial_id",), forward: bool = True) -> DataFrame:
    """Adds ``d_<column>`` (forward, for clustering) or ``<column>_diff`` (backward, as stored)."""
    w = by(keys)
    return df.withColumns({f"d_{c}" if forward else f"{c}_diff": (forward_difference if forward else backward_difference)(c, w) for c in columns})


def track_features(df: DataFrame, parts: Sequence[str] | None = None, keys: Sequence[str] = ("trial_id",), fps: float = DEFAULT_FPS, diameter_px: float | None = None) -> DataFrame:
    """The whole chain for tracks with ``<part>_x/_y/_likelihood`` columns."""
    parts = [c.removesuffix("_likelihood") for c in df.columns if c.endswith("_likelihood")] if parts is None else list(parts)
    df = sure_positions(repaired_eyes(df, keys), parts, keys)
    df = velocity(with_body_axis(df), keys, fps, diameter_px)
    df = aligned(df, [*parts, "frons"])
    return dynamics(df, [f"{p}_aligned_{a}" for p in [*parts, "frons"] for a in "xy"], keys, forward=False)


def pivoted_parts(long: DataFrame, key: str, part: str, parts: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """One row a frame from one row a frame and part: a single conditional aggregate in place of a join for each part."""
    return long.groupBy(key).agg(*(F.max(F.when(F.col(part) == p, F.col(v))).alias(f"{p}_{name}") for p in parts for name, v in values.items()))


def unpivoted_parts(wide: DataFrame, keys: Sequence[str], parts: Sequence[str], suffix: str = "") -> DataFrame:
    """One row a frame and part, for the long tables."""
    rows = F.explode(F.array(*(F.struct(F.lit(p).alias("body_part"), F.col(f"{p}{suffix}_x").alias("x_pos_mm"), F.col(f"{p}{suffix}_y").alias("y_pos_mm")) for p in parts)))
    return wide.select(*keys, rows.alias("p")).select(*keys, "p.*")
