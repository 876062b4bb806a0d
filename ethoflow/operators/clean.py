"""Boundary cleaning of feature tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ethoflow.functions.numeric import within

Bounds = Mapping[str, tuple[float | None, float | None]]

#: Closed ranges of the features (mm/s, body lengths); None leaves a side open, yaw_rad_s has no bound.
DEFAULT_BOUNDS: Bounds = {
    "thrust_mm_s": (-400.0, 400.0),
    "slip_mm_s": (-400.0, 400.0),
    "left_eye_x": (-25.0, 25.0),
    "left_eye_y": (-15.0, 15.0),
    "right_eye_x": (-25.0, 25.0),
    "right_eye_y": (-15.0, 15.0),
    "tail_base_x": (None, 30.0),
    "tail_1_x": (-25.0, 50.0),
    "tail_1_y": (-25.0, 25.0),
    "tail_2_x": (-40.0, 55.0),
    "tail_2_y": (-50.0, 50.0),
    "tail_3_x": (-50.0, 100.0),
    "tail_3_y": (None, None),
    "tail_end_x": (None, 80.0),
    "tail_end_y": (-100.0, 100.0),
    "left_eye_x_diff": (-20.0, 20.0),
    "left_eye_y_diff": (-75.0, 75.0),
    "right_eye_x_diff": (-20.0, 20.0),
    "right_eye_y_diff": (-75.0, 75.0),
    "tail_base_x_diff": (-15.0, 15.0),
    "tail_1_x_diff": (-100.0, 100.0),
    "tail_1_y_diff": (-100.0, 100.0),
    "tail_2_x_diff": (-100.0, 100.0),
    "tail_2_y_diff": (-100.0, 100.0),
    "tail_3_x_diff": (-100.0, 100.0),
    "tail_3_y_diff": (-100.0, 100.0),
    "tail_end_x_diff": (-100.0, 100.0),
    "tail_end_y_diff": (-150.0, 150.0),
}


def present(df: DataFrame, bounds: Bounds) -> Bounds:
    return {k: v for k, v in bounds.items() if k in df.columns}


def cleaned(df: DataFrame, bounds: Bounds, keep_nan: bool = True) -> DataFrame:
    """Rows with no bounded feature outside its closed range; absent features are skipped."""
    return df.where(within(present(df, bounds), keep_nan))


def removed(df: DataFrame, bounds: Bounds, keep_nan: bool = True) -> DataFrame:
    """The rows that ``cleaned`` leaves out."""
    return df.where(~within(present(df, bounds), keep_nan))
