"""From the experiment database to labels: export, dynamics, cleaning, normalisation and assignment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethoflow.operators.clean import DEFAULT_BOUNDS, cleaned
from ethoflow.operators.cluster import assigned
from ethoflow.operators.features import PARTS
from ethoflow.operators.sequence import by, forward_difference

#: The columns of the clustering's feature matrix, and those of them that are clustered (velocity and dynamics).
VELOCITY = ("thrust_mm_s", "slip_mm_s", "yaw_rad_s")
POSTURE = (
    "left_eye_x", "left_eye_y", "right_eye_x", "right_eye_y", "tail_base_x", "tail_1_x", "tail_1_y",
    "tail_2_x", "tail_2_y", "tail_3_x", "tail_3_y", "tail_end_x", "tail_end_y",
)
DYNAMICS = tuple(f"{c}_diff" for c in POSTURE)
FEATURES = VELOCITY + POSTURE + DYNAMICS
CLUSTERED = (0, 1, 2, *range(16, 29))
IDS = ("trial_id", "well_number", "frame_number", "tadpole_group_id")


def selected(columns: Sequence[int] = CLUSTERED) -> list[str]:
    """The names of features by their numbers."""
    return [FEATURES[i] for i in columns]


def base_features(t: Mapping[str, DataFrame], groups: Sequence[int]) -> DataFrame:
    """One row a frame of the groups: ids, velocity and posture; parts without a position are null.

    Posture of other groups' frames goes before the pivot (Spark adds a filter of the ids to the scan where that pays), which
    is one conditional aggregate. Of repeated rows of a part the largest value counts, as frames must not multiply. The rows
    have no order; frame numbers give it.
    """
    trials = t["trial"].where(F.col("tadpole_group_id").isin(*groups)).select("trial_id", "well_number", "tadpole_group_id")
    frames = t["time_series"].select("time_series_id", "trial_id", "frame_number").join(trials, "trial_id")
    frames = frames.join(t["velocity"].select("time_series_id", *VELOCITY), "time_series_id")
    parts = t["body_part"].where(F.col("body_marker").isin(*PARTS))
    part = F.col("body_marker")
    own = t["posture"].join(frames.select("time_series_id"), "time_series_id", "left_semi")
    wide = own.join(F.broadcast(parts), "body_part_id").groupBy("time_series_id").agg(*(
        F.max(F.when(part == c.rsplit("_", 1)[0], F.col(f"{c[-1]}_pos_mm"))).alias(c) for c in POSTURE
    ))
    return frames.join(wide, "time_series_id", "left").select(*IDS, *VELOCITY, *POSTURE)


def with_dynamics(df: DataFrame, trial: str | None = "trial_id", order: Sequence[str] = ("trial_id", "frame_number")) -> DataFrame:
    """Adds the posture's differences to the next frame, the last one repeated.

    Differences restart at each trial; without a trial column they run through the whole table in the given order, as
    the first published matrix was made: then the frame before and after are found by a dense row index, not in one task.
    """
    if trial is not None:
        w = by((trial,))
        return df.withColumns({f"{c}_diff": forward_difference(c, w) for c in POSTURE})
    from ethoflow.operators.sequence import row_index

    rows = row_index(df, order, "__i")
    last = rows.agg(F.max("__i")).first()[0] or 0
    after = rows.select((F.col("__i") - 1).alias("__i"), *(F.col(c).alias(f"__next_{c}") for c in POSTURE))
    step = F.least(F.col("__i"), F.lit(max(0, last - 1)))
    stepped = rows.join(after, "__i").select("__i", *((F.col(f"__next_{c}") - F.col(c)).alias(f"{c}_diff") for c in POSTURE))
    out = rows.withColumn("__step", step).join(stepped.withColumnRenamed("__i", "__step"), "__step", "left")
    return out.drop("__i", "__step")


def labels(
    base: DataFrame, stats: Sequence[tuple[float, float]], centroids: Sequence[Sequence[float]],
    columns: Sequence[int] = CLUSTERED, trial: str | None = "trial_id",
) -> DataFrame:
    """The base rows within bounds, with their label; stats are (mu, sigma) of all 29 features, centroids have the chosen ones.

    A row with a missing feature keeps label -1.
    """
    missing = [c for c in (*VELOCITY, *POSTURE) if c not in base.columns]
    if missing:
        raise KeyError(f"the base table lacks {missing}")
    if len(stats) != len(FEATURES):
        raise ValueError(f"statistics of {len(FEATURES)} features are wanted")
    inside = cleaned(with_dynamics(base, trial), DEFAULT_BOUNDS)
    names = selected(columns)
    return assigned(inside, names, centroids, [(FEATURES[i], *stats[i]) for i in columns])


def labels_from_database(t: Mapping[str, DataFrame], groups: Sequence[int], stats: Sequence[tuple[float, float]], centroids: Sequence[Sequence[float]], columns: Sequence[int] = CLUSTERED) -> DataFrame:
    """Rows (ids, label) of all frames of the groups. Spark partitions by trial, so groups need no loop."""
    return labels(base_features(t, groups), stats, centroids, columns).select(*IDS, "label")


#: The marker whose track is an animal's position, and the well's diameter.
POSITION_MARKER = "tail_base"
WELL_MM = 15.6


def locomotion_frames(t: Mapping[str, DataFrame], groups: Sequence[int]) -> DataFrame:
    """Frames for the locomotion metrics: velocity and the tail base's position in mm, both measured, with the well's centre.

    Wells are cut out round their centre, so that the centre is half a diameter from the image's edges.
    """
    trials = t["trial"].where(F.col("tadpole_group_id").isin(*groups)).join(t["video"].select("video_id", "pix2mm", "fps"), "video_id")
    frames = t["time_series"].join(trials.select("trial_id", "tadpole_group_id", "video_id", "pix2mm", "fps"), "trial_id")
    part = t["body_part"].where(F.col("body_marker") == POSITION_MARKER).select("body_part_id")
    at = t["trajectory"].join(F.broadcast(part), "body_part_id").select("time_series_id", "x_pos_mm", "y_pos_mm")
    rows = frames.join(t["velocity"].select("time_series_id", *VELOCITY), "time_series_id").join(at, "time_series_id")
    centre = F.lit(WELL_MM / 2)
    return rows.select(
        "trial_id", "tadpole_group_id", "video_id", "frame_number", "fps", *VELOCITY, (F.col("x_pos_mm") / F.col("pix2mm")).alias("x"),
        (F.col("y_pos_mm") / F.col("pix2mm")).alias("y"), centre.alias("cx"), centre.alias("cy"), centre.alias("radius"),
    )


def frames_of(t: Mapping[str, DataFrame], trials: Sequence[int], frames: Sequence[int]) -> DataFrame:
    """Rows (trial_id, frame_number, filename, well_number): where chosen frames are to be found in the recordings."""
    rows = t["time_series"].where(F.col("trial_id").isin(*trials) & F.col("frame_number").isin(*frames))
    return rows.join(t["trial"], "trial_id").join(t["video"].select("video_id", "filename"), "video_id").select("trial_id", "frame_number", "filename", "well_number")


def labelled_ids(rows: DataFrame, t: Mapping[str, DataFrame], velocity: bool = False) -> DataFrame:
    """Rows with time_series_id get trial, group and well, -1 where unknown, and on demand their velocities."""
    ids = t["time_series"].select("time_series_id", "trial_id").join(t["trial"].select("trial_id", "tadpole_group_id", "well_number"), "trial_id")
    out = rows.join(ids, "time_series_id", "left").withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("trial_id", "tadpole_group_id", "well_number")})
    return out.join(t["velocity"].select("time_series_id", *VELOCITY), "time_series_id", "left") if velocity else out
