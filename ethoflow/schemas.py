"""Schemas of the experiment database, one table an entity."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Names and types of the database's columns.
TABLES = {
    "experiment_attributes_association": "experiment_type_id int, attribute_id int",
    "well_attributes_association": "well_type_id int, attribute_id int",
    "experiment_type": "experiment_type_id int, protocol string, long_name string, short_name string, experiment_attribute_1 int, experiment_attribute_2 int, experiment_attribute_3 int, experiment_attribute_4 int, experiment_attribute_5 int",
    "experiment_type_attribute": "experiment_type_attribute_id int, name string",
    "investigator": "investigator_id int, first_name string, last_name string",
    "experiment_series": "series_id int, experiment_type_id int, investigator_id int, experiment_date timestamp_ntz",
    "frog": "frog_id int, female_tank string, female_identifier string, background_strain string",
    "tadpole_group": "tadpole_group_id int, mother_id int, fertilisation_date timestamp_ntz, development_stage string, seq_folder string, transgene string",
    "video": "video_id int, series_id int, pix2mm double, filename string, camera string, video_series_num int, video_series_size int, fps double, date_time timestamp_ntz",
    "trial": "trial_id int, video_id int, well_number int, well_type_id int, tadpole_group_id int",
    "well_type": "well_type_id int, name string, description string, well_attribute_1 int, well_attribute_2 int, well_attribute_3 int, well_attribute_4 int, well_attribute_5 int",
    "well_type_attribute": "well_type_attribute_id int, name string",
    "time_series": "time_series_id long, trial_id int, frame_number int",
    "body_part": "body_part_id int, body_marker string",
    "trajectory": "trajectory_id long, time_series_id long, body_part_id int, x_pos_mm double, y_pos_mm double",
    "posture": "posture_id long, time_series_id long, body_part_id int, x_pos_mm double, y_pos_mm double",
    "velocity": "velocity_id long, time_series_id long, thrust_mm_s double, yaw_rad_s double, slip_mm_s double",
    "clustering_type": "clustering_type_id int, name string",
    "clustering": "clustering_id long, clustering_type_id int, time_series_id long, centroid int",
}


#: Markers of the body parts, in the order of their ids.
BODY_MARKERS = ("left_eye", "right_eye", "frons", "tail_base", "tail_1", "tail_2", "tail_3", "tail_end")


def create(spark: SparkSession, root: str, names: Iterable[str] = tuple(TABLES)) -> None:
    """Empty tables under a folder where they are missing; body parts are seeded."""
    for name in names:
        schema = TABLES[name]
        rows = [(i, p) for i, p in enumerate(BODY_MARKERS, 1)] if name == "body_part" else []
        spark.createDataFrame(rows, schema).write.mode("ignore").parquet(f"{root}/{name}")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")
