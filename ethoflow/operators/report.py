"""Star joins and tables of the report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethoflow.functions.text import clutch, recording_day, transgene_parts


def listed(*columns: str):
    """Distinct non-null texts, sorted, with commas."""
    return F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", *columns))), ",")


def experiments(t: Mapping[str, DataFrame], types: Sequence[int] = ()) -> DataFrame:
    """One row an experiment type (of the given ones): people, dates of its series and number of videos."""
    rows = t["experiment_type"].where(F.col("experiment_type_id").isin(*types)) if types else t["experiment_type"]
    rows = rows.join(t["experiment_series"], "experiment_type_id")
    videos = t["video"].groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))  # video ids are unique
    rows = rows.join(t["investigator"], "investigator_id", "left").join(videos, "series_id", "left")
    return rows.groupBy("experiment_type_id", "short_name", "long_name", "protocol").agg(
        listed("first_name", "last_name").alias("investigators"), F.min("experiment_date").alias("series_first"),
        F.max("experiment_date").alias("series_last"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_videos"),
    )


def _filmed(t: Mapping[str, DataFrame]) -> DataFrame:
    """Animals of each group in each video with its series; trial ids are unique, so counting comes before the joins."""
    animals = t["trial"].groupBy("tadpole_group_id", "video_id").agg(F.count(F.lit(1)).alias("n"))
    return animals.join(t["video"].select("video_id", "series_id", "filename"), "video_id").join(t["experiment_series"].select("series_id", "experiment_type_id"), "series_id")


def groups(t: Mapping[str, DataFrame], types: Sequence[int] = ()) -> DataFrame:
    """One row a group of animals (in the given experiment types): numbers, transgene's parts, clutch and role."""
    rows = _filmed(t)
    rows = rows.where(F.col("experiment_type_id").isin(*types)) if types else rows
    sums = rows.groupBy("tadpole_group_id").agg(F.sum("n").alias("n_animals"), F.count(F.lit(1)).alias("n_videos"), F.min("filename").alias("file"))
    out = t["tadpole_group"].join(sums, "tadpole_group_id").withColumn("p", transgene_parts(F.col("transgene")))
    return out.select(
        "tadpole_group_id", "transgene", "mother_id", F.col("development_stage").alias("stage"), "fertilisation_date", "n_animals", "n_videos",
        "p.gene", "p.guide", "p.is_control", "p.is_empty", clutch(F.col("mother_id")).alias("clutch"),
        recording_day(F.col("file")).alias("recording_date"), "p.role",
    )


def internal_controls(groups_table: DataFrame) -> DataFrame:
    return groups_table.where("role = 'internal control'")


#: Marks in the short names of experiment types whose animals are controls for all others.
GLOBAL_CONTROLS = (("PTZ", "seizure-positive (PTZ)"), ("4AP", "seizure-positive (4-AP)"))


def global_controls(t: Mapping[str, DataFrame], excluded: Sequence[int]) -> DataFrame:
    """Animals and groups of the control experiment types outside the selected ones, with their role."""
    role = F.lit(None).cast("string")
    for mark, name in reversed(GLOBAL_CONTROLS):
        role = F.when(F.lower("short_name").contains(mark.lower()), name).otherwise(role)
    types = t["experiment_type"].withColumn("role", role).where("role is not null")
    types = types.where(~F.col("experiment_type_id").isin(*excluded)) if excluded else types
    rows = _filmed(t).join(types.select("experiment_type_id", "short_name", "role"), "experiment_type_id")
    per_group = rows.groupBy("experiment_type_id", "short_name", "role", "tadpole_group_id").agg(F.sum("n").alias("n"))
    return per_group.groupBy("experiment_type_id", "short_name", "role").agg(F.sum("n").alias("n_animals"), F.count("tadpole_group_id").alias("n_groups"))


def in_groups(df: DataFrame, groups_table: DataFrame) -> DataFrame:
    """The rows of an analysis table whose group is in the report, by whichever id column it has; all without one."""
    name = next((c for c in ("tadpole_group_id", "group_id") if c in df.columns), None)
    ids = groups_table.select(F.col("tadpole_group_id").alias(name)) if name else None
    return df if name is None else df.join(ids, name, "left_semi")


def summary_row(experiments_table: DataFrame, groups_table: DataFrame) -> DataFrame:
    """Numbers of experiments and videos, and of groups and animals without the empty wells, with the recordings' dates."""
    e = experiments_table.agg(F.count(F.lit(1)).alias("n_experiments"), F.coalesce(F.sum("n_videos"), F.lit(0)).alias("n_videos"))
    g = groups_table.where("role <> 'empty'").agg(
        F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("n_animals"), F.lit(0)).alias("n_animals"),
        F.min("recording_date").alias("first_day"), F.max("recording_date").alias("last_day"),
    )
    return e.crossJoin(F.broadcast(g))  # one row each


def prevalence_by_group(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy("category").agg(F.sum("prevalence").alias("prevalence")).orderBy(F.desc("prevalence"), "category")


def scale_maxima(catalogue: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Largest thrust and slip outside excluded groups; yaw and duration over all."""
    shown = ~F.col("category").isin(*excluded) if excluded else F.lit(True)
    return catalogue.agg(F.max(F.when(shown, F.abs("thrust"))).alias("max_thrust"), F.max(F.when(shown, F.abs("slip"))).alias("max_slip"), F.max(F.abs("yaw")).alias("max_yaw"), F.max("dur_mean_ms").alias("max_duration_ms"))


def cross_shares(df: DataFrame, row: str, column: str, by_row: bool = True) -> DataFrame:
    """Cross-tabulation as shares of each row, or of each column."""
    from pyspark.sql import Window

    n = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy(row if by_row else column)).cast("double"), F.lit(1e-12)))


def markdown(df: DataFrame, rows: int = 1000) -> str:
    """A report's table as Markdown; missing values are an em dash, floats have three digits.

    A report is read by people: a table of more rows raises ``ValueError`` instead of being cut.
    """
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"a table of over {rows} rows is no report")
    if not got:
        return "_none_"
    show = lambda v: "—" if v is None or v != v else f"{v:.3g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in got])
