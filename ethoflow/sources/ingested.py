"""From reviewed plans and tracks into the experiment database, each as one transaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethoflow.functions.text import initials_fit, parsed_date
from ethoflow.operators import features, ingest, metadata
from ethoflow.operators.ranges import kept
from ethoflow.schemas import BODY_MARKERS
from ethoflow.sources.store import Store

#: The well type that plans give, and the experiment type if none is named.
WELL_TYPE = ("medium", "plain rearing medium, no drug")
EXPERIMENT_TYPE = 7
#: Tables that a video's rows are in.
OF_VIDEO = ("video", "trial", "time_series", "velocity", "trajectory", "posture")


def _added(t, table: str, rows: DataFrame) -> None:
    """Stages new entities, if there are any."""
    if not rows.isEmpty():
        t.put(table, f"added-{t.number:09d}", rows)


def _filled(rows: DataFrame, schema: str, spark) -> DataFrame:
    """Columns that the table has and the rows lack are null."""
    return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in spark.createDataFrame([], schema).schema if f.name not in rows.columns})


def _investigators(store: Store, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new people, rows (sign, investigator_id)): a person fits by first name or by the first letters of both names."""
    people = store.read("investigator")
    signs = wanted.select(F.upper(F.trim("investigator_initials")).alias("sign")).distinct()
    fits = signs.join(F.broadcast(people), initials_fit(F.col("sign"), F.col("first_name"), F.col("last_name")))  # people are few
    known = fits.groupBy("sign").agg(F.min("investigator_id").alias("investigator_id"))
    new, ids = metadata.get_or_create(people.select("investigator_id", F.upper(F.trim("first_name")).alias("sign")), signs.join(known, "sign", "left_anti"), ("sign",), "investigator_id")
    return new.select("investigator_id", F.col("sign").alias("first_name"), F.lit("").alias("last_name")), known.unionByName(ids.select("sign", "investigator_id"))


def commit_plan(store: Store, plan: DataFrame, experiment_type: int = EXPERIMENT_TYPE, default_date: str | None = None, allow_gradient: bool = False) -> DataFrame:
    """Mothers, groups, people and the well type of a plan's ready rows, found or created in one transaction; gives the plate layouts.

    Mothers are told apart by name and strain, groups by mother, transgene and date of fertilisation. A plan that is
    committed again changes nothing. Rows that are not ready are left out; ``ingest.plan_status`` says why.
    """
    spark, t = store.spark, store.begin()
    rows = ingest.plan_status(plan, allow_gradient).where("plan_status = 'ready'")
    written = F.when(F.coalesce("fert_date", F.lit("")) != "", F.col("fert_date")).otherwise(F.lit(default_date or ""))
    rows = kept(rows.withColumns({"fertilised": parsed_date(written).cast("timestamp_ntz"), "sign": F.upper(F.trim("investigator_initials"))}), "plan")

    mother = ("female_identifier", "background_strain")
    new, ids = metadata.get_or_create(store.read("frog").select("frog_id", *mother), rows.select(*mother).distinct(), mother, "frog_id")
    # Of several plates of a new mother or group the first by name tells the tank or folder.
    first = lambda c: F.min_by(F.nullif(F.trim(c), F.lit("")), "video_stem")
    tanks = rows.groupBy(*mother).agg(first("female_tank").alias("female_tank"))
    _added(t, "frog", new.join(tanks, [*mother]))
    rows = rows.join(ids.select(*mother, F.col("frog_id").alias("mother_id")), [*mother])

    group = ("mother_id", "transgene", "fertilised")
    table = store.read("tadpole_group").withColumnRenamed("fertilisation_date", "fertilised")
    new, ids = metadata.get_or_create(table.select("tadpole_group_id", *group), rows.select(*group).distinct(), group, "tadpole_group_id")
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in group]
    folders = rows.groupBy(*group).agg(first("seq_folder").alias("seq_folder"))
    made = new.alias("n").join(folders.alias("f"), same("n", "f")).select("n.*", "f.seq_folder").withColumnRenamed("fertilised", "fertilisation_date")
    _added(t, "tadpole_group", _filled(made, store.schemas["tadpole_group"], spark))
    rows = rows.alias("r").join(ids.alias("i"), same("r", "i")).select("r.*", "i.tadpole_group_id")

    people, signs = _investigators(store, rows)
    _added(t, "investigator", people)
    rows = rows.join(signs, "sign")
    wells = store.read("well_type")
    new, ids = metadata.get_or_create(wells.select("well_type_id", "name"), spark.createDataFrame([WELL_TYPE[:1]], "name string"), ("name",), "well_type_id")
    _added(t, "well_type", _filled(new.withColumn("description", F.lit(WELL_TYPE[1])), store.schemas["well_type"], spark))
    rows = rows.crossJoin(F.broadcast(ids.select("well_type_id")))  # one row

    at = {c: F.col(c) for c in ("investigator_id", "well_type_id", "tadpole_group_id")} | {"experiment_type_id": F.lit(experiment_type)}
    made = ingest.layouts(rows, at)
    layout = t.put("plate_layout", "plan", made) if "plate_layout" in store.schemas else kept(made, "layout")
    t.commit()
    return layout


#: The table of plate layouts that a store may have beside those of the experiment database.
LAYOUT_SCHEMA = "video_stem string, well_number int, investigator_id int, experiment_type_id int, well_type_ids int, tadpole_type_ids int"


def ingest_videos(store: Store, batch: str, videos: DataFrame, layout: DataFrame, tracks: DataFrame, markers: Sequence[str] = BODY_MARKERS) -> None:
    """A batch of videos with their trials, frames, velocities, trajectories and postures, as one transaction.

    videos: columns of the video table but the id; layout: as ``commit_plan`` gives it; tracks: filename, well_number
    (from 1), frame_number, the velocities, ``<marker>_x``, ``<marker>_y`` and their ``_aligned`` forms where there are
    any. A video keeps its id; what any batch held of it before is replaced.
    """
    spark, t = store.spark, store.begin()
    known = store.read("video")
    new, ids = metadata.get_or_create(known.select("video_id", "filename"), videos.select("filename").distinct(), ("filename",), "video_id")
    for part in _batches_of(store, videos):
        if part != batch:
            _without(t, store, part, ids.select("video_id"))
    video = t.put("video", batch, _filled(videos.join(ids, "filename"), store.schemas["video"], spark))
    named = video.select("video_id", F.regexp_replace("filename", r"\.[^.]*$", "").alias("video_stem"))
    trial = t.put("trial", batch, ingest.trial_rows(layout, named))
    own = tracks.join(video.select("video_id", "filename"), "filename")
    frames = kept(metadata.frame_ids(ingest.occupied_tracks(trial, own)), "frames")  # read for four tables
    t.put("time_series", batch, frames.select("time_series_id", "trial_id", "frame_number"))
    t.put("velocity", batch, frames.withColumn("velocity_id", F.col("time_series_id")))
    number = F.array_position(F.array(*map(F.lit, BODY_MARKERS)), F.col("body_part")).cast("int")
    for table, suffix in (("trajectory", ""), ("posture", "_aligned")):
        there = [m for m in markers if f"{m}{suffix}_x" in tracks.columns]
        if there:
            long = features.unpivoted_parts(frames, ["time_series_id"], there, suffix).withColumn("body_part_id", number)
            # An id that repeated runs give again: the frame's, and the part's in its last digits.
            t.put(table, batch, long.withColumn(f"{table}_id", F.col("time_series_id") * 16 + F.col("body_part_id")))
        else:
            t.drop(table, batch)
    t.commit()


def _batches_of(store: Store, videos: DataFrame) -> list[str]:
    """The parts that hold any of the videos."""
    held = store.read("video")
    if not store.parts("video"):
        return []
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/video/(.*)-[0-9a-f]{32}/[^/]*$", 1)
    found = held.select("filename", folder.alias("part")).join(videos.select("filename").distinct(), "filename", "left_semi")
    return [r[0] for r in found.select("part").distinct().collect()]  # batches, not rows


def _without(t, store: Store, part: str, gone: DataFrame) -> None:
    """Rewrites a part of all tables without some videos."""
    def of(table: str) -> DataFrame:
        return store.spark.read.schema(store.schemas[table]).parquet(f"{store.root}/{t.state[table][part]}")

    trials = of("trial").join(gone, "video_id", "left_semi").select("trial_id")
    frames = of("time_series").join(trials, "trial_id", "left_semi").select("time_series_id")
    keys = {"video": (gone, "video_id"), "trial": (gone, "video_id"), "time_series": (trials, "trial_id")}
    rest = {table: of(table).join(*keys.get(table, (frames, "time_series_id")), "left_anti") for table in OF_VIDEO if part in t.state.get(table, {})}
    for table, rows in rest.items():
        t.put(table, part, rows)
