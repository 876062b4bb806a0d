"""Queries of transactions over several tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ethoflow.catalog import query
from ethoflow.operators import ingest
from ethoflow.operators.ranges import kept
from ethoflow.plans.roles import rounded
from ethoflow.plans.saved import MATCHED, STATUS, _plates
from ethoflow.schemas import TABLES
from ethoflow.session import scratch_path
from ethoflow.sources import ingested
from ethoflow.sources.store import Store


def _store(spark) -> Store:
    return Store(spark, scratch_path(spark, "store"), TABLES | {"plate_layout": ingested.LAYOUT_SCHEMA})


READY = f"""{MATCHED}, ready as (
  select *, ['A', 'B'][n % 2 + 1] as mother, ['CB', 'XY'][n % 2 + 1] as initials from plan join (select filename, n, regexp_replace(filename, '[.][^.]*$', '') as video_stem from numbered) using (video_stem) where {STATUS} = 'ready'
), ids as (
  select *, dense_rank() over (order by mother) as mother_id, dense_rank() over (order by initials) as investigator_id from ready
), entities as (
  select *, dense_rank() over (order by mother_id, transgene, nullif(fert_date, '')::timestamp nulls first) as tadpole_group_id from ids
)"""


@query(f"""with {READY} select video_stem, tadpole_group_id::int as tadpole_group_id, investigator_id::int as investigator_id, n_occupied::bigint as n_wells,
  (select max(tadpole_group_id) from entities)::bigint as n_groups, (select count(distinct mother) from entities)::bigint as n_frogs from entities""")
def committed_plan(spark, d):
    """Mothers, groups and people of a plan; the second commit of the same plan finds all of them. A commit reads no notes."""
    store, plan = _store(spark), kept(ingest.build_plan(*_plates(spark, d)).drop("notes"), "plan")
    ingested.commit_plan(store, plan)
    ingested.commit_plan(store, plan)
    rows = store.read("plate_layout").groupBy("video_stem").agg(F.max("tadpole_type_ids").alias("tadpole_group_id"), F.max("investigator_id").alias("investigator_id"), F.count("tadpole_type_ids").alias("n_wells"))
    n = store.read("tadpole_group").agg(F.count(F.lit(1)).alias("n_groups")).crossJoin(store.read("frog").agg(F.count(F.lit(1)).alias("n_frogs")))
    return rows.crossJoin(F.broadcast(n))  # one row


@query(f"""with {READY}, w as (
  select filename, video_stem, unnest(case occupied_wells when '1-4' then [1, 2, 3, 4] when '1-3' then [1, 2, 3] else [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 20] end) as well from entities
)
select filename, count(distinct well) as n_trials, count(*) as n_frames, round(sum(f * well + length(video_stem) % 2 * 100)::double, 6) as thrust, round(sum(f * 0.5::double * 2), 6) as x from w, range(5) r(f) group by all""")
def ingested_videos(spark, d):
    """Two batches, of which the second replaces half of the first one's videos; a third one never commits."""
    store = _store(spark)
    plan = kept(ingest.build_plan(*_plates(spark, d)).drop("notes"), "plan")
    layout = ingested.commit_plan(store, plan)
    ready = ingest.plan_status(plan).where("plan_status = 'ready'").select(F.col("video_path").alias("filename"), "video_stem")
    videos = ready.select("filename", F.lit(1).alias("series_id"), F.lit(50.0).alias("fps"), F.lit(6.0).alias("pix2mm"))
    grid = ready.withColumn("well_number", F.explode(F.sequence(F.lit(1), F.lit(24)))).withColumn("frame_number", F.explode(F.sequence(F.lit(0), F.lit(4))))
    tracks = grid.withColumns({
        "thrust_mm_s": (F.col("frame_number") * F.col("well_number")).cast("double"), "slip_mm_s": F.lit(0.0), "yaw_rad_s": F.lit(0.0),
        **{f"{m}_{a}": F.col("frame_number") * 0.5 for m in ("tail_base", "tail_1") for a in "xy"},
    })
    odd = F.length(F.regexp_replace("filename", r"\.[^.]*$", "")) % 2 == 1
    later = tracks.where(odd).withColumn("thrust_mm_s", F.col("thrust_mm_s") + 100)
    ingested.ingest_videos(store, "one", videos, layout, tracks)
    for _ in range(2):
        ingested.ingest_videos(store, "two", videos.where(odd), layout, later)
    lost = store.begin()
    for table in ("video", "trial"):
        lost.put(table, "three", store.read(table))
    frames = store.read("time_series").join(store.read("velocity"), "time_series_id").join(store.read("trial"), "trial_id").join(store.read("video"), "video_id")
    sums = frames.groupBy("filename").agg(F.count_distinct("trial_id").alias("n_trials"), F.count(F.lit(1)).alias("n_frames"), F.sum("thrust_mm_s").alias("thrust"))
    at = store.read("trajectory").join(store.read("time_series"), "time_series_id").join(store.read("trial"), "trial_id").join(store.read("video"), "video_id")
    return rounded(sums.join(at.groupBy("filename").agg(F.sum("x_pos_mm").alias("x")), "filename"))
