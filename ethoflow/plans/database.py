"""Queries over the experiment database, made of the events: exports, labels and look-ups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethoflow.catalog import query
from ethoflow.operators import build, kinematics, metadata
from ethoflow.operators.clean import DEFAULT_BOUNDS, cleaned
from ethoflow.plans.roles import FRAMES, frames, load, rounded
from ethoflow.schemas import BODY_MARKERS

GROUPS = (1, 2)
#: (factor, modulus, shift) of each part's x; y is x of the next factor. Some leave their bounds.
SPREAD = {p: (3 + 2 * i, 23 + 4 * i, 11 + 2 * i) for i, p in enumerate(BODY_MARKERS)}


def _x(part: str, turn: int):
    f, m, s = SPREAD[part]
    return ((F.col("time_series_id") * (f + turn)) % m - s).cast("double")


def database(spark, sf_dir: str) -> dict[str, DataFrame]:
    """Users are trials of four groups on five videos; events are frames. Some velocities and one part's positions are missing."""
    f = frames(spark, sf_dir)
    i = F.col("time_series_id")
    parts = spark.createDataFrame(list(enumerate(BODY_MARKERS, 1)), "body_part_id int, body_marker string")
    rows = F.explode(F.array(*(
        F.struct(F.lit(n).alias("body_part_id"), _x(p, 0).alias("x_pos_mm"), _x(p, 1).alias("y_pos_mm")) for n, p in enumerate(BODY_MARKERS, 1)
    )))
    long = f.select("time_series_id", rows.alias("p")).select("time_series_id", "p.*")
    e = load(spark, sf_dir, "events")
    return {
        "time_series": f.select("time_series_id", "trial_id", "frame_number"),
        "velocity": f.where(i % 31 != 0).select("time_series_id", "thrust_mm_s", "slip_mm_s", "yaw_rad_s"),
        "trial": e.select(F.col("user_id").alias("trial_id"), (F.col("user_id") % 24 + 1).alias("well_number"), (F.col("user_id") % 4).alias("tadpole_group_id"), (F.col("user_id") % 5).alias("video_id")).distinct(),
        "video": spark.range(5).select(F.col("id").alias("video_id"), F.format_string("v%02d.mp4", "id").alias("filename"), (F.col("id") + 2.0).alias("pix2mm"), F.lit(10.0).alias("fps")),
        "body_part": parts, "posture": long.where(~((i % 13 == 0) & (F.col("body_part_id") == 7))), "trajectory": long.where(i % 17 != 0),
    }


def _sql_x(part: str, turn: int) -> str:
    f, m, s = SPREAD[part]
    return f"(time_series_id * {f + turn} % {m} - {s})::double"


DATABASE = f"""{FRAMES}, velocity as (
  select time_series_id, thrust_mm_s, slip_mm_s, yaw_rad_s from frames where time_series_id % 31 <> 0
), trial as (
  select distinct user_id as trial_id, user_id % 24 + 1 as well_number, user_id % 4 as tadpole_group_id, user_id % 5 as video_id from events
), video as (
  select i as video_id, printf('v%02d.mp4', i) as filename, i + 2.0::double as pix2mm from range(5) r(i)
), body_part as (
  select unnest({list(BODY_MARKERS)}) as body_marker, generate_subscripts({list(BODY_MARKERS)}, 1) as body_part_id
), points as (
  select time_series_id, p.n as body_part_id, p.x as x_pos_mm, p.y as y_pos_mm from (
    select time_series_id, unnest([{', '.join(f"{{'n': {n}, 'x': ({_sql_x(p, 0)})::double, 'y': ({_sql_x(p, 1)})::double}}" for n, p in enumerate(BODY_MARKERS, 1))}]) as p from frames)
), posture as (
  select * from points where not (time_series_id % 13 = 0 and body_part_id = 7)
), trajectory as (
  select * from points where time_series_id % 17 <> 0
)"""
_PIVOT = ", ".join(f"max({c[-1]}_pos_mm) filter (body_marker = '{c.rsplit('_', 1)[0]}') as {c}" for c in build.POSTURE)
BASE = f"""chosen as (
  select f.time_series_id, f.trial_id, tr.well_number, f.frame_number, tr.tadpole_group_id, v.thrust_mm_s, v.slip_mm_s, v.yaw_rad_s
  from frames f join velocity v on f.time_series_id = v.time_series_id join trial tr on f.trial_id = tr.trial_id where tr.tadpole_group_id in {GROUPS}
), wide as (
  select time_series_id, {_PIVOT} from posture join body_part using (body_part_id) group by time_series_id
), base as (
  select chosen.* exclude (time_series_id), wide.* exclude (time_series_id) from chosen left join wide on chosen.time_series_id = wide.time_series_id
)"""


@query(f"with {DATABASE}, {BASE} select * replace (frame_number::int as frame_number) from base")
def base_features(spark, d):
    return build.base_features(database(spark, d), GROUPS)


def _dynamics(window: str) -> str:
    """The step to the next row; the last row repeats the one before, a lone row has none."""
    one = "case when lead(frame_number) over w is not null then lead({0}) over w - {0} when lag(frame_number) over w is not null then {0} - lag({0}) over w else 0 end as {0}_diff"
    return f"select *, {', '.join(one.format(c) for c in build.POSTURE)} from base window w as ({window})"


STEPS = f"steps as ({_dynamics('partition by trial_id order by frame_number')})"
_TOTALS = ", ".join(f"round(sum({c}_diff), 6) as {c}_diff" for c in build.POSTURE)


@query(f"with {DATABASE}, {BASE}, {STEPS} select trial_id, {_TOTALS} from steps group by 1")
def posture_dynamics(spark, d):
    steps = build.with_dynamics(build.base_features(database(spark, d), GROUPS))
    return rounded(steps.groupBy("trial_id").agg(*(F.sum(c).alias(c) for c in build.DYNAMICS)))


@query(f"with {DATABASE}, {BASE}, steps as ({_dynamics('order by trial_id, frame_number')}) select trial_id, {_TOTALS} from steps group by 1")
def posture_dynamics_whole_table(spark, d):
    steps = build.with_dynamics(build.base_features(database(spark, d), GROUPS), None)
    return rounded(steps.groupBy("trial_id").agg(*(F.sum(c).alias(c) for c in build.DYNAMICS)))


def _inside() -> str:
    tests = []
    for c, (low, high) in DEFAULT_BOUNDS.items():
        sides = [f"{c} < {low}" if low is not None else "", f"{c} > {high}" if high is not None else ""]
        tests += [f"coalesce({t}, false)" for t in sides if t]
    return "not (" + " or ".join(tests) + ")"


@query(f"with {DATABASE}, {BASE}, {STEPS} select trial_id, count(*) as n, count(*) filter ({_inside()}) as kept from steps group by 1")
def default_bounds(spark, d):
    steps = build.with_dynamics(build.base_features(database(spark, d), GROUPS))
    kept = cleaned(steps, DEFAULT_BOUNDS).groupBy("trial_id").agg(F.count(F.lit(1)).alias("kept"))
    n = steps.groupBy("trial_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(kept, "trial_id", "left").select("trial_id", "n", F.coalesce("kept", F.lit(0)).alias("kept"))


# No two centroids are equally near to a row.
STATS = [(i % 5 - 1.87, i % 3 + 1.07) for i in range(len(build.FEATURES))]
CENTROIDS = [[(i * (k + 2)) % 5 - 2 + k / 7 + i / 130 for i in range(len(build.CLUSTERED))] for k in range(4)]


def _far(k: int) -> str:
    z = [f"(({build.FEATURES[i]} - ({STATS[i][0]})) / {STATS[i][1]})" for i in build.CLUSTERED]
    return f"{sum(v * v for v in CENTROIDS[k])} - 2 * (" + " + ".join(f"{x} * ({v})" for x, v in zip(z, CENTROIDS[k])) + ")"


LABELS = f"""labels as (
  select trial_id, well_number, frame_number::int as frame_number, tadpole_group_id,
    case when {' + '.join(build.FEATURES[i] for i in build.CLUSTERED)} is null then -1 else list_position(far, list_min(far)) - 1 end::int as label
  from (select *, [{', '.join(_far(k) for k in range(len(CENTROIDS)))}] as far from steps where {_inside()})
)"""


@query(f"with {DATABASE}, {BASE}, {STEPS}, {LABELS} select * from labels")
def labels_from_database(spark, d):
    return build.labels_from_database(database(spark, d), GROUPS, STATS, CENTROIDS)


@query(f"with {DATABASE}, {BASE}, {STEPS}, {LABELS} select label, count(*) as n from labels where tadpole_group_id = 1 group by 1")
def labels_of_base_table(spark, d):
    base = build.base_features(database(spark, d), [1])
    return build.labels(base, STATS, CENTROIDS).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


TRACKED = f"""tracked as (
  select f.trial_id, tr.tadpole_group_id, tr.video_id, f.frame_number, thrust_mm_s, slip_mm_s, yaw_rad_s, j.x_pos_mm / pix2mm as x, j.y_pos_mm / pix2mm as y
  from (select time_series_id, trial_id, frame_number from frames) f join trial tr on f.trial_id = tr.trial_id join video using (video_id) join velocity v on f.time_series_id = v.time_series_id
    join trajectory j on f.time_series_id = j.time_series_id join body_part b on j.body_part_id = b.body_part_id and b.body_marker = 'tail_base'
  where tr.tadpole_group_id in {GROUPS}
)"""


@query(f"with {DATABASE}, {TRACKED} select trial_id, tadpole_group_id, video_id, frame_number::int as frame_number, round(thrust_mm_s, 6) as thrust_mm_s, round(x, 6) as x, round(y, 6) as y, 7.8::double as radius from tracked")
def locomotion_frames(spark, d):
    rows = build.locomotion_frames(database(spark, d), GROUPS)
    return rounded(rows.select("trial_id", "tadpole_group_id", "video_id", "frame_number", "thrust_mm_s", "x", "y", "radius"))


@query(f"""with {DATABASE}, {TRACKED}, r as (select trial_id, tadpole_group_id, sqrt(pow(x - 7.8, 2) + pow(y - 7.8, 2)) as r from tracked)
select trial_id, count(*) as n_frames, round(avg((r < 3.9)::int), 6) as centre_share, round(avg(r), 6) as mean_radial_mm from r group by 1""")
def animal_frames_summary(spark, d):
    rows = build.locomotion_frames(database(spark, d), GROUPS)
    zone = kinematics.thigmotaxis(rows).select("trial_id", "centre_share", "mean_radial_mm")
    return rounded(rows.groupBy("trial_id").agg(F.count(F.lit(1)).alias("n_frames")).join(zone, "trial_id"))


@query(f"""with {DATABASE} select f.trial_id, f.frame_number::int as frame_number, filename, tr.well_number
from frames f join trial tr on f.trial_id = tr.trial_id join video using (video_id) where f.trial_id in (1, 2, 3, 5, 8) and f.frame_number in (0, 3, 4)""")
def frame_extraction(spark, d):
    return build.frames_of(database(spark, d), [1, 2, 3, 5, 8], [0, 3, 4])


@query(f"""with {DATABASE}, ids as (select event_id * 2 as time_series_id from events)
select ids.time_series_id, coalesce(f.trial_id, -1) as trial_id, coalesce(tr.tadpole_group_id, -1) as tadpole_group_id, coalesce(tr.well_number, -1) as well_number
from ids left join frames f on ids.time_series_id = f.time_series_id left join trial tr on f.trial_id = tr.trial_id""")
def chunked_id_lookup(spark, d):
    ids = load(spark, d, "events").select((F.col("event_id") * 2).alias("time_series_id"))
    return build.labelled_ids(ids, database(spark, d))


@query(f"""with {DATABASE}, ids as (select event_id * 2 as time_series_id from events)
select ids.time_series_id, coalesce(tr.tadpole_group_id, -1) as tadpole_group_id, round(v.thrust_mm_s, 6) as thrust_mm_s, round(v.yaw_rad_s, 6) as yaw_rad_s
from ids left join frames f on ids.time_series_id = f.time_series_id left join trial tr on f.trial_id = tr.trial_id left join velocity v on ids.time_series_id = v.time_series_id""")
def id_lookup_with_velocity(spark, d):
    ids = load(spark, d, "events").select((F.col("event_id") * 2).alias("time_series_id"))
    rows = build.labelled_ids(ids, database(spark, d), velocity=True)
    return rounded(rows.select("time_series_id", "tadpole_group_id", "thrust_mm_s", "yaw_rad_s"))


@query(f"with {DATABASE} select o_orderkey, coalesce(tadpole_group_id, -1) as tadpole_group_id from orders left join trial on o_custkey = trial_id")
def group_id_mapping(spark, d):
    groups = database(spark, d)["trial"].select(F.col("trial_id").alias("o_custkey"), "tadpole_group_id")
    rows = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    return metadata.looked_up(rows, groups, "o_custkey", "tadpole_group_id").select("o_orderkey", "tadpole_group_id")
