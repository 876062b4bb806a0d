"""Queries of the locomotion metrics, with their SQL.

Some positions and velocities of the frames are made NaN, as tracks have gaps.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ethoflow.catalog import query
from ethoflow.functions.geometry import speed
from ethoflow.operators import kinematics
from ethoflow.plans.roles import FRAMES, TRACKS, frames, rounded, tracks

#: The events come about ten to the second and jump about, so runs are short and radial steps long.
LIMITS = kinematics.Limits(fps=10.0, burst_ms=100, chain_ms=2000, immobile_ms=200, circling_ms=200, radial_share=30.0, same_sign=0.6)

ORDERED = "(partition by trial_id order by frame_number)"
BASE = f"with {FRAMES}, {TRACKS}"


def _num(x: str) -> str:
    """A measured value, or null."""
    return f"case when isfinite({x}) then {x} end"


def long_runs(source: str, flag: str, least: int, name: str, more: str = "true") -> str:
    """CTEs: the rows of the source with keep (in a run of the flag of so many frames) and begins."""
    return f"""{name}_new as (
  select *, {flag} as flag, case when lag({flag}) over w is null or lag({flag}) over w <> {flag} then 1 else 0 end as new
  from {source} window w as {ORDERED}
), {name}_run as (
  select *, sum(new) over {ORDERED} as run from {name}_new
), {name} as (
  select *, flag and count(*) over (partition by trial_id, run) >= {least} and {more} as keep, new = 1 as begins from {name}_run
)"""


MOVED = """moved as (
  select *, sqrt(pow(thrust_mm_s, 2) + pow(slip_mm_s, 2)) as v from tracks
)"""


@query(f"""{BASE} select trial_id, round(coalesce(sum({_num('step')}), 0), 6) as path_mm
from (select trial_id, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) as step from tracks window w as {ORDERED}) group by 1""")
def path_length(spark, d):
    return rounded(kinematics.path_length(tracks(spark, d)))


TURNS = f"""turns as (
  select trial_id, round(coalesce(sum({_num('a')}), 0) / 10, 6) as rotation_rad, count(*) filter (sharp and not coalesce(before, false)) as sharp_turns,
    round(avg({_num('a')}), 6) as mean_abs_yaw
  from (select *, lag(sharp) over {ORDERED} as before from (select *, abs(yaw_rad_s) as a, isfinite(yaw_rad_s) and abs(yaw_rad_s) > 6 as sharp from tracks))
  group by 1
)"""


@query(f"{BASE}, {TURNS} select * from turns")
def turn_statistics(spark, d):
    return rounded(kinematics.turns(tracks(spark, d), LIMITS))


WELL = """centre as (
  select trial_id, median(x) as cx, median(y) as cy, count(*) as n from tracks where isfinite(x) and isfinite(y) group by 1
), well as (
  select c.trial_id, cx, cy, case when any_value(n) < 10 then 7.8 else quantile_cont(sqrt(pow(x - cx, 2) + pow(y - cy, 2)), 0.99) end as radius
  from tracks t join centre c using (trial_id) where isfinite(x) and isfinite(y) group by all
)"""


@query(f"{BASE}, {WELL} select trial_id, round(cx, 6) as cx, round(cy, 6) as cy, round(radius, 6) as radius from well")
def well_geometry(spark, d):
    return rounded(kinematics.well_geometry(tracks(spark, d)))


ZONE = f"""zone as (
  select trial_id, round(avg(case when isfinite(r) then inside::int end), 6) as centre_share, round(avg(case when isfinite(r) then 1 - inside::int end), 6) as periphery_share,
    count(*) filter (inside and not coalesce(before, false)) as centre_entries, round(avg({_num('r')}), 6) as mean_radial_mm
  from (select *, lag(inside) over {ORDERED} as before from (
    select *, isfinite(r) and r < 0.5 * radius as inside
    from (select t.*, radius, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) as r from tracks t join well using (trial_id))))
  group by 1
)"""


@query(f"{BASE}, {WELL}, {ZONE} select * from zone")
def thigmotaxis(spark, d):
    return rounded(kinematics.thigmotaxis(kinematics.with_well(tracks(spark, d)), LIMITS))


def _mobility(value: str, source: str) -> str:
    return f"""{long_runs(source, f'(isfinite({value}) and not {value} > 2)', 2, 'pause')}, mobile as (
  select trial_id, round((count(*) filter (isfinite({value})) - count(*) filter (keep)) / 10, 6) as mobile_s, round(count(*) filter (keep) / 10, 6) as immobile_s,
    round((count(*) filter (isfinite({value})) - count(*) filter (keep)) / nullif(count(*) filter (isfinite({value})), 0), 6) as mobile_share,
    count(*) filter (keep and begins) as immobile_bouts
  from pause group by 1
)"""


@query(f"{BASE}, {MOVED}, {_mobility('v', 'moved')} select * from mobile")
def mobility(spark, d):
    return rounded(kinematics.mobility(tracks(spark, d).withColumn("speed", speed()), LIMITS))


# Bursts are numbered; each looks back at the one before for the gap and the saccades in it.
DARTS = f"""{long_runs('moved', '(isfinite(v) and v > 8)', 1, 'burst')}, jerk as (
  select trial_id, frame_number from tracks where isfinite(yaw_rad_s) and abs(yaw_rad_s) > 6
), bursts as (
  select trial_id, run, min(frame_number) as a, max(frame_number) as z from burst where keep group by all
), looked as (
  select *, lag(z) over (partition by trial_id order by a) as y from bursts
), bridged as (
  select *, coalesce(a - y - 1 <= 20, false) and exists (select 1 from jerk j where j.trial_id = looked.trial_id and j.frame_number > y and j.frame_number < a) as joins
  from looked
), episodes as (
  select trial_id, e, count(*) as n, min(a) as a, max(z) as z
  from (select *, sum(case when joins then 0 else 1 end) over (partition by trial_id order by a) as e from bridged) group by all having count(*) >= 2
), darts as (
  select t.trial_id, coalesce(any_value(e.episodes), 0)::bigint as episodes, coalesce(any_value(b.bursts), 0)::bigint as bursts,
    round(coalesce(any_value(e.frames), 0)::double / 10, 6) as darting_s,
    round(coalesce(any_value(e.frames), 0)::double / nullif(count(*) filter (isfinite(t.v)), 0), 6) as darting_share
  from moved t
  left join (select trial_id, count(*) as episodes, sum(z - a + 1) as frames from episodes group by 1) e on t.trial_id = e.trial_id
  left join (select trial_id, count(*) as bursts from bursts group by 1) b on t.trial_id = b.trial_id
  group by 1
)"""


@query(f"{BASE}, {MOVED}, {DARTS} select * from darts")
def darting(spark, d):
    return rounded(kinematics.darting(tracks(spark, d).withColumn("abs_translational", speed()), LIMITS))


def _wrapped(step: str) -> str:
    """A step between two angles, within half a turn."""
    return f"(case when {step} > pi() then {step} - 2 * pi() when {step} < -pi() then {step} + 2 * pi() else {step} end)"


GRADIENT = "coalesce((lead({0}) over w - lag({0}) over w) / 2, lead({0}) over w - {0}, {0} - lag({0}) over w)"
# Null stands for NaN where SQL's functions would raise or order it; the neighbours' gradients are then null too.
CIRCLES = f"""polar as (
  select t.trial_id, t.frame_number, t.v, radius, isfinite(x) and isfinite(y) as placed,
    case when isfinite(x) and isfinite(y) then atan2(y - cy, x - cx) else 'NaN'::double end as theta, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) as r
  from moved t join well using (trial_id)
), steps as (
  select *, theta - lag(theta) over w as s_in, lead(theta) over w - theta as s_out, {GRADIENT.format('r')} as dr from polar window w as {ORDERED}
), turned as (
  select *, case when isfinite(s_in) and isfinite(s_out) then ({_wrapped('s_in')} + {_wrapped('s_out')}) / 2
    when s_in is null and isfinite(s_out) then {_wrapped('s_out')} when s_out is null and isfinite(s_in) then {_wrapped('s_in')} end as turn
  from steps
), walled as (
  select *, placed and isfinite(v) as valid, coalesce(placed and isfinite(v) and r > 0.7 * radius and abs(turn) * 10 > 0.5 and v > 3
    and isfinite(dr) and abs(dr) * 10 < 30 * radius, false) as near
  from turned
), {long_runs('walled', 'near', 2, 'circle', 'greatest(avg((turn > 0)::int) over (partition by trial_id, run), avg((turn < 0)::int) over (partition by trial_id, run)) >= 0.6')}, circles as (
  select trial_id, count(*) filter (keep and begins) as circling_bouts, round(count(*) filter (keep) / 10, 6) as circling_s,
    round(count(*) filter (keep) / nullif(count(*) filter (valid), 0), 6) as circling_share
  from circle group by 1
)"""


@query(f"{BASE}, {MOVED}, {WELL}, {CIRCLES} select * from circles")
def circling(spark, d):
    f = kinematics.with_well(tracks(spark, d)).withColumn("abs_translational", speed())
    return rounded(kinematics.circling(f, LIMITS))


CHANNEL_SQL = {"thrust": "thrust_mm_s", "slip": "slip_mm_s", "yaw": "yaw_rad_s", "abs_translational": "v", "speed": "ground"}
GROUND = f"""grounded as (
  select *, sqrt(pow({GRADIENT.format('x')}, 2) + pow({GRADIENT.format('y')}, 2)) * 10 as ground from moved window w as {ORDERED}
)"""


def _stats(name: str, x: str) -> str:
    v = _num(x)
    return f"round(avg({v}), 6) as {name}_mean, round(median({v}), 6) as {name}_median, round(stddev_pop({v}), 6) as {name}_sd"


@query(f"{BASE}, {MOVED}, {GROUND} select trial_id, {', '.join(_stats(n, x) for n, x in CHANNEL_SQL.items())} from grounded group by 1")
def channel_statistics(spark, d):
    return rounded(kinematics.channel_stats(kinematics.with_channels(tracks(spark, d), LIMITS), kinematics.CHANNELS))


@query(f"""{BASE}, {MOVED}, {GROUND}, {WELL}, {TURNS}, {ZONE}, {_mobility('ground', 'grounded')}, {DARTS}, {CIRCLES}, plain as (
  select trial_id, count(*) as n_frames, round(avg((isfinite(thrust_mm_s) and isfinite(yaw_rad_s))::int), 6) as valid_share,
    {', '.join(_stats(n, x) for n, x in CHANNEL_SQL.items())} from grounded group by 1
), path as (
  select trial_id, round(coalesce(sum({_num('step')}), 0), 6) as path_mm
  from (select trial_id, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) as step from tracks window w as {ORDERED}) group by 1
)
select plain.*, round(cx, 6) as cx, round(cy, 6) as cy, round(radius, 6) as radius, path_mm, turns.* exclude (trial_id), zone.* exclude (trial_id),
  mobile.* exclude (trial_id), darts.* exclude (trial_id), circles.* exclude (trial_id), 10.0::double as fps
from plain join well using (trial_id) join path using (trial_id) join turns using (trial_id) join zone using (trial_id) join mobile using (trial_id)
  join darts using (trial_id) join circles using (trial_id)""")
def animal_summary(spark, d):
    return rounded(kinematics.animal_summary(tracks(spark, d), LIMITS))


@query(f"""with {FRAMES} select grp, b::int as bin, n, round(n / (sum(n) over (partition by grp) * 0.5), 6) as density
from (select grp, least(floor(x / 0.5), 59) as b, count(*) as n from frames where x between 0 and 30 group by all)""")
def velocity_histogram(spark, d):
    return rounded(kinematics.histogram(frames(spark, d), "x", 0, 30, 60, ("grp",)))


def _binned(name: str, x: str) -> str:
    low, high = kinematics.HISTOGRAM_RANGES[name]
    width = (high - low) / kinematics.HISTOGRAM_BINS
    return f"""select trial_id, '{name}' as channel, {width} as width, least(floor(({x} - ({low})) / {width}), 59)::int as bin
  from grounded where isfinite({x}) and {x} between {low} and {high}"""


HISTOGRAMS = f"""{BASE}, {MOVED}, {GROUND}, binned as (
  {' union all '.join(_binned(n, x) for n, x in CHANNEL_SQL.items())}
), histograms as (
  select trial_id, channel, bin, n, n / (sum(n) over (partition by trial_id, channel) * width) as density
  from (select trial_id, channel, width, bin, count(*) as n from binned group by all)
)"""


@query(f"{HISTOGRAMS} select trial_id, channel, bin, n, round(density, 6) as density from histograms")
def channel_histograms(spark, d):
    return rounded(kinematics.channel_histograms(kinematics.with_channels(tracks(spark, d), LIMITS)))


@query(f"{HISTOGRAMS} select trial_id % 4 as grp, channel, bin, round(avg(density), 6) as density from histograms group by all")
def mean_histograms(spark, d):
    one = kinematics.channel_histograms(kinematics.with_channels(tracks(spark, d), LIMITS)).withColumn("grp", F.col("trial_id") % 4)
    return rounded(kinematics.mean_histogram(one, ("grp", "channel")))
