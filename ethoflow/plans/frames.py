"""Frame queries: each operator over the standard tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethoflow.catalog import query
from ethoflow.functions import numeric
from ethoflow.functions.geometry import aligned, per_second, speed, speed_with_turn, to_body_frame, with_body_axis
from ethoflow.operators import battery, bouts, clean, cluster, features, kinematics, markov, metadata, proportions, sequence, stats
from ethoflow.plans.roles import FRAMES, K, LANDMARKS, frames, landmarks, load, rounded

FPS = 50.0


SHARES = f"""with {FRAMES}, shares as (
  select trial_id, grp, label as cluster, n / sum(n) over (partition by trial_id) as proportion
  from (select trial_id, grp, l.label, count(f.label) as n from (select distinct trial_id, grp from frames) t cross join range(5) l(label)
    left join frames f using (trial_id, grp, label) group by all)
)"""


@query(f"{SHARES} select trial_id, {', '.join(f'round(max(proportion) filter (cluster = {k}), 6) as cluster_{k}' for k in range(K))} from shares group by trial_id")
def trial_proportions(spark, d):
    return rounded(proportions.wide(frames(spark, d), range(K)))


def _long(spark, d):
    shares = proportions.wide(frames(spark, d), range(K))
    return proportions.long(shares).withColumn("grp", F.col("trial_id") % 4)


@query(f"{SHARES} select trial_id, cluster::int as cluster, grp, round(proportion, 6) as proportion from shares")
def proportions_long(spark, d):
    return rounded(_long(spark, d))


@query(f"{SHARES} select grp, cluster::int as cluster, round(avg(proportion), 6) as mean, round(coalesce(stddev_samp(proportion) / sqrt(count(*)), 0), 6) as sem, count(*) as n from shares group by all")
def group_summary(spark, d):
    return rounded(proportions.summary(_long(spark, d)))


@query(f"with {FRAMES} select grp, label::int as label, n, round(n / sum(n) over (partition by grp), 6) as proportion from (select grp, label, count(*) as n from frames group by all)")
def pooled_proportions(spark, d):
    return rounded(proportions.pooled(frames(spark, d), ("grp",)))


@query(f"""with {FRAMES} select grp, round(avg(x), 6) as x_mean, round(stddev_samp(x) / sqrt(count(*)), 6) as x_sem, round(avg(y), 6) as y_mean, round(stddev_samp(y) / sqrt(count(*)), 6) as y_sem,
  count(*) as n_tadpoles from (select grp, trial_id, avg(x) as x, avg(y) as y from frames group by all) group by grp""")
def group_means(spark, d):
    animals = frames(spark, d).groupBy("grp", "trial_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).drop("trial_id")
    return rounded(proportions.group_means(animals, ("grp",)))


@query(f"with {FRAMES} select case when trial_id between 10 and 40 or label = 4 then 'late' when grp in (1, 2) then 'mid' end as grp_name, count(*) as n from frames where trial_id between 10 and 40 or label = 4 or grp in (1, 2) group by 1")
def criteria_groups(spark, d):
    rows = proportions.grouped(frames(spark, d), [("mid", proportions.matching({"grp": [1, 2]})), ("late", proportions.in_trials("10-40") | proportions.matching({"label": 4}))], "grp_name")
    return rows.groupBy("grp_name").agg(F.count(F.lit(1)).alias("n"))


PAIRS = f"""with {FRAMES}, pairs as (select grp, label as from_label, lead(label) over (partition by trial_id order by frame_number) as to_label from frames),
counts as (select from_label, to_label, count(*) as n from pairs where to_label is not null group by all)"""


@query(f"{PAIRS} select from_label::int as from_label, to_label::int as to_label, n from counts")
def transition_counts(spark, d):
    return markov.transitions(frames(spark, d))


@query(f"""{PAIRS} select from_label::int as from_label, to_label::int as to_label, n, sum(n) over (partition by from_label)::bigint as row_total,
  round(n / sum(n) over (partition by from_label), 6) as probability, round(sum(n) over (partition by from_label) / sum(n) over (), 6) as apriori from counts where from_label <> to_label""")
def transition_probabilities(spark, d):
    return rounded(markov.probabilities(markov.transitions(frames(spark, d))))


@query(f"""{PAIRS}, c as (select grp, from_label, to_label, count(*) as n from pairs where to_label is not null group by all) select grp, from_label::int as from_label, to_label::int as to_label, n,
  sum(n) over (partition by grp, from_label)::bigint as row_total, round(n / sum(n) over (partition by grp, from_label), 6) as probability,
  round(sum(n) over (partition by grp, from_label) / sum(n) over (partition by grp), 6) as apriori from c where from_label <> to_label""")
def grouped_transitions(spark, d):
    return rounded(markov.probabilities(markov.transitions(frames(spark, d), groups=("grp",)), ("grp",)))


def _tail(n: str, k: str, p: str) -> str:
    """One term of the binomial law."""
    return f"exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1) + {k} * ln({p}) + ({n} - {k}) * ln(1 - {p}))"


CELLS = f"""{PAIRS}, off as (select * from counts where from_label <> to_label), states as (select unnest([from_label, to_label]) as s from off group by 1),
cells as (select a.s as from_label, b.s as to_label, coalesce(n, 0) as n from states a cross join states b left join off on from_label = a.s and to_label = b.s),
levels as (
  select *, sum(n) over (partition by from_label) as row_total, n / sum(n) over (partition by from_label) as probability,
    sum(n) over (partition by from_label) / sum(n) over () as level from cells
), laws as (
  select from_label, to_label, row_total, n, sum(own) over w as own, sum(apriori) over w as apriori, i from (
    select *, case when probability > 0 then {_tail('row_total', 'i', 'probability')} else (i = 0)::int end as own, {_tail('row_total', 'i', 'level')} as apriori
    from (select *, unnest(range(0, (row_total + 1)::bigint)) as i from levels))
  window w as (partition by from_label, to_label order by i)
), tested as (
  select from_label, to_label, min(i) filter (own >= 0.025 - 1e-12) / any_value(row_total) as low, min(i) filter (own >= 0.975 - 1e-12) / any_value(row_total) as high,
    max(apriori) filter (i = n) as p_value from laws group by all
), adjusted as (
  select *, least(1, min(p_value * m / r) over (order by r rows between current row and unbounded following)) as p_adjusted
  from (select *, row_number() over (order by p_value) as r, count(*) over () as m from tested)
), marked as (
  select from_label, to_label, n, probability, level, low, high, p_value, p_adjusted, case when from_label = to_label then 'N/A' else
    case when high < level then 'below' when low > level then 'above' else 'within' end || case when p_adjusted < 0.05 then ' (significant)' else '' end end as verdict
  from levels join adjusted using (from_label, to_label)
)"""
_CELL = "from_label::int as from_label, to_label::int as to_label, n, round(low, 6) as low, round(high, 6) as high, round(p_value, 6) as p_value, round(p_adjusted, 6) as p_adjusted, verdict"


def _preferred(spark, d):
    cells = markov.preferred(markov.transitions(frames(spark, d)))
    return cells.select("from_label", "to_label", "n", "low", "high", "p_value", "p_adjusted", "verdict")


@query(f"{CELLS} select {_CELL} from marked")
def preferred_transitions(spark, d):
    return rounded(_preferred(spark, d))


@query(f"{CELLS} select {_CELL} from marked where contains(verdict, 'above')")
def significant_edges(spark, d):
    return rounded(markov.significant_edges(_preferred(spark, d)))


@query(f"""{PAIRS} select from_label::int as from_label, to_label::int as to_label, round(n / t, 6) as probability
from (select *, sum(n) over (partition by from_label) as t from counts where from_label <> to_label) where n / t >= 0.25""")
def strong_edges(spark, d):
    probabilities = markov.probabilities(markov.transitions(frames(spark, d)))
    return rounded(markov.strong_edges(probabilities, 0.25).select("from_label", "to_label", "probability"))


SHORT = f"""with {FRAMES}, short as (
  select * from (select *, lag(label) over (partition by trial_id order by frame_number) as before from frames) where before is null or before <> label
)"""


@query(f"{SHORT} select trial_id, frame_number::int as frame_number, label::int as label from short")
def dedupe_labels(spark, d):
    return sequence.changed_only(frames(spark, d), ("trial_id",)).select("trial_id", "frame_number", "label")


GRAMS = f"""{SHORT}, grams as (select label as a, lead(label, 1) over w as b, lead(label, 2) over w as c from short window w as (partition by trial_id order by frame_number)),
counted as (select a || '-' || b || '-' || c as motif, count(*) as n from grams where c is not null and a <> b and b <> c and a <> c group by 1)"""


@query(f"{GRAMS} select * from counted")
def ngram_motifs(spark, d):
    return markov.motifs(frames(spark, d), 3).select(F.array_join(F.transform("motif", lambda x: x.cast("string")), "-").alias("motif"), "n")


@query(f"""{GRAMS}, t as (select sum(n) as t from counted), law as (
  select i, sum(x) over (order by i) as c from (select i, {_tail('t', 'i', '(1 / 60)')} as x from (select t, unnest(range(0, (t + 1)::bigint)) as i from t))
), limits as (
  select min(i) filter (c >= 0.95 - 1e-12) as a, min(i) filter (c >= 0.99 - 1e-12) as b, min(i) filter (c >= 0.999 - 1e-12) as z from law
) select motif, n, n > a as above_95, n > b as above_99, n > z as above_999 from counted, limits""")
def motif_significance(spark, d):
    return markov.motif_significance(markov.motifs(frames(spark, d), 3), 3, K).withColumn("motif", F.array_join(F.transform("motif", lambda x: x.cast("string")), "-"))


def _bouts(label: str = "label", source: str = "frames") -> str:
    return f"""b as (select *, sum(new) over (partition by trial_id, well_number order by frame_number) as run from (
    select *, case when lag(frame_number) over w is null or {label} <> lag({label}) over w or frame_number - lag(frame_number) over w <> 1 then 1 else 0 end as new
    from {source} window w as (partition by trial_id, well_number order by frame_number))),
bouts as (select trial_id, well_number, run, {label} as label, min(frame_number) as first_frame, max(frame_number) as last_frame, count(*) as n_frames, count(*) / 50.0 * 1000 as duration_ms from b group by all)"""


@query(f"with {FRAMES}, {_bouts()} select trial_id, well_number, run::bigint as run, label::int as label, first_frame::int as first_frame, last_frame::int as last_frame, n_frames, round(duration_ms::double, 6) as duration_ms from bouts")
def bout_segments(spark, d):
    return rounded(bouts.segments(frames(spark, d), FPS))


SMOOTH = f"""with {FRAMES}, {_bouts()}, long as (
  select b.*, case when t.n_frames >= 2 then b.label end as kept from b join bouts t using (trial_id, well_number, run)
), smooth as (
  select trial_id, well_number, frame_number, coalesce(kept, last_value(kept ignore nulls) over (partition by trial_id, well_number order by frame_number rows between unbounded preceding and current row),
    first_value(kept ignore nulls) over (partition by trial_id, well_number order by frame_number rows between current row and unbounded following), label) as label from long
)"""


@query(f"{SMOOTH} select trial_id, frame_number::int as frame_number, label::int as label from smooth")
def bout_smooth(spark, d):
    return bouts.smoothed(frames(spark, d), 2).select("trial_id", "frame_number", "label")


ANIMALS = f"with {FRAMES}, {_bouts()}, animals as (select label, trial_id, well_number, avg(duration_ms) as mean_ms, median(duration_ms) as median_ms, count(*) as n_bouts from bouts group by all)"


@query(f"{ANIMALS} select label::int as label, trial_id, well_number, round(mean_ms::double, 6) as mean_ms, round(median_ms::double, 6) as median_ms, n_bouts from animals")
def per_animal_bouts(spark, d):
    return rounded(bouts.per_animal(bouts.segments(frames(spark, d), FPS)))


@query(f"""{ANIMALS} select label::int as label, count(*) as n_animals, sum(n_bouts)::bigint as n_bouts, round(avg(mean_ms)::double, 6) as mean_ms, round(coalesce(stddev_samp(mean_ms), 0), 6) as sd_ms,
  round(coalesce(stddev_samp(mean_ms) / sqrt(count(*)), 0), 6) as sem_ms, round(median(median_ms)::double, 6) as median_ms, round(quantile_cont(median_ms, 0.25)::double, 6) as q1_ms, round(quantile_cont(median_ms, 0.75)::double, 6) as q3_ms
from animals group by label""")
def prototype_durations(spark, d):
    return rounded(bouts.durations(frames(spark, d), FPS))


@query(f"{ANIMALS} select round(max(m)::double, 6) as max_mean_ms, round(max(q)::double, 6) as max_median_ms from (select avg(mean_ms) as m, median(median_ms) as q from animals group by label)")
def duration_maxima(spark, d):
    return rounded(bouts.maxima(bouts.durations(frames(spark, d), FPS)))


@query(f"with {FRAMES}, {_bouts()} select trial_id, count(*) as n, round(sum(duration_ms)::double, 6) as total_ms from bouts where duration_ms >= 40 - 1e-6 group by 1")
def long_bouts(spark, d):
    return rounded(bouts.long_enough(bouts.segments(frames(spark, d), FPS), 2, FPS).groupBy("trial_id").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("total_ms")))


def _per_frame(columns: str, where: str = "") -> str:
    return f"with {FRAMES} select trial_id, frame_number::int as frame_number, {columns} from frames {where} window w as (partition by trial_id order by frame_number)"


def _frame_query(make: Callable, names: list[str]):
    def run(spark, d):
        df = frames(spark, d)
        return rounded(make(df, sequence.by(("trial_id",))).select("trial_id", "frame_number", *names))

    return run


@query(_per_frame("round(coalesce(x - lag(x) over w, 0), 6) as d"))
def backward_diff(spark, d):
    return _frame_query(lambda f, w: f.withColumn("d", sequence.backward_difference("x", w)), ["d"])(spark, d)


@query(_per_frame("round(coalesce(lead(x) over w - x, x - lag(x) over w, 0), 6) as d"))
def forward_diff(spark, d):
    return _frame_query(lambda f, w: f.withColumn("d", sequence.forward_difference("x", w)), ["d"])(spark, d)


@query(_per_frame("round(last_value(case when likelihood >= 0.5 then x end ignore nulls) over (partition by trial_id order by frame_number rows between unbounded preceding and current row), 6) as filled").replace(" window w as (partition by trial_id order by frame_number)", ""))
def forward_fill(spark, d):
    return _frame_query(lambda f, w: f.withColumn("filled", sequence.filled_forward(F.when(F.col("likelihood") >= 0.5, F.col("x")), w)), ["filled"])(spark, d)


@query(f"""with {FRAMES}, k as (select trial_id, frame_number, case when likelihood >= 0.5 then x end as x from frames), g as (
  select *, max(case when x is not null then frame_number end) over (partition by trial_id order by frame_number rows between unbounded preceding and current row) as p,
    min(case when x is not null then frame_number end) over (partition by trial_id order by frame_number rows between current row and unbounded following) as q from k)
select g.trial_id, g.frame_number::int as frame_number, round(case when g.x is not null then g.x when g.p is null then null when g.q is null then a.x else a.x + (b.x - a.x) * (g.frame_number - g.p) / (g.q - g.p) end, 6) as filled
from g left join k a on g.trial_id = a.trial_id and g.p = a.frame_number left join k b on g.trial_id = b.trial_id and g.q = b.frame_number""")
def linear_interpolation(spark, d):
    return rounded(sequence.interpolate(frames(spark, d), {"filled": F.when(F.col("likelihood") >= 0.5, F.col("x"))}, ("trial_id",)).select("trial_id", "frame_number", "filled"))


GRADIENT = "coalesce((lead({0}) over w - lag({0}) over w) / 2, lead({0}) over w - {0}, {0} - lag({0}) over w)"


@query(_per_frame(f"round(sqrt(pow({GRADIENT.format('x')}, 2) + pow({GRADIENT.format('y')}, 2)) * 50, 6) as ground_speed"))
def gradient_speed(spark, d):
    return _frame_query(lambda f, w: f.withColumn("ground_speed", kinematics.ground_speed(w, FPS)), ["ground_speed"])(spark, d)


@query(_per_frame("round(sqrt(pow(thrust_mm_s, 2) + pow(slip_mm_s, 2)), 6) as speed, round(sqrt(pow(thrust_mm_s, 2) + pow(slip_mm_s, 2) + pow(yaw_rad_s, 2)), 6) as combined").replace(" window w as (partition by trial_id order by frame_number)", ""))
def speed_channels(spark, d):
    return _frame_query(lambda f, w: f.withColumns({"speed": speed(), "combined": speed_with_turn()}), ["speed", "combined"])(spark, d)


FEATURES = ("left_eye_x", "right_eye_y", "tail_base_y")
STATS = (("left_eye_x", 25.0, 14.0), ("right_eye_y", 5.0, 3.0), ("tail_base_y", -25.0, 0.0))
CENTROIDS = ((-1.0, -1.0, 0.0), (1.0, -1.0, 10.0), (-1.0, 1.0, 20.0), (1.0, 1.0, -20.0))


@query(f"""with {LANDMARKS}, m as (select avg(left_eye_x) as a, stddev_pop(left_eye_x) as b, avg(right_eye_y) as c, stddev_pop(right_eye_y) as d, avg(tail_base_y) as e, stddev_pop(tail_base_y) as f from landmarks)
select 0 as feature_idx, 'left_eye_x' as feature, round(a, 6) as mu, round(b, 6) as sigma from m union all select 1, 'right_eye_y', round(c, 6), round(d, 6) from m union all select 2, 'tail_base_y', round(e, 6), round(f, 6) from m""")
def mu_sigma(spark, d):
    return rounded(cluster.mu_sigma(landmarks(spark, d), FEATURES))


ROW = "trial_id, frame_number, part_key, supp_key"


@query(f"with {LANDMARKS} select {ROW}, round((left_eye_x - 25) / 14, 6) as left_eye_x, round((right_eye_y - 5) / 3, 6) as right_eye_y, round(tail_base_y + 25, 6) as tail_base_y from landmarks")
def zscore(spark, d):
    return rounded(cluster.zscored(landmarks(spark, d), STATS).select(*ROW.split(", "), *FEATURES))


BOUNDS = {"left_eye_x": (5.0, 45.0), "right_eye_y": (None, 9.0), "tail_base_y": (-58.0, None), "yaw_rad_s": (None, None), "absent": (0.0, 1.0)}
INSIDE = "left_eye_x between 5 and 45 and right_eye_y <= 9 and tail_base_y >= -58"


@query(f"with {LANDMARKS} select trial_id, count(*) as n, round(sum(tail_base_y), 6) as total from landmarks where {INSIDE} group by 1")
def clean_bounds(spark, d):
    return rounded(clean.cleaned(landmarks(spark, d), BOUNDS).groupBy("trial_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tail_base_y").alias("total")))


@query(f"with {LANDMARKS} select {ROW} from landmarks where not ({INSIDE})")
def removed_rows(spark, d):
    return clean.removed(landmarks(spark, d), BOUNDS).select(*ROW.split(", "))


def _distance(i: int) -> str:
    c = CENTROIDS[i]
    return f"{sum(v * v for v in c)} - 2 * ((left_eye_x - 25) / 14 * {c[0]} + (right_eye_y - 5) / 3 * {c[1]} + (tail_base_y + 25) * {c[2]})"


LABELLED = f"""with {LANDMARKS}, dist as (select *, [{', '.join(_distance(i) for i in range(len(CENTROIDS)))}] as ds from landmarks),
labelled as (select *, list_position(ds, list_min(ds)) - 1 as label from dist)"""


@query(f"{LABELLED} select {ROW}, label::int as label from labelled")
def nearest_centroid(spark, d):
    return cluster.assigned(landmarks(spark, d), FEATURES, CENTROIDS, STATS).select(*ROW.split(", "), "label")


def _labelled(spark, d):
    z = cluster.zscored(landmarks(spark, d), STATS)
    return cluster.assigned(z, FEATURES, CENTROIDS)


@query(f"{LABELLED} select round(sum(pow((left_eye_x - 25) / 14 - [{', '.join(str(c[0]) for c in CENTROIDS)}][label + 1], 2) + pow((right_eye_y - 5) / 3 - [{', '.join(str(c[1]) for c in CENTROIDS)}][label + 1], 2) + pow(tail_base_y + 25 - [{', '.join(str(c[2]) for c in CENTROIDS)}][label + 1], 2)), 2) as inertia from labelled")
def inertia(spark, d):
    return rounded(cluster.inertia(_labelled(spark, d), FEATURES, CENTROIDS), 2)


@query(f"""{LABELLED}, z as (select label, (left_eye_x - 25) / 14 as a, (right_eye_y - 5) / 3 as b, tail_base_y + 25 as c from labelled), m as (select label, count(*) as n, avg(a) as a, avg(b) as b, avg(c) as c from z group by 1),
g as (select avg(a) as a, avg(b) as b, avg(c) as c, count(*) as n from z)
select round((select sum(m.n * (pow(m.a - g.a, 2) + pow(m.b - g.b, 2) + pow(m.c - g.c, 2))) from m, g) / (select sum(pow(z.a - m.a, 2) + pow(z.b - m.b, 2) + pow(z.c - m.c, 2)) from z join m using (label)) * (select n from g - 0) / 1, 3) as calinski_harabasz""".replace("(select n from g - 0) / 1", "((select n from g) - (select count(*) from m)) / ((select count(*) from m) - 1)"))
def calinski_harabasz(spark, d):
    return rounded(cluster.calinski_harabasz(_labelled(spark, d), FEATURES), 3)


@query("with n as (select count(*) as n from events) select event_id from events, n where (event_id - (n.n * 90 // 100) + n.n) % n.n >= n.n * 30 // 100")
def leave_out(spark, d):
    e = load(spark, d, "events")
    return sequence.left_out(e, "event_id", e.count(), 30, 90).select("event_id")


@query(f"""{SHARES}, c as (select cluster, avg(proportion) as m from shares where grp = 0 group by 1) select trial_id, cluster::int as cluster, round(log2((proportion + 1e-4) / (m + 1e-4)), 6) as change from shares join c using (cluster)""")
def fold_change(spark, d):
    wide = proportions.wide(frames(spark, d), range(K)).withColumn("grp", (F.col("trial_id") % 4).cast("string"))
    changed = stats.fold_changes(wide, [f"cluster_{k}" for k in range(K)], "grp", "0")
    return rounded(proportions.long(changed.drop("grp")).withColumnRenamed("proportion", "change"))


INFERRED = f"""{SHARES}, m0 as (select cluster, avg(proportion) as m from shares where grp = 0 group by 1), x as (
  select trial_id, grp, cluster, log2((proportion + 1e-4) / (m + 1e-4)) as x from shares join m0 using (cluster)
), medians as (
  select i.trial_id, i.grp, o.grp as g, i.cluster, any_value(i.x) as x, median(o.x) as m from x i join x o on i.cluster = o.cluster and i.trial_id <> o.trial_id group by i.trial_id, i.grp, o.grp, i.cluster
), scores as (
  select trial_id, grp, g, round(case when max(x) = min(x) or max(m) = min(m) then -sqrt(sum(pow(x - m, 2))) else corr(x, m) end, 12) as score from medians group by 1, 2, 3
), told as (
  select trial_id, grp, arg_max(g, (score, -g)) as predicted from scores group by 1, 2
)"""


@query(f"{INFERRED} select grp::varchar as truth, predicted::varchar as predicted, count(*) as n, round(count(*) / sum(count(*)) over (partition by grp), 6) as share from told group by grp, predicted")
def reverse_inference(spark, d):
    wide = proportions.wide(frames(spark, d), range(K)).withColumn("grp", (F.col("trial_id") % 4).cast("string"))
    return rounded(stats.confusion(stats.reverse_inference(wide, [f"cluster_{k}" for k in range(K)], "grp", ["0", "1", "2", "3"], "trial_id")))


@query()
def compare_groups(spark, d):
    rows = _long(spark, d).withColumn("grp", F.col("grp").cast("string"))
    return rounded(stats.compare_groups(rows, "proportion", "grp", ("cluster",)))


@query("""with p as (select l_returnflag, l_linenumber, (abs(sum(l_orderkey * 31 + l_partkey)) % 997 + 1)::double / 2000 as p from lineitem group by all),
r as (select *, row_number() over (partition by l_returnflag order by p, l_linenumber) as k, count(*) over (partition by l_returnflag) as m from p)
select l_returnflag, l_linenumber, round(p, 6) as p, round(least(1, min(p * m / k) over (partition by l_returnflag order by k rows between current row and unbounded following)), 6) as p_adj from r""")
def bh_fdr(spark, d):
    p = load(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(((F.abs(F.sum(F.col("l_orderkey") * 31 + F.col("l_partkey"))) % 997 + 1).cast("double") / 2000).alias("p"))
    return rounded(stats.false_discovery(p, "p", "p_adj", ("l_returnflag",)))


@query(f"with {FRAMES} select trial_id, frame_number::int as frame_number, case when label in (0, 1) then 'active' when label in (1, 3) then 'pause' end as category from frames")
def agglomerate(spark, d):
    return metadata.agglomerated(frames(spark, d), [("active", [0, 1]), ("pause", [1, 3])]).select("trial_id", "frame_number", "category")


@query(f"with {FRAMES} select trial_id, frame_number::int as frame_number, label::int as label from (select *, row_number() over (partition by grp, label order by time_series_id) as r from frames) where r <= 3")
def first_n_per_group(spark, d):
    return sequence.first_rows(frames(spark, d), ("grp", "label"), ("time_series_id",), 3).select("trial_id", "frame_number", "label")


@query(f"with {FRAMES} select label::int as k, round(quantile_cont(x, 0.25), 6) as inertia_q1, round(quantile_cont(x, 0.5), 6) as inertia_median, round(quantile_cont(x, 0.75), 6) as inertia_q3, count(*) as n_fits from frames group by 1")
def quartiles_per_k(spark, d):
    return rounded(cluster.selection_summary(frames(spark, d).select(F.col("label").alias("k"), F.col("x").alias("inertia"))))


@query(f"with {LANDMARKS} select {ROW}, round((left_eye_x + right_eye_x) / 2, 6) as frons_x, round((left_eye_y + right_eye_y) / 2, 6) as frons_y, round((left_eye_x + right_eye_x + tail_base_x) / 3, 6) as com_x, round((left_eye_y + right_eye_y + tail_base_y) / 3, 6) as com_y, round(atan2((left_eye_y + right_eye_y) / 2 - tail_base_y, (left_eye_x + right_eye_x) / 2 - tail_base_x), 6) as yaw from landmarks")
def body_axis(spark, d):
    return rounded(with_body_axis(landmarks(spark, d)).select(*ROW.split(", "), "frons_x", "frons_y", "com_x", "com_y", "yaw"))


@query(f"""with {LANDMARKS}, a as (select *, (left_eye_x + right_eye_x) / 2 as fx, (left_eye_y + right_eye_y) / 2 as fy from landmarks), b as (select *, sqrt(pow(tail_base_x - fx, 2) + pow(tail_base_y - fy, 2)) as len from a)
select {ROW}, round(((left_eye_x - fx) * (tail_base_x - fx) + (left_eye_y - fy) * (tail_base_y - fy)) / len, 5) as eye_x, round(((left_eye_y - fy) * (tail_base_x - fx) - (left_eye_x - fx) * (tail_base_y - fy)) / len, 5) as eye_y, round(len, 5) as tail_x from b where len > 0""")
def posture_alignment(spark, d):
    got = aligned(with_body_axis(landmarks(spark, d)), ("left_eye", "tail_base"))
    return rounded(got.where(F.col("tail_base_aligned_x") > 0).select(*ROW.split(", "), F.col("left_eye_aligned_x").alias("eye_x"), F.col("left_eye_aligned_y").alias("eye_y"), F.col("tail_base_aligned_x").alias("tail_x")), 5)


@query(_per_frame("round(coalesce(x - lag(x) over w, 0) * cos(yaw_rad_s) + coalesce(y - lag(y) over w, 0) * sin(yaw_rad_s), 5) as thrust, round(coalesce(y - lag(y) over w, 0) * cos(yaw_rad_s) - coalesce(x - lag(x) over w, 0) * sin(yaw_rad_s), 5) as slip, round(coalesce(x - lag(x) over w, 0) * 15.6 / 100 * 50, 5) as dx_mm_s"))
def body_velocity(spark, d):
    w = sequence.by(("trial_id",))
    f = frames(spark, d).withColumns({"dx": sequence.backward_difference("x", w), "dy": sequence.backward_difference("y", w)})
    thrust, slip = to_body_frame(F.col("dx"), F.col("dy"), F.col("yaw_rad_s"))
    return rounded(f.select("trial_id", "frame_number", thrust.alias("thrust"), slip.alias("slip"), per_second(F.col("dx"), 15.6, 100.0, 50.0).alias("dx_mm_s")), 5)


@query("select l_orderkey, round(max(l_quantity) filter (l_returnflag = 'A'), 6) as A_q, round(max(l_tax) filter (l_returnflag = 'A'), 6) as A_t, round(max(l_quantity) filter (l_returnflag = 'N'), 6) as N_q, round(max(l_tax) filter (l_returnflag = 'N'), 6) as N_t, round(max(l_quantity) filter (l_returnflag = 'R'), 6) as R_q, round(max(l_tax) filter (l_returnflag = 'R'), 6) as R_t from lineitem group by 1")
def pivot_bodyparts(spark, d):
    return rounded(features.pivoted_parts(load(spark, d, "lineitem"), "l_orderkey", "l_returnflag", ("A", "N", "R"), {"q": "l_quantity", "t": "l_tax"}))


@query(f"with {LANDMARKS} select {ROW}, 'left_eye' as body_part, left_eye_x as x_pos_mm, left_eye_y as y_pos_mm from landmarks union all select {ROW}, 'tail_base', tail_base_x, tail_base_y from landmarks")
def unpivot_bodyparts(spark, d):
    return features.unpivoted_parts(landmarks(spark, d), ROW.split(", "), ("left_eye", "tail_base"))


@query(f"with {FRAMES} select trial_id, frame_number::int as frame_number, case when x < 0.5 then '***' when x < 1 then '**' when x < 3 then '*' else 'ns' end as sig from frames")
def significance_stars(spark, d):
    return frames(spark, d).select("trial_id", "frame_number", numeric.stars(F.when(F.col("x") < 0.5, 0.0005).when(F.col("x") < 1, 0.005).when(F.col("x") < 3, 0.03).otherwise(0.2)).alias("sig"))


def _vectors(spark, d):
    v = load(spark, d, "embeddings")
    return v.select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)))


# Attempts of three centroids each: the cheapest of the six matchings counts.
_MATCHINGS = ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))


@query(f"""with v as (select vec_id % 4 as position, label % 3 as k, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings),
c as (select position, k, list(m order by i) as e from (select position, k, i, avg(x::double) as m from v group by all) group by all),
f as (select position, list(e order by k) as e from c group by 1),
d as (select a.position, b.position as other, least({', '.join('+'.join(f'list_distance(a.e[{i + 1}], b.e[{j + 1}])' for i, j in enumerate(m)) for m in _MATCHINGS)}) as d from f a, f b),
r as (select other from (select other, sum(d) as t from d group by 1) order by round(t, 9), other limit 1)
select 3 as k, position::int as position, round(d, 6) as instability from d where other = (select other from r)""")
def instability(spark, d):
    v = _vectors(spark, d)
    means = v.groupBy((F.col("vec_id") % 4).cast("int").alias("position"), (F.col("label") % 3).alias("c")).agg(F.array(*(F.avg(f"f{i}") for i in range(64))).alias("e"))
    fits = means.groupBy("position").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "e"))), lambda s: s["e"]).alias("centroids"))
    fits = fits.withColumns({"k": F.size("centroids"), "del_size": F.lit(0)})
    return rounded(cluster.instability(fits).select("k", "position", "instability"))


@query()
def group_battery(spark, d):
    rows = _long(spark, d).withColumn("grp", F.col("grp").cast("string"))
    return rounded(battery.run_battery(rows, "proportion", "grp", ("cluster",)))


# 6.634896601021213 is the 0.99 quantile of chi-square with one degree of freedom: 0.05 over five labels.
@query(f"""with {FRAMES}, c as (select *, sum(n) over (partition by grp) as t from (select grp, label, count(*) as n from frames group by all)),
q as (select *, 6.634896601021213::double as q from c), r as (select *, sqrt(q * (q + 4 * n * (t - n) / t)) as root from q)
select grp, label::int as label, n, round(n / t, 6) as share, round(greatest(0, (q + 2 * n - root) / (2 * (t + q))), 6) as ci_low, round(least(1, (q + 2 * n + root) / (2 * (t + q))), 6) as ci_high from r""")
def multinomial_intervals(spark, d):
    return rounded(battery.multinomial_intervals(frames(spark, d), "label", ("grp",)))
