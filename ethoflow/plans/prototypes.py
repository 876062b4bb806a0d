"""Queries of prototypes, wells and small tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ethoflow.catalog import query
from ethoflow.functions import numeric, text
from ethoflow.operators import cluster, metadata, proportions, prototypes
from ethoflow.plans.roles import FRAMES, K, frames, load, rounded

ORDERED = "(partition by trial_id order by frame_number)"


@query(f"""with {FRAMES}, n as (select label, x, y, lead(x) over {ORDERED} as x2, lead(y) over {ORDERED} as y2 from frames)
select label::int as label, round(avg(x), 6) as x_before, round(avg(x2), 6) as x_after, round(avg(y), 6) as y_before, round(avg(y2), 6) as y_after from n group by 1""")
def posture_before_after(spark, d):
    return rounded(prototypes.posture_around(frames(spark, d), ("x", "y")))


@query(f"""with {FRAMES}, n as (
  select label, trial_id, frame_number, x, lead(x) over {ORDERED} as x2, row_number() over (partition by label order by trial_id, frame_number) as r
  from (select *, lead(x) over {ORDERED} as unused from frames)
)
select label::int as label, trial_id, frame_number::int as frame_number, round(x, 6) as x, round(x2, 6) as x_after
from (select label, trial_id, frame_number, x, lead(x) over {ORDERED} as x2 from frames) f
where (label, trial_id, frame_number) in (select (label, trial_id, frame_number) from n where r = 1)""")
def first_example_rows(spark, d):
    return rounded(prototypes.first_examples(frames(spark, d), ("x",)))


VELOCITY = ("thrust_mm_s", "slip_mm_s", "yaw_rad_s")


@query(f"with {FRAMES} select {', '.join(f'round(quantile_cont({c}, 0.95), 6) as {c}' for c in VELOCITY)} from frames")
def velocity_p95(spark, d):
    return rounded(prototypes.upper_percentiles(frames(spark, d), VELOCITY))


CENTRES = f"centres as (select label, {', '.join(f'avg({c}) as {c}' for c in VELOCITY)} from frames group by 1)"


def _centres(spark, d):
    return frames(spark, d).groupBy("label").agg(*(F.avg(c).alias(c) for c in VELOCITY))


@query(f"with {FRAMES}, {CENTRES} select label::int as label, {', '.join(f'round({c} / max(abs({c})) over (), 6) as {c}' for c in VELOCITY)} from centres")
def max_abs_normalise(spark, d):
    return rounded(prototypes.max_abs_scaled(_centres(spark, d), VELOCITY))


@query(f"""with {FRAMES}, {CENTRES}, p as (select {', '.join(f'quantile_cont({c}, 0.95) as p_{c}' for c in VELOCITY)} from frames)
select label::int as label, {', '.join(f'round({c} / p_{c} / 4, 6) as {c}' for c in VELOCITY)} from centres, p""")
def percentile_normalise(spark, d):
    scales = prototypes.upper_percentiles(frames(spark, d), VELOCITY)
    return rounded(prototypes.divided(prototypes.scaled_to(_centres(spark, d), scales, VELOCITY), VELOCITY, 4))


@query(f"with {FRAMES}, {CENTRES} select label::int as label, {', '.join(f'round({c} * {i + 2} + {i - 1}, 6) as {c}' for i, c in enumerate(VELOCITY))} from centres")
def de_zscore_centroids(spark, d):
    new = {c: numeric.un_zscore(F.col(c), i - 1.0, i + 2.0) for i, c in enumerate(VELOCITY)}
    return rounded(_centres(spark, d).withColumns(new))


@query(f"""with {FRAMES}, t as (select case when label = 2 then 'with' else 'without' end as side, x from frames),
e as (select side, min(x) as lo, (max(x) - min(x)) / 30 as w, count(*) as m from t group by 1)
select side, least(floor((x - lo) / w), 29)::int as bin, count(*) as n, round(count(*) / (m * w), 6) as density from t join e using (side) group by side, bin, m, w""")
def histogram_with_without(spark, d):
    own, other = prototypes.with_and_without(frames(spark, d), 2)
    both = own.withColumn("side", F.lit("with")).unionByName(other.withColumn("side", F.lit("without")))
    return rounded(prototypes.spread_histogram(both, "x", 30, ("side",)).drop("low"))


@query(f"with {FRAMES} select count(*) filter (label = 2) as n_with, count(*) filter (label <> 2) as n_without from frames")
def with_without_cluster(spark, d):
    own, other = prototypes.with_and_without(frames(spark, d), 2)
    return own.agg(F.count(F.lit(1)).alias("n_with")).crossJoin(other.agg(F.count(F.lit(1)).alias("n_without")))


@query(f"""with {FRAMES}, t as (select nullif(slip_mm_s, 0) as x from frames), e as (select min(x) as lo, (max(x) - min(x)) / 50 as w from t)
select least(floor((x - lo) / w), 49)::int as bin, count(*) as n, round(log10(count(*)), 6) as log_n from t, e where x is not null group by 1""")
def diagnostic_histogram(spark, d):
    h = prototypes.spread_histogram(frames(spark, d), "slip_mm_s", 50, zeros=False)
    return rounded(h.select("bin", "n", F.log10("n").alias("log_n")))


SHARES = f"""shares as (
  select trial_id, trial_id % 4 as grp, {', '.join(f'count(*) filter (label = {k}) / count(*) as cluster_{k}' for k in range(K))} from frames group by 1
)"""
CLUSTERS = [f"cluster_{k}" for k in range(K)]


def _shares(spark, d):
    return proportions.wide(frames(spark, d), range(K)).withColumn("grp", (F.col("trial_id") % 4).cast("string"))


@query(f"""with {FRAMES}, {SHARES}, m as (select grp, {', '.join(f'avg({c}) as {c}' for c in CLUSTERS)} from shares group by 1), u as (unpivot m on {', '.join(CLUSTERS)} into name "column" value v)
select u.grp::varchar as grp, u."column", round(log2((u.v + 1e-4) / (c.v + 1e-4)), 6) as change from u join u c on c.grp = 0 and c."column" = u."column" where u.grp <> 0""")
def heatmap_fold_change(spark, d):
    return rounded(prototypes.mean_change(_shares(spark, d), CLUSTERS, "grp", "0"))


@query(f"with {FRAMES} select trial_id, case when trial_id % 7 = 0 then 'a' when trial_id % 7 = 1 then 'b' when trial_id % 7 = 2 then 'c' else '' end as letter, case when trial_id % 7 = 0 then '★★★' when trial_id % 7 = 1 then '★★' when trial_id % 7 = 2 then '★' else 'n.s.' end as symbol from (select distinct trial_id from frames)")
def significance_letters(spark, d):
    p = F.get(F.array(F.lit(0.0005), F.lit(0.005), F.lit(0.03)), (F.col("trial_id") % 7).cast("int"))
    p = F.coalesce(p, F.lit(0.2))
    return frames(spark, d).select("trial_id").distinct().select("trial_id", numeric.sig_letters(p).alias("letter"), numeric.star_symbols(p).alias("symbol"))


@query(f"with {FRAMES} select grp, well_number, trial_id, row_number() over (partition by grp, well_number order by trial_id) as internal_id from (select distinct grp, well_number, trial_id from frames)")
def rank_within_group(spark, d):
    return prototypes.rank_within(frames(spark, d).select("grp", "well_number", "trial_id").distinct(), ("grp", "well_number"), ("trial_id",)).withColumn("internal_id", F.col("internal_id").cast("long"))


@query("with n as (select count(*) as n from events) select event_id, (event_id - n.n * 30 // 100 + n.n) % n.n as place from events, n")
def circular_shift(spark, d):
    e = load(spark, d, "events")
    return e.select("event_id", prototypes.shifted_index(F.col("event_id"), e.count(), 30).alias("place"))


CENTRES_OF_WELLS = """wells as (
  select l_orderkey as video_id, frame_number, well, well * 10 + (l_orderkey * 7 + well * 3 + frame_number * 5) % 11 as x, well * 5 + (l_orderkey + well + frame_number * frame_number) % 7 as y
  from (select distinct l_orderkey from lineitem where l_linenumber = 1) cross join range(30) f(frame_number) cross join range(4) w(well)
)"""


def _wells(spark, d):
    o = load(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("video_id")).distinct()
    grid = o.withColumn("frame_number", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("well", F.explode(F.sequence(F.lit(0), F.lit(3))))
    v, w, f = F.col("video_id"), F.col("well"), F.col("frame_number")
    return grid.withColumns({"x": (w * 10 + (v * 7 + w * 3 + f * 5) % 11).cast("double"), "y": (w * 5 + (v + w + f * f) % 7).cast("double")})


@query(f"""with {CENTRES_OF_WELLS}, a as (select video_id, well, median(x) as ax, median(y) as ay from wells where frame_number < 20 group by all),
s as (select video_id, frame_number, coalesce(avg(dx), 0) as dx, coalesce(avg(dy), 0) as dy from (
  select *, x - lag(x) over w as dx, y - lag(y) over w as dy from wells window w as (partition by video_id, well order by frame_number)) group by all),
p as (select video_id, frame_number, sum(dx) over w as x, sum(dy) over w as y from s window w as (partition by video_id order by frame_number))
select video_id, well::int as well, round(sum(ax + p.x), 4) as x, round(max(ay + p.y), 4) as y from p join a using (video_id) group by all""")
def drift_correction(spark, d):
    rows = prototypes.drift_corrected(_wells(spark, d))
    return rounded(rows.groupBy("video_id", "well").agg(F.sum("x").alias("x"), F.max("y").alias("y")), 4)


@query(f"""with {FRAMES}, f as (select trial_id, frame_number, x, row_number() over {ORDERED} as i, count(*) over (partition by trial_id) as n from frames),
k as (select o, exp(-0.5 * pow(o / 1.5, 2)) as w from range(-6, 7) r(o))
select a.trial_id, a.frame_number::int as frame_number, round(sum(b.x * k.w) / sum(k.w), 5) as smooth
from f a cross join k join f b on a.trial_id = b.trial_id and b.i = greatest(1, least(a.n, a.i + k.o)) group by all""")
def gaussian_smoothing(spark, d):
    rows = frames(spark, d).withColumn("smooth", F.col("x"))
    return rounded(prototypes.gaussian_smoothed(rows, ("smooth",), 1.5, ("trial_id",)).select("trial_id", "frame_number", "smooth"), 5)


CIRCLES = """circles as (
  select p_brand as plate, p_partkey, (p_partkey * 37 % 101)::double as cx, (p_partkey * 53 % 97)::double as cy, 10 + (p_partkey * 7 % 29) / 4.0 as radius from part
), kept as (
  select * from (select *, row_number() over (partition by plate order by abs(radius - m), cx, cy) as r from (select *, median(radius) over (partition by plate) as m from circles)) where r <= 24
)"""


def _circles(spark, d):
    p, i = load(spark, d, "part"), F.col("p_partkey")
    return p.select(F.col("p_brand").alias("plate"), "p_partkey", (i * 37 % 101).cast("double").alias("cx"), (i * 53 % 97).cast("double").alias("cy"), (10 + (i * 7 % 29) / 4.0).alias("radius"))


@query(f"with {CIRCLES} select plate, p_partkey from kept")
def closest_radii(spark, d):
    return prototypes.closest_radii(_circles(spark, d), ("plate",), ties=("p_partkey",)).select("plate", "p_partkey")


@query(f"""with {CIRCLES}, r as (select *, (row_number() over (partition by plate order by cy, cx) - 1) // 6 as line from kept)
select plate, p_partkey, row_number() over (partition by plate order by line, cx, cy) as well_number from r""")
def grid_order(spark, d):
    kept = prototypes.closest_radii(_circles(spark, d), ("plate",), ties=("p_partkey",))
    return prototypes.grid_order(kept, ("plate",), ties=("p_partkey",)).select("plate", "p_partkey", F.col("well_number").cast("long").alias("well_number"))


@query(f"with {FRAMES}, {SHARES}, u as (unpivot shares on {', '.join(CLUSTERS)} into name cluster value v) select floor(log10(v + 1e-10))::int as decade, count(*) as n from u group by 1")
def decade_groups(spark, d):
    rows = proportions.long(_shares(spark, d).drop("grp"))
    return prototypes.decades(rows, "proportion").groupBy("decade").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {FRAMES} select label::int as label, grp, count(distinct trial_id) as n_trials from frames group by all")
def trials_per_cluster(spark, d):
    return proportions.trials_per_label(frames(spark, d))


@query(f"with {FRAMES} select distinct label::int as label from frames where grp = 0 union select distinct label::int from frames where grp = 1")
def label_union(spark, d):
    return proportions.labels_in(frames(spark, d), F.col("grp").isin(0, 1))


@query("select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O'")
def paired_animals(spark, d):
    status = F.col("o_orderstatus")
    return proportions.in_all(load(spark, d, "orders"), "o_custkey", [status == "F", status == "O"])


PAIRS = """pairs as (
  select l_linenumber as label, l_returnflag as group_a, l_linestatus as group_b, round(avg(l_discount) - avg(l_tax), 6) as difference,
    (sum(l_partkey) % 1000)::double / 4000 as p from lineitem group by all
)"""


def _pairs(spark, d):
    rows = load(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("label"), F.col("l_returnflag").alias("group_a"), F.col("l_linestatus").alias("group_b"))
    return rows.agg(F.round(F.avg("l_discount") - F.avg("l_tax"), 6).alias("difference"), ((F.sum("l_partkey") % 1000).cast("double") / 4000).alias("p"))


@query(f"with {PAIRS} select label, group_a, group_b, difference, p from pairs where p < 0.05")
def significant_pairs(spark, d):
    return prototypes.significant(_pairs(spark, d), ("label", "group_a", "group_b", "difference"))


@query(f"with {PAIRS} select label, case when group_a = 'O' then group_b else group_a end as \"group\", p from pairs where group_a = 'O' or group_b = 'O'")
def control_against_gene(spark, d):
    return prototypes.control_pairs(_pairs(spark, d), "O").select("label", "group", "p")


@query(f"""with {PAIRS}, s as (select label, group_a || group_b as c, case when p < 0.05 then sign(difference)::int else 0 end as s from pairs)
select label, {', '.join(f"max(s) filter (c = '{c}')::int as {c}" for c in ('AF', 'NF', 'NO', 'RF'))} from s group by 1""")
def directional_summary(spark, d):
    pairs = _pairs(spark, d).withColumn("comparison", F.concat("group_a", "group_b")).where("comparison in ('AF', 'NF', 'NO', 'RF')")
    every = spark.createDataFrame([(None, c, 0.0, 1.0) for c in ("AF", "NF", "NO", "RF")], "label int, comparison string, difference double, p double")
    return prototypes.directions(pairs.select("label", "comparison", "difference", "p").unionByName(every)).where("label is not null")


@query("select n_nationkey, n_name from nation where contains(n_name, '_1') or contains(n_name, '4')")
def run_name_filter(spark, d):
    return prototypes.matching_names(load(spark, d, "nation").select("n_nationkey", "n_name"), "_1, 4", "n_name")


@query("""with v as (select vec_id, label, embedding[1:13]::double[] as p from embeddings), part(name, i, j) as (
  values ('frons', 0, 0), ('left_eye', 1, 2), ('right_eye', 3, 4), ('tail_base', 5, 0), ('tail_1', 6, 7), ('tail_2', 8, 9), ('tail_3', 10, 11), ('tail_end', 12, 13))
select vec_id, name as part, round(case when i = 0 then 0 else p[i] end, 6) as x, round(case when j = 0 then 0 else p[j] end, 6) as y from v, part""")
def landmark_points(spark, d):
    v = load(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 13).cast("array<double>").alias("positions"))
    return rounded(prototypes.landmark_points(v, "vec_id"))


@query("""select p_partkey, case when p_partkey % 4 = 0 then 'NeuroD2 g20' when p_partkey % 4 = 1 then 'g15_5MM' when p_partkey % 4 = 2 then 'Ap2b3' else 'WT' end as transgene from part""")
def transgene_label(spark, d):
    i = F.col("p_partkey") % 4
    gene = F.when(i == 0, "NeuroD2 ").when(i == 1, "N/A").when(i == 2, "Ap2b3").otherwise("null")
    guide = F.when(i == 0, "g20").when(i == 1, "g15_5MM").when(i == 2, "None").otherwise(F.lit(None).cast("string"))
    labels = load(spark, d, "part").withColumns({"gene": gene, "guide": guide})
    return labels.select("p_partkey", text.joined_label(("gene", "guide")).alias("transgene"))


MAP = "m as (select p_size as raw_id, min(p_type) as category from part group by 1), d as (select *, row_number() over (order by category, raw_id) - 1 as display_id from m)"


def _map(spark, d):
    return load(spark, d, "part").groupBy(F.col("p_size").alias("raw_id")).agg(F.min("p_type").alias("category"))


@query(f"with {FRAMES}, {MAP} select trial_id, frame_number::int as frame_number, label::int as label, display_id::int as display_id, coalesce(category, 'unclassified') as category from frames left join d on label = raw_id")
def label_lookup(spark, d):
    m = metadata.ordered_map(_map(spark, d)).withColumn("short_label", F.lit(None).cast("string"))
    rows = metadata.mapped_labels(frames(spark, d), m)
    return rows.select("trial_id", "frame_number", "label", F.col("display_id").cast("int").alias("display_id"), "category")


@query(f"with {FRAMES} select label::int as display_id, 'unclassified' as category, count(*) as n from frames group by 1")
def identity_map(spark, d):
    """Frames by display id under the map that leaves ids as they are."""
    m = metadata.identity_map(spark, 36).withColumn("short_label", F.lit(None).cast("string"))
    return metadata.mapped_labels(frames(spark, d), m).groupBy("display_id", "category").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {MAP} select raw_id, display_id::int as display_id, category, left(category, 2) || '.' || row_number() over (partition by category order by raw_id) as short_label from d")
def labelled_map(spark, d):
    m = metadata.ordered_map(_map(spark, d))
    return metadata.short_labels(m, F.substring("category", 1, 2)).select("raw_id", F.col("display_id").cast("int").alias("display_id"), "category", "short_label")


@query(f"with {MAP} select category, round(sum(r.v), 6) as total from d join (select p_size as raw_id, avg(p_retailprice) as v from part group by 1) r using (raw_id) where category like 'PROMO%' or category like 'ECONOMY%' group by 1")
def chosen_prototypes(spark, d):
    m = metadata.ordered_map(_map(spark, d))
    values = load(spark, d, "part").groupBy(F.col("p_size").alias("raw_id")).agg(F.avg("p_retailprice").alias("v"))
    rows = prototypes.in_display_order(values.withColumnRenamed("raw_id", "label"), m).join(m.select(F.col("raw_id").alias("label"), "category"), "label")
    rows = rows.where(F.col("category").startswith("PROMO") | F.col("category").startswith("ECONOMY"))
    return rounded(rows.groupBy("category").agg(F.sum("v").alias("total")))


@query("""with g as (select d::int as del_size, p::int as position, k::int as k from (values (0), (50), (25), (10)) a(d), range(2, 101, 2) b(p), range(2, 52, 2) c(k)),
f as (select [0, 50, 25, 10][p_partkey % 4 + 1] as del_size, p_size * 2 as position, p_partkey % 25 * 2 + 2 as k from part)
select * from g where not exists (select 1 from f where f.del_size = g.del_size and f.position = g.position and f.k = g.k)""")
def unfinished_fits(spark, d):
    """The grid without the fits that are there already."""
    n, size = F.col("p_partkey"), F.array(*map(F.lit, (0, 50, 25, 10)))
    done = load(spark, d, "part").select(F.get(size, (n % 4).cast("int")).alias("del_size"), (F.col("p_size") * 2).alias("position"), (n % 25 * 2 + 2).cast("int").alias("k"))
    return cluster.unfinished(cluster.sweep_grid(spark), done)
