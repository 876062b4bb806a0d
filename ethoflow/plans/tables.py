"""Queries of joins, look-ups, names, repairs and writers over small and long tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ethoflow import schemas
from ethoflow.catalog import query
from ethoflow.functions import numeric, text
from ethoflow.operators import bouts, build, cluster, features, ingest, metadata, proportions, report, sequence, stats
from ethoflow.plans.frames import ANIMALS, CENTROIDS, FEATURES, FPS
from ethoflow.plans.roles import FRAMES, LANDMARKS, frames, landmarks, load, rounded
from ethoflow.session import scratch_path
from ethoflow.sources import files

# Sources and sinks


@query(f"with {FRAMES} select trial_id, frame_number::int as frame_number, trial_id * 4294967296 + frame_number as time_series_id, round(thrust_mm_s, 6) as thrust_mm_s from frames")
def bulk_insert_velocity(spark, d):
    """Frames get their keys, both tables are written, and velocities are read back by them."""
    at, rows = scratch_path(spark, "insert"), metadata.frame_ids(frames(spark, d).drop("time_series_id"))
    rows.select("time_series_id", "trial_id", "frame_number").write.parquet(f"{at}/time_series")
    rows.select("time_series_id", "thrust_mm_s", "slip_mm_s", "yaw_rad_s").write.parquet(f"{at}/velocity")
    back = spark.read.parquet(f"{at}/time_series").join(spark.read.parquet(f"{at}/velocity"), "time_series_id")
    return rounded(back.select("trial_id", "frame_number", "time_series_id", "thrust_mm_s"))


@query(f"""with {FRAMES} select trial_id, frame_number::int as frame_number, label::int as label, 1 as batch from frames where grp < 2
union all select trial_id, frame_number::int, label::int, 2 from frames where grp >= 2""")
def append_labels(spark, d):
    at, rows = scratch_path(spark, "labels"), frames(spark, d).select("trial_id", "frame_number", "label", "grp")
    for batch, part in enumerate((rows.where("grp < 2"), rows.where("grp >= 2")), 1):
        files.append_labels(part.drop("grp"), at, batch)
    return spark.read.parquet(at).select("trial_id", "frame_number", "label", "batch")


@query("""with s as (select s_suppkey, (s_nationkey % 5)::int as part from supplier), n as (select * from s where part = 2 and s_suppkey % 2 = 0)
select s_suppkey, part, 'old' as version from s where part not in (select part from n) union all select s_suppkey, part, 'new' from n""")
def replace_partitions(spark, d):
    at, s = scratch_path(spark, "replace"), load(spark, d, "supplier").withColumn("part", (F.col("s_nationkey") % 5).cast("int"))
    files.replace(s.select("s_suppkey", F.lit("old").alias("version"), "part"), at, ("part",))
    files.replace(s.where("part = 2 and s_suppkey % 2 = 0").select("s_suppkey", F.lit("new").alias("version"), "part"), at, ("part",))
    return spark.read.parquet(at).select("s_suppkey", "part", "version")


@query("select c_custkey as k, case when c_custkey % 3 = 0 then 'new' else 'old' end as v from customer where c_custkey % 3 = 0 or c_custkey % 2 = 0")
def merged_maps(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    old, new = c.where("k % 2 = 0").withColumn("v", F.lit("old")), c.where("k % 3 = 0").withColumn("v", F.lit("new"))
    return files.merged_maps(old, new, "k", "v")


@query("select n_regionkey::int as region, count(*) as n_files from nation where n_nationkey % 7 <> 0 group by 1")
def file_listing(spark, d):
    at, n = scratch_path(spark, "tree"), load(spark, d, "nation").where("n_nationkey % 7 <> 0")
    n.select("n_name", F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("video")).repartition(1).write.partitionBy("region", "video").text(at)
    found = files.listing(spark, at, "part-*.txt").select(F.regexp_extract("path", r"region=(\d+)/", 1).cast("int").alias("region"))
    return found.groupBy("region").agg(F.count(F.lit(1)).alias("n_files"))


@query("""select n_name as stem, (n_nationkey * 10 + 20)::double as cx, (n_nationkey + 10)::double as cy, 15.0::double as radius from nation where n_nationkey % 3 <> 0""")
def annotation_scan(spark, d):
    at, n = scratch_path(spark, "coco"), load(spark, d, "nation")
    image = F.struct(F.col("n_nationkey").cast("long").alias("id"), F.concat("n_name", F.lit(".png")).alias("file_name"))
    box = F.array(F.col("n_nationkey") * 10.0, F.col("n_nationkey") * 1.0, F.lit(40.0), F.lit(20.0))
    shape = F.when(F.col("n_nationkey") % 3 == 0, "box").otherwise("circle")
    mark = F.struct(F.col("n_nationkey").cast("long").alias("image_id"), box.alias("bbox"), F.struct(shape.alias("shape")).alias("attributes"))
    doc = n.agg(F.collect_list(image).alias("images"), F.collect_list(mark).alias("annotations"))
    doc.select(F.to_json(F.struct("images", "annotations")).alias("value")).coalesce(1).write.text(at)
    return files.geometry(spark, at)


@query(f"""with {LANDMARKS}, part as (select i::int as body_part_id, {list(schemas.BODY_MARKERS)}[i] as body_marker from range(1, 9) r(i)),
long as (select 'left_eye' as body_marker, left_eye_x as x from landmarks union all select 'right_eye', right_eye_x from landmarks union all select 'tail_base', tail_base_x from landmarks)
select body_part_id, body_marker, count(*) as n, round(sum(x), 3) as x from long join part using (body_marker) group by all""")
def database_seed(spark, d):
    """Landmarks under the ids of the seeded body parts."""
    at = scratch_path(spark, "db")
    schemas.create(spark, at, ("body_part", "trial"))
    schemas.create(spark, at, ("body_part",))  # what is there stays
    long = features.unpivoted_parts(landmarks(spark, d), ["trial_id"], ("left_eye", "right_eye", "tail_base"))
    rows = long.withColumnRenamed("body_part", "body_marker").join(schemas.read(spark, at, "body_part"), "body_marker")
    return rounded(rows.groupBy("body_part_id", "body_marker").agg(F.count(F.lit(1)).alias("n"), F.sum("x_pos_mm").alias("x")), 3)


# Selectors, names and scalars


@query("select vec_id, round(embedding[1]::double + embedding[2]::double + embedding[3]::double + list_sum(embedding[17:29]::double[]), 5) as total from embeddings")
def column_ranges(spark, d):
    picked = numeric.column_spec("0,1,2,16-28")
    total = sum((F.col("embedding")[i].cast("double") for i in picked), F.lit(0.0))
    return rounded(load(spark, d, "embeddings").select("vec_id", total.alias("total")), 5)


_SELECTED = build.selected((0, 1, 2, 3))  # thrust, slip, yaw and the first position


@query(f"with {FRAMES} select trial_id, round(sum(thrust_mm_s), 4) as {_SELECTED[0]}, round(sum(slip_mm_s), 4) as {_SELECTED[1]}, round(sum(yaw_rad_s), 4) as {_SELECTED[2]}, round(sum(x), 4) as {_SELECTED[3]} from frames group by 1")
def feature_names(spark, d):
    """Features chosen by their numbers in the clustering's matrix."""
    rows = frames(spark, d).withColumnRenamed("x", "left_eye_x")
    return rounded(rows.groupBy("trial_id").agg(*(F.sum(c).alias(c) for c in _SELECTED)), 4)


@query("""select o_orderkey, 'cam' || o_custkey || '_well_' || printf('%02d', o_orderkey % 24) || '.mp4' as clip, 'cam' || o_custkey as stem, (o_orderkey % 24)::int as well,
  regexp_replace(o_orderpriority, '[^A-Za-z0-9._-]+', '_', 'g') as safe from orders""")
def clip_names(spark, d):
    o = load(spark, d, "orders")
    clip = text.clip_name(F.concat(F.lit("cam"), F.col("o_custkey").cast("string")), F.col("o_orderkey") % 24)
    rows = o.withColumn("clip", clip).withColumn("p", text.clip_parts(F.col("clip")))
    return rows.select("o_orderkey", "clip", "p.stem", "p.well", text.safe_name(F.col("o_orderpriority")).alias("safe"))


@query("""with p as (select s_suppkey, ['Christine', 'Xi', 'cb', 'Bob'][s_suppkey % 4 + 1] as first, ['Bar', 'Young', 'Z', ''][s_suppkey % 4 + 1] as last, ['CB', 'XY', 'bob'][s_suppkey % 3 + 1] as i from supplier)
select s_suppkey, lower(first) = lower(i) or lower(left(first, 1) || left(last, 1)) = lower(left(i, 2)) as fits from p""")
def initials_match(spark, d):
    k = F.col("s_suppkey")
    pick = lambda *xs: F.get(F.array(*map(F.lit, xs)), (k % len(xs)).cast("int"))
    rows = load(spark, d, "supplier").select("s_suppkey", pick("Christine", "Xi", "cb", "Bob").alias("first"), pick("Bar", "Young", "Z", "").alias("last"), pick("CB", "XY", "bob").alias("i"))
    return rows.select("s_suppkey", text.initials_fit(F.col("i"), F.col("first"), F.col("last")).alias("fits"))


@query("""select p_partkey, case when p_partkey % 4 = 0 then true when p_partkey % 4 = 1 then true else false end as gradient,
  case when p_partkey % 4 = 0 then 4 when p_partkey % 4 = 3 then 24 else 0 end as n_wells, case when p_partkey % 8 = 3 then 'control' else 'test' end as arena_role from part""")
def plate_flags(spark, d):
    k = F.col("p_partkey")
    test = F.when(k % 4 == 0, "5 mM, 1 to 3").when(k % 4 == 1, "4AP all").when(k % 8 == 7, "1-24").otherwise("")
    plates = load(spark, d, "part").select("p_partkey", F.when(k % 8 == 3, "1 to 24").otherwise("").alias("control_arenas"), test.alias("test_arenas"), F.lit("water").alias("drug_dose"), F.lit("g").alias("target_gene"), F.lit("s").alias("sgrna"))
    rows = ingest.with_derived(plates)
    return rows.select("p_partkey", F.col("is_gradient").alias("gradient"), F.size("occupied").alias("n_wells"), "arena_role")


@query("select c_custkey, case when c_custkey % 3 = 0 then null else c_custkey end::bigint as id, case when c_custkey % 3 = 0 then null else round(c_acctbal, 6) end as v from customer")
def nan_to_null(spark, d):
    nan = F.lit(float("nan"))
    c = load(spark, d, "customer").withColumns({"i": F.when(F.col("c_custkey") % 3 == 0, nan).otherwise(F.col("c_custkey").cast("double")), "x": F.when(F.col("c_custkey") % 3 == 0, nan).otherwise(F.col("c_acctbal"))})
    return rounded(c.select("c_custkey", numeric.real(F.col("i")).cast("long").alias("id"), numeric.real(F.col("x")).alias("v")))


@query("select s_suppkey, greatest(1, round_even(s_suppkey * 5 * 1e-3::double * 100.0::double, 0))::int as frames from supplier")
def frame_thresholds(spark, d):
    """Milliseconds at 100 frames a second; halves go to even."""
    return load(spark, d, "supplier").select("s_suppkey", numeric.frames_of_ms(F.col("s_suppkey") * 5, F.lit(100.0)).alias("frames"))


# Repairs


EYES = f"""eyes as (
  select trial_id, frame_number, x as lx, y as rx, likelihood as ll, (time_series_id * 7 % 10) / 10.0 as rl from frames
), held as (
  select *, last_value(case when not (ll < 0.5 and rl < 0.5) then lx end ignore nulls) over w as l, last_value(case when not (ll < 0.5 and rl < 0.5) then rx end ignore nulls) over w as r
  from eyes window w as (partition by trial_id order by frame_number rows between unbounded preceding and current row)
)"""


@query(f"""with {FRAMES}, {EYES} select trial_id, frame_number::int as frame_number, round(case when ll < 0.5 and rl >= 0.5 then r else l end, 6) as left_eye_x,
  round(case when rl < 0.5 and ll >= 0.5 then l else r end, 6) as right_eye_x from held""")
def eye_repair(spark, d):
    f = frames(spark, d).select(
        "trial_id", "frame_number", F.col("x").alias("left_eye_x"), F.col("x").alias("left_eye_y"), F.col("likelihood").alias("left_eye_likelihood"),
        F.col("y").alias("right_eye_x"), F.col("y").alias("right_eye_y"), (F.col("time_series_id") * 7 % 10 / 10).alias("right_eye_likelihood"),
    )
    return rounded(sequence.repaired_eyes(f, ("trial_id",)).select("trial_id", "frame_number", "left_eye_x", "right_eye_x"))


@query(f"""with {FRAMES}, t as (select trial_id, frame_number, yaw_rad_s / 2 as a from frames), s as (select *, a - lag(a) over (partition by trial_id order by frame_number) as d from t)
select trial_id, frame_number::int as frame_number, round(first_value(a) over w + coalesce(sum(case when d > pi() then d - 2 * pi() when d < -pi() then d + 2 * pi() else d end) over w, 0), 5) as unwrapped
from s window w as (partition by trial_id order by frame_number rows between unbounded preceding and current row)""")
def phase_unwrap(spark, d):
    f = frames(spark, d).withColumn("a", F.col("yaw_rad_s") / 2)
    return rounded(sequence.unwrap(f, "a", ("trial_id",)).select("trial_id", "frame_number", "unwrapped"), 5)


# Joins


@query("""with m as (select o_custkey as trial_id, arg_max(o_orderstatus, o_orderkey) as grp from orders group by 1)
select c_custkey, grp from customer join m on c_custkey = trial_id""")
def dimension_map(spark, d):
    """Of several groups listed for a trial the last one counts; trials without a group go."""
    pairs = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("grp"), F.col("o_orderkey").alias("position"))
    return load(spark, d, "customer").select("c_custkey").join(proportions.trial_groups(pairs, "c_custkey"), "c_custkey")


@query(f"with {FRAMES} select trial_id, label::int as label, n, case grp when 0 then 'control' when 1 then 'dose' end as group_name from (select trial_id, grp, label, count(*) as n from frames group by all)")
def group_label_map(spark, d):
    names = spark.createDataFrame([(0, "control"), (1, "dose")], "grp long, group_name string")
    n = frames(spark, d).groupBy("trial_id", "grp", "label").agg(F.count(F.lit(1)).alias("n"))
    return proportions.with_names(n, names, "grp").select("trial_id", "label", "n", "group_name")


@query(f"""with {FRAMES}, a as (select event_id, row_number() over (order by event_id) as i from events), b as (select label, row_number() over (order by trial_id, frame_number) as i from frames)
select event_id, label::int as label from a join b using (i)""")
def positional_append(spark, d):
    a = sequence.row_index(load(spark, d, "events").select("event_id"), ("event_id",))
    b = sequence.row_index(frames(spark, d).select("trial_id", "frame_number", "label"), ("trial_id", "frame_number"))
    return a.join(b, "row_index").select("event_id", "label")


@query("""select coalesce(o_custkey, c_custkey) as stem, case when o_custkey is null then 'no layout' when c_custkey is null then 'no video' else 'paired' end as status
from (select distinct o_custkey from orders where o_custkey % 4 <> 0) full join (select c_custkey from customer where c_custkey % 5 <> 0) on o_custkey = c_custkey""")
def file_pairing(spark, d):
    layouts = load(spark, d, "orders").where("o_custkey % 4 <> 0").select(F.col("o_custkey").alias("stem")).distinct()
    return metadata.paired(layouts, load(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("stem")), "stem")


@query("select c_custkey, case when c_custkey % 6 = 0 then 'moved' else c_mktsegment end as c_mktsegment from customer where c_custkey % 4 <> 1")
def bulk_update_and_delete(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    changed = metadata.updated(c, F.col("c_custkey") % 6 == 0, {"c_mktsegment": "moved"})
    return metadata.without(changed, F.col("c_custkey") % 4 == 1)


@query("select l.l_orderkey, l.l_suppkey from lineitem l where l_suppkey % 3 = 0 and not exists (select 1 from supplier where s_suppkey = l_suppkey and s_nationkey % 2 = 0)")
def orphan_rows(spark, d):
    child = load(spark, d, "lineitem").where("l_suppkey % 3 = 0").select("l_orderkey", "l_suppkey")
    parent = load(spark, d, "supplier").where("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return metadata.orphans(child, parent, "l_suppkey").select("l_orderkey", "l_suppkey")


# Aggregates


@query(f"""with {FRAMES}, k as (select max(label) as k from frames), c as (select trial_id, l as cluster, count(*) filter (label = l) as n, count(*) as all_n from frames, (select unnest(range(0, k + 1)) as l from k) group by all)
select trial_id, cluster::int as cluster, round(n / all_n, 6) as proportion from c""")
def proportions_by_data(spark, d):
    """Shares of as many labels as occur."""
    return rounded(proportions.long(proportions.wide_by_data(frames(spark, d))))


@query(f"with {LANDMARKS} select 0 as feature_idx, 'left_eye_x' as feature, round(avg(left_eye_x), 6) as mu, round(stddev_pop(left_eye_x), 6) as sigma from landmarks union all select 1, 'left_eye_y', round(avg(left_eye_y), 6), round(stddev_pop(left_eye_y), 6) from landmarks")
def mu_sigma_without_ids(spark, d):
    rows = landmarks(spark, d).select("trial_id", "frame_number", "left_eye_x", "left_eye_y")
    return rounded(cluster.mu_sigma(rows, [c for c in rows.columns if c not in ("trial_id", "frame_number")]))


@query(f"with {FRAMES} select grp, well_number, round(avg((label = 2)::int), 6) as share, count(*) as n from frames group by all")
def baseline_proportions(spark, d):
    return rounded(proportions.share_of_label(frames(spark, d), ("grp", "well_number"), 2))


@query(f"with {FRAMES} select well_number, label::int as label, n, round(n / sum(n) over (partition by well_number), 6) as proportion from (select well_number, label, count(*) as n from frames group by all)")
def proportions_by_well(spark, d):
    return rounded(proportions.pooled(frames(spark, d), ("well_number",)))


@query(f"""{ANIMALS}, l as (select label, count(*) as n_animals, list(round(mean_ms::double, 6) order by mean_ms, trial_id) as means, list(n_bouts order by mean_ms, trial_id) as bouts from animals group by 1)
select k::int as label, coalesce(n_animals, 0) as n_animals, array_to_string(coalesce(bouts, []), ',') as bouts, round(coalesce(list_sum(means), 0), 3) as total from range(7) r(k) left join l on k = label""")
def duration_lists(spark, d):
    """Per prototype, those without a bout too, the animals' own numbers in order."""
    animals = bouts.per_animal(bouts.segments(frames(spark, d), FPS))
    lists = bouts.animal_lists(animals, spark.range(7).select(F.col("id").cast("int").alias("label")))
    total = F.aggregate("means", F.lit(0.0), lambda s, x: s + x)
    return rounded(lists.select("label", "n_animals", F.array_join(F.transform("bouts", lambda x: x.cast("string")), ",").alias("bouts"), total.alias("total")), 3)


@query("select (s_suppkey % 4 + 2)::int as k, (s_suppkey % 3 * 10)::int as reduction, round(median(s_acctbal), 6) as median, count(*) as n_fits from supplier group by all")
def sweep_curve(spark, d):
    s = load(spark, d, "supplier").select((F.col("s_suppkey") % 4 + 2).cast("int").alias("k"), (F.col("s_suppkey") % 3 * 10).cast("int").alias("reduction"), "s_acctbal")
    return rounded(s.groupBy("k", "reduction").agg(F.median("s_acctbal").alias("median"), F.count(F.lit(1)).alias("n_fits")))


_NEAR = "list_min([" + ", ".join("(" + " + ".join(f"pow({x} - ({v * (1 + 0.0)} + fit), 2)" for x, v in zip(FEATURES, c)) + ")" for c in CENTROIDS) + "])"


@query(f"""with {LANDMARKS}, rows as (select *, row_number() over (order by trial_id, frame_number, part_key, supp_key) - 1 as i, count(*) over () as n from landmarks), fits as (select unnest([0, 1, 2]) as fit, unnest([0, 30, 50]) as cut)
select fit::int as fit, round(sum({_NEAR}), 1) as inertia, count(*) as n from rows, fits where cut = 0 or (i - n * (fit * 40) // 100 + n) % n >= n * cut // 100 group by fit""")
def inertia_back_fill(spark, d):
    """Inertia of several saved fits, each over the rows that its own leave-out kept."""
    rows = sequence.row_index(landmarks(spark, d), ("trial_id", "frame_number", "part_key", "supp_key"), "i")
    fits = [(k, cut, 40.0 * k, [[v + k for v in c] for c in CENTROIDS]) for k, cut in enumerate((0, 30, 50))]
    fits = spark.createDataFrame(fits, "fit int, del_size int, position double, centroids array<array<double>>")
    return rounded(cluster.inertia_of_fits(rows, FEATURES, fits, "i", ("fit",)), 1)


@query("""with c as (select p_type as category, abs(p_retailprice - 1500) as thrust, abs(p_size - 25.0::double) as slip, p_size as yaw, p_partkey::double as dur from part)
select round(max(thrust) filter (category not like 'STANDARD%'), 6) as max_thrust, round(max(slip) filter (category not like 'STANDARD%'), 6) as max_slip, max(yaw)::double as max_yaw, max(dur) as max_duration_ms from c""")
def prototype_scales(spark, d):
    p = load(spark, d, "part")
    rows = p.select(F.col("p_type").alias("category"), (F.col("p_retailprice") - 1500).alias("thrust"), (F.col("p_size") - 25.0).alias("slip"), F.col("p_size").cast("double").alias("yaw"), F.col("p_partkey").cast("double").alias("dur_mean_ms"))
    names = [r[0] for r in p.select("p_type").where(F.col("p_type").startswith("STANDARD")).distinct().collect()]  # a few categories
    return rounded(report.scale_maxima(rows, names))


@query(f"""with {FRAMES}, s as (select trial_id, grp, avg((label = 1)::int) as p from frames where grp < 2 group by all), r as (
  select grp, (rank() over (order by round(p, 9)) + count(*) over (partition by round(p, 9)) / 2.0 - 0.5) as rank from s
) select round(sum(rank) filter (grp = 0) - count(*) filter (grp = 0) * (count(*) filter (grp = 0) + 1) / 2, 6)::double as u, count(*) filter (grp = 0) as n_a, count(*) filter (grp = 1) as n_b from r""")
def rank_sum(spark, d):
    shares = frames(spark, d).where("grp < 2").groupBy("trial_id", "grp").agg(F.round(F.avg((F.col("label") == 1).cast("double")), 9).alias("p"))
    return rounded(stats.rank_sums(shares, "p", "grp", 0, 1))


@query(f"with {LANDMARKS} select trial_id, frame_number, part_key, supp_key, round(sqrt(pow(left_eye_x - tail_base_x, 2) + pow(left_eye_y - tail_base_y, 2)), 6) as length, round(asinh(left_eye_y), 6) as a, round(log10(left_eye_x), 6) as l from landmarks")
def vector_math(spark, d):
    f = landmarks(spark, d)
    length = F.hypot(F.col("left_eye_x") - F.col("tail_base_x"), F.col("left_eye_y") - F.col("tail_base_y"))
    return rounded(f.select("trial_id", "frame_number", "part_key", "supp_key", length.alias("length"), F.asinh("left_eye_y").alias("a"), F.log10("left_eye_x").alias("l")))


@query("select event_id, (props->>'$.k')::int as k from events where (props->>'$.k') is not null")
def json_fields(spark, d):
    e = load(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return e.where("p.k is not null").select("event_id", "p.k")
