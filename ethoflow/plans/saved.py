"""Queries that write results with the library's sinks and read them back, and those of the metadata ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ethoflow.catalog import query
from ethoflow.operators import bouts, cluster, ingest, metadata, prototypes, sequence
from ethoflow.plans.frames import ANIMALS, FEATURES, FPS
from ethoflow.plans.report import VIDEO_NAMES, _names
from ethoflow.plans.roles import FRAMES, LANDMARKS, frames, landmarks, load, rounded
from ethoflow.session import scratch_path
from ethoflow.sources import files, saved, sheets


@query(f"""with {LANDMARKS}, s as (
  {' union all '.join(f'select {i} as feature_idx, avg({c}) as mu, stddev_pop({c}) as sigma from landmarks' for i, c in enumerate(FEATURES))}
) select feature_idx::int as feature_idx, round(mu, 6) as mu, round(sigma, 6) as sigma from s""")
def mu_sigma_file(spark, d):
    at = scratch_path(spark, "mu-sigma")
    saved.write_mu_sigma(cluster.mu_sigma(landmarks(spark, d), FEATURES), at)
    return rounded(saved.read_mu_sigma(spark, at))


def _fits(spark, d):
    """A fit for each supplier: k centroids of two numbers."""
    s = load(spark, d, "supplier")
    k = (F.col("s_suppkey") % 4 + 2).cast("int")
    rows = F.transform(F.sequence(F.lit(1), k), lambda i: F.array(i.cast("double"), (F.col("s_suppkey") % 7).cast("double")))
    return s.select(
        k.alias("k"), rows.alias("centroids"), (F.col("s_suppkey") % 3 * 10).cast("double").alias("reduction_percent"), F.col("s_suppkey").cast("double").alias("cut_position_percent"),
        F.col("s_acctbal").alias("calinski_harabasz_score"), (F.col("s_acctbal") / 2).alias("inertia"),
    )


@query("""select (s_suppkey % 4 + 2)::int as k, s_suppkey::double as cut_position_percent, (s_suppkey % 3 * 10)::double as reduction_percent, s_acctbal as calinski_harabasz_score,
  (s_suppkey % 7)::double * (s_suppkey % 4 + 2) as total from supplier""")
def fit_files(spark, d):
    at = scratch_path(spark, "fits")
    saved.write_fits(_fits(spark, d), at)
    total = F.aggregate("centroids", F.lit(0.0), lambda s, c: s + c[1])
    return files.fits(spark, at).select("k", "cut_position_percent", "reduction_percent", "calinski_harabasz_score", total.alias("total"))


@query("""with f as (select s_suppkey % 4 + 2 as k, s_suppkey % 3 * 10 as r, s_suppkey as p, unnest(range(1, (s_suppkey % 4 + 3)::bigint)) as i, s_suppkey % 7 as v from supplier)
select p::double as cut_position_percent, (i - 1)::int as centroid, i::double as x, v::double as y from f where k = 3 and r = 10""")
def chosen_fits(spark, d):
    rows = cluster.chosen_centroids(_fits(spark, d), 3, 10)
    return rows.select("cut_position_percent", "centroid", F.col("values")[0].alias("x"), F.col("values")[1].alias("y"))


@query("""with s as (select s_suppkey as id, (s_suppkey % 4 + 2) as k, (s_suppkey % 3 * 10) as r from supplier)
select id, 'out/run/delSize_' || r || '/k_' || k || '/run_meta_k' || k || '_delSize' || r || '_delPosP' || id || '.json' as meta,
  'out/run/delSize_' || r || '/k_' || k || '/labels/run_labels_k' || k || '_delSize' || r || '_delPosP' || id || '.npy' as labels from s""")
def fit_paths(spark, d):
    s = load(spark, d, "supplier")
    grid = s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 4 + 2).alias("k"), (F.col("s_suppkey") % 3 * 10).alias("del_size"), F.col("s_suppkey").alias("position"))
    return saved.fit_paths(grid, "out", "run").select("id", "meta", saved.labels_path(F.col("meta")).alias("labels"))


@query(f"{ANIMALS} select label::int as label, count(*) as n_animals, round(avg(mean_ms)::double, 6) as mean_ms, round(median(median_ms)::double, 6) as median_ms from animals group by 1")
def duration_file(spark, d):
    at = scratch_path(spark, "durations")
    saved.write_durations(bouts.durations(frames(spark, d), FPS), at, fps=FPS, smooth_min_frames=1)
    return rounded(saved.read_durations(spark, at, "n_animals:bigint,mean_ms:double,median_ms:double"))


@query(f"{ANIMALS} select round(max(m)::double, 6) as dur_max_mean_of_means_ms, round(max(q)::double, 6) as dur_max_median_of_medians_ms from (select avg(mean_ms) as m, median(median_ms) as q from animals group by label)")
def duration_file_maxima(spark, d):
    at = scratch_path(spark, "durations")
    saved.write_durations(bouts.durations(frames(spark, d), FPS), at, fps=FPS)
    return rounded(saved.read_duration_maxima(spark, at))


@query("""with d as (select distinct p_type as category, p_size as raw_id from part)
select raw_id, (row_number() over (order by category, raw_id) - 1)::int as display_id, category, '' as short_label, '' as description from d""")
def cluster_map_file(spark, d):
    at = scratch_path(spark, "map")
    saved.write_cluster_map(metadata.ordered_map(load(spark, d, "part").select(F.col("p_type").alias("category"), F.col("p_size").alias("raw_id")).distinct()), at)
    return saved.read_cluster_map(spark, at)


VELOCITY = ("thrust_mm_s", "slip_mm_s", "yaw_rad_s")


@query(f"""with {FRAMES}, c as (select label, {', '.join(f'avg({v}) as {v}' for v in VELOCITY)} from frames group by 1)
select label::int as centroid, round(thrust_mm_s, 6) as thrust, round(slip_mm_s * 2 + 1, 6) as slip, round(yaw_rad_s / max(abs(yaw_rad_s)) over (), 6) as yaw from c""")
def centroid_results_file(spark, d):
    at = scratch_path(spark, "centroids")
    c = frames(spark, d).groupBy("label").agg(*(F.avg(v).alias(v) for v in VELOCITY))
    scaled = prototypes.max_abs_scaled(c, VELOCITY).select("label", F.array(*VELOCITY).alias("feature_val_nmax"))
    rows = c.select("label", F.array(*VELOCITY).alias("feature_val_zscored"), F.array(*(F.col(v) * 2 + 1 for v in VELOCITY)).alias("feature_val_uf"))
    saved.write_centroid_results(rows.join(scaled, "label").withColumnRenamed("label", "centroid"), VELOCITY, at)
    got = saved.read_centroid_results(spark, at)
    return rounded(got.select("centroid", F.col("feature_val_zscored")[0].alias("thrust"), F.col("feature_val_uf")[1].alias("slip"), F.col("feature_val_nmax")[2].alias("yaw")))


@query("select n_name as stem, w::int as well, n_nationkey * 2.5::double as cx, w * 1.25::double as cy, 7.5::double as radius from nation cross join range(24) r(w)")
def geometry_file(spark, d):
    at = scratch_path(spark, "geometry")
    grid = load(spark, d, "nation").withColumn("well", F.explode(F.sequence(F.lit(0), F.lit(23))))
    saved.write_geometry(grid.select(F.col("n_name").alias("stem"), "well", (F.col("n_nationkey") * 2.5).alias("cx"), (F.col("well") * 1.25).alias("cy"), F.lit(7.5).alias("radius")), at)
    return saved.read_geometry(spark, at)


def _video_metadata(spark, d):
    n, i = load(spark, d, "nation"), F.col("n_nationkey")
    at = F.make_timestamp_ntz(F.lit(2024), F.lit(3), (i % 28 + 1).cast("int"), (i * 7 % 24).cast("int"), F.lit(5), F.lit(1.25))
    return n.select(
        F.concat("n_name", F.lit(".mp4")).alias("name"), F.lit("cam").alias("camera"), (F.lit(50.0) + i % 3).alias("fps"), at.alias("date_time"),
        (100.0 + i).alias("median_well_radius_pixels"), F.lit(15.6).alias("real_well_diameter_mm"),
    )


VIDEO_METADATA = """metadata as (
  select n_name || '.mp4' as name, n_regionkey as series, 50.0::double + n_nationkey % 3 as fps, (100.0 + n_nationkey)::double as r,
    make_timestamp(2024, 3, (n_nationkey % 28 + 1)::bigint, (n_nationkey * 7 % 24)::bigint, 5, 1.25) as date_time from nation
)"""


@query(f"with {VIDEO_METADATA} select name, fps, date_time, round(r, 6) as median_well_radius_pixels from metadata")
def video_metadata_file(spark, d):
    at = scratch_path(spark, "videos")
    saved.write_metadata(_video_metadata(spark, d), at)
    got = saved.read_metadata(spark, at)
    return rounded(got.select("name", "fps", F.col("date_time").cast("timestamp_ntz").alias("date_time"), "median_well_radius_pixels"))


@query(f"""with {VIDEO_METADATA} select series as series_id, name as filename, round(r * 2 / 15.6, 6) as pix2mm, (row_number() over (partition by series order by date_time, name) - 1)::int as video_series_num,
  (count(*) over (partition by series))::int as video_series_size, date_time from metadata""")
def insert_videos(spark, d):
    regions = load(spark, d, "nation").select(F.concat("n_name", F.lit(".mp4")).alias("name"), "n_regionkey")
    rows = ingest.video_rows(_video_metadata(spark, d).join(regions, "name"), F.col("n_regionkey"))
    return rounded(rows.select("series_id", "filename", "pix2mm", "video_series_num", "video_series_size", "date_time"))


@query(f"with {VIDEO_METADATA} select series, min(date_time) as experiment_date, arg_min(name, (date_time, name)) as first_video from metadata group by 1")
def insert_series(spark, d):
    regions = load(spark, d, "nation").select(F.concat("n_name", F.lit(".mp4")).alias("name"), F.col("n_regionkey").alias("series"))
    return ingest.series_start(_video_metadata(spark, d).join(regions, "name"), ["series"])


def _plates(spark, d):
    """Plate records: arenas, doses and transgenes by the key's number."""
    videos, plates = _names(spark, d)
    n = F.coalesce(F.expr("try_cast(substring(key, 2) as int)"), F.lit(0))
    pick = lambda *xs: F.get(F.array(*map(F.lit, xs)), n % len(xs))
    none = F.lit("")
    return videos, plates.withColumns({
        "control_arenas": pick("1 to 4", "", "", ""), "test_arenas": pick("", "1-12, 20", "5mM ptz 1 to 3", ""), "drug_dose": pick("10 mM PTZ", "", "", "", ""),
        "target_gene": pick("NeuroD2", "null", "Ap2b3"), "sgrna": pick("g20", "null", "N/A"), "initials": pick("CB", "XY"), "fert_date_raw": pick("3/2/24", "31/11/24"),
        "exp_date_raw": none, "female_identifier": pick("A", "B"), "background_strain": none, "female_tank": none, "seq_folder": none, "notes": none,
    })


MATCHED = f"""{VIDEO_NAMES}, matched as (
  select v.filename, case when e.c = 1 then e.key when t.c = 1 then t.key when p.c = 1 then p.key end as key,
    case when e.c = 1 then 'exact' when t.c = 1 then 'tail' when p.c = 1 then 'prefix' when e.c > 1 then 'ambiguous' else 'unmatched' end as status
  from videos v left join e using (filename) left join t using (filename) left join p using (filename)
), numbered as (
  select *, case when key is not null then coalesce(try_cast(substr(key, 2) as int), 0) end as n from matched
), plan as (
  select regexp_replace(filename, '[.][^.]*$', '') as video_stem, coalesce(key, '') as row_key, status as match_method,
    coalesce(['NeuroD2 g20', 'WT', 'Ap2b3'][n % 3 + 1], '') as transgene, coalesce(['1-4', '1-12,20', '1-3', ''][n % 4 + 1], '') as occupied_wells,
    coalesce([4, 13, 3, 0][n % 4 + 1], 0)::int as n_occupied, case when n is null then '' when n % 4 = 2 or n % 5 = 0 then '1' else '0' end as is_gradient,
    case when n is null then '' when n % 4 = 0 then 'control' else 'test' end as arena_role, case when n % 2 = 0 then '2024-02-03' else '' end as fert_date
  from numbered
)"""
_PLAN = ("video_stem", "row_key", "match_method", "transgene", "occupied_wells", "n_occupied", "is_gradient", "arena_role", "fert_date")


@query(f"with {MATCHED} select * from plan")
def build_plan(spark, d):
    return ingest.build_plan(*_plates(spark, d)).select(*_PLAN)


@query(f"with {MATCHED} select * replace (n_occupied::varchar as n_occupied) from plan")
def plan_file(spark, d):
    at = scratch_path(spark, "plan")
    saved.write_plan(ingest.build_plan(*_plates(spark, d)), at)
    return saved.read_plan(spark, at).select(*_PLAN)


STATUS = "case when transgene = '' then 'no transgene/path' when is_gradient = '1' then 'gradient' when occupied_wells = '' then 'no occupied wells' else 'ready' end"


@query(f"with {MATCHED} select video_stem, {STATUS} as plan_status from plan")
def plan_status(spark, d):
    return ingest.plan_status(ingest.build_plan(*_plates(spark, d))).select("video_stem", "plan_status")


@query(f"with {MATCHED} select count(*) as n_videos, count(*) filter (row_key <> '') as n_matched, count(*) filter (row_key = '') as n_unmatched, count(*) filter (row_key <> '' and is_gradient = '1') as n_gradient from plan")
def plan_summary(spark, d):
    return ingest.plan_counts(ingest.build_plan(*_plates(spark, d)))


def _layouts(spark, d):
    ids = {"investigator_id": F.lit(3), "experiment_type_id": F.lit(2), "well_type_id": F.lit(1), "tadpole_group_id": F.length("video_stem")}
    return ingest.layouts(ingest.build_plan(*_plates(spark, d)), ids)


LAYOUTS = f"""{MATCHED}, layout as (
  select video_stem, w::int as well_number, w + 1 <= case occupied_wells when '1-4' then 4 when '1-3' then 3 else 12 end or (occupied_wells = '1-12,20' and w = 19) as here
  from plan cross join range(24) r(w) where {STATUS} = 'ready'
)"""


@query(f"""with {LAYOUTS} select video_stem, well_number, 3 as investigator_id, 2 as experiment_type_id, case when here then 1 end as well_type_ids,
  case when here then length(video_stem) end::int as tadpole_type_ids from layout""")
def layout_files(spark, d):
    at = scratch_path(spark, "layouts")
    saved.write_layouts(_layouts(spark, d), at)
    return saved.read_layouts(spark, at).select("video_stem", *saved.LAYOUT)


@query(f"with {LAYOUTS} select length(video_stem)::bigint * 32 + well_number + 1 as trial_id, (well_number + 1)::int as well_number from layout where here")
def insert_trials(spark, d):
    layout = _layouts(spark, d)
    videos = layout.select("video_stem").distinct().withColumn("video_id", F.length("video_stem").cast("long"))
    return ingest.trial_rows(layout, videos).select("trial_id", "well_number")


@query("""with t as (select c_custkey as request, (c_custkey % 3)::int as e, (c_custkey % 4)::int as i, (c_custkey % 5)::int as a from customer),
s as (select s_suppkey as series_id, (s_suppkey % 3)::int as e, (s_suppkey % 4)::int as i, [(s_suppkey % 5)::int, (s_suppkey % 2 + 5)::int] as own from supplier)
select request, min(s.series_id) as series_id from t left join s on t.e = s.e and t.i = s.i and list_sort([t.a, t.a % 2 + 5]) = list_sort(s.own) group by 1""")
def find_series(spark, d):
    c, s = load(spark, d, "customer"), load(spark, d, "supplier")
    key, day = F.col("s_suppkey"), F.lit(None).cast("date").alias("experiment_date")
    series = s.select(key.alias("series_id"), (key % 3).cast("int").alias("experiment_type_id"), (key % 4).cast("int").alias("investigator_id"), day)
    own = s.select(key.alias("series_id"), F.explode(F.array((key % 5).cast("int"), (key % 2 + 5).cast("int"))).alias("attribute_id"))
    n = F.col("c_custkey")
    wanted = c.select(n.alias("request"), (n % 3).cast("int").alias("experiment_type_id"), (n % 4).cast("int").alias("investigator_id"), day, F.array((n % 5).cast("int"), (n % 5 % 2 + 5).cast("int")).alias("attribute_ids"))
    return ingest.series_by_attributes(series, own, wanted)


@query("select l_orderkey as trial_id, l_linenumber as well_number, l_suppkey as well_type_id, round(l_quantity, 6) as quantity from lineitem where l_linenumber <= 2")
def csv_scan(spark, d):
    at = scratch_path(spark, "csv")
    rows = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("trial_id"), F.col("l_linenumber").alias("well_number"), F.col("l_suppkey").alias("well_type_id"), F.col("l_quantity").alias("quantity"), "l_tax")
    for n in (1, 2):
        rows.where(F.col("well_number") == n).write.csv(f"{at}/{n}", header=True)
    schema = "trial_id long, well_number int, well_type_id long, quantity double, l_tax double"
    return rounded(saved.labelled_csv(spark, [f"{at}/1", f"{at}/2"], schema).drop("l_tax"))


def _sheet(spark, d):
    """A sheet with two lines of headings, of which the second counts; lines without a key and absent columns."""
    k = F.col("s_suppkey").cast("string")
    n = F.col("s_suppkey")
    rows = load(spark, d, "supplier").select(
        F.when(n % 5 != 0, F.concat(F.lit(" P"), k)).alias("a"), F.when(n % 2 == 0, "CB").alias("b"), F.concat(F.lit("g"), (n % 3).cast("string")).alias("c"),
        F.concat(F.lit("1 to "), (n % 24).cast("string")).alias("e"), F.when(n % 3 != 2, F.concat(F.lit("a"), k, F.lit(".mp4"))).alias("f"),
        F.when(n % 3 == 1, F.concat(F.lit("b, "), k)).alias("g"), F.lit(0).alias("line"),
    )
    heads = [("Plate", "", "", "Wells", "Recordings", "", -2), ("Key (unique)", "Initials", "sgRNA rank, dilution", "Test arenas", "Video 1", "video 2", -1)]
    heads = spark.createDataFrame(heads, "a string, b string, c string, e string, f string, g string, line int")
    return heads.unionByName(rows)


def _records(got):
    return got.select("key", "initials", "sgrna", "test_arenas", "notes", F.array_join("videos", ",").alias("videos"))


_SHEET = """select 'P' || s_suppkey as key, case when s_suppkey % 2 = 0 then 'CB' else '' end as initials, 'g' || s_suppkey % 3 as sgrna, '1 to ' || s_suppkey % 24 as test_arenas, '' as notes,
  case when s_suppkey % 3 = 0 then 'a' || s_suppkey || '.mp4' when s_suppkey % 3 = 1 then 'a' || s_suppkey || '.mp4,b, ' || s_suppkey else '' end as videos from supplier where s_suppkey % 5 <> 0"""


@query(_SHEET)
def plate_sheet(spark, d):
    """The sheet saved as CSV."""
    at = scratch_path(spark, "sheet")
    _sheet(spark, d).repartition(1).sortWithinPartitions("line").drop("line").write.csv(at, emptyValue="")
    return _records(ingest.sheet_records(spark, at))


@query(_SHEET)
def plate_workbook(spark, d):
    """The sheet as a workbook, written and read."""
    at, names = scratch_path(spark, "workbook").removeprefix("file://") + "/plates.xlsx", ("a", "b", "c", "e", "f", "g")
    lines = sequence.row_index(_sheet(spark, d), ("line", "a", "c", "e"), "n").select((F.col("n") + 1).alias("line"), F.array(*names).alias("cells"))
    sheets.write_sheet(lines, at)
    return _records(ingest.sheet_records(spark, at))
