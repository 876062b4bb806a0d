"""Metadata and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ethoflow.catalog import query
from ethoflow.functions import text
from ethoflow.operators import metadata, report, sequence
from ethoflow.plans.roles import GROUPS, STAR, load, star


EXPERIMENTS = """experiments as (
  select e.experiment_type_id, e.short_name, e.long_name, e.protocol,
    coalesce(string_agg(distinct i.first_name || ' ' || i.last_name, ',' order by i.first_name || ' ' || i.last_name), '') as investigators,
    min(s.experiment_date) as series_first, max(s.experiment_date) as series_last, count(distinct v.video_id) as n_videos
  from experiment_type e join series s on e.experiment_type_id = s.experiment_type_id left join investigator i on s.investigator_id = i.investigator_id
    left join video v on s.series_id = v.series_id
  where e.experiment_type_id in (0, 1) group by all
)"""


@query(f"with {STAR}, {EXPERIMENTS} select * from experiments")
def star_experiments(spark, d):
    return report.experiments(star(spark, d), [0, 1])


@query(f"with {STAR}, {GROUPS} select * from groups")
def star_groups(spark, d):
    return report.groups(star(spark, d), [0, 1])


@query(f"with {STAR}, {GROUPS} select tadpole_group_id, guide, n_animals from groups where role = 'internal control'")
def internal_controls(spark, d):
    return report.internal_controls(report.groups(star(spark, d), [0, 1])).select("tadpole_group_id", "guide", "n_animals")


@query(f"""with {STAR} select f.experiment_type_id::int as experiment_type_id, short_name, case when lower(short_name) like '%ptz%' then 'seizure-positive (PTZ)' else 'seizure-positive (4-AP)' end as role,
  count(distinct trial_id) as n_animals, count(distinct tadpole_group_id) as n_groups
from filmed f join experiment_type e on f.experiment_type_id = e.experiment_type_id
where f.experiment_type_id <> 1 and (lower(short_name) like '%ptz%' or lower(short_name) like '%4ap%') group by all""")
def global_controls(spark, d):
    return report.global_controls(star(spark, d), [1])


@query(f"""with {STAR}, {EXPERIMENTS}, {GROUPS}
select (select count(*) from experiments) as n_experiments, (select sum(n_videos) from experiments)::bigint as n_videos, count(*) as n_groups, sum(n_animals)::bigint as n_animals,
  min(recording_date) as first_day, max(recording_date) as last_day from groups where role <> 'empty'""")
def report_summary(spark, d):
    t = star(spark, d)
    return report.summary_row(report.experiments(t, [0, 1]), report.groups(t, [0, 1]))


@query(f"with {STAR}, {GROUPS} select o_orderkey, o_custkey as group_id, o_totalprice from orders where o_custkey in (select tadpole_group_id from groups where role = 'edited')")
def report_group_filter(spark, d):
    rows = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("group_id"), "o_totalprice")
    return report.in_groups(rows, report.groups(star(spark, d), [0, 1]).where("role = 'edited'"))


@query("""with o as (select o_orderkey, [(o_orderkey % 24 + 1)::int, ((o_orderkey * 7) % 24 + 1)::int] as ends, (o_custkey % 30)::int as extra from orders)
select o_orderkey, array_to_string(list_sort(list_distinct(list_concat(range(list_min(ends), list_max(ends) + 1), case when extra between 1 and 24 then [extra::bigint] else [] end))), ',') as wells from o""")
def well_range_parse(spark, d):
    o = load(spark, d, "orders")
    spec = F.concat((F.col("o_orderkey") % 24 + 1).cast("string"), F.lit(" to  "), (F.col("o_orderkey") * 7 % 24 + 1).cast("string"), F.lit(", "), (F.col("o_custkey") % 30).cast("string"))
    return o.select("o_orderkey", F.array_join(F.transform(text.wells(spec), lambda x: x.cast("string")), ",").alias("wells"))


@query("""with w as (select distinct o_custkey, (o_orderkey % 24 + 1) as w from orders), r as (select *, w - row_number() over (partition by o_custkey order by w) as run from w),
g as (select o_custkey, min(w) as a, max(w) as z from r group by o_custkey, run)
select o_custkey, string_agg(case when a = z then a::varchar else a || '-' || z end, ',' order by a) as wells from g group by 1""")
def compact_wells(spark, d):
    w = load(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set((F.col("o_orderkey") % 24 + 1).cast("int"))).alias("w"))
    return w.select("o_custkey", text.compact(F.col("w")).alias("wells"))


@query("""select o_orderkey, case when o_orderkey % 8 = 7 then null when o_orderkey % 8 = 6 then date '1970-02-01' else o_orderdate::date end as day from orders""")
def multi_format_date(spark, d):
    o, t = load(spark, d, "orders"), F.col("o_orderdate")
    written = F.lit("31/11/24")
    for i, f in enumerate(("yyyy-MM-dd HH:mm:ss", "yyyy-M-d", "d/M/yyyy", "dd/MM/yy", "dd-MM-yyyy", "d-M-yy")):
        written = F.when(F.col("o_orderkey") % 8 == i, F.date_format(t, f)).otherwise(written)
    written = F.when(F.col("o_orderkey") % 8 == 6, "1/2/70").otherwise(written)
    return o.select("o_orderkey", text.parsed_date(written).alias("day"))


@query("""with t as (select c_mktsegment as k, min(c_custkey) as id from customer where c_mktsegment < 'F' group by 1), w as (select distinct c_mktsegment as k from customer),
n as (select k, row_number() over (order by k) + (select max(id) from t) as id from w where k not in (select k from t))
select c.c_custkey, coalesce(t.id, n.id)::bigint as id from customer c left join t on c.c_mktsegment = t.k left join n on c.c_mktsegment = n.k""")
def upsert_get_or_create(spark, d):
    c = load(spark, d, "customer")
    known = c.where("c_mktsegment < 'F'").groupBy(F.col("c_mktsegment").alias("k")).agg(F.min("c_custkey").alias("id"))
    return metadata.get_or_create(known, c.select("c_custkey", F.col("c_mktsegment").alias("k")), ("k",), "id")[1].select("c_custkey", "id")


@query("""with v as (select o_orderkey from orders where o_orderkey < 50), t as (select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem)
select t.* from t where l_orderkey not in (select o_orderkey from v)""")
def cascade_delete(spark, d):
    o, l = load(spark, d, "orders"), load(spark, d, "lineitem")
    tables = {
        "video": o.select(F.col("o_orderkey").alias("video_id"), F.when(F.col("o_orderkey") < 50, "gone").otherwise("kept").alias("filename")),
        "trial": o.select(F.col("o_orderkey").alias("video_id"), F.col("o_orderkey").alias("trial_id")),
        "time_series": l.select(F.col("l_orderkey").alias("trial_id"), F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("time_series_id")),
    }
    frames = l.select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("time_series_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    left = metadata.without_video(tables | {"velocity": frames, "posture": frames, "trajectory": frames}, "gone")
    return left["velocity"].drop("time_series_id")


@query("select c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') as name, right(c_name, 9) as tail from customer")
def name_keys(spark, d):
    return load(spark, d, "customer").select("c_custkey", text.plain_name(F.concat("c_name", F.lit(".mp4"))).alias("name"), text.tail_key(F.col("c_name")).alias("tail"))


# Recordings of a name: five in six are in a plate, under their name or with a slip in it (a letter left out, another time); some names are in two plates.
VIDEO_NAMES = """names as (
  select c_custkey as i, 'Cam' || (c_custkey % 9) || '_' || printf('%03d', c_custkey % 1000) || '_' || printf('%06d', c_custkey * 7 % 1000000) as name from customer
), plates as (
  select printf('#%d', i // 3) as key, case i % 6 when 0 then name when 1 then replace(name, 'Cam', 'Ca') when 2 then left(name, length(name) - 6) || '999999' when 3 then lower(replace(name, '_', '-')) || ',mp4'
    else name end as v from names where i % 6 <> 5
  union all select '#dup', name from names where i % 12 = 4
), keyed as (
  select key, regexp_replace(regexp_replace(lower(v), '[^a-z0-9]', '', 'g'), 'mp4$', '') as n from plates
), videos as (
  select name || '.MP4' as filename, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') as n from names
), e as (
  select v.filename, count(distinct key) as c, min(key) as key from videos v join keyed k on v.n = k.n group by 1
), t as (
  select v.filename, count(distinct key) as c, min(key) as key from videos v join keyed k on right(v.n, 9) = right(k.n, 9) and regexp_matches(v.n, '[0-9]{9}$') and regexp_matches(k.n, '[0-9]{9}$') group by 1
), p as (
  select v.filename, count(distinct key) as c, min(key) as key from videos v join keyed k on left(v.n, length(v.n) - 6) = left(k.n, length(k.n) - 6) and regexp_matches(v.n, '[0-9]{9}$') and regexp_matches(k.n, '[0-9]{9}$') group by 1
)"""


def _names(spark, d):
    c, i = load(spark, d, "customer"), F.col("c_custkey")
    name = F.format_string("Cam%d_%03d_%06d", i % 9, i % 1000, i * 7 % 1000000)
    names = c.select(i.alias("i"), name.alias("name"))
    slip = (
        F.when(F.col("i") % 6 == 1, F.replace("name", F.lit("Cam"), F.lit("Ca"))).when(F.col("i") % 6 == 2, F.concat(F.expr("left(name, length(name) - 6)"), F.lit("999999")))
        .when(F.col("i") % 6 == 3, F.concat(F.lower(F.replace("name", F.lit("_"), F.lit("-"))), F.lit(",mp4"))).otherwise(F.col("name"))
    )
    one = names.where("i % 6 <> 5").select(F.format_string("#%d", F.expr("i div 3")).alias("key"), slip.alias("v"))
    plates = one.unionAll(names.where("i % 12 = 4").select(F.lit("#dup"), "name")).groupBy("key").agg(F.collect_list("v").alias("videos"))
    return names.select(F.concat("name", F.lit(".MP4")).alias("filename")), plates


@query(f"""with {VIDEO_NAMES} select v.filename, case when e.c = 1 then e.key when t.c = 1 then t.key when p.c = 1 then p.key end as key,
  case when e.c = 1 then 'exact' when t.c = 1 then 'tail' when p.c = 1 then 'prefix' when e.c > 1 then 'ambiguous' else 'unmatched' end as status
from videos v left join e using (filename) left join t using (filename) left join p using (filename)""")
def match_videos(spark, d):
    return metadata.matched_videos(*_names(spark, d))


@query(f"""with {VIDEO_NAMES}, hits as (
  select v.filename, k.key from videos v join keyed k on v.n = k.n or (regexp_matches(v.n, '[0-9]{{9}}$') and regexp_matches(k.n, '[0-9]{{9}}$')
    and (right(v.n, 9) = right(k.n, 9) or left(v.n, length(v.n) - 6) = left(k.n, length(k.n) - 6)))
)
select v.filename, coalesce(string_agg(distinct h.key, ',' order by h.key), '') as keys from videos v left join hits h using (filename) group by 1""")
def candidate_keys(spark, d):
    return metadata.candidate_keys(*_names(spark, d)).withColumn("keys", F.array_join("keys", ","))


@query("select p_brand, p_type, n, round(n / sum(n) over (partition by p_brand), 6) as share from (select p_brand, p_type, count(*) as n from part group by all)")
def cross_tab(spark, d):
    return report.cross_shares(load(spark, d, "part"), "p_brand", "p_type").withColumn("share", F.round("share", 6))


@query("select p_type as category, round(sum(p_retailprice), 4) as prevalence from part group by 1")
def group_prevalence(spark, d):
    return report.prevalence_by_group(load(spark, d, "part").select(F.col("p_type").alias("category"), F.col("p_retailprice").alias("prevalence"))).withColumn("prevalence", F.round("prevalence", 4))


@query("""with d as (select distinct p_type as category, p_size as raw_id from part)
select category, raw_id, (row_number() over (order by category, raw_id) - 1)::int as display_id from d""")
def cluster_map(spark, d):
    return metadata.ordered_map(load(spark, d, "part").select(F.col("p_type").alias("category"), F.col("p_size").alias("raw_id")).distinct())


@query("""select o_orderkey, w as well from orders cross join range(1, 8) r(w)
where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linenumber = w)""")
def missing_clips(spark, d):
    o, l = load(spark, d, "orders"), load(spark, d, "lineitem")
    files = l.select(F.col("l_orderkey").alias("stem"), (F.col("l_linenumber") - 1).alias("well"))
    grid = metadata.missing_clips(o.select(F.col("o_orderkey").alias("stem")), files, 7)
    return grid.select(F.col("stem").alias("o_orderkey"), (F.col("well") + 1).cast("long").alias("well"))


@query("select o_custkey, o_orderkey, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as r from orders) where r = 1")
def first_video(spark, d):
    return sequence.first_rows(load(spark, d, "orders"), ("o_custkey",), ("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey", "o_orderdate")
