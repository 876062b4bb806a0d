"""The standard tables in the roles of the frame database, in Spark and as SQL prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LABELS = ("click", "error", "purchase", "signup", "view")
K = len(LABELS)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a frame stream: a user is a recording, an event a frame."""
    e = load(spark, sf_dir, "events")
    label = F.array_position(F.array(*map(F.lit, LABELS)), F.col("event_type")).cast("int") - 1
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.col("user_id").alias("trial_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("frame_number"),
        F.col("event_id").alias("time_series_id"), label.alias("label"), (F.col("user_id") % 24 + 1).alias("well_number"), (F.col("user_id") % 4).alias("grp"),
        (F.col("value") / 10).alias("x"), (k / 10).alias("y"), (F.col("value") / 10).alias("thrust_mm_s"), ((k - 50) / 10).alias("slip_mm_s"),
        ((F.col("event_id") * 7 % 13 - 6) * 1.25).alias("yaw_rad_s"), (k / 100).alias("likelihood"),
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating-point columns cut to so many digits, as results are compared by value."""
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


FRAMES = """frames as (
  select user_id as trial_id, row_number() over (partition by user_id order by ts, event_id) - 1 as frame_number, event_id as time_series_id,
    list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 as label, user_id % 24 + 1 as well_number, user_id % 4 as grp,
    value / 10 as x, (props->>'$.k')::double / 10 as y, value / 10 as thrust_mm_s, ((props->>'$.k')::double - 50) / 10 as slip_mm_s,
    (event_id * 7 % 13 - 6) * 1.25::double as yaw_rad_s, (props->>'$.k')::double / 100 as likelihood
  from events
)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames with gaps: NaN for some positions and velocities."""
    i, nan = F.col("time_series_id"), F.lit(float("nan"))
    return frames(spark, sf_dir).withColumns({
        "x": F.when(i % 19 == 0, nan).otherwise(F.col("x")), "thrust_mm_s": F.when(i % 23 == 0, nan).otherwise(F.col("thrust_mm_s")),
        "yaw_rad_s": F.when(i % 29 == 0, nan).otherwise(F.col("yaw_rad_s")),
    })


TRACKS = """tracks as (
  select * replace (case when time_series_id % 19 = 0 then 'NaN'::double else x end as x,
    case when time_series_id % 23 = 0 then 'NaN'::double else thrust_mm_s end as thrust_mm_s,
    case when time_series_id % 29 = 0 then 'NaN'::double else yaw_rad_s end as yaw_rad_s)
  from frames
)"""


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as tracked landmarks of a recording for each order."""
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("trial_id"), F.col("l_linenumber").alias("frame_number"), F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key"),
        F.col("l_quantity").alias("left_eye_x"), (F.col("l_tax") * 100).alias("left_eye_y"), (F.col("l_quantity") + 4).alias("right_eye_x"), (F.col("l_discount") * 100).alias("right_eye_y"),
        (F.col("l_quantity") / 2).alias("tail_base_x"), (F.col("l_extendedprice") / 1000 - 60).alias("tail_base_y"),
    )


LANDMARKS = """landmarks as (
  select l_orderkey as trial_id, l_linenumber as frame_number, l_partkey as part_key, l_suppkey as supp_key, l_quantity as left_eye_x, l_tax * 100 as left_eye_y,
    l_quantity + 4 as right_eye_x, l_discount * 100 as right_eye_y, l_quantity / 2 as tail_base_x, l_extendedprice / 1000 - 60 as tail_base_y
  from lineitem
)"""


#: Transgene labels of the groups, by the customer's number.
TRANSGENES = ("G: NeuroD2, SgRNA: g20", "NeuroD2_g15_5MM", "Ap2b3 g2", "NO TADOLE", "EEF1A2: null", "WT", "", "sgRNA egfla2: g7")
SHORT_NAMES = ("ND2", "PTZ dose", "x4ap")


def _pick(names: tuple[str, ...], number) -> F.Column:
    return F.get(F.array(*map(F.lit, names)), number.cast("int"))


def star(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers as groups of animals, orders as trials, nations as videos, regions as series of three experiment types."""
    c, o, n, r, s = (load(spark, sf_dir, t) for t in ("customer", "orders", "nation", "region", "supplier"))
    key, mother = F.col("r_regionkey"), F.col("c_custkey")
    series = r.select(
        key.alias("series_id"), (key % 3).alias("experiment_type_id"), (key + 1).cast("long").alias("investigator_id"),
        F.date_add(F.lit("2024-01-10").cast("date"), (key * 3).cast("int")).alias("experiment_date"),
    )
    types = spark.range(3).select(
        F.col("id").cast("int").alias("experiment_type_id"), _pick(SHORT_NAMES, F.col("id")).alias("short_name"),
        F.concat(F.lit("type "), F.col("id").cast("string")).alias("long_name"), F.lit("p1").alias("protocol"),
    )
    return {
        "experiment_type": types, "experiment_series": series,
        "investigator": s.select(F.col("s_suppkey").alias("investigator_id"), F.substring("s_name", 1, 8).alias("first_name"), F.substring("s_name", 10, 20).alias("last_name")),
        "video": n.select(
            F.col("n_nationkey").alias("video_id"), F.col("n_regionkey").alias("series_id"),
            F.format_string("rec%06d_%s", F.col("n_nationkey") + 240101, F.col("n_name")).alias("filename"), F.lit(None).cast("timestamp_ntz").alias("date_time"),
        ),
        "trial": o.select(F.col("o_orderkey").alias("trial_id"), (F.col("o_orderkey") % 25).cast("int").alias("video_id"), F.col("o_custkey").alias("tadpole_group_id")),
        "tadpole_group": c.select(
            mother.alias("tadpole_group_id"), _pick(TRANSGENES, mother % 8).alias("transgene"), (mother % 13).alias("mother_id"),
            F.concat(F.lit("st"), (mother % 5).cast("string")).alias("development_stage"), F.date_add(F.lit("2024-01-01").cast("date"), (mother % 9).cast("int")).alias("fertilisation_date"),
        ),
    }


def _list(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


STAR = f"""series as (
  select r_regionkey as series_id, r_regionkey % 3 as experiment_type_id, r_regionkey + 1 as investigator_id, date '2024-01-10' + (r_regionkey * 3)::int as experiment_date from region
), experiment_type as (
  select i::int as experiment_type_id, {_list(SHORT_NAMES)}[i + 1] as short_name, 'type ' || i as long_name, 'p1' as protocol from range(3) r(i)
), investigator as (
  select s_suppkey as investigator_id, substr(s_name, 1, 8) as first_name, substr(s_name, 10, 20) as last_name from supplier
), video as (
  select n_nationkey as video_id, n_regionkey as series_id, format('rec{{:06d}}_{{}}', n_nationkey + 240101, n_name) as filename from nation
), trial as (
  select o_orderkey as trial_id, o_orderkey % 25 as video_id, o_custkey as tadpole_group_id from orders
), tadpole_group as (
  select c_custkey as tadpole_group_id, {_list(TRANSGENES)}[c_custkey % 8 + 1] as transgene, c_custkey % 13 as mother_id, 'st' || c_custkey % 5 as stage,
    date '2024-01-01' + (c_custkey % 9)::int as fertilisation_date from customer
), filmed as (
  select * from trial join video using (video_id) join series using (series_id)
)"""
#: The parts of a transgene label, by its text in lower case.
PARTS = """case when low like '%neurod2%' then 'NeuroD2' when low like '%eef1a2%' or low like '%egfla2%' then 'Eef1a2' when low like '%ap2b3%' then 'Ap2b3'
    when none then 'empty' else 'WT/other' end as gene,
  case when low like '%5mm%' then 'g15_5MM' when low like '%g20%' then 'g20' when low like '%null%' then 'null' when trim(string_split(transgene, ':')[-1]) = '' then '-'
    else trim(string_split(transgene, ':')[-1]) end as guide,
  (low like '%5mm%' or low like '%null%') and not none as is_control, none as is_empty,
  case when none then 'empty' when low like '%5mm%' or low like '%null%' then 'internal control' else 'edited' end as role"""
GROUPS = f"""groups as (
  select tadpole_group_id, transgene, mother_id, stage, fertilisation_date, n_animals, n_videos, gene, guide, is_control, is_empty,
    case mother_id when 10 then 'A' when 11 then 'B' when 3 then 'P' else mother_id::varchar end as clutch,
    '20' || file[4:5] || '-' || file[6:7] || '-' || file[8:9] as recording_date, role
  from (select *, {PARTS} from (select *, lower(transgene) as low, transgene = '' or lower(transgene) like '%no tad%' as none from tadpole_group))
  join (select tadpole_group_id, count(distinct trial_id) as n_animals, count(distinct video_id) as n_videos, min(filename) as file
    from filmed where experiment_type_id in (0, 1) group by 1) using (tadpole_group_id)
)"""
