"""Saved results: statistics, fits, centroids, durations, maps, plans and layouts as CSV and JSON, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ethoflow.sources import video_files


def _in_file_order(df: DataFrame, out: str) -> DataFrame:
    """Numbers the rows of one small file from 0."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.monotonically_increasing_id())
    return df.withColumn(out, F.row_number().over(w) - 1)


def _one_text(df: DataFrame, document: Column, path: str) -> None:
    """Writes a one-row table's document as one text file."""
    df.select(document.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_mu_sigma(stats: DataFrame, path: str) -> None:
    """Rows (feature_idx, mu, sigma), one a feature."""
    stats.select("feature_idx", "mu", "sigma").coalesce(1).sortWithinPartitions("feature_idx").write.mode("overwrite").csv(path, header=True)


def read_mu_sigma(spark: SparkSession, path: str) -> DataFrame:
    """Rows (feature_idx, mu, sigma); a file without indices (columns mu and sigma) has its features in the order of lines."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    df = df if "feature_idx" in df.columns else _in_file_order(df, "feature_idx")
    return df.select(F.col("feature_idx").cast("int").alias("feature_idx"), F.col("mu").cast("double").alias("mu"), F.col("sigma").cast("double").alias("sigma"))


#: The fields of a fit's metadata.
FIT_SCHEMA = (
    "calinski_harabasz_score double, inertia double, data_file string, reduction_percent double, cut_position_percent double, "
    "centroids array<array<double>>, start_time string, duration_s double"
)


#: Writers of many small files: the tasks that write files also put them in place, not the driver one by one.
BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def _writers(df: DataFrame) -> int:
    """Tasks that write many small files: a few for each core, however small the table is."""
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def write_fits(fits: DataFrame, path: str) -> None:
    """One JSON document a fit, in folders by reduction and number of clusters; fields that a table lacks are null."""
    fields = [(n, t) for n, t in (f.strip().split(" ", 1) for f in FIT_SCHEMA.split(", "))]
    rows = fits.select(*(F.col(n) if n in fits.columns else F.lit(None).cast(t).alias(n) for n, t in fields))
    rows = rows.withColumns({"delSize": F.col("reduction_percent").cast("int"), "k": F.size("centroids")})
    rows = rows.repartition(_writers(rows))
    rows.write.mode("overwrite").partitionBy("delSize", "k").options(**BY_TASKS).option("maxRecordsPerFile", 1).json(path)


def fit_stem(tag: str, k: Column, size: Column, position: Column, kind: str) -> Column:
    return F.format_string(f"{tag}_{kind}_k%d_delSize%d_delPosP%d", k.cast("int"), size.cast("int"), position.cast("int"))


def fit_paths(grid: DataFrame, parent: str, tag: str) -> DataFrame:
    """Adds the paths of each fit's metadata, centroids and labels; nothing is created."""
    k, size, at = F.col("k"), F.col("del_size"), F.col("position")
    base = F.format_string(f"{parent}/{tag}/delSize_%d/k_%d", size.cast("int"), k.cast("int"))
    path = lambda kind, folder, ending: F.concat(base, F.lit(folder), fit_stem(tag, k, size, at, kind), F.lit(ending))
    return grid.withColumns({"meta": path("meta", "/", ".json"), "centroids": path("centroids", "/centroids/", ".npy"), "labels": path("labels", "/labels/", ".npy")})


def labels_path(meta: Column) -> Column:
    """Where the labels of a fit are, from its metadata's path; null for other files."""
    folder, name = F.regexp_extract(meta, r"^(.*)/[^/]*$", 1), F.substring_index(meta, "/", -1)
    return F.when(name.contains("_meta_") & name.endswith(".json"), F.concat(folder, F.lit("/labels/"), F.replace(F.replace(name, F.lit("_meta_"), F.lit("_labels_")), F.lit(".json"), F.lit(".npy"))))


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    """Rows (centroid, values) of a fit's JSON document, or of a ``.npy`` file (the source must be registered)."""
    if not path.endswith(".npy"):
        rows = spark.read.json(path, schema="centroids array<array<double>>", multiLine=True).where("centroids is not null")
        return rows.select(F.posexplode("centroids").alias("centroid", "values"))
    return spark.read.format("npy").load(path).select(F.col("row_index").cast("int").alias("centroid"), "values")


def write_centroid_results(results: DataFrame, features: Sequence[str], path: str) -> None:
    """One document: the features' names, and each centroid's normalised, physical and max-scaled values."""
    names = ("centroid", "feature_val_zscored", "feature_val_uf", "feature_val_nmax")
    one = results.agg(F.array_sort(F.collect_list(F.struct(*names))).alias("centroids"))
    _one_text(one, F.to_json(F.struct(F.array(*map(F.lit, features)).alias("feature_labels"), "centroids")), path)


def read_centroid_results(spark: SparkSession, path: str) -> DataFrame:
    kind = "feature_labels array<string>, centroids array<struct<centroid:int,feature_val_zscored:array<double>,feature_val_uf:array<double>,feature_val_nmax:array<double>>>"
    return spark.read.json(path, schema=kind, multiLine=True).select(F.explode("centroids").alias("c")).select("c.*")


def write_durations(summary: DataFrame, path: str, label: str = "label", **settings: object) -> None:
    """One document: each prototype's summary under its number, and under ``_global`` the maxima and settings."""
    own = [c for c in summary.columns if c != label]
    entry = F.concat(F.lit('"'), F.col(label).cast("string"), F.lit('":'), F.to_json(F.struct(*own), {"ignoreNullFields": "false"}))
    one = summary.agg(
        F.array_join(F.array_sort(F.collect_list(F.struct(F.col(label).alias("k"), entry.alias("e"))))["e"], ",").alias("all"),
        F.to_json(F.struct(
            F.max("mean_ms").alias("dur_max_mean_of_means_ms"), F.max("median_ms").alias("dur_max_median_of_medians_ms"),
            *(F.lit(v).alias(n) for n, v in settings.items()),
        )).alias("max"),
    )
    _one_text(one, F.concat(F.lit("{"), F.col("all"), F.lit(',"_global":'), F.col("max"), F.lit("}")), path)


def read_durations(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Rows (label, fields) of a saved document, without its ``_global`` part."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<{fields}>>").alias("m"))
    rows = doc.select(F.explode("m").alias("label", "s")).where("label <> '_global'")
    return rows.select(F.col("label").cast("int").alias("label"), "s.*")


def read_duration_maxima(spark: SparkSession, path: str) -> DataFrame:
    kind = "dur_max_mean_of_means_ms:double,dur_max_median_of_medians_ms:double"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<{kind}>>").alias("m"))
    return doc.select(F.element_at("m", "_global").alias("g")).select("g.*")


_CLUSTER = "raw_id:int,display_id:int,category:string,short_label:string,description:string"


def write_cluster_map(cluster_map: DataFrame, path: str) -> None:
    """One document: the number of clusters, and the clusters in display order."""
    texts = {c: (F.coalesce(c, F.lit("")) if c in cluster_map.columns else F.lit("")) for c in ("short_label", "description")}
    rows = cluster_map.select("raw_id", F.col("display_id").cast("int").alias("display_id"), "category", *(x.alias(c) for c, x in texts.items()))
    entry = F.struct("display_id", F.struct("raw_id", "display_id", "category", "short_label", "description").alias("c"))
    one = rows.agg(F.count(F.lit(1)).alias("k"), F.array_sort(F.collect_list(entry))["c"].alias("clusters"))
    _one_text(one, F.to_json(F.struct("k", "clusters")), path)


def read_cluster_map(spark: SparkSession, path: str) -> DataFrame:
    """Rows (raw_id, display_id, category, short_label, description); absent texts are empty."""
    doc = spark.read.json(path, schema=f"k int, clusters array<struct<{_CLUSTER}>>", multiLine=True)
    rows = doc.select(F.explode("clusters").alias("c")).select("c.*")
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("short_label", "description")})


#: The columns of a plan.
PLAN = (
    "video_path", "video_stem", "row_key", "match_method", "investigator_initials", "female_identifier", "background_strain",
    "female_tank", "target_gene", "sgrna", "transgene", "fert_date", "fert_date_raw", "exp_date", "seq_folder",
    "occupied_wells", "n_occupied", "is_gradient", "arena_role", "notes",
)


def write_plan(plan: DataFrame, path: str) -> None:
    """The plan's columns as text; what is missing is empty."""
    columns = [(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in plan.columns else F.lit("")).alias(c) for c in PLAN]
    plan.select(*columns).write.mode("overwrite").csv(path, header=True, emptyValue="", escape='"')


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in PLAN), escape='"', multiLine=True)
    return rows.na.fill("")


#: The columns of a plate's metadata table.
LAYOUT = ("well_number", "investigator_id", "experiment_type_id", "well_type_ids", "tadpole_type_ids")


def write_layouts(layouts: DataFrame, path: str) -> None:
    """Rows (video_stem and the metadata table's columns) as one CSV a video; blank wells have empty fields."""
    rows = layouts.select("video_stem", *LAYOUT).repartition(_writers(layouts), "video_stem").sortWithinPartitions("video_stem", "well_number")
    if at := video_files.mounted(path):
        video_files.write(rows.select("video_stem", F.to_csv(F.struct(*LAYOUT)).alias("line")), at, ",".join(LAYOUT))
    else:  # Spark's writer and reader keep the files' names on the driver
        rows.write.mode("overwrite").partitionBy("video_stem").options(**BY_TASKS).csv(path, header=True)


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} int" for c in LAYOUT)
    if at := video_files.mounted(path):
        lines = video_files.read(spark, at, 4 * spark.sparkContext.defaultParallelism)
        return lines.select(F.from_csv("line", schema).alias("r"), "video_stem").select("r.*", "video_stem")
    return spark.read.csv(path, header=True, schema=f"{schema}, video_stem string")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Video metadata from ``{name: {...}}`` documents: rows (name, camera, fps, date_time, median_well_radius_pixels, real_well_diameter_mm)."""
    kind = "camera:string,fps:double,date:string,time:string,median_well_radius_pixels:double,real_well_diameter_mm:double"
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,struct<{kind}>>")).alias("name", "v"))
    at = F.try_to_timestamp(F.concat_ws(" ", "v.date", "v.time"), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return doc.select("name", "v.camera", "v.fps", at.alias("date_time"), "v.median_well_radius_pixels", "v.real_well_diameter_mm")


def write_metadata(videos: DataFrame, path: str) -> None:
    """The same documents: one object of all videos, times padded to microseconds."""
    body = F.struct(
        "camera", "fps", F.date_format("date_time", "yyyy-MM-dd").alias("date"), F.date_format("date_time", "HH:mm:ss.SSSSSS").alias("time"),
        "median_well_radius_pixels", "real_well_diameter_mm",
    )
    one = videos.agg(F.map_from_entries(F.collect_list(F.struct("name", body))).alias("m"))
    _one_text(one, F.to_json("m"), path)


def write_geometry(circles: DataFrame, path: str) -> None:
    """Rows (stem, well, cx, cy, radius) as ``{stem: {well: [cx, cy, r]}}``."""
    wells = circles.groupBy("stem").agg(F.map_from_entries(F.collect_list(F.struct(F.col("well").cast("string"), F.array("cx", "cy", "radius")))).alias("w"))
    _one_text(wells.agg(F.map_from_entries(F.collect_list(F.struct("stem", "w"))).alias("m")), F.to_json("m"), path)


def read_geometry(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,array<double>>>")).alias("stem", "w"))
    rows = doc.select("stem", F.explode("w").alias("well", "c"))
    return rows.select("stem", F.col("well").cast("int").alias("well"), F.col("c")[0].alias("cx"), F.col("c")[1].alias("cy"), F.col("c")[2].alias("radius"))


def labelled_csv(spark: SparkSession, paths: Sequence[str], schema: str, needed: Sequence[str] = ("trial_id", "well_number", "well_type_id")) -> DataFrame:
    """Several CSV files one after another; the needed columns must be among them."""
    df = spark.read.csv(list(paths), header=True, schema=schema)
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise KeyError(f"the tables lack {missing}")
    return df


#: Folders of results by purpose.
RESULTS = {
    "figures_centroids": "figures/centroids", "figures_proportions": "figures/proportions", "figures_velocity": "figures/velocity",
    "figures_markov_chain": "figures/markov_chain", "figures_summary": "figures/summary", "stats": "stats", "data": "data",
}


def results(base: str) -> dict[str, str]:
    """Paths of the results' folders; Spark's writers create them."""
    return {purpose: f"{base.rstrip('/')}/{folder}" for purpose, folder in RESULTS.items()}
