"""Plates, videos and identities: matching, get-or-create and rewriting of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethoflow.functions.text import plain_name, prefix_key, tail_key
from ethoflow.operators.ranges import row_index


def _keys_by(plates: DataFrame, key: Column, name: str) -> DataFrame:
    """Per normalised name: how many plates it leads to, and the first of them."""
    rows = plates.select("key", F.explode("videos").alias("v")).where("v is not null").select("key", key.alias(name)).where(F.col(name).isNotNull())
    return rows.groupBy(name).agg(F.count_distinct("key").alias(f"{name}_n"), F.min("key").alias(f"{name}_key"))


#: (name, key) of each tier of video matching, in the order in which they are tried.
TIERS = (("exact", plain_name), ("tail", tail_key), ("prefix", prefix_key))


def matched_videos(videos: DataFrame, plates: DataFrame) -> DataFrame:
    """Rows (filename, key, status): the plain name, then the nine digits at its end, then what stands before the time.

    A tier decides only if it leads to exactly one plate; else the next is tried. Without a decision a name that is
    a plate's own is ``ambiguous``, others are ``unmatched``. plates: key and videos (an array of names).
    """
    rows = videos.select("filename").distinct()
    for name, key in TIERS:
        rows = rows.withColumn(name, key(F.col("filename"))).join(_keys_by(plates, key(F.col("v")), name), name, "left")
    chosen = F.coalesce(*(F.when(F.col(f"{n}_n") == 1, F.struct(F.col(f"{n}_key").alias("key"), F.lit(n).alias("status"))) for n, _ in TIERS))
    none = F.when(F.col("exact_n") > 1, "ambiguous").otherwise("unmatched")
    return rows.withColumn("c", chosen).select("filename", F.col("c.key").alias("key"), F.coalesce("c.status", none).alias("status"))


def candidate_keys(videos: DataFrame, plates: DataFrame) -> DataFrame:
    """Rows (filename, keys): the plates that any tier leads to, sorted; what to choose from where no tier decides."""
    return with_candidates(videos.select("filename").distinct(), plates, F.lit(True))


def with_candidates(rows: DataFrame, plates: DataFrame, wanted: Column) -> DataFrame:
    """Adds the sorted ``keys`` of the plates that any tier leads to, none where they are not wanted.

    Plates are listed once for each name, so videos and plates of one name never meet pair by pair; where nothing reads
    ``keys``, Spark leaves the joins out.
    """
    names, columns = plates.select("key", F.explode("videos").alias("v")).where("v is not null"), rows.columns
    for name, key in TIERS:
        at, keys = f"__{name}", f"__{name}_keys"
        lists = names.select("key", key(F.col("v")).alias(at)).where(F.col(at).isNotNull()).groupBy(at).agg(F.collect_set("key").alias(keys))
        # Rows without a name get one that no plate has, each its own, so that they do not meet in one task.
        rows = rows.withColumn(at, F.coalesce(F.when(wanted, key(F.col("filename"))), F.concat(F.lit("#"), F.col("filename")))).join(lists, at, "left")
    none = F.array().cast("array<string>")
    keys = F.array_sort(F.array_distinct(F.concat(*(F.coalesce(f"__{name}_keys", none) for name, _ in TIERS))))
    return rows.select(*columns, keys.alias("keys"))


def get_or_create(table: DataFrame, wanted: DataFrame, keys: Sequence[str], id_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, wanted rows with ids): known keys keep their id, new ones get the next.

    New entities are numbered in the order of their keys, dealt to ranges.
    """
    new = wanted.select(*keys).distinct().alias("w").join(table.alias("t"), [F.col(f"w.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys], "left_anti")
    top = table.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top"))
    placed = row_index(new, keys, "__n").crossJoin(F.broadcast(top))  # one row
    numbered = placed.withColumn(id_col, (F.col("__top") + F.col("__n") + 1).cast(dict(table.dtypes)[id_col])).drop("__top", "__n")
    known = table.groupBy(*keys).agg(F.min(id_col).alias(id_col)).unionByName(numbered)
    ids = wanted.alias("w").join(known.alias("k"), [F.col(f"w.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys]).select("w.*", f"k.{id_col}")
    return numbered, ids


def looked_up(rows: DataFrame, table: DataFrame, key: str, value: str, default: object = -1) -> DataFrame:
    """Adds the value that a table has for each row's key, and the default for unknown keys."""
    return rows.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def updated(table: DataFrame, condition: Column, values: Mapping[str, object]) -> DataFrame:
    return table.withColumns({c: F.when(condition, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def without(table: DataFrame, condition: Column) -> DataFrame:
    return table.where(~F.coalesce(condition, F.lit(False)))


def without_video(tables: Mapping[str, DataFrame], filename: str) -> dict[str, DataFrame]:
    """All tables without a video, its trials and their frames; the series stays."""
    gone = tables["video"].where(F.col("filename") == filename).select("video_id")
    trials = tables["trial"].join(gone, "video_id", "left_semi").select("trial_id")
    frames = tables["time_series"].join(trials, "trial_id", "left_semi").select("time_series_id")
    out = dict(tables)
    for name, ids, key in (("video", gone, "video_id"), ("trial", trials, "trial_id"), ("time_series", frames, "time_series_id"), *((n, frames, "time_series_id") for n in ("velocity", "posture", "trajectory"))):
        out[name] = tables[name].join(ids, key, "left_anti")
    return out


def frame_ids(df: DataFrame, trial: str = "trial_id", frame: str = "frame_number") -> DataFrame:
    """A key that depends on trial and frame alone, so that it survives retries and reruns."""
    return df.withColumn("time_series_id", F.shiftleft(F.col(trial).cast("long"), 32) + F.col(frame).cast("long"))


def plate_layout(spark, occupied: DataFrame, series: Sequence[str] = ("investigator_id", "experiment_type_id", "well_type_id", "tadpole_group_id")) -> DataFrame:
    """24 rows, blank where a well is not occupied."""
    wells = spark.range(1, 25).select(F.col("id").cast("int").alias("well_number"))
    return wells.join(F.broadcast(occupied.select("well_number", *series)), "well_number", "left")


def missing_clips(videos: DataFrame, files: DataFrame, wells: int = 24) -> DataFrame:
    """(stem, well) pairs without a file; wells in names count from zero."""
    grid = videos.select("stem").distinct().withColumn("well", F.explode(F.sequence(F.lit(0), F.lit(wells - 1))))
    return grid.join(files.select("stem", "well").distinct(), ["stem", "well"], "left_anti")


def mapped_labels(df: DataFrame, cluster_map: DataFrame, label: str = "label") -> DataFrame:
    """Adds display id, category and short label; unknown labels show as ``C<label>``, ``unclassified``."""
    m = cluster_map.select(F.col("raw_id").alias(label), "display_id", "category", "short_label")
    out = df.join(m, label, "left")
    return out.withColumns({"category": F.coalesce("category", F.lit("unclassified")), "short_label": F.coalesce(F.nullif("short_label", F.lit("")), F.concat(F.lit("C"), F.col(label).cast("string")))})


def ordered_map(categories: DataFrame, by_category: bool = True) -> DataFrame:
    """Display ids from 0 by category and raw id, or by raw id: a dimension of at most hundreds of rows."""
    order = ("category", "raw_id") if by_category else ("raw_id",)
    return categories.withColumn("display_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1)


def identity_map(spark, k: int, category: str = "unclassified") -> DataFrame:
    """Rows (raw_id, display_id, category) where both ids are the same."""
    i = F.col("id").cast("int")
    return spark.range(k).select(i.alias("raw_id"), i.alias("display_id"), F.lit(category).alias("category"))


def short_labels(cluster_map: DataFrame, short: Column) -> DataFrame:
    """Adds ``<category's short name>.<number in the category>``, numbered in display order."""
    n = F.row_number().over(Window.partitionBy("category").orderBy("display_id"))
    return cluster_map.withColumn("short_label", F.concat(short, F.lit("."), n.cast("string")))


def agglomerated(df: DataFrame, groups: Sequence[tuple[str, Sequence[int]]], label: str = "label", out: str = "category") -> DataFrame:
    """Labels to named groups; the first group that lists a label counts, others stay null."""
    name = F.lit(None).cast("string")
    for g, members in reversed(list(groups)):
        name = F.when(F.col(label).isin(*members), g).otherwise(name)
    return df.withColumn(out, name)


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Foreign keys without a parent."""
    return child.where(F.col(key).isNotNull()).join(parent, key, "left_anti")


def paired(layouts: DataFrame, videos: DataFrame, key: str) -> DataFrame:
    """Rows (key, status): ``paired``, or which side lacks the other."""
    a, b = layouts.select(key, F.lit(True).alias("__a")), videos.select(key, F.lit(True).alias("__b"))
    status = F.when(F.col("__a").isNull(), "no layout").when(F.col("__b").isNull(), "no video").otherwise("paired")
    return a.join(b, key, "full").select(key, status.alias("status"))
