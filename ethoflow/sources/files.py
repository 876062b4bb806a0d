"""Readers and writers over Spark's own formats, with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(spark: SparkSession, paths: str | Sequence[str], schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One or more CSV files with a header; only the named columns are parsed."""
    df = spark.read.csv([paths] if isinstance(paths, str) else list(paths), header=True, schema=schema, enforceSchema=False)
    return df.select(*columns) if columns else df


def table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet or CSV by the path's ending."""
    if path.endswith(".csv"):
        if schema is None:
            raise ValueError("a CSV file needs a schema")
        return csv(spark, path, schema)
    return spark.read.parquet(path)


def fits(spark: SparkSession, root: str) -> DataFrame:
    """Fit metadata from JSON files in a tree: (path, k, reduction_percent, cut_position_percent, scores, centroids).

    Files that are not JSON objects with two or more centroids of one width are left out.
    """
    schema = "centroids array<array<double>>, reduction_percent double, cut_position_percent double, calinski_harabasz_score double, inertia double, duration_s double"
    df = spark.read.schema(schema).json(root, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json", mode="PERMISSIVE")
    df = df.withColumn("path", F.col("_metadata.file_path")).where(F.size("centroids") >= 2)
    return df.where(F.size(F.array_distinct(F.transform("centroids", F.size))) == 1).withColumn("k", F.size("centroids"))


def geometry(spark: SparkSession, path: str) -> DataFrame:
    """Circles of an annotation file: (stem, cx, cy, radius) from its images and annotations."""
    doc = spark.read.json(path, multiLine=True, schema="images array<struct<id:long,file_name:string>>, annotations array<struct<image_id:long,bbox:array<double>,attributes:struct<shape:string>>>")
    a = doc.select(F.explode("annotations").alias("a")).where("a.attributes.shape = 'circle'").select("a.image_id", F.col("a.bbox").alias("b"))
    i = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), F.regexp_replace("i.file_name", r"\.[^.]*$", "").alias("stem"))
    return a.join(i, "image_id").select("stem", (F.get("b", F.lit(0)) + F.get("b", F.lit(2)) / 2).alias("cx"), (F.get("b", F.lit(1)) + F.get("b", F.lit(3)) / 2).alias("cy"), ((F.get("b", F.lit(2)) + F.get("b", F.lit(3))) / 4).alias("radius"))


def listing(spark: SparkSession, root: str, pattern: str = "*.mp4") -> DataFrame:
    """Paths in a tree without hidden files; contents are not read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return df.select("path").where(~F.col("path").rlike(r"/\.[^/]*$"))


def append_labels(df: DataFrame, path: str, batch: int) -> None:
    """Adds a batch of labelled rows; the batch number keeps the order of additions."""
    df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(path)


def replace(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Replaces only the partitions that the rows belong to."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def merged_maps(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keyed values where the new ones win, as a full outer join."""
    return old.select(key, F.col(value).alias("__old")).join(new.select(key, F.col(value).alias("__new")), key, "full").select(key, F.coalesce("__new", "__old").alias(value))
