"""Feature files to label files in one call, with the clustering's own statistics and centroids."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethoflow.sources import arrays, saved


def labelled(rows: DataFrame, mu: np.ndarray, sigma: np.ndarray, centroids: np.ndarray, columns: Sequence[int]) -> DataFrame:
    """Rows (row_index, label) of rows (row_index, values): normalised with saved statistics, then the nearest centroid.

    A row with a missing or infinite clustered feature gets -1, and so does every row where a feature's deviation is 0 or unknown.
    """
    chosen = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("values").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[:, chosen]
            with np.errstate(all="ignore"):
                z = (x - mu[chosen]) / sigma[chosen]
            good = np.isfinite(z).all(axis=1)
            label = np.full(len(z), -1, dtype=np.int32)
            label[good] = ((centroids * centroids).sum(axis=1) - 2 * z[good] @ centroids.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("row_index"), pa.array(label)], names=["row_index", "label"])

    return rows.mapInArrow(run, "row_index long, label int")


def assign_file(
    spark: SparkSession, features: str, stats: str, centroids: str, out: str, columns: Sequence[int] | None = None, append_to: str | None = None,
    ids: DataFrame | None = None,
) -> int:
    """Labels every row of a ``.npy`` feature file and writes the label file; returns the number of rows in it.

    stats: the clustering's saved mu and sigma; centroids: its ``.json`` or ``.npy``. append_to: an earlier label file of
    the same clustering, whose labels come first. ids: rows (row_index, ...) of the new rows, written beside the labels as ``<out>.ids``,
    with the numbers that the rows have in the label file.
    """
    arrays.register(spark)
    n, width = arrays.shape_of(features)
    saved_stats = sorted(tuple(r) for r in saved.read_mu_sigma(spark, stats).collect())  # a row a feature
    mu, sigma = (np.array([r[i] for r in saved_stats], dtype=float) for i in (1, 2))
    if len(mu) != width:
        raise ValueError(f"{width} features, but statistics of {len(mu)}")
    found = saved.read_centroids(spark, centroids).orderBy("centroid").collect()  # k rows
    c = np.array([r["values"] for r in found], dtype=float)
    chosen = list(range(width)) if columns is None else list(columns)
    if c.ndim != 2 or c.shape[1] != len(chosen):
        raise ValueError(f"centroids of {c.shape[1:]} features, but {len(chosen)} are chosen")
    before = arrays.shape_of(append_to)[0] if append_to else 0
    rows = labelled(spark.read.format("npy").load(features), mu, sigma, c, chosen).withColumn("row_index", F.col("row_index") + before)
    if append_to:
        old = spark.read.format("npy").load(append_to).select("row_index", F.get("values", F.lit(0)).cast("int").alias("label"))
        rows = old.unionAll(rows)
    arrays.write_npy(rows, out, before + n, dtype="<i4")
    if ids is not None:
        ids.withColumn("row_index", F.col("row_index") + before).write.mode("overwrite").parquet(f"{out}.ids")
    return before + n
