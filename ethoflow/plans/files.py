"""Queries that write result files and read them back, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ethoflow.catalog import query
from ethoflow.operators import cluster
from ethoflow.plans.fits import NAMES, indexed
from ethoflow.session import scratch_path
from ethoflow.sources import arrays, label_files, saved

#: The clustered features of the label files.
CHOSEN = [*range(0, 8), *range(20, 40)]


@query(f"""with v as (select row_number() over (order by vec_id) - 1 as i, vec_id, embedding::double[] as e, count(*) over () as n from embeddings),
u as (select i, j, x, avg(x) over (partition by j) as mu, stddev_pop(x) over (partition by j) as sigma from (select i, unnest(e) as x, generate_subscripts(e, 1) - 1 as j from v)),
z as (select i, list((x - mu) / sigma order by j) as z from u where j in {tuple(CHOSEN)} group by i),
c as (select i as c, z as m from z where i < 5),
l as (select i, arg_min(c, (d, c)) as label from (select z.i, c.c, list_distance(z, m) as d from z, c) group by i)
select (l.i + t.b * n)::bigint as row_index, label::int as label, case when t.b = 1 then vec_id end as vec_id from l join v on l.i = v.i, (values (0), (1)) t(b)""")
def label_file(spark, d):
    """Features, statistics and centroids to a label file, then a second batch appended; read back with its ids."""
    at = scratch_path(spark, "labels").removeprefix("file://")
    base = indexed(spark, d)
    rows, n = base.select(F.col("i").alias("row_index"), F.array(*NAMES).alias("values"), "vec_id"), base.count()
    arrays.write_npy(rows.select("row_index", "values"), f"{at}/features.npy", n, len(NAMES))
    stats = cluster.mu_sigma(base, NAMES)
    saved.write_mu_sigma(stats, f"file://{at}/mu_sigma")
    by = {r.feature_idx: (r.mu, r.sigma) for r in stats.collect()}
    first = rows.where("row_index < 5").orderBy("row_index").select("values").collect()
    centroids = [[(r[0][j] - by[j][0]) / by[j][1] for j in CHOSEN] for r in first]
    spark.createDataFrame([(centroids,)], "centroids array<array<double>>").coalesce(1).write.json(f"file://{at}/centroids")
    given = (f"{at}/features.npy", f"file://{at}/mu_sigma", f"file://{at}/centroids")
    label_files.assign_file(spark, *given, f"{at}/first.npy", CHOSEN)
    label_files.assign_file(spark, *given, f"{at}/both.npy", CHOSEN, append_to=f"{at}/first.npy", ids=rows.select("row_index", "vec_id"))
    labels = spark.read.format("npy").load(f"{at}/both.npy").select("row_index", F.get("values", F.lit(0)).cast("int").alias("label"))
    return labels.join(spark.read.parquet(f"file://{at}/both.npy.ids"), "row_index", "left")
