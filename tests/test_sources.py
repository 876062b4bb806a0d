import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethoflow import schemas
from ethoflow.sources import arrays, files, saved
from ethoflow.streaming import frames as live


def test_npy_and_sqlite(spark, tmp_path):
    arrays.register(spark)
    x = np.arange(12.0).reshape(6, 2)
    np.save(tmp_path / "x.npy", x)
    got = spark.read.format("npy").option("block", "4").load(str(tmp_path / "x.npy")).orderBy("row_index").collect()
    assert [r.values for r in got] == x.tolist()
    db = sqlite3.connect(tmp_path / "a.db")
    db.execute("create table t(trial_id int, v real)")
    db.executemany("insert into t values(?, ?)", [(i, i / 2) for i in range(10)])
    db.commit()
    got = spark.read.format("sqlite").schema("trial_id int, v double").option("query", "select * from t").option("key", "trial_id").option("parts", "3").load(str(tmp_path / "a.db"))
    assert got.count() == 10 and got.agg(F.sum("v")).first()[0] == 22.5


def test_fit_files(spark, tmp_path):
    good = {"centroids": [[1.0, 2.0], [3.0, 4.0]], "reduction_percent": 10.0, "cut_position_percent": 2.0, "calinski_harabasz_score": 100.0}
    (tmp_path / "k_2").mkdir()
    (tmp_path / "k_2/a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text("not json")
    (tmp_path / "c.json").write_text(json.dumps({"centroids": [[1.0]]}))
    got = files.fits(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0].k == 2 and got[0].calinski_harabasz_score == 100


def test_tables(spark, tmp_path):
    schemas.create(spark, str(tmp_path))
    assert schemas.read(spark, str(tmp_path), "body_part").count() == 8
    assert schemas.read(spark, str(tmp_path), "trial").count() == 0
    (tmp_path / "t.csv").write_text("trial_id,label\n1,2\n")
    assert [tuple(r) for r in files.table(spark, str(tmp_path / "t.csv"), "trial_id int, label int").collect()] == [(1, 2)]
    with pytest.raises(ValueError):
        files.table(spark, "x.csv")


def test_live_bouts(spark, tmp_path):
    rows = [(1, i, x) for i, x in enumerate([0, 0, 1, 1, 1, 2])]
    spark.createDataFrame(rows, "trial_id long, frame_number long, label int").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = live.live_bouts(spark.readStream.schema("trial_id long, frame_number long, label int").parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("bouts_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.label, r.n_frames) for r in spark.table("bouts_out").collect()) == [(0, 2), (1, 3)]


def test_many_files_are_written_by_many_tasks(spark, tmp_path):
    """A file for each fit and video, although the rows come in one partition."""
    fits = spark.range(0, 24, 1, 1).select(F.array(F.array(F.lit(1.0)), F.array(F.lit(2.0))).alias("centroids"), F.lit(10.0).alias("reduction_percent"), F.col("id").cast("double").alias("cut_position_percent"))
    saved.write_fits(fits, str(tmp_path / "fits"))
    got = sorted((tmp_path / "fits").glob("*/*/*.json"))
    assert len(got) == 24 and len({p.name[:10] for p in got}) > 4
    assert sorted(r.cut_position_percent for r in files.fits(spark, str(tmp_path / "fits")).collect()) == [float(i) for i in range(24)]
    wells = spark.range(0, 48, 1, 1).select(F.concat(F.lit("v"), F.expr("id div 2").cast("string")).alias("video_stem"), (F.col("id") % 2).cast("int").alias("well_number"), *(F.lit(1).alias(c) for c in saved.LAYOUT[1:]))
    saved.write_layouts(wells, str(tmp_path / "layouts"))
    got = sorted((tmp_path / "layouts").glob("*/*.csv"))
    assert len(got) == 24 and len({p.name[:10] for p in got}) > 4
    assert saved.read_layouts(spark, str(tmp_path / "layouts")).count() == 48


def test_the_driver_lists_no_layout_files(spark, tmp_path):
    """Tasks list and read the files; folders, names and fields are those that Spark's own writer and reader have."""
    stems = ["v1", "a b", "x=1%", "c:d", "e/f", "Stra\u00dfe", "{z}[0]^", "q'\"", "w\\n?*#", "", None]
    rows = [(stem, w, 3, 2, 1 if w else None, None) for stem in stems for w in (1, 0)]
    df = spark.createDataFrame(rows, "video_stem string, " + ", ".join(f"{c} int" for c in saved.LAYOUT))
    ours, theirs = str(tmp_path / "ours"), str(tmp_path / "theirs")
    saved.write_layouts(df, ours)
    df.sortWithinPartitions("video_stem", "well_number").write.partitionBy("video_stem").csv(theirs, header=True)
    assert sorted(p.name for p in (tmp_path / "ours").iterdir() if p.is_dir()) == sorted(p.name for p in (tmp_path / "theirs").iterdir() if p.is_dir())
    want = sorted(map(str, ((stem or None, *r) for stem, *r in rows)))
    kind = ", ".join(f"{c} int" for c in saved.LAYOUT) + ", video_stem string"
    got = [saved.read_layouts(spark, ours), saved.read_layouts(spark, "file://" + theirs), spark.read.csv(ours, header=True, schema=kind)]
    assert [sorted(map(str, map(tuple, g.select("video_stem", *saved.LAYOUT).collect()))) for g in got] == [want] * 3
    assert got[0].inputFiles() == [] and (tmp_path / "ours" / "_SUCCESS").exists()
    saved.write_layouts(df.where("video_stem = 'v1'"), ours)
    assert saved.read_layouts(spark, ours).count() == 2
