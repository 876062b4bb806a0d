"""Transactions over tables, plan commits, label files, sheets and densities."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethoflow.operators import density, ingest
from ethoflow.schemas import TABLES
from ethoflow.sources import arrays, ingested, label_files
from ethoflow.sources.store import Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "db"), TABLES | {"plate_layout": ingested.LAYOUT_SCHEMA, "t": "a int, b string"})


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_nothing_is_seen_before_the_commit(spark, store):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    first = store.begin()
    first.put("t", "one", df)
    assert rows(store.read("t")) == [] and store.parts("t") == []
    first.commit()
    assert rows(store.read("t")) == [(1, "x")]
    lost = store.begin()
    lost.put("t", "one", df.withColumn("a", F.lit(5)))
    lost.put("t", "two", df)
    assert rows(store.read("t")) == [(1, "x")]  # a failure between tables leaves the old state
    other = store.begin()
    other.put("t", "two", df.withColumn("b", F.lit("y")))
    other.commit()
    with pytest.raises(RuntimeError):
        lost.commit()  # someone else was faster
    assert rows(store.read("t")) == [(1, "x"), (1, "y")]
    again = store.begin()
    again.put("t", "two", df.withColumn("a", F.lit(7)))
    again.drop("t", "one")
    held = store.read("t")
    again.commit()
    assert rows(store.read("t")) == [(7, "x")] and rows(held) == [(1, "x"), (1, "y")]


PLAN = "video_stem string, video_path string, investigator_initials string, female_identifier string, background_strain string, female_tank string, seq_folder string, transgene string, fert_date string, occupied_wells string, is_gradient string"


def test_a_plan_committed_twice_changes_nothing(spark, store):
    plan = spark.createDataFrame([
        ("v1", "v1.mp4", "cb", "A", "wt", "", "s1", "ND2", "2024-02-03", "1-3", "0"), ("v2", "v2.mp4", "CB", "A", "wt", "T2", "", "ND2", "2024-02-03", "2", "0"),
        ("v3", "v3.mp4", "XY", "B", "wt", "T3", "", "ND2", "31/11/24", "24", "0"), ("v4", "v4.mp4", "XY", "B", "wt", "", "", "", "", "1", "0"), ("v5", "v5.mp4", "XY", "B", "wt", "", "", "ND2", "", "1", "1"),
    ], PLAN)
    people = spark.createDataFrame([(4, "Christine", "Bar"), (9, "CB", "")], TABLES["investigator"])
    t = store.begin()
    t.put("investigator", "known", people)
    t.commit()
    layout = ingested.commit_plan(store, plan)
    got = {r.video_stem: (r.group, r.person, r.n) for r in layout.groupBy("video_stem").agg(F.max("tadpole_type_ids").alias("group"), F.max("investigator_id").alias("person"), F.count("tadpole_type_ids").alias("n")).collect()}
    assert got == {"v1": (1, 4, 3), "v2": (1, 4, 1), "v3": (2, 10, 1)}
    assert [tuple(r) for r in store.read("frog").select("frog_id", "female_tank", "female_identifier").orderBy("frog_id").collect()] == [(1, None, "A"), (2, "T3", "B")]
    assert store.read("tadpole_group").where("fertilisation_date is null").select("tadpole_group_id", "mother_id").collect() == [(2, 2)]
    tables = ("frog", "tadpole_group", "investigator", "well_type", "plate_layout")
    before = {n: rows(store.read(n).na.fill("").na.fill(-1)) for n in tables}
    ingested.commit_plan(store, plan)
    assert {n: rows(store.read(n).na.fill("").na.fill(-1)) for n in tables} == before
    assert len(before["well_type"]) == 1


def test_a_video_ingested_again_is_replaced_wherever_it_was(spark, store):
    layout = spark.createDataFrame([(v, w, 1, 7, 1 if w < 2 else None, 5 if w < 2 else None) for v in ("a", "b") for w in range(4)], ingested.LAYOUT_SCHEMA)
    videos = spark.createDataFrame([("a.mp4", 1, 50.0), ("b.mp4", 1, 50.0)], "filename string, series_id int, fps double")
    tracks = spark.createDataFrame([(f"{v}.mp4", w, f, float(f), 0.0, 0.0, 1.0 * f, 2.0) for v in "ab" for w in (1, 2, 3) for f in range(4)], "filename string, well_number int, frame_number int, thrust_mm_s double, slip_mm_s double, yaw_rad_s double, tail_base_x double, tail_base_y double")
    ingested.ingest_videos(store, "one", videos, layout, tracks)
    ids = rows(store.read("time_series"))
    assert len(ids) == 2 * 2 * 4 and store.read("trajectory").count() == 16 and store.read("posture").count() == 0
    ingested.ingest_videos(store, "one", videos, layout, tracks)
    assert rows(store.read("time_series")) == ids
    ingested.ingest_videos(store, "two", videos.where("filename = 'b.mp4'"), layout, tracks.where("frame_number < 2"))
    assert rows(store.read("video").select("video_id", "filename")) == [(1, "a.mp4"), (2, "b.mp4")]
    assert rows(store.read("time_series").groupBy((F.col("trial_id") / 32).cast("int")).count()) == [(1, 8), (2, 4)]
    assert store.read("velocity").count() == 12 and store.read("trajectory").count() == 12


def test_npy_files_appear_whole_or_not_at_all(spark, tmp_path):
    at = str(tmp_path / "x.npy")
    df = spark.range(1000).select(F.col("id").alias("row_index"), F.array(F.col("id") * 1.0, F.lit(2.0)).alias("values")).repartition(7, "row_index")
    arrays.write_npy(df, at, 1000, 2)
    want = np.stack([np.arange(1000.0), np.full(1000, 2.0)], axis=1)
    seen = lambda: [f for f in os.listdir(tmp_path) if not f.startswith(".")]  # noqa: E731  a task that outlives a failure may leave a hidden file
    assert (np.load(at) == want).all() and os.listdir(tmp_path) == ["x.npy"]
    for bad in (df.where("row_index > 0"), df.withColumn("row_index", F.col("row_index") + 1), df.withColumn("values", F.array(F.lit(1.0)))):
        with pytest.raises(Exception):  # noqa: B017
            arrays.write_npy(bad, at, 1000, 2)
        assert (np.load(at) == want).all() and seen() == ["x.npy"]
    arrays.write_npy(df.where("false"), str(tmp_path / "none.npy"), 0, 2)
    assert np.load(tmp_path / "none.npy").shape == (0, 2)


def test_feature_files_to_label_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 4))
    x[3, 1] = np.nan
    np.save(tmp_path / "x.npy", x)
    mu, sigma, c = x[4:].mean(axis=0), x[4:].std(axis=0), rng.normal(size=(3, 2))
    np.save(tmp_path / "c.npy", c)
    (tmp_path / "s.csv").write_text("feature_idx,mu,sigma\n" + "".join(f"{i},{float(m)!r},{float(s)!r}\n" for i, (m, s) in enumerate(zip(mu, sigma))))
    given = [spark, str(tmp_path / "x.npy"), str(tmp_path / "s.csv"), str(tmp_path / "c.npy")]
    assert label_files.assign_file(*given, str(tmp_path / "l.npy"), [1, 3]) == 50
    z = ((x - mu) / sigma)[:, [1, 3]]
    want = np.where(np.isfinite(z).all(axis=1), ((z[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1), -1)
    got = np.load(tmp_path / "l.npy")
    assert got.dtype == np.int32 and (got == want).all() and got[3] == -1
    ids = spark.range(50).select(F.col("id").alias("row_index"), (F.col("id") * 10).alias("time_series_id"))
    assert label_files.assign_file(*given, str(tmp_path / "both.npy"), [1, 3], append_to=str(tmp_path / "l.npy"), ids=ids) == 100
    assert (np.load(tmp_path / "both.npy") == np.concatenate([want, want])).all()
    assert rows(spark.read.parquet(str(tmp_path / "both.npy.ids")))[0] == (50, 0)
    with pytest.raises(ValueError):
        label_files.assign_file(*given, str(tmp_path / "l.npy"), [1, 2, 3])


def test_density_is_near_the_exact_one(spark):
    rng = np.random.default_rng(1)
    x = np.exp(rng.normal(3, 0.4, 300))
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("few", 1.0), ("few", 2.0), ("same", 5.0), ("same", 5.0), ("same", 5.0), ("a", None), ("a", -1.0)], "k string, v double")
    got = density.kernel_density(df, "v", ("k",), log=True).orderBy("point").collect()
    assert {r.k for r in got} == {"a"} and len(got) == 200 and max(r.relative for r in got) == 1
    lx = np.log10(x)
    at, h = np.log10([r.x for r in got]), lx.std(ddof=1) * len(lx) ** -0.2
    want = np.exp(-(((at[:, None] - lx[None]) / h) ** 2) / 2).sum(axis=1) / (len(lx) * h * math.sqrt(2 * math.pi))
    assert np.abs([r.density for r in got] - want).max() < 0.01 * want.max()


def test_boxes(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", 7.0)], "k string, v double")
    got = {r.k: tuple(r)[1:] for r in density.box_statistics(df, "v", ("k",)).collect()}
    assert got == {"a": (5, 2.0, 3.0, 4.0, 1.0, 4.0, 1), "b": (1, 7.0, 7.0, 7.0, 7.0, 7.0, 0)}


def test_equal_series_are_met_once(spark):
    """Series that no request can tell apart are one row before they meet the requests."""
    series = spark.createDataFrame([(i, 1, 2, None) for i in (9, 4, 7)] + [(3, 1, 2, None)], "series_id long, experiment_type_id int, investigator_id int, experiment_date date")
    own = spark.createDataFrame([(i, a) for i in (9, 4, 7) for a in (5, 6)] + [(3, 5)], "series_id long, attribute_id int")
    wanted = spark.createDataFrame([(1, 1, 2, None, [6, 5]), (2, 1, 2, None, [5]), (3, 1, 1, None, [5])], "request long, experiment_type_id int, investigator_id int, experiment_date date, attribute_ids array<int>")
    got = ingest.series_by_attributes(series, own, wanted)
    assert sorted(map(tuple, got.collect())) == [(1, 4), (2, 3), (3, None)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 3
