"""Hand-computed cases for the frame operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethoflow.functions import numeric, text
from ethoflow.functions.geometry import aligned, per_second, to_body_frame, with_body_axis, wrapped
from ethoflow.operators import bouts, clean, cluster, features, kinematics, markov, metadata, proportions, prototypes, sequence, stats

W = lambda: sequence.by(("trial_id",))


def col(df, *names):
    rows = df.select(*names).collect()
    return [r[0] if len(names) == 1 else tuple(r) for r in rows]


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


def eyes(spark, le, re, tb):
    return spark.createDataFrame([(*map(float, le), *map(float, re), *map(float, tb))], "left_eye_x double, left_eye_y double, right_eye_x double, right_eye_y double, tail_base_x double, tail_base_y double")


def test_body_axis(spark):
    r = with_body_axis(eyes(spark, (0, 0), (4, 2), (0, -10))).first()
    assert (r.frons_x, r.frons_y) == (2, 1)
    r = with_body_axis(eyes(spark, (0, 0), (3, 0), (0, 9))).first()
    assert (r.com_x, r.com_y) == (1, 3)


def test_velocity(spark):
    def track(rows, fps):
        df = spark.createDataFrame([(1, i, *map(float, r)) for i, r in enumerate(rows)], "trial_id int, frame_number int, com_x double, com_y double, yaw double")
        return col(features.velocity(df, fps=fps).orderBy("frame_number"), "thrust_mm_s", "slip_mm_s", "yaw_rad_s")

    assert track([(0, 0, 0), (2, 0, 0), (4, 0, 0)], 1.0) == [(0, 0, 0), (2, 0, 0), (2, 0, 0)]
    thrust, slip, _ = track([(0, 0, math.pi / 2), (2, 0, math.pi / 2)], 1.0)[1]
    assert thrust == pytest.approx(0, abs=1e-12) and slip == pytest.approx(-2)
    assert [r[2] for r in track([(0, 0, 0), (0, 0, 0.1), (0, 0, 0.2)], 10.0)] == pytest.approx([0, 1, 1])


def test_alignment_and_units(spark):
    r = aligned(with_body_axis(eyes(spark, (0, 0), (2, 0), (5, 5))), ("tail_base", "frons")).first()
    assert r.tail_base_aligned_x == pytest.approx(math.sqrt(41)) and r.tail_base_aligned_y == pytest.approx(0, abs=1e-12)
    assert (r.frons_aligned_x, r.frons_aligned_y) == (0, 0)
    assert one(spark, per_second(F.lit(10.0), 17, 34.0, 50)) == 250


def test_wrapped(spark):
    steps = [3.0, -3.0, 4.0, -4.0, math.pi, -math.pi, 0.0]
    unwrapped = [float(np.diff(np.unwrap([0, s]))[0]) for s in steps]
    got = col(spark.createDataFrame([(i, s) for i, s in enumerate(steps)], "i int, s double").orderBy("i").select(wrapped(F.col("s")).alias("x")), "x")
    assert got == pytest.approx(unwrapped)


def stream(spark, xs, trial=1):
    return spark.createDataFrame([(trial, i, None if x is None else float(x)) for i, x in enumerate(xs)], "trial_id int, frame_number int, x double")


def values(df, expr):
    return col(df.withColumn("v", expr).orderBy("trial_id", "frame_number"), "v")


def test_differences(spark):
    df = stream(spark, [1, 3, 6]).union(stream(spark, [5], 2))
    assert values(df, sequence.backward_difference("x", W())) == [0, 2, 3, 0]
    assert values(df, sequence.forward_difference("x", W())) == [2, 3, 3, 0]
    nan = values(stream(spark, [1, float("nan"), 6]), sequence.forward_difference("x", W()))
    assert all(math.isnan(x) for x in nan)
    assert values(df, sequence.gradient("x", W())) == [2, 2.5, 3, None]


def test_interpolation(spark):
    df = stream(spark, [None, 1, None, None, 4, None])
    want = [None, 1, 2, 3, 4, 4]
    assert values(df, sequence.interpolated(F.col("x"), W())) == want
    got = sequence.interpolate(df.withColumnRenamed("x", "y"), {"x": F.col("y")}, ("trial_id",))
    assert col(got.orderBy("frame_number"), "x") == want
    assert values(df, sequence.filled_forward(F.col("x"), W())) == [None, 1, 1, 1, 4, 4]


def labels(spark, xs, frames=None, animal=1):
    frames = frames or range(len(xs))
    return spark.createDataFrame([(animal, 1, int(f), int(x)) for f, x in zip(frames, xs)], "trial_id int, well_number int, frame_number int, label int")


def test_bouts(spark):
    seg = lambda df: sorted(col(bouts.segments(df, 1000.0), "label", "duration_ms"))
    assert seg(labels(spark, [0, 0, 1, 1, 1])) == [(0, 2), (1, 3)]
    assert seg(labels(spark, [0, 0]).union(labels(spark, [0, 0], animal=2))) == [(0, 2), (0, 2)]
    assert seg(labels(spark, [4, 4, 4, 4], [0, 1, 100, 101])) == [(4, 2), (4, 2)]
    assert seg(labels(spark, [])) == []


@pytest.mark.parametrize("before,minimum,after", [
    ([5, 5, 5, 22, 5, 5, 5], 2, [5] * 7), ([22, 5, 5, 5], 2, [5] * 4), ([5, 5, 5, 22, 22, 5, 5, 5], 2, [5, 5, 5, 22, 22, 5, 5, 5]), ([1, 2, 3], 1, [1, 2, 3]), ([1, 2, 3], 2, [1, 2, 3]),
])
def test_smoothing(spark, before, minimum, after):
    assert col(bouts.smoothed(labels(spark, before), minimum).orderBy("frame_number"), "label") == after


def test_smoothing_stays_inside_an_animal(spark):
    df = labels(spark, [5, 5, 7]).union(labels(spark, [7, 6, 6], animal=2))
    assert col(bouts.smoothed(df, 2).orderBy("trial_id", "frame_number"), "label") == [5, 5, 5, 6, 6, 6]


def test_animals_are_the_sample(spark):
    df = spark.createDataFrame([(3, t, w, float(d)) for t, w, ds in ((1, 1, (2, 4)), (1, 2, (6, 8)), (2, 1, (3, 5))) for d in ds], "label int, trial_id int, well_number int, duration_ms double")
    r = bouts.across_animals(bouts.per_animal(df)).first()
    assert (r.n_animals, r.n_bouts) == (3, 6) and r.sem_ms > 0
    r = bouts.one_animal(spark.createDataFrame([(1, float(d)) for d in (10, 20, 30)], "label int, duration_ms double")).first()
    assert (r.mean_ms, r.median_ms, r.q1_ms, r.q3_ms) == (20, 20, 15, 25)
    d = spark.createDataFrame([(20.0,), (40.0,), (20.0,)], "duration_ms double")
    assert col(bouts.long_enough(d, 2, 50.0), "duration_ms") == [40]
    empty = bouts.across_animals(bouts.per_animal(df).where("false"), spark.range(2).select(F.col("id").cast("int").alias("label")))
    assert [tuple(r)[1:3] for r in empty.collect()] == [(0, 0), (0, 0)]


def test_proportions(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (1, 0), (1, 1), (2, 0), (2, 2)], "trial_id int, label int")
    assert sorted(map(tuple, proportions.wide(df, range(3)).collect())) == [(1, 0.75, 0.25, 0), (2, 0.5, 0, 0.5)]
    assert len(proportions.wide(df, range(5)).columns) == 6
    s = proportions.summary(proportions.long(proportions.wide(df, range(3))).withColumn("grp", F.lit("a")).where("trial_id = 1"))
    assert all(r.sem == 0 and r.n == 1 for r in s.collect())
    assert proportions.parse_trials("1-3,7") == [(1, 3), (7, 7)] and proportions.parse_trials([1, "2-4", (6, 8)]) == [(1, 1), (2, 4), (6, 8)]


def test_cleaning_keeps_or_drops_nan(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (5.1,), (float("nan"),)], "a double")
    assert clean.cleaned(df, {"a": (None, 5.0)}).count() == 3
    assert clean.cleaned(df, {"a": (None, 5.0), "b": (0.0, 1.0)}, keep_nan=False).count() == 2
    assert clean.removed(df, {"a": (2.0, 5.0)}).count() == 2


def test_assignment(spark):
    cents = [[-3.0, 0, 0], [3.0, 0, 0], [0, 3.0, 0]]
    st = (("a", 5.0, 2.0), ("b", -2.0, 4.0), ("c", 10.0, 1.0))
    rng = np.random.default_rng(0)
    raw = rng.normal((5, -2, 10), (6, 8, 2), (300, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(raw)] + [(300, float("nan"), 0.0, 0.0), (301, None, 0.0, 0.0)], "i int, a double, b double, c double")
    got = col(cluster.assigned(df, ("a", "b", "c"), cents, st).orderBy("i"), "label")
    z = (raw - [5, -2, 10]) / [2, 4, 1]
    want = np.argmin(((z[:, None] - np.array(cents)) ** 2).sum(axis=2), axis=1).tolist()
    assert got == [*want, -1, -1]
    with pytest.raises(ValueError):
        cluster.assigned(df, ("a", "b"), cents)


def test_inertia_and_dispersion(spark):
    x = [[0, 0], [2, 0], [10, 10], [12, 10]]
    df = spark.createDataFrame([(float(a), float(b), k) for (a, b), k in zip(x, (0, 0, 1, 1))], "a double, b double, label int")
    assert cluster.inertia(df, ("a", "b"), [[1, 0], [11, 10]]).first()[0] == 4
    assert cluster.calinski_harabasz(df, ("a", "b")).first()[0] == pytest.approx(200 / (4 / 2))
    assert cluster.calinski_harabasz(df.withColumn("label", F.lit(0)), ("a", "b")).first()[0] is None


def test_instability_and_matching():
    a = np.array([[0.0, 0], [5, 5], [9, 0]])
    assert cluster.instability_of([a, a]).tolist() == [0, 0]
    assert cluster.instability_of([a, a[::-1]]).tolist() == [0, 0]
    got = cluster.instability_of([a, a, a + 3])
    assert got[0] == got[1] == 0 and got[2] > 0
    assert cluster.instability_of([]).size == 0 and cluster.instability_of([a]).tolist() == [0]
    from itertools import permutations

    rng = np.random.default_rng(1)
    for n in (1, 2, 4, 6):
        cost = rng.random((n, n))
        best = min(cost[np.arange(n), list(p)].sum() for p in permutations(range(n)))
        assert cost[np.arange(n), cluster.best_matching(cost)].sum() == pytest.approx(best)


def test_elbow_spec_and_leave_out(spark):
    assert cluster.elbow(range(1, 11), [100, 55, 30, 26, 24, 22, 21, 20, 19, 18], 1.0) in range(2, 6)
    assert numeric.column_spec("0,1,2,16-28") == [0, 1, 2, *range(16, 29)] and numeric.column_spec(None) is None and numeric.column_spec("5") == [5]
    kept = col(sequence.left_out(spark.range(10), "id", 10, 30, 90).orderBy("id"), "id")
    assert kept == [2, 3, 4, 5, 6, 7, 8]


def test_silhouette_of_far_clusters():
    x = np.array([[0.0], [1], [100], [101]])
    assert (cluster.silhouette_of(x, np.array([0, 0, 1, 1])) > 0.98).all()


def motion(spark, xy, speed=None, yaw=None, n=None):
    n = n or len(xy)
    rows = [(1, i, float(xy[i][0]), float(xy[i][1]), float(speed[i]) if speed is not None else 0.0, 0.0, float(yaw[i]) if yaw is not None else 0.0) for i in range(n)]
    df = spark.createDataFrame(rows, "trial_id int, frame_number int, x double, y double, thrust_mm_s double, slip_mm_s double, yaw_rad_s double")
    return df.withColumns({"speed": F.abs("thrust_mm_s"), "abs_translational": F.abs("thrust_mm_s"), "cx": F.lit(0.0), "cy": F.lit(0.0), "radius": F.lit(7.5)})


def test_circler(spark):
    t = np.arange(2000) / 50
    ring = np.stack([7 * np.cos(1.2 * t), 7 * np.sin(1.2 * t)], axis=1)
    r = kinematics.circling(motion(spark, ring, np.full(2000, 8.4))).first()
    assert r.circling_share > 0.8 and r.circling_bouts >= 1
    # The thresholds: 0.7 of the radius, 0.5 rad/s, 3 mm/s, 0.6 radii a second outward.
    turning = lambda r, w, v: kinematics.circling(motion(spark, np.stack([r * np.cos(w * t), r * np.sin(w * t)], axis=1), np.full(2000, v))).first().circling_bouts
    assert (turning(5.3, 1.2, 8), turning(5.2, 1.2, 8)) == (1, 0)
    assert (turning(7, 0.52, 8), turning(7, 0.48, 8)) == (1, 0)
    assert (turning(7, 1.2, 3.1), turning(7, 1.2, 2.9)) == (1, 0)
    wave = lambda a: 6.5 + a * np.sin(5 * t) / 5
    assert (turning(wave(4.3), 1.2, 8), turning(wave(9.0), 1.2, 8)) == (1, 0)
    gaps = np.full(2000, 8.4)
    gaps[::2] = np.nan  # speeds that were not measured are no frames of circling
    r = kinematics.circling(motion(spark, ring, gaps)).first()
    assert r.circling_bouts == 0 and r.circling_share == 0
    assert kinematics.circling(motion(spark, ring, np.full(2000, np.nan))).first().circling_share is None
    jitter = np.random.default_rng(0).normal(0, 0.1, (2000, 2))
    assert kinematics.circling(motion(spark, jitter, np.full(2000, 1.0))).first().circling_share < 0.05
    t = kinematics.thigmotaxis(motion(spark, ring)).first()
    assert t.periphery_share > 0.9
    assert kinematics.thigmotaxis(motion(spark, jitter)).first().centre_share > 0.9


def test_darting(spark):
    def run(second, saccade=True):
        speed, yaw = np.zeros(600), np.zeros(600)
        speed[100:120] = speed[second : second + 20] = 20
        if saccade:
            yaw[120:128] = 10
        return kinematics.darting(motion(spark, np.zeros((600, 2)), speed, yaw)).first()

    assert (run(139).episodes, run(139).bursts, run(139).darting_share) == (1, 2, pytest.approx(59 / 600))
    assert run(300).bursts == 2
    assert run(300).episodes == 0
    assert run(139, False).episodes == 0


def test_mobility_path_and_turns(spark):
    speed = np.zeros(1000)
    speed[200:700] = 10
    r = kinematics.mobility(motion(spark, np.zeros((1000, 2)), speed)).first()
    assert 0.45 <= r.mobile_share <= 0.55 and r.immobile_bouts == 2
    speed[:] = np.nan
    r = kinematics.mobility(motion(spark, np.zeros((1000, 2)), speed)).first()
    assert r.mobile_share is None and r.immobile_bouts == 0 and r.immobile_s == 0
    assert kinematics.path_length(motion(spark, [(i, 0) for i in range(101)])).first().path_mm == 100
    r = kinematics.turns(motion(spark, np.zeros((1000, 2)), None, np.full(1000, 2.0))).first()
    assert r.rotation_rad == pytest.approx(40) and r.sharp_turns == 0


def test_histogram_edges(spark):
    xs = [0.0, 0.5, 1.0, 2.0, 2.1, -1.0, float("nan")]
    got = dict(col(kinematics.histogram(spark.createDataFrame([(x,) for x in xs], "x double"), "x", 0, 2, 4), "bin", "n"))
    want, _ = np.histogram(xs[:5], bins=4, range=(0, 2))
    assert [got.get(i, 0) for i in range(4)] == want.tolist()


def test_markov(spark):
    df = labels(spark, [0, 1, 1, 0, 1]).union(labels(spark, [2, 0], animal=2))
    counts = markov.transitions(df)
    assert {(r.from_label, r.to_label): r.n for r in counts.collect()} == {(0, 1): 2, (1, 1): 1, (1, 0): 1, (2, 0): 1}
    p = {(r.from_label, r.to_label): (r.probability, r.apriori) for r in markov.probabilities(counts).collect()}
    assert p == {(0, 1): (1, 0.5), (1, 0): (1, 0.25), (2, 0): (1, 0.25)}
    cells = markov.preferred(counts).collect()
    assert len(cells) == 9 and sum(c.verdict == "N/A" for c in cells) == 3


def test_binomial():
    assert markov.binomial_cdf(2, 4, 0.5) == pytest.approx(11 / 16)
    assert [markov.binomial_quantile(q, 4, 0.5) for q in (0.0, 0.3, 0.5, 0.99)] == [0, 1, 2, 4]
    assert markov.binomial_cdf(0, 0, 0.5) == 1 and markov.binomial_quantile(0.5, 0, 0.5) == 0


def test_motifs(spark):
    got = {tuple(r.motif): r.n for r in markov.motifs(labels(spark, [0, 0, 1, 2, 0, 0, 2, 0]), 3).collect()}
    assert got == {(0, 1, 2): 1, (1, 2, 0): 1}


def test_group_statistics(spark):
    rng = np.random.default_rng(0)
    rows = [(float(x), g, i) for g, m in (("Baseline", 0.1), ("Dose", 0.5), ("Other", 0.1)) for i, x in enumerate(rng.normal(m, 0.05, 20))]
    df = spark.createDataFrame(rows, "proportion double, grp string, i int")
    got = stats.compare_groups(df, "proportion", "grp", n=500).collect()
    assert len(got) == 3 and all(r.p_adj >= r.p for r in got)
    assert next(r for r in got if (r.group_a, r.group_b) == ("Baseline", "Dose")).p_adj < 0.05
    per = stats.compare_groups(df.withColumn("cluster", F.col("i") % 2), "proportion", "grp", ("cluster",), n=100)
    assert per.count() == 6


def test_reverse_inference(spark):
    rng = np.random.default_rng(1)
    rows = [(f"{g}{i}", g, *map(float, np.abs(rng.normal(m, 0.02)))) for g, m in (("a", (0.6, 0.3, 0.1)), ("b", (0.1, 0.6, 0.3)), ("c", (0.3, 0.1, 0.6))) for i in range(12)]
    df = spark.createDataFrame(rows, "id string, treatment string, prop_0 double, prop_1 double, prop_2 double")
    pred = stats.reverse_inference(df, ["prop_0", "prop_1", "prop_2"], "treatment", ["a", "b", "c"], "id").cache()
    # Around its own mean the control group's changes are noise; the other two groups are found.
    assert all(r.predicted == r.truth for r in pred.where("truth <> 'a'").collect())
    assert stats.accuracy(pred).first()[0] > 24 / 36
    # Against medians that are really taken without the animal.
    x, truth = np.array([r[2:] for r in rows]), np.array([r[1] for r in rows])
    x = np.log2((x + 1e-4) / (x[truth == "a"].mean(axis=0) + 1e-4))
    want = {}
    for i in range(len(x)):
        score = {g: np.corrcoef(x[i], np.median(x[(truth == g) & (np.arange(len(x)) != i)], axis=0))[0, 1] for g in "abc"}
        want[rows[i][0]] = max("abc", key=lambda g: round(score[g], 12))
    assert {r.id: r.predicted for r in pred.collect()} == want
    sums = stats.confusion(pred).groupBy("truth").agg(F.sum("share").alias("s"))
    assert col(sums, "s") == pytest.approx([1, 1, 1])


def test_rank_and_tail_functions():
    a, b = np.array([1.0, 2, 3, 4]), np.array([5.0, 6, 7, 8])
    assert stats.mann_whitney(a, b)[0] == 0
    assert stats.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert stats.chi_square_quantile(0.95, 2) == pytest.approx(5.991464547107979)
    assert stats.t_tail(2.228138851964939, 10) == pytest.approx(0.05)
    assert stats.f_tail(4.9646027437307145, 1, 10) == pytest.approx(0.05)
    assert stats.kruskal(a, b)[0] == pytest.approx(16 / 3)
    assert stats.friedman(np.array([[1.0, 2, 3]] * 4))[0] == pytest.approx(8)
    assert all(math.isnan(x) for x in stats.wilcoxon(np.zeros(5)))
    assert stats.goodman([50, 50])[0][0] == pytest.approx(1 - stats.goodman([50, 50])[1][1])
    assert stats.choose_test(2, True, False) == "wilcoxon" and stats.choose_test(3, False, True) == "anova"


def test_false_discovery(spark):
    df = spark.createDataFrame([("a", p) for p in (0.01, 0.04, 0.03, 0.005)], "k string, p double")
    assert dict(col(stats.false_discovery(df, "p", "q", ("k",)), "p", "q")) == pytest.approx({0.005: 0.02, 0.01: 0.02, 0.03: 0.04, 0.04: 0.04})


@pytest.mark.parametrize("written,wells", [
    ("1 to 24", list(range(1, 25))), ("1-24", list(range(1, 25))), ("1 to  24", list(range(1, 25))), ("1,2 4-24", [1, 2, *range(4, 25)]),
    ("1 to 19, 21, 22", [*range(1, 20), 21, 22]), ("1 to 17", list(range(1, 18))), ("", []), (None, []), ("5-3", [3, 4, 5]), ("0, 30", []), ("1 - 5", [1, 5]), ("10mM 3", [3]),
])
def test_wells(spark, written, wells):
    assert one(spark, text.wells(F.lit(written).cast("string"))) == wells


def test_text_functions(spark):
    assert one(spark, text.compact(F.array(*map(F.lit, (1, 2, 4, 5, 6, 9))))) == "1-2,4-6,9"
    assert one(spark, text.parsed_date(F.lit("31/11/24"))) is None
    for written, day in (("03/02/24", "2024-02-03"), ("12-03-2024", "2024-03-12"), ("1/2/2024", "2024-02-01"), ("2024-01-05 10:00:00", "2024-01-05"), ("5-6-69", "1969-06-05"), ("240131", "None"), ("12.03.2024", "None")):
        assert str(one(spark, text.parsed_date(F.lit(written)))) == day
    labels = spark.createDataFrame([("NeuroD2", "g20"), ("no_xenopus_target", "g15_5MM"), ("null", "null"), ("", None), ("na", "N/A")], "a string, b string")
    assert col(labels.select(text.joined_label(("a", "b")).alias("x")), "x") == ["NeuroD2 g20", "no_xenopus_target g15_5MM", "WT", "WT", "na"]
    parts = lambda t: one(spark, text.transgene_parts(F.lit(t)))
    assert (parts("G: NeuroD2, SgRNA: g20").gene, parts("G: NeuroD2, SgRNA: g20").is_control) == ("NeuroD2", False)
    assert (parts("NeuroD2_g15_5MM").is_control, parts("NeuroD2_g15_5MM").guide) == (True, "g15_5MM")
    assert parts("Ap2b3 g2").gene == "Ap2b3" and parts("NO TADOLE").is_empty and parts("NO TADOLE").role == "empty"
    assert one(spark, text.plain_name(F.lit("My_Video-01.MP4"))) == "myvideo01"
    assert one(spark, text.recording_day(F.lit("x240131_a"))) == "2024-01-31" and one(spark, text.recording_day(F.lit("x"))) == "unknown"
    assert tuple(one(spark, text.clip_parts(text.clip_name(F.lit("v"), F.lit(3))))) == ("v", 3)
    assert [one(spark, numeric.stars(F.lit(p))) for p in (0.0005, 0.005, 0.03, 0.2, float("nan"))] == ["***", "**", "*", "ns", ""]
    assert one(spark, text.is_gradient(F.lit("5 mM PTZ"))) is True


def test_matching_tiers(spark):
    plates = spark.createDataFrame([
        ("p1", ["Run_A.mp4"]), ("p2", ["cam 012123456"]), ("p3", ["dup"]), ("p4", ["dup"]), ("p5", ["camA_001101010.mp4"]), ("p6", ["x_777888888"]), ("p7", ["x_777888888", "both_777888888"]),
    ], "key string, videos array<string>")
    names = ["run-a.MP4", "other_012123456.mp4", "dup.mp4", "none.mp4", "run-a-long.mp4", "camA_001999999.mp4", "camA.mp4", "both_777888888", "x_777888888"]
    got = {r.filename: (r.key, r.status) for r in metadata.matched_videos(spark.createDataFrame([(n,) for n in names], "filename string"), plates).collect()}
    assert got == {
        "run-a.MP4": ("p1", "exact"), "other_012123456.mp4": ("p2", "tail"), "dup.mp4": (None, "ambiguous"), "none.mp4": (None, "unmatched"), "run-a-long.mp4": (None, "unmatched"),
        "camA_001999999.mp4": ("p5", "prefix"), "camA.mp4": (None, "unmatched"), "both_777888888": ("p7", "exact"), "x_777888888": (None, "ambiguous"),
    }
    keys = {r.filename: r["keys"] for r in metadata.candidate_keys(spark.createDataFrame([("x_777888888",), ("none",)], "filename string"), plates).collect()}
    assert keys == {"x_777888888": ["p6", "p7"], "none": []}


def test_candidates_are_listed_once_for_a_name(spark):
    """Plates and videos of one name do not meet pair by pair, and a plan without notes looks for no candidates."""
    from ethoflow.operators import ingest

    plates = spark.createDataFrame([(f"p{i}", [f"cam_001{i:06d}"], *[""] * 15) for i in range(40)], "key string, videos array<string>, " + ", ".join(
        f"{n} string" for n in ("initials", "fert_date_raw", "female_tank", "female_identifier", "background_strain", "target_gene", "cas9", "sgrna", "seq_folder", "exp_date_raw", "stage", "control_arenas", "test_arenas", "drug_dose", "notes")))
    videos = spark.createDataFrame([(f"cam_001{i + 500:06d}.mp4",) for i in range(30)] + [("cam_001000003.mp4",)], "filename string")
    plan = ingest.build_plan(videos, plates)
    got = {r.video_path: (r.row_key, r.notes) for r in plan.collect()}
    assert got["cam_001000003.mp4"] == ("p3", "") and len(got) == 31
    assert got["cam_001000500.mp4"] == ("", "NEEDS MANUAL MATCH; candidates: " + ", ".join(sorted(f"p{i}" for i in range(40))))
    assert "collect_set" not in plan.drop("notes")._jdf.queryExecution().optimizedPlan().toString()


def test_get_or_create_twice(spark):
    table = spark.createDataFrame([(7, "a", None)], "id int, k string, m string")
    wanted = spark.createDataFrame([("a", None), ("b", "x"), ("b", "x"), (None, None)], "k string, m string")
    new, ids = metadata.get_or_create(table, wanted, ("k", "m"), "id")
    assert sorted(col(new, "id")) == [8, 9] and ids.count() == 4
    again, ids2 = metadata.get_or_create(table.unionByName(new), wanted, ("k", "m"), "id")
    assert again.count() == 0 and sorted(map(str, ids2.collect())) == sorted(map(str, ids.collect()))


def test_binomial_law():
    """Against the plain sum."""
    for n, p in ((1, 0.5), (7, 0.3), (40, 0.02), (200, 0.6)):
        law = np.array([math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)])
        total = np.cumsum(law)
        assert [markov.binomial_cdf(k, n, p) for k in range(-1, n + 1)] == pytest.approx([0.0, *total], abs=1e-10)
        for q in (0.025, 0.5, 0.975):
            assert markov.binomial_quantile(q, n, p) == int(np.argmax(total >= q - 1e-12))
    assert 4_990_000 < markov.binomial_quantile(0.025, 10_000_000, 0.5) < 5_000_000


def test_row_index_is_dense(spark):
    df = spark.range(100).select((F.col("id") * 37 % 101).alias("v"))
    got = col(sequence.row_index(df, ["v"]).orderBy("v"), "row_index")
    assert got == list(range(100))


def test_partitions_do_not_matter(spark):
    df = labels(spark, [0, 1, 1, 2, 0, 0, 1]).union(labels(spark, [1, 1, 0, 0], animal=2))
    want = sorted(map(tuple, bouts.durations(df, 50.0).collect()))
    assert sorted(map(tuple, bouts.durations(df.repartition(7), 50.0).collect())) == want


def test_drift_correction_broadcasts_no_rows(spark):
    """Every well of a video is there in each of its frames, at the anchor plus the mean step so far."""
    grid = spark.range(2).select(F.col("id").alias("video_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("frame_number"))
    grid = grid.withColumn("well", F.explode(F.sequence(F.lit(0), F.lit(2))))
    rows = grid.withColumns({"x": (F.col("well") * 10 + F.col("frame_number") * F.col("video_id")).cast("double"), "y": F.col("well").cast("double")})
    df = prototypes.drift_corrected(rows, head=1)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, rows.collect()))


def test_length_on_the_edge_of_a_bin(spark):
    """The middle frame moves by (-0.6, 0.45), 7.5 a second at ten frames: the lower edge of bin 9."""
    track = [(1, f, x, y, 0.0, 0.0, 0.0) for f, (x, y) in enumerate([(2.738, 2.0), (1.2189999999999999, 8.0), (1.538, 2.9)])]
    df = spark.createDataFrame(track, "trial_id int, frame_number int, x double, y double, thrust_mm_s double, slip_mm_s double, yaw_rad_s double")
    moved = kinematics.with_channels(df, kinematics.Limits(fps=10.0)).where("frame_number = 1")
    assert [r.bin for r in kinematics.channel_histograms(moved).where("channel = 'speed'").collect()] == [9]


def test_equal_circles_are_decided(spark):
    """Of equal circles the smaller number comes first, in whatever order the rows arrive."""
    rows = [("p", i, 1.0, 2.0, 5.0) for i in range(40)]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "plate string, i int, cx double, cy double, radius double").repartition(3)
        kept = prototypes.closest_radii(df, ("plate",), 24, ties=("i",))
        got = prototypes.grid_order(kept, ("plate",), ties=("i",))
        assert sorted(col(got, "i", "well_number")) == [(i, i + 1) for i in range(24)]


def test_a_summary_deals_its_frames_to_enough_tasks(spark, monkeypatch):
    """A task's frames don't grow with the table: so many tasks that each has TASK_FRAMES of them or so, however few bytes they have."""
    rows = spark.range(4000).select(
        (F.col("id") % 200).alias("trial_id"), F.floor(F.col("id") / 200).alias("frame_number"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"),
        (F.col("id") % 11).cast("double").alias("thrust_mm_s"), (F.col("id") % 3).cast("double").alias("slip_mm_s"), (F.col("id") % 13 - 6).cast("double").alias("yaw_rad_s"),
    )
    whole = {r.trial_id: r for r in kinematics.animal_summary(rows).collect()}
    monkeypatch.setattr(kinematics, "TASK_FRAMES", 100, raising=False)
    for made in (kinematics.animal_summary, kinematics.mobility, kinematics.darting):
        value = {} if made is kinematics.animal_summary else {"value": "thrust_mm_s"}
        got = made(rows, **value).withColumn("task", F.spark_partition_id()).collect()
        assert len(got) == 200 and len({r.task for r in got}) >= 30
        if not value:
            assert all(r.asDict() == whole[r.trial_id].asDict() | {"task": r.task} for r in got)
