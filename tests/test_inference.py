"""Exact laws, whole-table orders, batched fits and bounded samples against plain versions."""

import math
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethoflow.operators import bouts, cluster, exact, fits, ranges, sequence, stats


def test_rank_sum_law_is_the_enumeration():
    for n in range(1, 7):
        for m in range(1, 7):
            want = [0] * (n * m + 1)
            for chosen in combinations(range(1, n + m + 1), n):
                want[sum(chosen) - n * (n + 1) // 2] += 1
            assert list(map(int, exact.rank_sum_counts(n, m))) == want
            for u in range(n * m + 1):
                far = sum(w for v, w in enumerate(want) if abs(v - n * m / 2) >= abs(u - n * m / 2))
                assert exact.rank_sum_p(u, n, m) == pytest.approx(min(1.0, far / sum(want) if 2 * u != n * m else 1.0))
    assert sum(map(int, exact.rank_sum_counts(8, 3000))) == math.comb(3008, 8)  # beyond 64 bits


def test_signed_rank_law_is_the_enumeration():
    for n in range(1, 9):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in product((0, 1), repeat=n)]
        for w in range(n * (n + 1) // 2 + 1):
            low = min(w, n * (n + 1) // 2 - w)
            assert exact.signed_rank_p(w, n) == pytest.approx(min(1.0, 2 * sum(s <= low for s in sums) / 2**n))
    assert stats.wilcoxon(np.arange(1.0, 6))[1] == pytest.approx(0.0625)
    assert stats.mann_whitney(np.arange(3.0), np.arange(3.0) + 10)[1] == pytest.approx(0.1)


def test_tied_or_large_samples_take_the_normal_law():
    a, b = np.array([1.0, 2, 2, 3]), np.array([2.0, 3, 4, 5])
    u, p = stats.mann_whitney(a, b)
    assert u == 2.5 and p == pytest.approx(0.134, abs=0.02) and p != exact.rank_sum_p(u, 4, 4)
    assert stats.wilcoxon(np.array([1.0, -1, 2, 3, 0]))[1] != exact.signed_rank_p(1.5, 4)


@pytest.mark.parametrize("statistic", list(stats.STATISTICS))
def test_relabelled_share_is_the_enumeration(statistic):
    rng, f = np.random.default_rng(0), stats.STATISTICS[statistic]
    for n, m in ((1, 1), (3, 4), (5, 5), (1, 7), (8, 3)):
        a, b = rng.integers(0, 6, n).astype(float), rng.integers(0, 6, m).astype(float)  # with ties
        both, hits = np.concatenate([a, b]), 0
        for chosen in combinations(range(n + m), n):
            mask = np.zeros(n + m, dtype=bool)
            mask[list(chosen)] = True
            hits += abs(f(both[mask], both[~mask])) >= abs(f(a, b)) - 1e-9
        assert exact.relabelled_share(a, b, statistic) == pytest.approx(hits / math.comb(n + m, n))
        assert stats.permutation_p(a, b, "all", statistic=statistic) == pytest.approx(hits / math.comb(n + m, n))


def test_relabelling_large_groups_by_halves_and_its_bound():
    a, b = np.arange(20.0), np.arange(20.0) + 0.5
    assert 0.5 < exact.relabelled_share(a, b) < 1
    with pytest.raises(ValueError):
        exact.relabelled_share(np.arange(30.0), np.arange(30.0))
    assert math.isnan(exact.relabelled_share(a, np.zeros(0)))


def test_median_law_is_the_enumeration_and_the_limit_of_draws():
    rng = np.random.default_rng(1)
    for n in (3, 4, 5, 6):
        xs = np.sort(rng.integers(0, 5, n) / 2)
        want: dict[float, float] = {}
        for draw in product(range(n), repeat=n):
            v = float(np.median(xs[list(draw)]))
            want[v] = want.get(v, 0) + n**-n
        got: dict[float, float] = {}
        for v, p in zip(*exact.median_law(xs)):
            got[float(v)] = got.get(float(v), 0) + p
        assert {k: v for k, v in got.items() if v > 1e-12} == pytest.approx(want)
    for n in (37, 500, 1000, 3001):
        xs = np.sort(rng.normal(size=n))
        assert exact.median_interval(xs) == pytest.approx(stats.bootstrap_median(xs, 4000), abs=0.4 / math.sqrt(n))
    assert exact.median_interval(np.array([2.0, 5.0])) == (2.0, 5.0) and math.isnan(exact.median_interval(np.zeros(0))[0])


def test_rank_tests_equal_the_pairwise_ones(spark):
    rng = np.random.default_rng(2)
    rows = [(k, g, float(x)) for k in "ab" for g, n in (("p", 4), ("q", 9), ("r", 12)) for x in (rng.integers(0, 8, n) if k == "a" else rng.normal(size=n))]
    df = spark.createDataFrame([*rows, ("a", "p", None), ("a", None, 1.0), ("a", "p", float("nan"))], "k string, g string, v double")
    got = stats.rank_tests(df, "v", "g", ("k",)).collect()
    assert len(got) == 6
    for r in got:
        x, y = (np.array([v for k, g, v in rows if (k, g) == (r.k, name)]) for name in (r.group_a, r.group_b))
        assert (r.u, r.p) == pytest.approx(stats.mann_whitney(x, y)) and (r.n_a, r.n_b) == (len(x), len(y))
    assert stats.rank_tests(df.where("k = 'b'"), "v", "g").count() == 3
    assert stats.rank_tests(df.where("false"), "v", "g", ("k",)).count() == 0
    signed = {r.k: (r.w, r.p) for r in stats.signed_rank_tests(df.where("g is not null"), "v", ("k",)).collect()}
    for k in "ab":
        assert signed[k] == pytest.approx(stats.wilcoxon(np.array([v for key, _, v in rows if key == k])))


def test_correction_without_keys_is_that_of_one_key(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, float(p)) for i, p in enumerate(rng.integers(1, 40, 300) / 50)], "i int, p double").repartition(7)
    whole = {r.i: r.q for r in stats.false_discovery(df, "p", "q", ()).collect()}
    one = {r.i: r.q for r in stats.false_discovery(df.withColumn("k", F.lit(1)), "p", "q", ("k",)).collect()}
    assert whole == pytest.approx(one)


def test_numbers_stay_when_tasks_run_again(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 1009).alias("v"), "id")
    rows = sequence.row_index(df, ["v"])
    first = {r.id: r.row_index for r in rows.collect()}
    assert sorted(first.values()) == list(range(5000))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:  # everything that is not written is computed again, dealt to other tasks
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        again = rows.repartition(3, "id")
        assert {r.id: r.row_index for r in again.collect()} == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    by = sorted(first, key=first.get)
    assert [i * 7919 % 1009 for i in by] == sorted(i * 7919 % 1009 for i in range(5000))
    assert "persist" not in open(sequence.__file__).read() and sequence.row_index(df.where("false"), ["v"]).count() == 0


def test_running_values_over_ranges(spark):
    rng = np.random.default_rng(4)
    xs = rng.integers(0, 9, 400).astype(float)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double").repartition(5)
    got = {r.i: (r.s, r.low) for r in ranges.least_from_here(ranges.running_sums(df, ["i"], {"s": "x"}), ["i"], "x", "low").collect()}
    assert all(got[i] == (xs[:i].sum(), xs[i:].min()) for i in range(400))


def test_all_fits_move_as_they_would_alone(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.3, (60, 2)) for m in ((0, 0), (3, 0), (0, 4))])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(180, float("nan"), 0.0)], "i int, a double, b double").repartition(4)
    rows, runs = fits.matrix_rows(df, ["a", "b"], "i"), [fits.Run(s, p, x[:k]) for s, p in ((0, 2), (25, 90)) for k in (2, 3, 5)]
    for run, (found, cost, ch, n) in zip(runs, fits.lloyd(rows, runs, 181, 7, 0.0)):
        own = x[(np.arange(180) - int(181 * run.position / 100)) % 181 >= int(181 * run.del_size / 100)]
        c = run.centroids.copy()
        for _ in range(7):
            label = ((own[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([own[label == j].mean(axis=0) if (label == j).any() else c[j] for j in range(len(c))])
        label = ((own[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert found.centroids == pytest.approx(c) and n == len(own)
        assert cost == pytest.approx(((own - c[label]) ** 2).sum())
        inside = sum(((own[label == j] - own[label == j].mean(axis=0)) ** 2).sum() for j in set(label))
        between = sum((label == j).sum() * ((own[label == j].mean(axis=0) - own.mean(axis=0)) ** 2).sum() for j in set(label))
        k = len(set(label))
        assert ch == pytest.approx(between * (len(own) - k) / (inside * (k - 1)))
    swept = cluster.sweep(df.where("i < 180"), ["a", "b"], "i", [(0, 2, 3), (10, 40, 3), (0, 2, 4)], seed=1).collect()
    assert [r.k for r in swept] == [3, 3, 4] and swept[0].inertia < 60
    assert cluster.gathered(spark.createDataFrame(swept)).where("instability is not null").count() == 3


def test_samples_are_the_smallest_hashes_of_each_label(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 3900, 0).otherwise(1).alias("label"), F.col("id").cast("double").alias("x"))
    got = cluster.stratified(df, 50, repeats=3, seed=7).collect()
    for repeat in range(3):
        want = df.withColumn("h", F.pmod(F.xxhash64(F.lit(7) + F.lit(repeat), "label", "x"), F.lit(1 << 31))).where("label = 0").orderBy("h").limit(50).collect()
        assert {r.x for r in got if r.repeat == repeat and r.label == 0} == {r.x for r in want}
        assert sum(r.repeat == repeat and r.label == 1 for r in got) == 50
    assert cluster.stratified(df.where("x >= 3990"), 50, repeats=2).count() == 20


def test_silhouette_medians_over_repeats(spark):
    rows = [(0, 1, 2, 0.5), (0, 2, 2, 0.1), (1, 1, 2, 0.7), (1, 2, 2, 0.3), (2, 1, 2, 0.9), (2, 2, 2, 0.5)]
    df = spark.createDataFrame([(r, k, n, s) for r, k, n, s in rows], "repeat int, label int, n long, silhouette double")
    got = {r.label: r for r in cluster.silhouette_summary(df).collect()}
    assert got[1].label_silhouette == pytest.approx(0.7) and got[2].label_silhouette == pytest.approx(0.3)
    assert (got[1].mean_silhouette, got[1].q1, got[1].q3) == pytest.approx((0.5, 0.4, 0.6))


def test_duration_summary_with_interval(spark):
    animals = spark.createDataFrame([(0, i, float(i), float(i), 1) for i in range(9)] + [(1, 0, 4.0, 4.0, 2)], "label int, trial_id int, mean_ms double, median_ms double, n_bouts long")
    labels = spark.createDataFrame([(0,), (1,), (2,)], "label int")
    got = {r.label: (r.ci_low, r.ci_high) for r in bouts.with_interval(bouts.across_animals(animals, labels), animals).collect()}
    assert got == {0: exact.median_interval(np.arange(9.0)), 1: (4.0, 4.0), 2: (0.0, 0.0)}


def test_whole_silhouettes_meet_all_pairs(spark):
    """Tiles of seven rows, two clusterings, one of them with a single row of a label."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3))
    labels = {0: np.arange(50) % 3, 1: np.where(np.arange(50) == 4, 2, np.arange(50) % 2)}
    rows = [(k, int(c), [float(v) for v in r]) for k, lab in labels.items() for c, r in zip(lab, x)]
    df = spark.createDataFrame(rows, "k int, label int, x array<double>").repartition(5)
    got = {(r.k, r.label): (r.n, r.silhouette) for r in cluster.whole_silhouettes(df, ("k",), tile=7).collect()}
    for k, lab in labels.items():
        s = cluster.silhouette_of(x, lab)
        for c in set(lab.tolist()):
            assert got[k, c] == (int((lab == c).sum()), pytest.approx(s[lab == c].mean()))
    every = cluster.silhouettes(df.where("k = 0").select("label", "x"), None, repeats=2).collect()
    assert sorted((r.repeat, r.label, r.n) for r in every) == [(r, c, int((labels[0] == c).sum())) for r in (0, 1) for c in range(3)]


def _shuffled(spark):
    """Records written to shuffles so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_silhouettes_do_not_send_the_rows_to_every_tile(spark):
    """Thirty strips: rows are not sent to each of them, and two clusterings of the same rows meet their pairs once; some rows are in one of them only."""
    rng = np.random.default_rng(5)
    x, labels = rng.normal(size=(600, 3)), np.stack([np.arange(600) % 3, np.where(np.arange(600) % 7 == 0, -1, np.arange(600) % 4)], 1)
    df = spark.createDataFrame([(c.tolist(), r.tolist()) for c, r in zip(labels, x)], "labels array<int>, x array<double>").repartition(5)
    single, before = df.select(F.col("labels")[0].alias("label"), "x"), _shuffled(spark)
    one = {(0, r.label): (r.n, r.silhouette) for r in cluster.whole_silhouettes(single, tile=20).collect()}
    assert _shuffled(spark) - before < 6000  # a task sends each row's sums once
    both = {(r.clustering, r.label): (r.n, r.silhouette) for r in cluster.whole_silhouettes_of(df, tile=20).collect()}
    for f in (0, 1):
        there = labels[:, f] >= 0
        s, own = cluster.silhouette_of(x[there], labels[there, f]), labels[there, f]
        want = {(f, c): (int((own == c).sum()), pytest.approx(s[own == c].mean())) for c in range(own.max() + 1)}
        assert {k: v for k, v in both.items() if k[0] == f} == want
        assert f or one == want


def _held(run):
    import tracemalloc

    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_random_relabellings_of_few_values():
    """Counts of values are drawn instead of rows; against the normal law of the difference of means."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 5, 10_000) / 4, rng.integers(0, 5, 10_000) / 4
    p, held = _held(lambda: stats.permutation_p(a, b, 4000))
    both = np.concatenate([a, b])
    want = math.erfc(abs(a.mean() - b.mean()) / (both.std(ddof=1) * math.sqrt(2 / 10_000)) / math.sqrt(2))
    assert p == pytest.approx(want, abs=0.03) and held < 50 << 20
    assert stats.permutation_p(a, b + 1, 200) == 1 / 201


def test_median_law_of_many_values():
    """Only neighbouring draws are paired: the law is whole, and its memory follows the root of the number."""
    xs = np.sort(np.random.default_rng(4).normal(size=9000))
    (values, shares), held = _held(lambda: exact.median_law(xs))
    assert shares.sum() == pytest.approx(1) and held < 40 << 20
    assert float(values @ shares) == pytest.approx(np.median(xs), abs=0.01)
