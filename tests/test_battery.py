import math

import numpy as np
import pytest

from ethoflow.operators import battery


def test_published_values():
    # Shapiro and Wilk's own example: the weights of eleven men.
    w, p = battery.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert w == pytest.approx(0.79, abs=0.005) and p == pytest.approx(0.0067, abs=0.0005)
    assert battery.range_tail(3.314, 3) == pytest.approx(0.05, abs=1e-3)
    assert battery.range_tail(3.877, 3, 10) == pytest.approx(0.05, abs=1e-3)
    assert all(math.isnan(v) for v in battery.shapiro_wilk(np.ones(5)))


def test_battery(spark):
    rng = np.random.default_rng(0)
    rows = [(k, g, s, float(rng.normal(m, 1))) for k in ("x", "y") for g, m in (("a", 0), ("b", 0), ("c", 6 if k == "x" else 0)) for s in range(15)]
    df = spark.createDataFrame(rows, "k string, g string, s int, v double")
    for subject in (None, "s"):
        got = {(r.k, r.group_a, r.group_b): r for r in battery.run_battery(df, "v", "g", ("k",), subject).collect()}
        assert len(got) == 6 and got["x", "a", "c"].p_pair < 0.01 and got["x", "a", "b"].p_pair > 0.05
        assert got["x", "a", "c"].significant
    two = battery.run_battery(df.where("g <> 'c'"), "v", "g", ("k",)).collect()
    assert {r.test for r in two} <= {"welch", "mann_whitney"} and len(two) == 2
    shares = battery.multinomial_intervals(df, "g", ("k",)).collect()
    assert all(r.ci_low < r.share < r.ci_high for r in shares)
