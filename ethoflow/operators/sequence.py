"""Operators over ordered frames: differences, gaps, runs.

Every operator partitions by a recording's keys and orders by the frame number,
so one shuffle serves any number of them in a row.  Null means that no row is
there; NaN is a value and stays one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ethoflow.operators import ranges


def by(keys: Sequence[str], order: str = "frame_number") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def _so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _from_here(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.currentRow, Window.unboundedFollowing)


def backward_difference(x: str, w: WindowSpec) -> Column:
    """x minus the frame before; zero in the first frame (NaN there too gives zero)."""
    return F.when(F.row_number().over(w) == 1, 0.0).otherwise(F.col(x) - F.lag(x).over(w))


def forward_difference(x: str, w: WindowSpec) -> Column:
    """The next frame minus x; the last frame repeats the step before it, a lone frame gives zero."""
    after = F.lead(F.struct(x)).over(w)
    before = F.lag(F.struct(x)).over(w)
    return F.when(after.isNotNull(), after[x] - F.col(x)).when(before.isNotNull(), F.col(x) - before[x]).otherwise(0.0)


def gradient(x: str, w: WindowSpec) -> Column:
    """Central difference, one-sided at the ends; null for a lone frame."""
    after, before = F.lead(x).over(w), F.lag(x).over(w)
    return F.when(after.isNotNull() & before.isNotNull(), (after - before) / 2).when(after.isNotNull(), after - F.col(x)).when(before.isNotNull(), F.col(x) - before)


def turning(theta: str, w: WindowSpec) -> Column:
    """Gradient of the unwrapped angle, from wrapped steps on both sides."""
    from ethoflow.functions.geometry import wrapped

    into, out = wrapped(F.col(theta) - F.lag(theta).over(w)), wrapped(F.lead(theta).over(w) - F.col(theta))
    return F.when(into.isNotNull() & out.isNotNull(), (into + out) / 2).otherwise(F.coalesce(into, out))


def unwrap(df: DataFrame, theta: str, keys: Sequence[str], out: str = "unwrapped", order: str = "frame_number") -> DataFrame:
    """Adds the angle without jumps of over half a turn between neighbours."""
    from ethoflow.functions.geometry import wrapped

    w = by(keys, order)
    df = df.withColumn("__step", F.coalesce(wrapped(F.col(theta) - F.lag(theta).over(w)), F.lit(0.0)))
    return df.withColumn(out, F.first(theta).over(_so_far(w)) + F.sum("__step").over(_so_far(w))).drop("__step")


def filled_forward(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(_so_far(w))


def interpolated(x: Column, w: WindowSpec) -> Column:
    """Nulls between two values lie on the line by row position; a gap at the start stays, one at the end holds the last value."""
    at = F.row_number().over(w)
    known = F.when(x.isNotNull(), F.struct(at.alias("i"), x.alias("x")))
    p, q = F.last(known, ignorenulls=True).over(_so_far(w)), F.first(known, ignorenulls=True).over(_from_here(w))
    line = p["x"] + (q["x"] - p["x"]) * (at - p["i"]) / (q["i"] - p["i"])
    return F.when(x.isNotNull(), x).when(p.isNull(), F.lit(None)).when(q.isNull(), p["x"]).otherwise(line)


def interpolate(df: DataFrame, columns: dict[str, Column], keys: Sequence[str], order: str = "frame_number") -> DataFrame:
    """Adds interpolated columns from expressions that are null where a value is missing."""
    w = by(keys, order)
    df = df.withColumn("__at", F.row_number().over(w))
    known = {f"__k_{n}": F.when(x.isNotNull(), F.struct(F.col("__at").alias("i"), x.alias("x"))) for n, x in columns.items()}
    df = df.withColumns(known)
    df = df.withColumns({f"__p_{n}": F.last(f"__k_{n}", ignorenulls=True).over(_so_far(w)) for n in columns} | {f"__q_{n}": F.first(f"__k_{n}", ignorenulls=True).over(_from_here(w)) for n in columns})
    new = {}
    for n in columns:
        p, q, k = F.col(f"__p_{n}"), F.col(f"__q_{n}"), F.col(f"__k_{n}")
        new[n] = F.when(k.isNotNull(), k["x"]).when(p.isNull(), F.lit(None)).when(q.isNull(), p["x"]).otherwise(p["x"] + (q["x"] - p["x"]) * (F.col("__at") - p["i"]) / (q["i"] - p["i"]))
    return df.withColumns(new).drop("__at", *(f"__{c}_{n}" for n in columns for c in "kpq"))


def repaired_eyes(df: DataFrame, keys: Sequence[str], threshold: float = 0.5, order: str = "frame_number") -> DataFrame:
    """Both eyes unsure: the last sure position; one unsure: the other eye's position."""
    w = by(keys, order)
    l_bad, r_bad = F.col("left_eye_likelihood") < threshold, F.col("right_eye_likelihood") < threshold
    new = {}
    for side, other, own_bad, other_bad in (("left_eye", "right_eye", l_bad, r_bad), ("right_eye", "left_eye", r_bad, l_bad)):
        for axis in "xy":
            held = {n: filled_forward(F.when(~(l_bad & r_bad), F.col(f"{n}_{axis}")), w) for n in (side, other)}
            new[f"{side}_{axis}"] = F.when(own_bad & ~other_bad, held[other]).otherwise(held[side])
    return df.withColumns(new)


def with_runs(df: DataFrame, keys: Sequence[str], changes: Sequence[str], order: str = "frame_number", gaps: bool = True, out: str = "run") -> DataFrame:
    """Adds a run number from 1: a new run where a column changes or, with ``gaps``, frames are not consecutive."""
    w = by(keys, order)
    new = F.lag(order).over(w).isNull()
    for c in changes:
        new = new | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    if gaps:
        new = new | (F.col(order) - F.lag(order).over(w) != 1)
    df = df.withColumn("__new", F.coalesce(new, F.lit(True)).cast("long"))
    return df.withColumn(out, F.sum("__new").over(_so_far(w))).drop("__new")


def runs(df: DataFrame, keys: Sequence[str], changes: Sequence[str], order: str = "frame_number", gaps: bool = True, aggs: Sequence[Column] = ()) -> DataFrame:
    """One row a run: its keys, values, first and last frame and length."""
    numbered = with_runs(df, keys, changes, order, gaps)
    return numbered.groupBy(*keys, "run", *changes).agg(F.min(order).alias("first_frame"), F.max(order).alias("last_frame"), F.count(F.lit(1)).alias("n_frames"), *aggs)


def changed_only(df: DataFrame, keys: Sequence[str], label: str = "label", order: str = "frame_number") -> DataFrame:
    """Rows whose label differs from the one before in the same recording."""
    w = by(keys, order)
    return df.withColumn("__before", F.lag(F.struct(label)).over(w)).where(F.col("__before").isNull() | ~F.col(f"__before.{label}").eqNullSafe(F.col(label))).drop("__before")


def left_out(df: DataFrame, index: str, n: int, percent: float, position: float) -> DataFrame:
    """The rows without a contiguous share that starts at a percentage and wraps round; index runs from 0 to n - 1."""
    size, start = int(n * percent / 100), int(n * position / 100)
    return df if size == 0 else df.where(F.pmod(F.col(index) - start, F.lit(n)) >= size)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 1) -> DataFrame:
    """The first rows of each group by an order, such as its first traces or a series' first recording."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def row_index(df: DataFrame, order: Sequence[str], out: str = "row_index") -> DataFrame:
    """A dense 0-based index in the order of the columns, without a sort in one task; the same after a lost executor."""
    return ranges.row_index(df, order, out)
