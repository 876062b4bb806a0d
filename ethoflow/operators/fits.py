"""Many k-means fits at once: every pass over the rows moves the centroids of all fits of a sweep.

Centroids of all fits are one broadcast matrix (a grid's fits times k times
features, so bounded by the grid).  A task multiplies its rows with it and sums
its rows by fit and label before anything is shuffled; a row for each fit and
label reaches the driver, which moves the centroids.  Fits that no longer move
leave the passes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethoflow.functions.numeric import all_real
from ethoflow.operators.ranges import FILE_ROWS, kept

#: Centroids that a task compares its rows with at a time.
WIDE = 4096
#: Rows that starts are drawn from, by a seeded hash; a bound of the sample, not of the rows that are fitted.
START_ROWS = 4096


class Run(NamedTuple):
    """One fit of a sweep: percent left out, from which percent on, and its centroids."""

    del_size: float
    position: float
    centroids: np.ndarray


def _left(runs: Sequence[Run], n: int) -> list[tuple[int, int]]:
    """(first row, rows) that each fit leaves out."""
    return [(int(n * r.position / 100), int(n * r.del_size / 100)) for r in runs]


def matrix_rows(df: DataFrame, columns: Sequence[str], index: str) -> DataFrame:
    """Rows (i, x) with finite features, written once for all passes."""
    return kept(df.where(all_real(columns)).select(F.col(index).cast("long").alias("i"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x")), "features", FILE_ROWS)


def totals(rows: DataFrame, runs: Sequence[Run], n: int) -> list[tuple[np.ndarray, np.ndarray, float, float]]:
    """For each fit (rows a label, their sums [label, feature], inertia, sum of squares) over the rows that it keeps; one pass."""
    sent = rows.sparkSession.sparkContext.broadcast(([np.asarray(r.centroids, dtype=float) for r in runs], _left(runs, n)))
    schema = pa.schema([("fit", pa.int32()), ("label", pa.int32()), ("n", pa.float64()), ("cost", pa.float64()), ("square", pa.float64()), ("sums", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, left = sent.value
        groups, group, wide = [], [], 0
        for f, c in enumerate(centroids):
            if group and wide + len(c) > WIDE:
                groups, group, wide = [*groups, group], [], 0
            group.append(f)
            wide += len(c)
        groups = [*groups, group] if group else groups
        stacked = [(np.concatenate([centroids[f] for f in g]), g) for g in groups]
        count = [np.zeros(len(c)) for c in centroids]
        sums = [np.zeros(c.shape) for c in centroids]
        cost, square = np.zeros(len(centroids)), np.zeros(len(centroids))
        for batch in batches:
            if not batch.num_rows:
                continue
            i, x = batch.column("i").to_numpy(), batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            own = (x * x).sum(axis=1)
            for c, g in stacked:
                d = (c * c).sum(axis=1) - 2 * x @ c.T
                at = 0
                for f in g:
                    k = len(centroids[f])
                    mine, (start, size) = d[:, at : at + k], left[f]
                    at += k
                    label = mine.argmin(axis=1)
                    keep = np.ones(len(i), dtype=bool) if size == 0 else (i - start) % n >= size
                    hot = np.zeros((len(i), k))
                    hot[np.flatnonzero(keep), label[keep]] = 1
                    count[f] += hot.sum(axis=0)
                    sums[f] += hot.T @ x
                    square[f] += own[keep].sum()
                    cost[f] += np.maximum(0, mine[np.arange(len(i)), label] + own)[keep].sum()
        out = [(f, j, count[f][j], cost[f] if j == 0 else 0.0, square[f] if j == 0 else 0.0, sums[f][j]) for f in range(len(centroids)) for j in range(len(centroids[f]))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    width = len(runs[0].centroids[0])
    part = rows.mapInArrow(run, "fit int, label int, n double, cost double, square double, sums array<double>")
    summed = part.groupBy("fit", "label").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.sum("square").alias("square"), *(F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(width)))
    out = [(np.zeros(len(r.centroids)), np.zeros(np.shape(r.centroids)), 0.0, 0.0) for r in runs]
    for r in summed.collect():  # a row for each fit and label
        n_of, sums, cost, square = out[r.fit]
        n_of[r.label], sums[r.label] = r.n, r[5:]
        out[r.fit] = (n_of, sums, cost + r.cost, square + r.square)
    return out


def labels_of(rows: DataFrame, runs: Sequence[Run], n: int) -> DataFrame:
    """Adds ``labels``: for each fit the row's nearest centroid, -1 where the fit leaves the row out; one pass."""
    sent = rows.sparkSession.sparkContext.broadcast(([np.asarray(r.centroids, dtype=float) for r in runs], _left(runs, n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            i, x = batch.column("i").to_numpy(), batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            out = np.empty((len(i), len(runs)), dtype=np.int32)
            for f, (c, (start, size)) in enumerate(zip(*sent.value)):
                near = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
                out[:, f] = near if size == 0 else np.where((i - start) % n >= size, near, -1)
            ends = pa.array(np.arange(len(i) + 1, dtype=np.int32) * len(runs))
            yield batch.append_column("labels", pa.ListArray.from_arrays(ends, pa.array(out.ravel())))

    return rows.mapInArrow(run, "i long, x array<double>, labels array<int>")


def dispersion(n: np.ndarray, sums: np.ndarray, square: float) -> float | None:
    """Calinski-Harabasz from a fit's totals; None for under two labels."""
    some = n > 0
    k, all_rows = int(some.sum()), float(n.sum())
    if k < 2 or all_rows <= k:
        return None
    middle = float(((sums[some] ** 2).sum(axis=1) / n[some]).sum())
    grand = float((sums.sum(axis=0) ** 2).sum()) / all_rows
    inside = square - middle
    return (middle - grand) * (all_rows - k) / (inside * (k - 1)) if inside > 0 else None


def lloyd(rows: DataFrame, runs: Sequence[Run], n: int, max_iter: int = 100, tol: float = 1e-4) -> list[tuple[Run, float, float | None, int]]:
    """(fit, inertia, dispersion, rows kept) of each fit from its given centroids.

    A label that loses all rows keeps its centroid.  Passes end when no centroid
    of any fit moves by more than tol.
    """
    runs, moving = [Run(r.del_size, r.position, np.asarray(r.centroids, dtype=float)) for r in runs], list(range(len(runs)))
    for _ in range(max_iter):
        if not moving:
            break
        still = []
        for f, (count, sums, _, _) in zip(moving, totals(rows, [runs[f] for f in moving], n)):
            old = runs[f].centroids
            new = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], old)
            runs[f] = runs[f]._replace(centroids=new)
            if float(np.sqrt(((new - old) ** 2).sum(axis=1)).max()) > tol:
                still.append(f)
        moving = still
    return [(r, cost, dispersion(count, sums, square), int(count.sum())) for r, (count, sums, cost, square) in zip(runs, totals(rows, runs, n))]


def starts(rows: DataFrame, specs: Sequence[tuple[float, float, int]], n: int, seed: int = 0) -> list[Run]:
    """Seeded starting centroids of each (del_size, position, k): k-means++ over a drawn sample of the rows that the fit keeps."""
    sample = rows.orderBy(F.xxhash64(F.lit(seed), "i", "x")).limit(START_ROWS).collect()  # a bounded top list
    i, x = np.array([r.i for r in sample]), np.array([r.x for r in sample])
    out = []
    for number, (size, position, k) in enumerate(specs):
        first, gone = _left([Run(size, position, np.empty(0))], n)[0]
        own = x if gone == 0 else x[(i - first) % n >= gone]
        rng = np.random.default_rng([seed, number])
        if len(own) < k:
            raise ValueError(f"{len(own)} rows are too few for {k} centroids")
        chosen = [own[rng.integers(len(own))]]
        far = ((own - chosen[0]) ** 2).sum(axis=1)
        while len(chosen) < k:
            share = far / far.sum() if far.sum() > 0 else None
            chosen.append(own[rng.choice(len(own), p=share)])
            far = np.minimum(far, ((own - chosen[-1]) ** 2).sum(axis=1))
        out.append(Run(size, position, np.array(chosen)))
    return out


def table(spark, found: Sequence[tuple[Run, float, float | None, int]]) -> DataFrame:
    """A row for each fit, as the sweep's files have them."""
    out = [(float(r.del_size), float(r.position), len(r.centroids), cost, ch, n, r.centroids.tolist()) for r, cost, ch, n in found]
    return spark.createDataFrame(out, "del_size double, position double, k int, inertia double, calinski_harabasz double, n long, centroids array<array<double>>")
