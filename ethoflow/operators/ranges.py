"""Orders over whole tables: numbers and running values without a sort in one task.

Rows are dealt to ranges of the order and written, sorted, to the shared folder;
what is written does not change, so a task that runs again after a lost executor
finds the same rows at the same places.  One row of totals a range reaches the
driver and comes back as offsets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethoflow.session import scratch_path, shuffles_freed

RANGE, AT = "__range", "__at"
#: Rows of a file of a table that many passes compute on, so that every core gets some.
FILE_ROWS = 4096


def kept(df: DataFrame, label: str, file_rows: int = 0) -> DataFrame:
    """The rows, written to the shared folder and read from there; file_rows: rows of a file at most, 0 for any number."""
    at = f"{scratch_path(df.sparkSession, label)}/rows"
    with shuffles_freed(df.sparkSession):
        df.write.option("maxRecordsPerFile", file_rows).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def ranged(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Rows with the number of their range and their place in it; rows of equal order follow the source's order and may be split."""
    tie, place = "__tie", "__place"
    by = [*order, tie]
    rows = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop(tie)
    # The id is the partition's number over the row's place in it.
    numbered = kept(rows.withColumn(place, F.monotonically_increasing_id()), "ranges")
    return numbered.withColumns({RANGE: F.shiftright(place, 33), AT: F.col(place).bitwiseAND((1 << 33) - 1)}).drop(place)


def _per_range(rows: DataFrame, totals: Sequence[Column]) -> list[tuple]:
    return sorted(tuple(r) for r in rows.groupBy(RANGE).agg(*totals).collect())


def _with_offsets(rows: DataFrame, offsets: list[tuple], names: Sequence[str], kind: str) -> DataFrame:
    spark = rows.sparkSession
    table = spark.createDataFrame(offsets, f"{RANGE} long, " + ", ".join(f"{n} {kind}" for n in names))
    return rows.join(F.broadcast(table), RANGE)  # a row for each range


def row_index(df: DataFrame, order: Sequence[str | Column], out: str = "row_index") -> DataFrame:
    """A dense index from 0 in the order of the columns."""
    rows = ranged(df, order)
    offsets, total = [], 0
    for part, n in _per_range(rows, [F.count(F.lit(1))]):
        offsets.append((part, total))
        total += n
    return _with_offsets(rows, offsets, ["__before"], "long").withColumn(out, F.col("__before") + F.col(AT)).drop(RANGE, AT, "__before")


def running_sums(df: DataFrame, order: Sequence[str | Column], columns: Mapping[str, str]) -> DataFrame:
    """Adds, for each (new name, column), the column's sum over all rows before."""
    rows, names = ranged(df, order), list(columns)
    offsets, total = [], [0.0] * len(names)
    for part, *sums in _per_range(rows, [F.coalesce(F.sum(columns[n]), F.lit(0)).cast("double") for n in names]):
        offsets.append((part, *total))
        total = [a + b for a, b in zip(total, sums)]
    before = Window.partitionBy(RANGE).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    held = _with_offsets(rows, offsets, [f"__o_{n}" for n in names], "double")
    return held.withColumns({n: F.coalesce(F.sum(columns[n]).over(before), F.lit(0)) + F.col(f"__o_{n}") for n in names}).drop(RANGE, AT, *(f"__o_{n}" for n in names))


def least_from_here(df: DataFrame, order: Sequence[str | Column], column: str, out: str) -> DataFrame:
    """Adds the least value of the column from the row to the last one."""
    rows = ranged(df, order)
    offsets, least = [], None
    for part, low in reversed(_per_range(rows, [F.min(column)])):
        offsets.append((part, least))
        least = low if least is None else least if low is None else min(low, least)
    behind = Window.partitionBy(RANGE).orderBy(AT).rowsBetween(0, Window.unboundedFollowing)
    held = _with_offsets(rows, offsets, ["__o"], "double")
    return held.withColumn(out, F.least(F.min(column).over(behind), "__o")).drop(RANGE, AT, "__o")
