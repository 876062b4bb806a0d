"""Shares of labels by recording and group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wide(df: DataFrame, labels: Sequence[int], trial: str = "trial_id", label: str = "label") -> DataFrame:
    """One row a recording with ``cluster_<label>`` shares; unassigned rows (-1) count if listed or found by the caller."""
    counted = [F.count_if(F.col(label) == x).alias(f"cluster_{x}") for x in labels]
    total = sum((F.col(f"cluster_{x}") for x in labels[1:]), F.col(f"cluster_{labels[0]}"))
    out = df.where(F.col(label).isNotNull()).groupBy(trial).agg(*counted).withColumn("__n", total)
    return out.select(trial, *(F.try_divide(F.col(f"cluster_{x}"), F.col("__n")).alias(f"cluster_{x}") for x in labels))


def labels_in(df: DataFrame, condition: Column | None = None, label: str = "label") -> DataFrame:
    """The labels that occur, or those of rows that meet a condition; of several groups it is the union of their sets."""
    rows = df if condition is None else df.where(condition)
    return rows.select(label).where(F.col(label).isNotNull()).distinct()


def wide_by_data(df: DataFrame, trial: str = "trial_id", label: str = "label") -> DataFrame:
    """``wide`` with the labels from 0 to the largest that occurs, as one aggregate finds it; unassigned rows do not count."""
    top = df.agg(F.max(label)).first()[0]
    return wide(df.where(F.col(label) >= 0), range(max(0, -1 if top is None else top) + 1), trial, label)


def share_of_label(df: DataFrame, keys: Sequence[str], value: int, label: str = "label") -> DataFrame:
    """Rows (keys, share, n): one label's share of the frames of each group, such as wells of a baseline and of a dose."""
    return df.groupBy(*keys).agg(F.avg((F.col(label) == value).cast("double")).alias("share"), F.count(F.lit(1)).alias("n"))


def trials_per_label(df: DataFrame, keys: Sequence[str] = ("grp",), label: str = "label", trial: str = "trial_id") -> DataFrame:
    """How many recordings of each group have a label at all."""
    return df.groupBy(label, *keys).agg(F.count_distinct(trial).alias("n_trials"))


def in_all(df: DataFrame, key: str, conditions: Sequence[Column]) -> DataFrame:
    """The keys that have a row for every condition, as paired animals have for both of their recordings; one aggregate."""
    seen = df.groupBy(key).agg(*(F.bool_or(F.coalesce(c, F.lit(False))).alias(f"__c{i}") for i, c in enumerate(conditions)))
    every = F.lit(True)
    for i in range(len(conditions)):
        every = every & F.col(f"__c{i}")
    return seen.where(every).select(key)


def with_names(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Adds the names of groups, null for groups without one; names: one row a group, a small dimension."""
    return df.join(F.broadcast(names), key, "left")


def long(shares: DataFrame, ids: Sequence[str] = ("trial_id",)) -> DataFrame:
    names = [c for c in shares.columns if c.startswith("cluster_")]
    return shares.unpivot(list(ids), names, "cluster", "proportion").withColumn("cluster", F.regexp_replace("cluster", "^cluster_", "").cast("int"))


def summary(rows: DataFrame, keys: Sequence[str] = ("grp", "cluster"), value: str = "proportion") -> DataFrame:
    """Mean, standard error (zero for one row) and count."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0)).alias("sem"), F.count(value).alias("n"))


def pooled(df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Share of each label among all frames of a group."""
    n = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("proportion", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def group_means(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and standard error (null for one row) of every numeric column, and the rows' count."""
    numeric = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "short") and f.name not in keys]
    aggs = [a for c in numeric for a in (F.avg(c).alias(f"{c}_mean"), (F.stddev_samp(c) / F.sqrt(F.count(c))).alias(f"{c}_sem"))]
    return df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("n_tadpoles"))


def grouped(df: DataFrame, criteria: Sequence[tuple[str, Column]], out: str = "grp", keep_rest: bool = False) -> DataFrame:
    """Names rows by conditions; of several that hold the last one counts, and rows of none go."""
    name = F.lit(None).cast("string")
    for label, condition in criteria:
        name = F.when(condition, label).otherwise(name)
    df = df.withColumn(out, name)
    return df if keep_rest else df.where(F.col(out).isNotNull())


def trial_groups(pairs: DataFrame, trial: str = "trial_id", order: str = "position") -> DataFrame:
    """One group a trial: of several rows the one listed last."""
    return pairs.groupBy(trial).agg(F.max_by("grp", order).alias("grp"))


def matching(criteria: dict) -> Column:
    """A condition from column -> value, list, or (``_range``) closed range."""
    ok = F.lit(True)
    for name, want in criteria.items():
        if name.endswith("_range"):
            ok = ok & F.col(name.removesuffix("_range")).between(*want)
        elif isinstance(want, (list, tuple, set)):
            ok = ok & F.col(name).isin(*want)
        else:
            ok = ok & F.col(name).eqNullSafe(F.lit(want))
    return ok


def parse_trials(spec: str | int | Sequence) -> list[tuple[int, int]]:
    """``1-3,7`` (or a list of numbers, texts and pairs) as closed ranges."""
    if isinstance(spec, int):
        return [(spec, spec)]
    if isinstance(spec, str):
        out = []
        for part in spec.split(","):
            low, _, high = part.strip().partition("-")
            out.append((int(low), int(high or low)))
        return out
    return [r for item in spec for r in ([tuple(item)] if isinstance(item, (list, tuple)) else parse_trials(item))]


def in_trials(spec: str | int | Sequence, trial: str = "trial_id") -> Column:
    ok = F.lit(False)
    for low, high in parse_trials(spec):
        ok = ok | F.col(trial).between(low, high)
    return ok
