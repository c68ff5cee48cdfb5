"""Raw reporting rates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.functions.keys import attach, names, require
from taxaflow.functions.links import proportion


def reporting_rate(df: DataFrame, keys: Iterable[str], success_col: str = "success", trials_col: str | None = None) -> DataFrame:
    """Successes, trials and their ratio per group; without ``trials_col`` every row is one trial."""
    keys = names(keys)
    require(df, *keys, success_col)
    trials = F.sum(trials_col) if trials_col else F.count(success_col)
    sums = df.groupBy(*keys).agg(F.sum(success_col).alias("success"), trials.alias("trials"))
    return sums.withColumn("prop", proportion(F.col("success"), F.col("trials")))


def points_at(raw: DataFrame, shown: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Raw rows at the values that a result shows."""
    cols = names(cols)
    return attach(raw, shown.select(*cols).distinct(), cols, "left_semi")


def latest_time(df: DataFrame, by: Iterable[str], time_col: str, recent: float | None = None) -> DataFrame:
    """Rows at ``recent``, or without it at the group's last time."""
    if recent is not None:
        return df.where(F.col(time_col) == recent)
    by = names(by)
    last = df.groupBy(*by).agg(F.max(time_col).alias(time_col))
    return attach(df, last, [*by, time_col], "left_semi")


def edge_times(df: DataFrame, by: Iterable[str], time_col: str) -> DataFrame:
    """Rows at the group's first or last time, ties kept."""
    by = names(by)
    ends = df.groupBy(*by).agg(F.min(time_col).alias("min"), F.max(time_col).alias("max"))
    marked = attach(df, ends, by).where((F.col(time_col) == F.col("min")) | (F.col(time_col) == F.col("max")))
    return marked.withColumn("edge", F.when(F.col(time_col) == F.col("min"), "min").otherwise("max")).drop("min", "max")


def attach_levels(df: DataFrame, by: Iterable[str], col: str, name: str = "levels") -> DataFrame:
    """Number of distinct values of ``col`` in the group, on every row."""
    by = names(by)
    return attach(df, df.select(*by, col).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias(name)), by)
