"""Visits to sites: numbering, detection histories and their sufficient counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaflow.functions.keys import join_same, names, require
from taxaflow.session import durable


def slices_of(df: DataFrame, keys: Iterable[str], order_cols: Iterable[str], name: str = "__slice") -> DataFrame:
    """Rows with the number of the slice they lie in, slices being ranges of about equal size in the order of keys and ``order_cols``.

    The bounds come from a sample of whole sort keys, so neither a key with most of
    the rows nor an order column with one value makes a large slice; only rows that
    are equal in every column stay together.  The table is stored, which fixes them.
    """
    every = F.xxhash64(*df.columns)
    cut = df.repartitionByRange(*names(keys), *names(order_cols), every)
    return durable(cut.withColumn(name, F.spark_partition_id().cast("long")))


def number_visits(df: DataFrame, site_cols: Iterable[str], order_cols: Iterable[str], name: str = "visit") -> DataFrame:
    """Number the rows of a site from 1 in the order of ``order_cols``.

    Rows are numbered inside range slices, and each slice is shifted by the rows of
    its site in the slices before it, so a site with very many visits is never sorted
    in one task, whatever its order columns hold.
    """
    site, order = names(site_cols), names(order_cols)
    require(df, *site, *order)
    sliced = slices_of(df, site, order)
    counts = sliced.groupBy(*site, "__slice").agg(F.count(F.lit(1)).alias("__rows"))
    # one row for each slice a site lies in
    before = F.sum("__rows").over(W.partitionBy(*site).orderBy("__slice")) - F.col("__rows")
    counts = durable(counts.withColumn("__before", before).drop("__rows"))
    inside = F.row_number().over(W.partitionBy(*site, "__slice").orderBy(*order))
    numbered = join_same(sliced.withColumn("__inside", inside), counts, [*site, "__slice"])
    return numbered.withColumn(name, F.col("__inside") + F.col("__before")).drop("__inside", "__before", "__slice")


def detection_history(
    df: DataFrame, time_geo: Iterable[str], site_cols: Iterable[str], order_cols: Iterable[str], success_col: str = "success"
) -> DataFrame:
    """One row per visit of each site: its number and its success (null for a missed visit).

    Every visit is a row of its own, so no history is ever held by one task.
    """
    keys = [*names(time_geo), *names(site_cols)]
    return number_visits(df, keys, order_cols).select(*keys, "visit", F.col(success_col).alias("success"))


def visits_wide(
    df: DataFrame, time_geo: Iterable[str], site_cols: Iterable[str], order_cols: Iterable[str], success_col: str = "success"
) -> DataFrame:
    """One row per site and a column ``visit_1`` to ``visit_n`` each, null where not visited; n is the longest history.

    The data's own longest history gives the width, so no visit is left out.  A
    table of very many columns is refused by Spark (``spark.sql.pivotMaxValues``);
    ``detection_history`` has no such limit.
    """
    keys = [*names(time_geo), *names(site_cols)]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    n_visits = counts.agg(F.max("__n")).first()[0] or 0
    visits = detection_history(df, time_geo, site_cols, order_cols, success_col)
    wide = visits.groupBy(*keys).pivot("visit", list(range(1, n_visits + 1))).agg(F.first("success"))
    return wide.select(*keys, *[F.col(str(i)).alias(f"visit_{i}") for i in range(1, n_visits + 1)])


def site_counts(df: DataFrame, time_geo: Iterable[str], site_cols: Iterable[str], success_col: str = "success") -> DataFrame:
    """Visits and detections per site: all an occupancy estimate with constant detection needs."""
    keys = [*names(time_geo), *names(site_cols)]
    require(df, *keys, success_col)
    return df.groupBy(*keys).agg(
        F.count(success_col).alias("n_visits"), F.count_if(F.col(success_col) > 0).alias("n_det")
    )


def occupancy_histogram(df: DataFrame, time_geo: Iterable[str], site_cols: Iterable[str], success_col: str = "success") -> DataFrame:
    """Sites by (visits, detections) for each time and geography."""
    per_site = site_counts(df, time_geo, site_cols, success_col)
    return per_site.groupBy(*names(time_geo), "n_visits", "n_det").agg(F.count(F.lit(1)).alias("n_sites"))
