"""Which taxa have enough data: six rules from one aggregate."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaflow.functions.keys import attach, names, nan_to_null, require
from taxaflow.operators.lists import presences

#: One boolean column per rule, in report order.
RULES = ("shortest_max", "min_occurrences", "min_years", "max_year", "min_year", "max_gap")


def sufficiency(
    df: DataFrame,
    var_cols: str | Iterable[str] = "taxa",
    time_col: str = "year",
    remove_0: bool = True,
    success_col: str = "success",
) -> DataFrame:
    """Longest list, records, times, first and last time and largest gap per taxon.

    Records are first reduced to one row per (taxon, time), which spreads a
    common taxon over its times and leaves few rows for the gap window.  An
    unknown time counts as one more time; an unknown time or list length makes
    the maximum it belongs to unknown.
    """
    var = names(var_cols)
    require(df, *var, time_col, "list_length")
    df = nan_to_null(presences(df, success_col) if remove_0 else df, time_col, "list_length")
    per_time = df.groupBy(*var, time_col).agg(
        F.count(F.lit(1)).alias("records"),
        F.count("list_length").alias("known_lists"),
        F.max("list_length").alias("longest"),
    )
    in_order = W.partitionBy(*var).orderBy(F.col(time_col).asc_nulls_last())
    per_time = per_time.withColumn("step", F.col(time_col) - F.lag(time_col).over(in_order))
    known_time = F.count(time_col) == F.count(F.lit(1))
    return per_time.groupBy(*var).agg(
        F.when(F.sum("known_lists") == F.sum("records"), F.max("longest")).alias("longest_list"),
        F.sum("records").alias("occurrences"),
        F.count(F.lit(1)).alias("times"),
        F.when(known_time, F.max(time_col)).alias("last_time"),
        F.when(known_time, F.min(time_col)).alias("first_time"),
        F.greatest(F.max("step"), F.when(known_time, F.lit(0))).alias("largest_gap"),
    )


def rule_columns(
    shortest_max: float, min_occurrences: float, min_years: float, max_year: float, min_year: float, max_gap: float
) -> dict[str, Column]:
    """Removal condition of each rule; equality removes, an unknown value does not."""
    hit = {
        "shortest_max": F.col("longest_list") <= shortest_max,
        "min_occurrences": F.col("occurrences") <= min_occurrences,
        "min_years": F.col("times") <= min_years,
        "max_year": F.col("last_time") <= max_year,
        "min_year": F.col("first_time") >= min_year,
        "max_gap": F.col("largest_gap") >= max_gap,
    }
    return {rule: F.coalesce(hit[rule], F.lit(False)) for rule in RULES}


def filter_reasons(
    df: DataFrame,
    var_cols: str | Iterable[str] = "taxa",
    time_col: str = "year",
    remove_0: bool = True,
    shortest_max: float = 3,
    min_occurrences: float = 5,
    min_years: float = 3,
    *,
    max_year: float,
    min_year: float | None = None,
    max_gap: float = 10,
    success_col: str = "success",
) -> DataFrame:
    """Measures and one flag per rule for every taxon with a usable record."""
    min_year = max_year - 10 if min_year is None else min_year
    measured = sufficiency(df, var_cols, time_col, remove_0, success_col)
    flags = rule_columns(shortest_max, min_occurrences, min_years, max_year, min_year, max_gap)
    any_rule = reduce(Column.__or__, [F.col(rule) for rule in RULES])
    return measured.withColumns(flags).withColumn("removed", any_rule)


def filter_list_df(df: DataFrame, var_cols: str | Iterable[str] = "taxa", **rules) -> DataFrame:
    """All rows, zeros included, of the taxa that no rule removes.

    A taxon without a usable record is in no rule's set and stays.
    """
    gone = filter_reasons(df, var_cols, **rules).where("removed").select(*names(var_cols))
    return attach(df, gone, names(var_cols), "left_anti")
