"""Exact interpolated quantiles per group, for groups of any size."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaflow.functions.keys import attach, join_same, names, nan_to_null, require
from taxaflow.functions.text import quantile_name

#: Distinct values a group keeps for choosing its bin bounds.
SAMPLE = 8192
#: A group is cut into STEP * STEP bins: STEP coarse ones, each into STEP fine ones.
STEP = 16
BINS = STEP * STEP


def group_quantiles(
    df: DataFrame,
    by: str | Iterable[str] | None,
    value: str,
    probs: Sequence[float],
    prefix: str = "",
    few_values: bool = False,
    times: str | None = None,
) -> DataFrame:
    """One row per group with one column per probability (linear interpolation, nulls skipped).

    ``few_values`` says that a group has few distinct values (years, list
    lengths), so counts per value fit in one aggregation buffer.  Otherwise no
    task ever holds a whole group.  ``times`` names a column that says how many
    equal rows a row stands for.
    """
    by = names(by)
    require(df, *by, value, *names(times))
    df = nan_to_null(df.select(*by, value, (F.col(times) if times else F.lit(1)).cast("long").alias("__times")), value)
    if few_values:
        often = [F.col("__times")] if times else []
        found = df.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(float(p)) for p in probs]), *often).alias("__q"))
        return found.select(*by, *[F.col("__q")[i].alias(quantile_name(p, prefix)) for i, p in enumerate(probs)])
    if by:
        return _ranked_quantiles(df, by, value, probs, prefix)
    whole = _ranked_quantiles(df.withColumn("__all", F.lit(0)), ["__all"], value, probs, prefix)
    return whole.drop("__all")


def _ranked_quantiles(df: DataFrame, by: list[str], value: str, probs: Sequence[float], prefix: str) -> DataFrame:
    """Find the values at the wanted ranks by counting bins first.

    A group is cut at bounds taken from a sample that depends on the values
    alone, so a recomputed task cuts at the same places.  Bin counts tell which
    bins hold the wanted ranks, and only those bins are put in order.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum("__times").alias("__c"))
    # Reading __c keeps this branch's shuffle equal to the other ones, so Spark reuses it.
    sizes = counts.groupBy(*by).agg(F.sum((F.col("__c") > 0).cast("long")).alias("__distinct"))
    chance = F.lit(float(SAMPLE)) / F.col("__distinct")
    sampled = attach(counts, sizes, by, "inner").where(
        F.pmod(F.xxhash64(value), F.lit(1 << 20)) < chance * (1 << 20)
    )
    cuts = F.expr("array(" + ", ".join(f"{i / BINS}D" for i in range(1, BINS)) + ")")
    bounds = sampled.groupBy(*by).agg(F.percentile(value, cuts, F.col("__c")).alias("__bounds"))
    bounds = bounds.withColumn("__coarse", F.transform(F.sequence(F.lit(STEP), F.lit(BINS - 1), F.lit(STEP)), lambda i: F.col("__bounds")[i - 1]))

    def below(limits: Column) -> Column:
        return F.size(F.filter(limits, lambda b: b < F.col(value)))

    coarse = F.coalesce(below(F.col("__coarse")), F.lit(0))
    fine = F.slice("__bounds", F.col("__part") * STEP + 1, F.lit(STEP - 1))
    binned = (
        attach(counts, bounds, by)
        .withColumn("__part", coarse)
        .withColumn("__bin", F.col("__part") * STEP + F.coalesce(below(fine), F.lit(0)))
        .drop("__bounds", "__coarse", "__part")
    )

    per_bin = binned.groupBy(*by, "__bin").agg(F.sum("__c").alias("__rows"))
    in_group = W.partitionBy(*by)
    per_bin = per_bin.withColumns(
        {
            "__n": F.sum("__rows").over(in_group),
            "__start": F.sum("__rows").over(in_group.orderBy("__bin")) - F.col("__rows"),
        }
    )
    places = [(F.col("__n") - 1) * F.lit(float(p)) for p in probs]
    wanted = reduce(
        Column.__or__,
        [
            (end(place) >= F.col("__start")) & (end(place) < F.col("__start") + F.col("__rows"))
            for place in places
            for end in (F.floor, F.ceil)
        ],
    )
    targets = per_bin.where(wanted).drop("__rows")
    inside = W.partitionBy(*by, "__bin").orderBy(value)
    ranked = join_same(binned, targets, [*by, "__bin"], "inner").withColumn(
        "__last", F.col("__start") + F.sum("__c").over(inside) - 1
    )
    ranked = ranked.withColumn("__first", F.col("__last") - F.col("__c") + 1)

    def at(rank: Column) -> Column:
        return F.max(F.when(rank.between(F.col("__first"), F.col("__last")), F.col(value)))

    pieces = [
        part
        for i, place in enumerate(places)
        for part in (at(F.floor(place)).alias(f"__low{i}"), at(F.ceil(place)).alias(f"__high{i}"))
    ]
    found = ranked.groupBy(*by).agg(F.max("__n").alias("__n"), *pieces)
    out = []
    for i, p in enumerate(probs):
        place = (F.col("__n") - 1) * F.lit(float(p))
        low, high = F.col(f"__low{i}").cast("double"), F.col(f"__high{i}").cast("double")
        out.append((low + (high - low) * (place - F.floor(place))).alias(quantile_name(p, prefix)))
    return found.select(*by, *out)
