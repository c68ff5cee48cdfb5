"""Tables for looking at model data."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaflow.functions.keys import attach, join_same, names, require
from taxaflow.operators.quantiles import group_quantiles


def numeric_columns(df: DataFrame, skip: Iterable[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in set(skip)]


def character_columns(df: DataFrame, skip: Iterable[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in set(skip)]


def drop_constant(df: DataFrame) -> DataFrame:
    """Drop columns with a single value; the test is one row of minima, maxima and null counts."""
    checks = [
        ((F.count(c) == F.count(F.lit(1))) & F.min(c).eqNullSafe(F.max(c)) | (F.count(c) == 0)).alias(c) for c in df.columns
    ]
    constant = df.agg(*checks).first()
    return df.select(*[c for c in df.columns if not constant[c]])


def long_numbers(df: DataFrame, cols: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Numeric columns as rows ``(keep, variable, value)``."""
    cols = names(cols)
    return df.select(*names(keep), *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(names(keep), cols, "variable", "value")


def long_texts(df: DataFrame, cols: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Character columns as rows ``(keep, variable, level)``."""
    return df.select(*names(keep), *names(cols)).unpivot(names(keep), names(cols), "variable", "level")


def level_counts(df: DataFrame, cols: Iterable[str], by: Iterable[str] = (), max_levels: int | None = 30) -> DataFrame:
    """Rows per level of the character variables with fewer than ``max_levels`` levels."""
    by = names(by)
    counts = long_texts(df, cols, by).groupBy(*by, "variable", "level").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(*by, "variable").agg(F.count(F.lit(1)).alias("levels"))
    if max_levels is not None:
        sizes = sizes.where(F.col("levels") < max_levels)
    return join_same(counts, sizes, [*by, "variable"], "inner", tiny=not by)


def box_summary(df: DataFrame, resp: str, cols: Iterable[str], by: Iterable[str] = (), max_levels: int | None = 30) -> DataFrame:
    """Five-number summary of the response per level: quartiles, whiskers within 1.5 IQR, outliers."""
    by = names(by)
    long = long_texts(df.withColumn("__r", F.col(resp).cast("double")), cols, [*by, "__r"])
    keys = [*by, "variable", "level"]
    if max_levels is not None:
        few = level_counts(df, cols, by, max_levels).select(*by, "variable").distinct()
        long = attach(long, few, [*by, "variable"], "left_semi", tiny=not by)
    quartiles = group_quantiles(long, keys, "__r", [0.25, 0.5, 0.75], few_values=False)
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = F.col("__r").between(F.col("q25") - reach, F.col("q75") + reach)
    return (
        attach(long.where(F.col("__r").isNotNull()), quartiles, keys, "inner", tiny=not by and max_levels is not None)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.when(inside, F.col("__r"))).alias("whisker_low"),
            F.first("q25").alias("q25"),
            F.first("q50").alias("q50"),
            F.first("q75").alias("q75"),
            F.max(F.when(inside, F.col("__r"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def _ranges(long: DataFrame, keys: list[str]) -> DataFrame:
    return long.groupBy(*keys).agg(F.min("value").alias("__low"), F.max("value").alias("__high"))


def _bin(bins: int) -> Column:
    width = F.col("__high") - F.col("__low")
    place = F.floor(F.try_divide(F.col("value") - F.col("__low"), width) * bins).cast("int")
    return F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)) + 1


def histogram(df: DataFrame, cols: Iterable[str], by: Iterable[str] = (), bins: int = 30) -> DataFrame:
    """Counts in equal-width bins from the least to the greatest value of each variable."""
    keys = [*names(by), "variable"]
    long = long_numbers(df, cols, by).where(F.col("value").isNotNull())
    placed = attach(long, _ranges(long, keys), keys, tiny=not names(by)).withColumn("bin", _bin(bins))
    width = (F.first("__high") - F.first("__low")) / bins
    return placed.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        (F.first("__low") + width * (F.col("bin") - 1)).alias("bin_low"),
        (F.first("__low") + width * F.col("bin")).alias("bin_high"),
    )


def binned_mean(df: DataFrame, resp: str, cols: Iterable[str], by: Iterable[str] = (), bins: int = 20) -> DataFrame:
    """Mean response and its standard error along each variable."""
    keys = [*names(by), "variable"]
    long = long_numbers(df.withColumn("__r", F.col(resp).cast("double")), cols, [*names(by), "__r"])
    long = long.where(F.col("value").isNotNull() & F.col("__r").isNotNull())
    placed = attach(long, _ranges(long, keys), keys, tiny=not names(by)).withColumn("bin", _bin(bins))
    return placed.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean_value"),
        F.avg("__r").alias("mean_resp"),
        F.try_divide(F.stddev_samp("__r"), F.sqrt(F.count(F.lit(1)))).alias("se_resp"),
    )


def density(df: DataFrame, cols: Iterable[str], by: Iterable[str] = (), points: int = 128, bins: int = 512) -> DataFrame:
    """Gaussian kernel density on an even grid, with the rule-of-thumb bandwidth.

    Values are counted in bins first, so the kernel sum works on at most ``bins``
    rows per variable whatever the number of values.
    """
    by = names(by)
    keys = [*by, "variable"]
    long = long_numbers(df, cols, by).where(F.col("value").isNotNull())
    return density_of(long, keys, points, bins, tiny=not by)


def density_of(long: DataFrame, keys: Sequence[str], points: int = 128, bins: int = 512, tiny: bool = False) -> DataFrame:
    """Density of ``value`` per group in ``keys``; ``tiny`` if the groups are a handful."""
    keys = names(keys)
    spread = long.groupBy(*keys).agg(
        F.count("value").alias("__n"), F.stddev_samp("value").alias("__sd"), F.min("value").alias("__low"), F.max("value").alias("__high")
    )
    quartiles = group_quantiles(long, keys, "value", [0.25, 0.75], prefix="__", few_values=False)
    iqr = (F.col("__q75") - F.col("__q25")) / 1.34
    narrow = F.when((iqr > 0) & (iqr < F.col("__sd")), iqr).otherwise(F.col("__sd"))
    stats = join_same(spread, quartiles, keys)
    # a variable with one value has no spread: its size, or one, stands in, as density estimates commonly do
    size = F.when(F.col("__low") != 0, F.abs("__low")).otherwise(F.lit(1.0))
    width = F.when(F.col("__sd") > 0, narrow).otherwise(size)
    stats = stats.withColumn("__bw", 0.9 * width * F.pow(F.col("__n"), F.lit(-0.2)))
    placed = attach(long, stats, keys, "inner", tiny=tiny).withColumn("__bin", _bin(bins))
    counts = placed.groupBy(*keys, "__bin", "__low", "__high", "__bw", "__n").agg(F.count(F.lit(1)).alias("__c"))
    start, stop = F.col("__low") - 3 * F.col("__bw"), F.col("__high") + 3 * F.col("__bw")
    step = (stop - start) / (points - 1)
    centre = F.col("__low") + (F.col("__bin") - 0.5) * (F.col("__high") - F.col("__low")) / bins
    grid = counts.withColumns({"__start": start, "__step": step, "__centre": centre})
    grid = grid.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("__start") + F.col("point") * F.col("__step")
    kernel = F.exp(-0.5 * F.pow((x - F.col("__centre")) / F.col("__bw"), 2)) / (2.5066282746310002 * F.col("__bw") * F.col("__n"))
    return grid.groupBy(*keys, "point").agg(F.max(x).alias("x"), F.sum(F.col("__c") * kernel).alias("density"))


def lm_smooth(df: DataFrame, resp: str, cols: Iterable[str], by: Iterable[str] = ()) -> DataFrame:
    """Straight-line fit of the response on each variable."""
    by = names(by)
    long = long_numbers(df.withColumn("__r", F.col(resp).cast("double")), cols, [*by, "__r"])
    return long.groupBy(*by, "variable").agg(
        F.regr_count("__r", "value").alias("n"),
        F.regr_slope("__r", "value").alias("slope"),
        F.regr_intercept("__r", "value").alias("intercept"),
        F.regr_r2("__r", "value").alias("r2"),
    )


def pair_correlations(df: DataFrame, cols: Iterable[str], by: Iterable[str] = ()) -> DataFrame:
    """Correlation of every pair of numeric columns, from one aggregate."""
    by, pairs = names(by), list(combinations(names(cols), 2))
    wide = df.groupBy(*by).agg(*[F.corr(a, b).alias(f"__c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(
        *[F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), F.col(f"__c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
    )
    return wide.select(*by, F.inline(rows))


def cross_counts(df: DataFrame, cols: Iterable[str], by: Iterable[str] = ()) -> DataFrame:
    """Rows per combination of levels for every pair of character columns, in one pass."""
    by = names(by)
    pairs = F.array(
        *[
            F.struct(F.lit(a).alias("var_a"), F.col(a).alias("level_a"), F.lit(b).alias("var_b"), F.col(b).alias("level_b"))
            for a, b in combinations(names(cols), 2)
        ]
    )
    return df.select(*by, F.inline(pairs)).groupBy(*by, "var_a", "level_a", "var_b", "level_b").agg(F.count(F.lit(1)).alias("n"))


def residual_stats(df: DataFrame, by: Iterable[str] = (), residual_col: str = "residual", times: str | None = None) -> DataFrame:
    """Mean and standard deviation for the normal curve over the residuals, of which each counts ``times`` times."""
    if times:
        x, n = F.col(residual_col), F.when(F.col(residual_col).isNotNull(), F.col(times).cast("long"))
        sums = df.groupBy(*names(by)).agg(F.coalesce(F.sum(n), F.lit(0).cast("long")).alias("n"), F.try_divide(F.sum(n * x), F.sum(n)).alias("mean"), F.sum(n * x * x).alias("__sq"))
        # residuals are about zero, so nothing is lost in the difference
        variance = F.greatest(F.col("__sq") - F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0)) / (F.col("n") - 1)
        return sums.select(*names(by), "n", "mean", F.when(F.col("n") > 1, F.sqrt(variance)).alias("sd"))
    return df.groupBy(*names(by)).agg(
        F.count(residual_col).alias("n"), F.avg(residual_col).alias("mean"), F.stddev_samp(residual_col).alias("sd")
    )


def explore(
    df: DataFrame,
    resp: str,
    by: Iterable[str] = (),
    max_levels: int = 30,
    residual_col: str | None = None,
    include: Iterable[str] | None = None,
) -> dict[str, DataFrame]:
    """All exploration tables of a model's data, lazily, from the same projection."""
    by = names(by)
    require(df, resp, *by)
    skip = {resp, *by, *names(residual_col)}
    chosen = [c for c in (names(include) or df.columns) if c not in skip]
    base = df.select(*by, resp, *names(residual_col), *chosen)
    numbers, texts = numeric_columns(base, skip), character_columns(base, skip)
    out: dict[str, DataFrame] = {}
    if texts:
        out["level_counts"] = level_counts(base, texts, by, max_levels)
        out["box_summary"] = box_summary(base, resp, texts, by, max_levels)
        if len(texts) > 1:
            out["cross_counts"] = cross_counts(base, texts, by)
    out["histogram"] = histogram(base, [resp, *numbers], by)
    out["density"] = density(base, [resp, *numbers], by)
    if numbers:
        out["binned_mean"] = binned_mean(base, resp, numbers, by)
        out["pair_correlations"] = pair_correlations(base, [resp, *numbers], by)
    if residual_col:
        out["residual_stats"] = residual_stats(base, by, residual_col)
        if numbers:
            out["residual_lm"] = lm_smooth(base, residual_col, numbers, by)
        if texts:
            out["residual_box"] = box_summary(base, residual_col, texts, by, max_levels)
    return out
