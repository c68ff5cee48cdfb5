"""Where to predict."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.functions.keys import is_integral, join_same, names, require
from taxaflow.functions.text import quantile_name
from taxaflow.operators.quantiles import group_quantiles


def steps(low: Column, high: Column, step: float, whole: bool) -> Column:
    """Array ``low, low + step, ...`` up to ``high``."""
    if whole and float(step).is_integer():
        return F.sequence(low, high, F.lit(int(step)))
    count = F.floor((high - low) / step + 1e-10).cast("int")
    return F.transform(F.sequence(F.lit(0), count), lambda i: low + i * F.lit(float(step)))


def time_grid(
    data: DataFrame, by: Iterable[str], var_col: str, cat_col: str | None = "cat", pred_step: float = 1, rand_col: str | None = None, times: str | None = None
) -> DataFrame:
    """Every step from the first to the last time of each category (and random level), re-centred.

    ``var`` is the time minus the median time of all rows of the model, of which each
    counts ``times`` times.
    """
    by = names(by)
    groups = [*by, *names(cat_col), *names(rand_col)]
    require(data, *groups, var_col)
    known = data.where(F.col(var_col).isNotNull())
    for col in names(cat_col) + names(rand_col):
        known = known.where(F.col(col).isNotNull())
    spans = known.groupBy(*groups).agg(F.min(var_col).alias("__low"), F.max(var_col).alias("__high"))
    points = steps(F.col("__low"), F.col("__high"), pred_step, is_integral(data, var_col))
    grid = spans.select(*groups, F.explode(points).alias(var_col))
    centre = group_quantiles(data, by, var_col, [0.5], prefix="__centre_", few_values=True, times=times)
    return join_same(grid, centre, by).withColumn("var", F.col(var_col) - F.col("__centre_q50")).drop("__centre_q50")


def cov_quantiles(data: DataFrame, by: Iterable[str], cov_col: str = "cov", cov_q: Sequence[float] = (0.5,), times: str | None = None) -> DataFrame:
    """Covariate values at quantiles of the data, as rows ``(by, ord, cov_q, cov, log_cov)``."""
    by = names(by)
    wide = group_quantiles(data, by, cov_col, cov_q, prefix="__", few_values=True, times=times)
    pairs = F.array(*[F.struct(F.lit(quantile_name(p)).alias("cov_q"), F.col(quantile_name(p, "__")).alias("cov")) for p in cov_q])
    return _covariates(wide.select(*by, F.posexplode(F.array_sort(F.transform(pairs, lambda s: F.struct(s["cov"].alias("cov"), s["cov_q"].alias("cov_q"))))).alias("ord", "__s")), by)


def cov_values(data: DataFrame, by: Iterable[str], values: Sequence[float], cov_col: str = "cov", times: str | None = None) -> DataFrame:
    """Given covariate values, named by the percent of the data at or below them.

    The empirical distribution at all given points comes from one aggregate.
    """
    by = names(by)
    n = F.col(times) if times else F.lit(1)
    at_or_below = F.array(*[F.struct(F.lit(float(v)).alias("cov"), (F.sum(F.when(F.col(cov_col) <= v, n).otherwise(0)) / F.sum(n)).alias("share")) for v in values])
    found = data.where(F.col(cov_col).isNotNull()).groupBy(*by).agg(at_or_below.alias("__a"))
    label = lambda s: F.concat(F.lit("q"), F.bround(100 * s["share"], 0).cast("int").cast("string"))
    named = F.array_sort(F.transform("__a", lambda s: F.struct(s["cov"].alias("cov"), label(s).alias("cov_q"))))
    return _covariates(found.select(*by, F.posexplode(named).alias("ord", "__s")), by)


def _covariates(rows: DataFrame, by: list[str]) -> DataFrame:
    named = rows.select(*by, (F.col("ord") + 1).alias("ord"), F.col("__s.cov_q").alias("cov_q"), F.col("__s.cov").cast("double").alias("cov"))
    return named.withColumn("log_cov", F.when(F.col("cov") > 0, F.ln("cov")))


def prediction_grid(
    data: DataFrame,
    by: Iterable[str],
    var_col: str,
    cat_col: str | None = "cat",
    covariates: DataFrame | None = None,
    pred_step: float = 1,
    rand_col: str | None = None,
    include_random: bool = False,
    new_level: str = "State",
    log_cov: bool = True,
    binomial: bool = True,
    y_total: int = 100,
    times: str | None = None,
) -> DataFrame:
    """Times of each category at each covariate value, ready for prediction.

    ``covariates`` comes from ``cov_quantiles`` or ``cov_values`` and is joined on
    the model key.  Without ``include_random`` a random column holds ``new_level``.
    """
    by = names(by)
    grid = time_grid(data, by, var_col, cat_col, pred_step, rand_col if include_random else None, times)
    if rand_col and not include_random:
        grid = grid.withColumn(rand_col, F.lit(new_level))
    if covariates is not None:
        grid = join_same(grid, covariates, by).withColumn("use_cov", F.col("log_cov" if log_cov else "cov"))
        grid = grid.where(F.col("use_cov").isNotNull())
    if binomial:
        grid = grid.withColumns({"y": F.lit(0), "y_total": F.lit(y_total)})
    return grid


def observed_contexts(
    data: DataFrame, by: Iterable[str], context: Iterable[str], cov_col: str | None = None, unique_cov: bool = False, y_total: int = 100
) -> DataFrame:
    """Observed contexts once each, at the model's median list length.

    ``unique_cov`` takes the median over distinct list lengths instead of rows.
    """
    by, context = names(by), names(context)
    grid = data.select(*by, *context).distinct().withColumns({"y": F.lit(0), "y_total": F.lit(y_total)})
    if cov_col is None:
        return grid
    source = data.select(*by, cov_col)
    middle = group_quantiles(source.distinct() if unique_cov else source, by, cov_col, [0.5], prefix="__cov_", few_values=True)
    return join_same(grid, middle, by).withColumnRenamed("__cov_q50", "cov").withColumn("log_cov", F.when(F.col("cov") > 0, F.ln("cov")))
