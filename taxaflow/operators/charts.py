"""Chart-ready tables: the data behind each figure."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.functions.keys import join_same, names, require
from taxaflow.functions.likelihood import LIKELIHOOD, Scale, add_likelihood
from taxaflow.functions.text import quantile_name
from taxaflow.operators.explore import density_of
from taxaflow.operators.reporting import latest_time, points_at
from taxaflow.operators.summary import sample_draws

# The nested intervals of the interval chart, widest first.
INTERVALS = ("q01", "q99", "q10", "q90", "q25", "q75", "q50")


def interval_table(res: DataFrame, keys: Iterable[str], likelihood_col: str = "pos_raw", scale: Scale = LIKELIHOOD) -> DataFrame:
    """Nested intervals and the likelihood that colours them."""
    keys = names(keys)
    require(res, *keys, *INTERVALS, likelihood_col)
    return add_likelihood(res.select(*keys, *INTERVALS, likelihood_col), likelihood_col, scale)


def interval_points(raw: DataFrame, intervals: DataFrame, x: str = "year", facet_col: str | None = None, facet: str | None = None) -> DataFrame:
    """Raw rows at the times shown; ``facet`` places them all in one panel."""
    shown = points_at(raw, intervals, [x])
    return shown.withColumn(facet_col, F.lit(facet)) if facet_col and facet is not None else shown


def spaghetti_table(pred: DataFrame, keys: Iterable[str], n: int = 500, by: Iterable[str] = (), seed: int = 1) -> DataFrame:
    """Sampled draws as lines: one row per key and draw, flagged divergent if ``pred`` carries flags."""
    keys = names(keys)
    arrays = ["pred", *(["divergent"] if "divergent" in pred.columns else [])]
    rows = pred.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("draw", "__s"))
    rows = rows.select(*keys, "draw", *[F.col(f"__s.{a}").alias(a) for a in arrays])
    return sample_draws(rows.where(F.col("pred").isNotNull()), n, by, seed=seed)


def ribbon_table(res: DataFrame, keys: Iterable[str], res_q: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Median and outer quantiles along time, for each summary row."""
    keys = names(keys) + (["divergent"] if "divergent" in res.columns else [])
    low, high = quantile_name(min(res_q)), quantile_name(max(res_q))
    middle = quantile_name(sorted(res_q)[len(res_q) // 2])
    return res.select(*keys, F.col(middle).alias("middle"), F.col(low).alias("low"), F.col(high).alias("high"))


def change_density(
    pred: DataFrame,
    res: DataFrame,
    keys: Iterable[str],
    var_col: str,
    diff_direction: str = "positive",
    diff_category: str | None = None,
    recent: float | None = None,
    by: Iterable[str] = (),
    points: int = 128,
    scale: Scale = LIKELIHOOD,
) -> DataFrame:
    """Density of change draws per category at the latest test time, with the likelihood of the direction."""
    by, keys = names(by), names(keys)
    now = latest_time(pred.where(F.size(F.filter("diff", lambda x: x.isNotNull())) > 0), by, var_col, recent) if (
        by or recent is not None
    ) else pred.where(F.col(var_col) == F.lit(pred.agg(F.max(var_col)).first()[0]))
    judged = add_likelihood(res.select(*keys, diff_direction), diff_direction, scale)
    joined = join_same(now, judged, keys, "inner")
    if diff_category is None:
        joined, diff_category = joined.withColumn("all", F.lit("all")), "all"
    groups = [*by, diff_category, "likelihood"]
    long = joined.select(*groups, F.explode("diff").alias("value")).where(F.col("value").isNotNull())
    return density_of(long, groups, points)


def parameter_rows(draws: DataFrame, terms: DataFrame, by: str = "model_id") -> DataFrame:
    """Draws of every coefficient with its name and divergence, for pairs and parallel-coordinate charts.

    ``draws`` has ``beta`` arrays, ``terms`` the coefficient names in the same order.
    """
    joined = join_same(draws, terms.select(by, "coefficients"), [by], "inner")
    named = F.posexplode(F.arrays_zip(F.col("coefficients").alias("parameter"), F.col("beta").alias("value"))).alias("__i", "__s")
    kept = [c for c in ("draw", "chain", "divergent") if c in draws.columns]
    return joined.select(by, *kept, named).select(by, *kept, "__s.parameter", "__s.value")
