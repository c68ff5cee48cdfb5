"""Trend analyses from records to statements, for all taxa at once."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.functions.keys import join_same, names, require
from taxaflow.functions.links import OCCUPANCY_MARGIN, clamp_proportion
from taxaflow.models.fit import TrendFit, fit_trend
from taxaflow.models.predict import epred_draws
from taxaflow.operators.contrast import contrast, year_diff
from taxaflow.operators.frame import compress_patterns, model_frame
from taxaflow.operators.grid import cov_quantiles, cov_values, observed_contexts, prediction_grid
from taxaflow.operators.occupancy import occupancy_fit
from taxaflow.operators.summary import RES_Q, posterior_summary
from taxaflow.session import durable

# Spline knots of the list-length, reporting-rate and occupancy models.
K_LIST_LENGTH = 6
K_OTHER = 4


def list_length_model(
    df: DataFrame,
    by: str,
    y: str,
    y_total: str | None = None,
    var_col: str = "year",
    cat_col: str | None = None,
    cov_col: str | None = "list_length",
    random_col: str | None = None,
    log_cov: bool = True,
    rand_slope: bool = True,
    mod_type: str = "glm",
    family: str = "binomial",
    k: int = K_LIST_LENGTH,
    times: str | None = None,
    **fit_options,
) -> tuple[DataFrame, TrendFit]:
    """List-length-corrected reporting rate of every model in ``by``: its frame and its fit.

    ``times`` names a column that says how many equal records a row stands for.
    """
    if mod_type not in ("glm", "gam"):
        raise ValueError(f"unknown model type {mod_type!r}")
    if family == "binomial" and y_total is None:
        df, y_total = df.withColumn("__one", F.lit(1)), "__one"
    frame = model_frame(df, by, y, y_total, var_col, cat_col, cov_col, random_col, log_cov, beta=family == "beta", times=times)
    patterns = compress_patterns(frame, by, times)
    return frame.drop("__one"), fit_trend(
        patterns, by, family, k if mod_type == "gam" else None, rand_slope, **fit_options
    )


def model_results(
    frame: DataFrame,
    fit: TrendFit,
    ref: str | float = -20,
    var_col: str = "year",
    pred_step: float = 1,
    cov_q: Sequence[float] = (0.5,),
    res_q: Sequence[float] = RES_Q,
    ps_thresh: float = 0.05,
    n_draws: int = 1000,
    binomial: bool = True,
    include_random: bool = False,
    new_level: bool = False,
    cov_val: Sequence[float] | None = None,
    times: str | None = None,
) -> dict[str, DataFrame]:
    """Predictions on a grid, their contrast with ``ref``, and one summary row per prediction.

    A binomial prediction is a proportion, and ``ps_thresh`` a difference of
    proportions.  Predictions are made at the centre of the random effects, or with
    ``new_level`` for a level drawn from them.  With ``include_random`` every level has
    rows of its own (column ``rand``), from its first to its last time, with its own
    effects; the fit must have levels then.  ``cov_val`` gives values of the covariate
    in place of the quantiles ``cov_q``; they are named by the percent of data up to them.
    A row of the frame counts ``times`` times.
    """
    by = fit.by
    if include_random and (fit.levels is None or "rand" not in frame.columns):
        raise ValueError("the fit has no random levels to include")
    covariates = None
    if "cov" in frame.columns:
        covariates = cov_quantiles(frame, [by], "cov", cov_q, times) if cov_val is None else cov_values(frame, [by], cov_val, times=times)
    data = frame if "cat" in frame.columns else frame.withColumn("cat", F.lit("all"))
    rand = ["rand"] if include_random else []
    grid = prediction_grid(data, [by], var_col, "cat", covariates, pred_step, *rand, include_random=include_random, binomial=binomial, times=times)
    pred = epred_draws(fit, grid, include_random, new_level)
    keys = [by, *rand, *(["cov"] if covariates is not None else [])]
    contrasted = contrast(pred, ref, var_col, "cat", keys)
    every = [by, "cat", *rand, var_col, *(["cov_q", "cov"] if covariates is not None else [])]
    return {"pred": contrasted, "res": posterior_summary(contrasted, every, n_draws, res_q, ps_thresh)}


def reporting_rate_model(
    df: DataFrame, taxa_col: str, geo_cols: Iterable[str], random_col: str | None = "grid_l", time_col: str = "year",
    success_col: str = "success", trials_col: str = "trials", **fit_options,
) -> tuple[DataFrame, TrendFit]:
    """Binomial spline of time by geography (the last of ``geo_cols``) with a random intercept per grid cell."""
    geo = names(geo_cols)[-1]
    require(df, taxa_col, geo, time_col, success_col, trials_col)
    frame = model_frame(df, taxa_col, success_col, trials_col, time_col, geo, None, random_col)
    return frame, fit_trend(compress_patterns(frame, taxa_col), taxa_col, "binomial", K_OTHER, False, **fit_options)


def occupancy_model(
    df: DataFrame, taxa_col: str, geo_cols: Iterable[str], site_col: str = "grid_l", time_col: str = "year",
    success_col: str = "success", **fit_options,
) -> tuple[DataFrame, DataFrame, TrendFit]:
    """Occupancy per year and geography, then a Beta-response spline of time by geography."""
    geo_cols = names(geo_cols)
    cells = durable(occupancy_fit(df, geo_cols, [site_col], [taxa_col], time_col, success_col))
    usable = cells.where(F.col("occ").isNotNull()).withColumn("occ", clamp_proportion(F.col("occ"), OCCUPANCY_MARGIN))
    frame = model_frame(usable, taxa_col, "occ", None, time_col, geo_cols[-1], None, None)
    fit = fit_trend(compress_patterns(frame, taxa_col), taxa_col, "beta", K_OTHER, False, **fit_options)
    return cells, frame, fit


def change_since(
    frame: DataFrame, fit: TrendFit, reference: int, recent: int, geo_col: str, time_col: str = "year", cov_col: str | None = None, limit_preds: bool = True
) -> DataFrame:
    """Change draws per model and geography between two times, at the median covariate.

    Only geographies whose own data reach both times are compared.
    """
    by = fit.by
    contexts = observed_contexts(frame, [by], ["cat"], cov_col)
    tests = F.array(*[F.struct(F.lit(t).alias(time_col)) for t in (reference, recent)])
    centre = frame.groupBy(by).agg(F.first(F.col(time_col) - F.col("var")).alias("__centre"))
    grid = join_same(contexts.select(*contexts.columns, F.inline(tests)), centre, [by], "inner")
    grid = grid.withColumn("var", F.col(time_col) - F.col("__centre")).drop("__centre")
    if cov_col:
        grid = grid.withColumn("use_cov", F.col("log_cov"))
    pred = epred_draws(fit, grid).withColumn(geo_col, F.col("cat"))
    return year_diff(pred, frame, [by, geo_col], reference, recent, time_col, limit_preds)
