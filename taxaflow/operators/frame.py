"""Model frames: generic columns, usable terms, covariate patterns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.functions.keys import attach, count_levels, names, nan_to_null, require
from taxaflow.functions.links import clamp_proportion
from taxaflow.operators.quantiles import group_quantiles


def model_frame(
    df: DataFrame,
    by: str | Iterable[str],
    y: str,
    y_total: str | None = None,
    var_col: str | None = "var",
    cat_col: str | None = "cat",
    cov_col: str | None = "cov",
    random_col: str | None = None,
    log_cov: bool = True,
    beta: bool = False,
    times: str | None = None,
) -> DataFrame:
    """Original columns plus ``y, y_total, var, cat, rand, cov, log_cov, use_cov``.

    ``var`` is centred on its median in the model.  The logarithm of a covariate
    at or below zero is null.  ``times`` names a column that says how many equal
    records a row stands for.
    """
    by = names(by)
    chosen = {"y": y, "y_total": y_total, "cat": cat_col, "rand": random_col, "cov": cov_col}
    require(df, *by, *[c for c in [*chosen.values(), var_col] if c])
    if var_col:
        centre = group_quantiles(df, by, var_col, [0.5], prefix="__centre_", few_values=True, times=times)
        df = attach(df, centre, by).withColumn("__var", F.col(var_col) - F.col("__centre_q50")).drop("__centre_q50")
    out = df.withColumns({name: F.col(col) for name, col in chosen.items() if col})
    if var_col:
        out = out.withColumn("var", F.col("__var")).drop("__var")
    out = out.withColumn("y", F.col("y").cast("double"))
    if y_total:
        out = out.withColumn("y_total", F.col("y_total").cast("double"))
    if cov_col:
        out = nan_to_null(out.withColumn("cov", F.col("cov").cast("double")), "cov")
        out = out.withColumn("log_cov", F.when(F.col("cov") > 0, F.ln("cov")))
        out = out.withColumn("use_cov", F.col("log_cov" if log_cov else "cov"))
    return out.withColumn("y", clamp_proportion(F.col("y"))) if beta else out


def model_levels(frame: DataFrame, by: str | Iterable[str]) -> DataFrame:
    """Level counts of covariate, category and random factor, 0 where the model has none."""
    by = names(by)

    def levels(col: str):
        return count_levels(col) if col in frame.columns else F.lit(0).cast("long")

    unusable = F.count_if(F.col("cov").isNotNull() & F.col("use_cov").isNull()) if "use_cov" in frame.columns else F.lit(0).cast("long")
    return frame.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_data"),
        levels("use_cov").alias("n_cov"),
        levels("cat").alias("n_cat"),
        levels("rand").alias("n_rand"),
        unusable.alias("n_bad_cov"),
    )


def term_selection(
    frame: DataFrame, by: str | Iterable[str], mod_type: str = "glm", rand_slope: bool = True
) -> DataFrame:
    """Terms of each model: covariate, category and random terms need more than one level."""
    if mod_type not in ("glm", "gam"):
        raise ValueError(f"unknown model type {mod_type!r}")
    spline = mod_type == "gam"
    usable = {
        "s(var)" if spline else "var": F.lit(True),
        "use_cov": F.col("n_cov") > 1,
        "cat": F.col("n_cat") > 1,
        "s(var, by=cat)" if spline else "var:cat": F.col("n_cat") > 1,
        "(var | rand)" if rand_slope else "(1 | rand)": F.col("n_rand") > 1,
    }
    terms = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in usable.items()]))
    bad = F.col("n_bad_cov")
    message = F.when(bad > 0, F.concat(bad.cast("string"), F.lit(" rows without a logarithm of the covariate")))
    return model_levels(frame, by).withColumns({"terms": terms, "message": message})


def compress_patterns(frame: DataFrame, by: str | Iterable[str], times: str | None = None) -> DataFrame:
    """Sum successes and trials over rows with equal predictors: exact for binomial responses.

    Squares are kept as well, which makes it exact for the other families too.  A row
    counts ``times`` times.
    """
    predictors = [c for c in ("var", "use_cov", "cat", "rand") if c in frame.columns]
    trials = F.col("y_total") if "y_total" in frame.columns else F.lit(1.0)
    n = F.col(times).cast("long") if times else F.lit(1).cast("long")
    return frame.groupBy(*names(by), *predictors).agg(
        F.sum(n * F.col("y")).alias("y"),
        F.sum(n * trials).alias("y_total"),
        F.sum(n * F.col("y") * F.col("y")).alias("y_sq"),
        F.sum(n).alias("n_rows"),
    )
