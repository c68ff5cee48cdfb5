"""Design columns of a trend model, the same for fitting and for prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.functions.keys import attach, join_same
from taxaflow.operators.quantiles import group_quantiles

#: Category of a model without categories.
NO_CAT = "all"


def width(k: int | None) -> int:
    """Columns of a design row: intercept, time (``k - 1`` spline columns), covariate."""
    return 3 if k is None else k + 1


def build_design(patterns: DataFrame, by: str, k: int | None) -> DataFrame:
    """Scales, level counts and spline knots of each model.

    Knots are quantiles of the distinct times.  A covariate with one value gets
    no scale, which turns its column into zeros.
    """
    n = F.col("n_rows").cast("double")

    def spread(col: str) -> Column:
        mean = F.sum(n * F.col(col)) / F.sum(n)
        variance = F.sum(n * F.col(col) * F.col(col)) / F.sum(n) - mean * mean
        return F.when((F.count_distinct(col) > 1) & (variance > 0), F.sqrt(variance))

    has_cov = "use_cov" in patterns.columns
    design = patterns.groupBy(by).agg(
        F.coalesce(spread("var"), F.lit(1.0)).alias("var_scale"),
        (F.sum(n * F.col("use_cov")) / F.sum(n) if has_cov else F.lit(0.0)).alias("cov_centre"),
        (spread("use_cov") if has_cov else F.lit(None).cast("double")).alias("cov_scale"),
        F.sum("n_rows").alias("n_data"),
        F.sum("y").alias("__y"),
        F.sum("y_sq").alias("__y_sq"),
        (F.count_distinct("use_cov") if has_cov else F.lit(0).cast("long")).alias("n_cov"),
        F.count_distinct("cat").alias("n_cat"),
        (F.count_distinct("rand") if "rand" in patterns.columns else F.lit(0).cast("long")).alias("n_rand"),
    )
    if k is None:
        return design.withColumn("knots", F.lit(None).cast("array<double>"))
    probs = [i / (k - 1) for i in range(k)]
    wide = group_quantiles(patterns.select(by, "var").distinct(), [by], "var", probs, prefix="__", few_values=True)
    knots = wide.select(by, F.array(*[F.col(c).cast("double") for c in wide.columns if c != by]).alias("knots"))
    return join_same(design, knots, [by])


def time_columns(k: int | None) -> list[Column]:
    """Scaled time, or the natural cubic spline basis over the model's knots."""
    if k is None:
        return [F.col("var") / F.col("var_scale")]
    first, reach = F.col("knots")[0], F.col("knots")[k - 1] - F.col("knots")[0]
    x = F.coalesce(F.try_divide(F.col("var") - first, reach), F.lit(0.0))
    at = [F.coalesce(F.try_divide(F.col("knots")[i] - first, reach), F.lit(i / (k - 1))) for i in range(k)]

    def cube(knot: Column) -> Column:
        return F.pow(F.greatest(x - knot, F.lit(0.0)), F.lit(3.0))

    def part(i: int) -> Column:
        return (cube(at[i]) - cube(at[k - 1])) / (at[k - 1] - at[i])

    last = part(k - 2)
    return [x, *[part(i) - last for i in range(k - 2)]]


def with_features(rows: DataFrame, design: DataFrame, by: str, k: int | None, name: str = "u") -> DataFrame:
    """Add the design row as an array; rows need ``var`` and, if modelled, ``use_cov``."""
    joined = attach(rows, design.select(by, "var_scale", "cov_centre", "cov_scale", "knots"), [by], "inner")
    cov = (F.col("use_cov") - F.col("cov_centre")) / F.col("cov_scale") if "use_cov" in rows.columns else F.lit(0.0)
    cov = F.when(F.col("cov_scale").isNull(), F.lit(0.0)).otherwise(cov)
    features = F.array(F.lit(1.0), *time_columns(k), cov)
    return joined.withColumn(name, features).drop("var_scale", "cov_centre", "cov_scale", "knots")


def dot(u: Column, beta: Column, q: int) -> Column:
    """Product of a design row and coefficients of length ``q``."""
    total = u[0] * beta[0]
    for i in range(1, q):
        total = total + u[i] * beta[i]
    return total
