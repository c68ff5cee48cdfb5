"""Expected-value draws on a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.functions import draws as D
from taxaflow.functions.keys import attach, join_same
from taxaflow.functions.links import inverse_link
from taxaflow.models.design import NO_CAT, dot, width, with_features
from taxaflow.models.fit import TrendFit


def epred_draws(
    fit: TrendFit, grid: DataFrame, include_random: bool = False, new_level: bool = False, seed: int = 1, cat_col: str = "cat", rand_col: str = "rand"
) -> DataFrame:
    """Add ``pred``: one expected value per draw for every grid row.

    With ``include_random`` a level of the fit gets its effect, drawn together with the
    coefficients: its mean moves with those of the draw, and intercept and slope have
    their covariance given them.  Other levels, and all rows without
    ``include_random``, are predicted at the centre of the random effects, or with
    ``new_level`` for a level drawn from their distribution.
    """
    q, by = width(fit.k), fit.by
    rows = with_features(grid, fit.design, by, fit.k, "__u")
    rows = rows.withColumn("__cat", F.col(cat_col).cast("string") if cat_col in grid.columns else F.lit(NO_CAT))
    draws = fit.draws.withColumnRenamed("cat", "__cat").withColumnRenamed("draws", "__draws")
    rows = join_same(rows, draws, [by, "__cat"], "inner")
    eta = F.transform("__draws", lambda beta: dot(F.col("__u"), beta, q))
    known = include_random and fit.levels is not None and rand_col in grid.columns
    if fit.levels is not None and (known or new_level):
        level = F.col(rand_col).cast("string") if rand_col in grid.columns else F.lit(None).cast("string")
        mean, spread = F.lit(None).cast("array<double>"), F.lit(None).cast("array<double>")
        if known:
            levels = fit.levels.select(by, F.col("rand").alias(rand_col), F.col("b").alias("__b"), F.col("v").alias("__v"))
            rows = join_same(rows, levels, [by, rand_col])
            rows = join_same(rows, _moves(fit, grid.select(by, F.col(rand_col).alias("rand")).distinct(), q).withColumnRenamed("rand", rand_col), [by, rand_col])
            mean, spread = F.col("__b"), F.col("__v")
        if new_level:
            rows = join_same(rows, fit.spec.select(by, F.col("sigma").alias("__sigma")), [by])
            spread = F.coalesce(spread, F.col("__sigma"))
        model = F.coalesce(F.col(by).cast("string"), F.lit(""))
        if not known:
            rows = rows.withColumn("__move", F.lit(None).cast("array<struct<b0:double,b1:double>>"))
        rows = rows.withColumn("__effect", _effects(mean, spread, F.size("__draws"), F.xxhash64(F.lit(seed), model, level)))
        part = lambda i, b: F.col("__effect")[i][b] + F.coalesce(F.col("__move")[i][b], F.lit(0.0))
        effect = lambda i: part(i, "b0") + part(i, "b1") * F.col("__u")[1]
        eta = F.transform("__draws", lambda beta, i: dot(F.col("__u"), beta, q) + effect(i))
    pred = F.transform(eta, lambda x: inverse_link(x, fit.link))
    return rows.withColumn("pred", pred).drop("__u", "__cat", "__draws", "__b", "__v", "__sigma", "__effect", "__move")


def _moves(fit: TrendFit, wanted: DataFrame, q: int) -> DataFrame:
    """Per wanted level, how far each draw of the coefficients moves the mean of its effects (``__move``).

    A level adds up what the coefficients of its categories do; usually it has one.
    """
    links = join_same(fit.links, wanted, [fit.by, "rand"], "left_semi")
    rows = join_same(links, fit.draws, [fit.by, "cat"], "inner")

    def along(draw: Column, first: int) -> Column:
        return sum((F.col("move")[first + j] * (draw[j] - F.col("beta")[j]) for j in range(1, q)), F.col("move")[first] * (draw[0] - F.col("beta")[0]))

    slope = lambda draw: F.when(F.size("move") > q, along(draw, q)).otherwise(F.lit(0.0))
    moved = F.transform("draws", lambda draw: F.struct(along(draw, 0).alias("b0"), slope(draw).alias("b1")))
    parts = rows.select(fit.by, "rand", moved.alias("__part")).groupBy(fit.by, "rand").agg(F.collect_list("__part").alias("__parts"))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: F.struct((x["b0"] + y["b0"]).alias("b0"), (x["b1"] + y["b1"]).alias("b1")))
    total = F.aggregate(F.slice("__parts", 2, F.size("__parts")), F.col("__parts")[0], add)
    return parts.select(fit.by, "rand", total.alias("__move"))


def _effects(mean: Column, covariance: Column, n: Column, key: Column) -> Column:
    """Draws of (intercept, slope) effects of a level: the mean and a Cholesky factor times normals made from hashes of ``key``."""

    def uniform(i: Column, part: int) -> Column:
        return (F.pmod(F.xxhash64(key, i, F.lit(part)), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    def normal(i: Column, part: int) -> Column:
        return F.sqrt(-2 * F.ln(uniform(i, 2 * part))) * F.cos(6.283185307179586 * uniform(i, 2 * part + 1))

    at = lambda array, i: F.coalesce(F.try_element_at(array, F.lit(i)), F.lit(0.0))
    low = F.sqrt(F.greatest(at(covariance, 1), F.lit(0.0)))
    across = F.coalesce(F.try_divide(at(covariance, 2), low), F.lit(0.0))
    rest = F.sqrt(F.greatest(at(covariance, 4) - across * across, F.lit(0.0)))
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            (at(mean, 1) + low * normal(i, 0)).alias("b0"), (at(mean, 2) + across * normal(i, 0) + rest * normal(i, 1)).alias("b1")
        ),
    )


def residuals(fit: TrendFit, frame: DataFrame, include_random: bool = False) -> DataFrame:
    """Posterior-mean fitted value and residual of every row of the model frame.

    Draws are made once for each different combination of predictors; rows only
    get the mean back, so no row meets an array of draws.
    """
    predictors = [c for c in (fit.by, "var", "use_cov", "cat", *(["rand"] if include_random else [])) if c in frame.columns]
    patterns = epred_draws(fit, frame.select(*predictors).distinct(), include_random)
    means = patterns.select(*predictors, D.mean(F.col("pred")).alias("fitted"))
    observed = F.try_divide(F.col("y"), F.col("y_total")) if "y_total" in frame.columns else F.col("y")
    return attach(frame, means, predictors, "inner").withColumn("residual", observed - F.col("fitted"))
