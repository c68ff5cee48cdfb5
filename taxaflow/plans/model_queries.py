"""Queries that fit trend models to the occurrence records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.functions.keys import join_same, names
from taxaflow.models.predict import residuals
from taxaflow.operators import summary as S
from taxaflow.operators.contrast import year_diff_draws
from taxaflow.operators.diagnostics import coefficient_counts
from taxaflow.operators.explore import residual_stats
from taxaflow.plans.catalog import LISTED, OCC, query, r
from taxaflow.plans.record_queries import counted, occurrences
from taxaflow.plans.trends import change_since, list_length_model, model_results, occupancy_model, reporting_rate_model
from taxaflow.session import durable

DRAWS = 1000
#: Draws where every level has rows of its own.
FEW = 200

# A binary time makes the logistic model saturated, so its coefficients have a closed form.
_SATURATED = f"""{OCC}, x AS (SELECT taxa, region, CAST(quantity > 25 AS INTEGER) AS late, success FROM occ),
med AS (SELECT taxa, quantile_cont(late, 0.5) AS m FROM x GROUP BY taxa),
p AS (SELECT taxa, region,
             1e0 / sum(success) FILTER (WHERE late = 0) + 1e0 / (count(*) FILTER (WHERE late = 0) - sum(success) FILTER (WHERE late = 0)) AS v0,
             1e0 / sum(success) FILTER (WHERE late = 1) + 1e0 / (count(*) FILTER (WHERE late = 1) - sum(success) FILTER (WHERE late = 1)) AS v1,
             ln(sum(success) FILTER (WHERE late = 0) / (count(*) FILTER (WHERE late = 0) - sum(success) FILTER (WHERE late = 0))) AS l0,
             ln(sum(success) FILTER (WHERE late = 1) / (count(*) FILTER (WHERE late = 1) - sum(success) FILTER (WHERE late = 1))) AS l1
      FROM x GROUP BY ALL),
own AS (SELECT taxa, region, l0 + (l1 - l0) * m AS a, l1 - l0 AS b, (1 - m) * (1 - m) * v0 + m * m * v1 AS va, v0 + v1 AS vb, row_number() OVER (PARTITION BY taxa ORDER BY region) AS i FROM p JOIN med USING (taxa)),
ref AS (SELECT taxa, a AS a0, b AS b0, va AS va0, vb AS vb0 FROM own WHERE i = 1)"""


def saturated(spark, folder):
    data = occurrences(spark, folder).withColumn("late", (F.col("quantity") > 25).cast("int"))
    return list_length_model(data, "taxa", "success", var_col="late", cat_col="region", cov_col=None, prior_scale=None, n_draws=10)


@query(
    "fit_glm",
    f"""WITH {_SATURATED} SELECT taxa, '(Intercept)' AS term, {r('a0')} AS estimate, {r('sqrt(va0)')} AS sd FROM ref
        UNION ALL SELECT taxa, 'var', {r('b0')}, {r('sqrt(vb0)')} FROM ref
        UNION ALL SELECT taxa, 'cat' || region, {r('a - a0')}, {r('sqrt(va + va0)')} FROM own JOIN ref USING (taxa) WHERE i > 1
        UNION ALL SELECT taxa, 'var:cat' || region, {r('b - b0')}, {r('sqrt(vb + vb0)')} FROM own JOIN ref USING (taxa) WHERE i > 1""",
)
def _(spark, folder):
    return saturated(spark, folder)[1].coef


@query(
    "fit_gaussian",
    f"""WITH {OCC}, med AS (SELECT taxa, quantile_cont(year, 0.5) AS m FROM occ GROUP BY taxa),
        f AS (SELECT taxa, regr_slope(ln(price), year - m) AS b, regr_intercept(ln(price), year - m) AS a,
                     (regr_syy(ln(price), year - m) - regr_sxy(ln(price), year - m) ** 2 / regr_sxx(ln(price), year - m)) / (count(*) - 2) AS phi,
                     regr_sxx(ln(price), year - m) AS sxx, avg(year - m) AS mx, count(*) AS n FROM occ JOIN med USING (taxa) GROUP BY taxa)
        SELECT taxa, '(Intercept)' AS term, {r('a')} AS estimate, {r('sqrt(phi * (1e0 / n + mx * mx / sxx))')} AS sd FROM f
        UNION ALL SELECT taxa, 'var', {r('b')}, {r('sqrt(phi / sxx)')} FROM f""",
)
def _(spark, folder):
    data = occurrences(spark, folder).withColumn("log_price", F.ln("price"))
    fit = list_length_model(data, "taxa", "log_price", family="gaussian", cov_col=None, prior_scale=None, n_draws=10)[1]
    return fit.coef


def list_length_fit(spark, folder, **options):
    data = counted(spark, folder, *names(options.get("random_col")))
    return list_length_model(data, "taxa", "success", cat_col="region", times="times", **{"n_draws": DRAWS, **options})


def judged(fit, rows, name="converged"):
    """``rows`` with whether the model they come from has converged."""
    return join_same(rows, fit.spec.select(fit.by, F.col("converged").alias(name)), [fit.by])


@query("fit_list_length")
def _(spark, folder):
    return list_length_fit(spark, folder)[1].coef


@query("model_status")
def _(spark, folder):
    return coefficient_counts(list_length_fit(spark, folder)[1].spec).select(
        "taxa", "n_data", "n_cov", "n_cat", "n_fixed_coefs", "n_random_coefs", "has_cov", "status", "converged", "message"
    )


@query("fit_spline")
def _(spark, folder):
    fit = list_length_fit(spark, folder, mod_type="gam")[1]
    return join_same(fit.weights, fit.spec.select("taxa", "weight_all", "iterations", "converged", "status"), ["taxa"])


@query("fit_random")
def _(spark, folder):
    fit = list_length_fit(spark, folder, random_col="site", rand_slope=False)[1]
    return judged(fit, fit.coef)


def scores(frame, fit, prior_scale=2.5):
    """Per model, the largest score of its log posterior at the estimates, in standard errors.

    It is made from the records and the table of estimates by name, not from the fit's
    own equations: at the estimates all scores are zero, of coefficients and levels.
    Rows of the frame count ``times`` times; their sums per category and level are
    stored, so each row meets its level once.
    """
    by = fit.by
    wide = fit.coef.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("term", "estimate"))).alias("beta"))
    models = durable(join_same(wide, fit.design.select(by, "var_scale", "cov_centre", "cov_scale"), [by], "inner"))
    rand = [] if fit.levels is None else ["rand"]
    rows = join_same(frame.select(by, "cat", *rand, "var", "use_cov", "y", "times"), models, [by], "inner")
    at = lambda name: F.coalesce(F.col("beta")[name], F.lit(0.0))
    cat = F.concat(F.lit("cat"), F.col("cat"))
    slope = at(F.lit("var")) + at(F.concat(F.lit("var:"), cat))
    eta = at(F.lit("(Intercept)")) + at(cat) + slope * F.col("var") + at(F.lit("use_cov")) * F.col("use_cov")
    if rand:
        levels = fit.levels.select(by, "rand", F.col("b")[0].alias("b"))
        rows, eta = join_same(rows, levels, [by, "rand"]), eta + F.col("b")
    mu, n = 1 / (1 + F.exp(-eta)), F.col("times")
    left, info = n * (F.col("y") - mu), n * mu * (1 - mu)
    units = {"1": F.lit(1.0), "x": F.col("var") / F.col("var_scale"), "z": (F.col("use_cov") - F.col("cov_centre")) / F.col("cov_scale")}
    sums = [f(part * u ** (1 + (name == "i"))).alias(f"{name}{k}") for k, u in units.items() for name, part, f in (("g", left, F.sum), ("i", info, F.sum))]
    summed = durable(rows.groupBy(by, "cat", *rand).agg(*sums, *[F.first(x).alias(x) for x in (["b"] if rand else [])]))
    rows = join_same(summed, models, [by], "inner")
    if rand:
        rows = join_same(rows, fit.spec.select(by, F.col("sigma")[0].alias("s")), [by])
    weak = prior_scale**-2

    def score(groups, x, estimate, known=F.lit(1.0)):
        grouped = rows.groupBy(*groups).agg(F.sum(F.col(f"g{x}") * known).alias("g"), F.sum(F.col(f"i{x}") * known).alias("i"), F.first(estimate).alias("e"))
        off = F.coalesce(F.col("g") - F.col("e"), F.lit(0.0)) / F.sqrt(F.greatest(F.col("i"), F.lit(1e-6)))
        return grouped.select(by, F.abs(off).alias("off"))

    none = F.lit(0.0)
    pieces = [
        score([by], "1", none),
        score([by], "x", weak * at(F.lit("var")) * F.col("var_scale")),
        score([by], "z", weak * at(F.lit("use_cov")) * F.col("cov_scale")),
    ]
    # the first category is the reference: what it leaves over belongs to the shared coefficients
    for x, estimate in (("1", at(cat)), ("x", at(F.concat(F.lit("var:"), cat)) * F.col("var_scale"))):
        pieces.append(score([by, "cat"], x, weak * estimate, F.when(F.col("beta")[cat].isNotNull(), F.lit(1.0)).otherwise(none)))
    if rand:
        pieces.append(score([by, "rand"], "1", F.when(F.col("s") > 0, F.col("b") / F.col("s"))))
    return reduce(DataFrame.unionByName, pieces).groupBy(by).agg(F.max("off").alias("off"))


@query("model_results")
def _(spark, folder):
    frame, fit = list_length_fit(spark, folder)
    return model_results(frame, fit, ref=-3, n_draws=DRAWS, times="times")["res"]


@query("residuals_of_fit")
def _(spark, folder):
    frame, fit = list_length_fit(spark, folder)
    return residual_stats(residuals(fit, frame), ["taxa"], times="times")


_STATIONARY = f"WITH {LISTED} SELECT taxa, TRUE AS converged, 0e0 AS score FROM listed WHERE list_length IS NOT NULL GROUP BY taxa"


@query("fit_list_length_score", _STATIONARY)
def _(spark, folder):
    """The scores of the list-length models, which are zero where the fit has found the largest posterior."""
    frame, fit = list_length_fit(spark, folder)
    return judged(fit, scores(frame, fit).select("taxa", F.round("off", 3).alias("score")))


@query("fit_random_score", _STATIONARY)
def _(spark, folder):
    """The same with a random intercept for each site; the scores of the levels are among them."""
    frame, fit = list_length_fit(spark, folder, random_col="site", rand_slope=False)
    return judged(fit, scores(frame, fit).select("taxa", F.round("off", 3).alias("score")))


@query("model_results_random")
def _(spark, folder):
    """Predictions for every nation of a region with its own effect, and for a nation not seen yet."""
    frame, fit = list_length_fit(spark, folder, random_col="nation", rand_slope=False, n_draws=FEW)
    known = model_results(frame, fit, ref=-3, n_draws=FEW, include_random=True, cov_val=[3], times="times")["res"]
    unseen = model_results(frame, fit, ref=-3, n_draws=FEW, new_level=True, cov_val=[3], times="times")["res"]
    return known.unionByName(unseen.withColumn("rand", F.lit("a new level")), allowMissingColumns=True)


@query("rr_trend")
def _(spark, folder):
    counts = occurrences(spark, folder).groupBy("taxa", "year", "region", "nation").agg(
        F.sum("success").alias("success"), F.count("success").alias("trials")
    )
    frame, fit = reporting_rate_model(counts, "taxa", ["region"], "nation", n_draws=DRAWS)
    return judged(fit, S.change_summary(change_since(frame, fit, 1996, 2000, "region"), ["taxa", "region"]))


@query("occ_trend")
def _(spark, folder):
    _, frame, fit = occupancy_model(occurrences(spark, folder), "kind", ["region"], "site", n_draws=DRAWS)
    return judged(fit, S.change_summary(change_since(frame, fit, 1996, 2000, "region"), ["kind", "region"]))


@query("overall_of_models")
def _(spark, folder):
    """Reporting-rate and occupancy models of the same taxa, stacked and judged together."""
    occ = occurrences(spark, folder)
    counts = occ.groupBy("kind", "year", "region").agg(F.sum("success").alias("success"), F.count("success").alias("trials"))
    rate_frame, rate = reporting_rate_model(counts, "kind", ["region"], None, n_draws=DRAWS)
    _, cell_frame, cell = occupancy_model(occ, "kind", ["region"], "site", n_draws=DRAWS)
    models = {
        name: year_diff_draws(change_since(frame, fit, 1996, 2000, "region")).select("kind", "region", "draw", "diff")
        for name, frame, fit in (("reporting rate", rate_frame, rate), ("occupancy", cell_frame, cell))
    }
    return judged(rate, judged(cell, S.overall_change(S.stack_models(models), ["kind"]), "occupancy_converged"), "rate_converged")
