"""Queries that look at model data."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxaflow.functions.links import proportion
from taxaflow.operators import explore as X
from taxaflow.operators.frame import compress_patterns, model_frame, model_levels, term_selection
from taxaflow.operators.grid import cov_quantiles, cov_values, observed_contexts, prediction_grid, time_grid
from taxaflow.plans.catalog import LISTED, OCC, query, r
from taxaflow.plans.record_queries import counted, listed, occurrences

NUMBERS = ("price", "quantity", "discount", "size")
TEXTS = ("region", "nation", "kind")


def _long(cols, source="occ", keep=""):
    return " UNION ALL ".join(
        f"SELECT {keep}'{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM {source}" for c in cols
    )


def _levels(cols, keep="", source="occ"):
    return " UNION ALL ".join(f"SELECT {keep}'{c}' AS variable, {c} AS level FROM {source}" for c in cols)


@query(
    "level_counts",
    f"""WITH {OCC}, l AS ({_levels(TEXTS)}), c AS (SELECT variable, level, count(*) AS n FROM l GROUP BY ALL),
        s AS (SELECT variable, count(*) AS levels FROM c GROUP BY ALL)
        SELECT variable, level, n, levels FROM c JOIN s USING (variable) WHERE levels < 30""",
)
def _(spark, folder):
    return X.level_counts(occurrences(spark, folder), TEXTS, max_levels=30)


@query(
    "box_summary",
    f"""WITH {OCC}, l AS ({_levels(('region', 'nation'), 'price AS v, ')}),
        q AS (SELECT variable, level, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM l GROUP BY ALL)
        SELECT variable, level, count(*) AS n, {r('q1')} AS q25, {r('q2')} AS q50, {r('q3')} AS q75,
               {r('min(CASE WHEN v BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1) THEN v END)')} AS whisker_low,
               {r('max(CASE WHEN v BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1) THEN v END)')} AS whisker_high,
               count(*) FILTER (WHERE v NOT BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1)) AS outliers
        FROM l JOIN q USING (variable, level) GROUP BY variable, level, q1, q2, q3""",
)
def _(spark, folder):
    return X.box_summary(occurrences(spark, folder), "price", ["region", "nation"])


_BINNED = """ranges AS (SELECT variable, min(value) AS lo, max(value) AS hi FROM l GROUP BY ALL),
placed AS (SELECT l.*, lo, hi, CAST(least(coalesce(floor((value - lo) / nullif(hi - lo, 0) * {bins}), 0), {bins} - 1) AS INTEGER) + 1 AS bin
           FROM l JOIN ranges USING (variable))"""


@query(
    "histogram",
    f"""WITH {OCC}, l AS ({_long(NUMBERS)}), {_BINNED.format(bins=30)}
        SELECT variable, bin, count(*) AS n, {r('lo + (hi - lo) / 30 * (bin - 1)')} AS bin_low, {r('lo + (hi - lo) / 30 * bin')} AS bin_high
        FROM placed GROUP BY variable, bin, lo, hi""",
)
def _(spark, folder):
    return X.histogram(occurrences(spark, folder), NUMBERS)


@query(
    "binned_mean",
    f"""WITH {OCC}, l AS ({_long(NUMBERS, keep='success, ')}), {_BINNED.format(bins=20)}
        SELECT variable, bin, count(*) AS n, {r('avg(value)')} AS mean_value, {r('avg(success)')} AS mean_resp,
               {r('stddev_samp(success) / sqrt(count(*))')} AS se_resp FROM placed GROUP BY variable, bin""",
)
def _(spark, folder):
    return X.binned_mean(occurrences(spark, folder), "success", NUMBERS)


@query(
    "density",
    f"""WITH {OCC}, l AS ({_long(('price', 'quantity'))}),
        s AS (SELECT variable, count(*) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi,
              (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34e0 AS iqr FROM l GROUP BY ALL),
        b AS (SELECT *, 0.9e0 * (CASE WHEN iqr > 0 AND iqr < sd THEN iqr ELSE sd END) * pow(n, -0.2e0) AS bw FROM s),
        c AS (SELECT variable, CAST(least(floor((value - lo) / (hi - lo) * 512), 511) AS INTEGER) + 1 AS bin, count(*) AS c
              FROM l JOIN b USING (variable) GROUP BY ALL),
        g AS (SELECT c.*, lo, hi, bw, n, CAST(unnest(range(0, 128)) AS INTEGER) AS point FROM c JOIN b USING (variable)),
        x AS (SELECT *, lo - 3 * bw + point * (hi - lo + 6 * bw) / 127 AS x, lo + (bin - 0.5e0) * (hi - lo) / 512 AS centre FROM g)
        SELECT variable, point, {r('max(x)')} AS x,
               {r('sum(c * exp(-0.5e0 * pow((x - centre) / bw, 2)) / (2.5066282746310002e0 * bw * n))')} AS density
        FROM x GROUP BY variable, point""",
)
def _(spark, folder):
    return X.density(occurrences(spark, folder), ["price", "quantity"])


@query(
    "lm_smooth",
    f"""WITH {OCC}, l AS ({_long(NUMBERS, keep='success, ')})
        SELECT variable, regr_count(success, value) AS n, {r('regr_slope(success, value)')} AS slope,
               {r('regr_intercept(success, value)')} AS intercept, {r('regr_r2(success, value)')} AS r2 FROM l GROUP BY variable""",
)
def _(spark, folder):
    return X.lm_smooth(occurrences(spark, folder), "success", NUMBERS)


@query(
    "pairs_corr",
    f"WITH {OCC} "
    + " UNION ALL ".join(
        f"SELECT region, '{a}' AS var_a, '{b}' AS var_b, {r(f'corr({a}, {b})')} AS corr FROM occ GROUP BY region"
        for i, a in enumerate(NUMBERS)
        for b in NUMBERS[i + 1 :]
    ),
)
def _(spark, folder):
    return X.pair_correlations(occurrences(spark, folder), NUMBERS, ["region"])


@query(
    "cross_counts",
    f"WITH {OCC} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS var_a, {a} AS level_a, '{b}' AS var_b, {b} AS level_b, count(*) AS n FROM occ GROUP BY {a}, {b}"
        for a, b in (("region", "nation"), ("region", "kind"), ("nation", "kind"))
    ),
)
def _(spark, folder):
    return X.cross_counts(occurrences(spark, folder), TEXTS)


@query(
    "drop_constant",
    f"WITH {OCC} SELECT taxa, year, success, count(*) AS n FROM occ GROUP BY ALL",
)
def _(spark, folder):
    occ = occurrences(spark, folder).select("taxa", "year", "success", F.lit("same").alias("constant"), F.lit(None).cast("int").alias("nothing"))
    kept = X.drop_constant(occ)
    return kept.groupBy(*kept.columns).agg(F.count(F.lit(1)).alias("n"))


@query(
    "columns_by_type",
    f"""WITH {OCC} SELECT region, {r('avg(price)')} AS price, {r('avg(quantity)')} AS quantity, {r('avg(discount)')} AS discount,
        {r('avg(size)')} AS size FROM occ GROUP BY region""",
)
def _(spark, folder):
    occ = occurrences(spark, folder).select("region", "nation", *NUMBERS)
    return occ.groupBy("region").agg(*[F.avg(c).alias(c) for c in X.numeric_columns(occ)])


@query(
    "complete_rows",
    f"""WITH {LISTED} SELECT taxa, year, count(*) AS n, {r('avg(success / nullif(list_length - 1, 0))')} AS prop
        FROM listed WHERE list_length - 1 <> 0 GROUP BY taxa, year""",
)
def _(spark, folder):
    rows = listed(spark, folder).withColumn("prop", proportion(F.col("success"), F.col("list_length") - 1))
    return rows.dropna("any").groupBy("taxa", "year").agg(F.count(F.lit(1)).alias("n"), F.avg("prop").alias("prop"))


# Model data: one model per taxon, list length as covariate, region as category, site as random factor.
def frame(spark, folder):
    usable = listed(spark, folder).where("list_length is not null")
    counted = usable.withColumn("one", F.lit(1))
    return model_frame(counted, "taxa", "success", "one", "year", "region", "list_length", "site")


_FRAME = f"""{LISTED}, used AS (SELECT * FROM listed WHERE list_length IS NOT NULL),
centre AS (SELECT taxa, quantile_cont(year, 0.5) AS centre FROM used GROUP BY taxa),
frame AS (SELECT used.*, CAST(success AS DOUBLE) AS y, 1e0 AS y_total, year - centre AS var, region AS cat, site AS rand,
                 CAST(list_length AS DOUBLE) AS cov, ln(list_length) AS log_cov FROM used JOIN centre USING (taxa))"""


@query(
    "model_frame",
    f"WITH {_FRAME} SELECT taxa, list, line, {r('y')} AS y, {r('y_total')} AS y_total, {r('var')} AS var, cat, rand, {r('cov')} AS cov, {r('log_cov')} AS use_cov FROM frame",
)
def _(spark, folder):
    return frame(spark, folder).select("taxa", "list", "line", "y", "y_total", "var", "cat", "rand", "cov", "use_cov")


@query(
    "model_levels",
    f"""WITH {_FRAME} SELECT taxa, count(*) AS n_data, count(DISTINCT log_cov) AS n_cov, count(DISTINCT cat) AS n_cat,
        count(DISTINCT rand) AS n_rand, CAST(0 AS BIGINT) AS n_bad_cov FROM frame GROUP BY taxa""",
)
def _(spark, folder):
    return model_levels(frame(spark, folder), "taxa")


@query(
    "term_selection",
    f"""WITH {_FRAME}, n AS (SELECT taxa, count(DISTINCT log_cov) AS n_cov, count(DISTINCT cat) AS n_cat, count(DISTINCT rand) AS n_rand
          FROM frame GROUP BY taxa)
        SELECT taxa, 'var' || CASE WHEN n_cov > 1 THEN ' + use_cov' ELSE '' END
          || CASE WHEN n_cat > 1 THEN ' + cat + var:cat' ELSE '' END || CASE WHEN n_rand > 1 THEN ' + (var | rand)' ELSE '' END AS terms FROM n""",
)
def _(spark, folder):
    return term_selection(frame(spark, folder), "taxa").select("taxa", F.array_join("terms", " + ").alias("terms"))


@query(
    "pattern_compress",
    f"""WITH {_FRAME} SELECT taxa, {r('var')} AS var, {r('log_cov')} AS use_cov, cat, sum(y) AS y, sum(y_total) AS y_total,
        sum(y * y) AS y_sq, count(*) AS n_rows FROM frame GROUP BY taxa, var, log_cov, cat""",
)
def _(spark, folder):
    return compress_patterns(frame(spark, folder).drop("rand"), "taxa")


@query(
    "time_grid",
    f"""WITH {_FRAME}, spans AS (SELECT taxa, cat, min(year) AS lo, max(year) AS hi FROM frame GROUP BY ALL)
        SELECT taxa, cat, CAST(unnest(generate_series(lo, hi)) AS INTEGER) AS year, {r('year - centre')} AS var
        FROM spans JOIN centre USING (taxa)""",
)
def _(spark, folder):
    return time_grid(frame(spark, folder), ["taxa"], "year")


@query(
    "time_grid_steps",
    f"""WITH {_FRAME}, spans AS (SELECT taxa, cat, min(year) AS lo, max(year) AS hi FROM frame GROUP BY ALL),
        points AS (SELECT taxa, cat, lo + 0.5e0 * unnest(generate_series(0, 2 * (hi - lo))) AS year FROM spans)
        SELECT taxa, cat, {r('year')} AS year, {r('year - centre')} AS var FROM points JOIN centre USING (taxa)""",
)
def _(spark, folder):
    return time_grid(frame(spark, folder), ["taxa"], "year", pred_step=0.5)


_COVQ = f"""{_FRAME}, q AS (SELECT taxa, unnest([quantile_cont(cov, 0.1), quantile_cont(cov, 0.5), quantile_cont(cov, 0.9)]) AS cov,
  unnest(['q10', 'q50', 'q90']) AS cov_q, unnest([1, 2, 3]) AS ord FROM frame GROUP BY taxa)"""


@query("cov_quantiles", f"WITH {_COVQ} SELECT taxa, CAST(ord AS INTEGER) AS ord, cov_q, {r('cov')} AS cov, {r('ln(cov)')} AS log_cov FROM q")
def _(spark, folder):
    return cov_quantiles(frame(spark, folder), ["taxa"], "cov", [0.1, 0.5, 0.9])


@query(
    "cov_ecdf_labels",
    f"""WITH {_FRAME}, v AS (SELECT taxa, CAST(unnest([1, 2, 3]) AS INTEGER) AS ord, unnest([1e0, 2e0, 3e0]) AS cov,
          unnest([avg(CAST(cov <= 1 AS INTEGER)), avg(CAST(cov <= 2 AS INTEGER)), avg(CAST(cov <= 3 AS INTEGER))]) AS e FROM frame GROUP BY taxa)
        SELECT taxa, ord, 'q' || CAST(round_even(100 * e, 0) AS INTEGER) AS cov_q, {r('cov')} AS cov, {r('ln(cov)')} AS log_cov FROM v""",
)
def _(spark, folder):
    return cov_values(frame(spark, folder), ["taxa"], [1, 2, 3])


@query(
    "prediction_grid",
    f"""WITH {_COVQ}, spans AS (SELECT taxa, cat, min(year) AS lo, max(year) AS hi FROM frame GROUP BY ALL),
        grid AS (SELECT taxa, cat, CAST(unnest(generate_series(lo, hi)) AS INTEGER) AS year FROM spans)
        SELECT taxa, cat, year, 'State' AS rand, {r('year - centre')} AS var, cov_q, {r('cov')} AS cov, {r('ln(cov)')} AS use_cov,
               0 AS y, 100 AS y_total
        FROM grid JOIN centre USING (taxa) JOIN q USING (taxa)""",
)
def _(spark, folder):
    data = counted(spark, folder).withColumns({"cat": F.col("region"), "cov": F.col("list_length").cast("double")})
    covariates = cov_quantiles(data, ["taxa"], "cov", [0.1, 0.5, 0.9], "times")
    grid = prediction_grid(data, ["taxa"], "year", covariates=covariates, rand_col="rand", times="times")
    return grid.drop("ord", "log_cov")


@query(
    "observed_contexts",
    f"""WITH {_FRAME}, m AS (SELECT taxa, quantile_cont(cov, 0.5) AS cov FROM frame GROUP BY taxa)
        SELECT DISTINCT taxa, cat, year, 0 AS y, 100 AS y_total, {r('m.cov')} AS cov, {r('ln(m.cov)')} AS log_cov
        FROM frame JOIN m USING (taxa)""",
)
def _(spark, folder):
    return observed_contexts(frame(spark, folder), ["taxa"], ["cat", "year"], "cov")
