"""Queries on occurrence records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.functions.keys import count_levels
from taxaflow.functions.likelihood import LIKELIHOOD, add_likelihood, count_classes
from taxaflow.functions.links import geo_mean, inverse_link, link
from taxaflow.operators.cooccur import cooccur_pairs, cooccur_test, presence_matrix
from taxaflow.operators.detection import detection_history, number_visits, occupancy_histogram, visits_wide
from taxaflow.operators.lists import add_list_length, list_lengths, unite
from taxaflow.operators.occupancy import occupancy_fit
from taxaflow.operators.quantiles import group_quantiles
from taxaflow.operators.reporting import attach_levels, edge_times, latest_time, reporting_rate
from taxaflow.operators.sufficiency import RULES, filter_list_df, filter_reasons
from taxaflow.plans.catalog import LISTED, OCC, query, r
from taxaflow.session import durable
from taxaflow.sources.model_store import pending_models
from taxaflow.sources.occurrences import read_order_occurrences as occurrences

FILTER = dict(max_year=2000, min_year=1996, max_gap=2)


def listed(spark, folder) -> DataFrame:
    return add_list_length(occurrences(spark, folder), "taxa", ["list"])


def counted(spark, folder, *others) -> DataFrame:
    """Equal records of lists with a length, once each with their number (``times``): a stored table, so the records are joined once."""
    cols = ["taxa", "year", "region", "success", "list_length", *others]
    usable = listed(spark, folder).where("list_length is not null")
    return durable(usable.groupBy(*cols).agg(F.count(F.lit(1)).alias("times")))


@query("read_occurrences", f"WITH {OCC} SELECT taxa, list, year, region, success FROM occ")
def _(spark, folder):
    return occurrences(spark, folder).select("taxa", "list", "year", "region", "success")


@query("add_list_length", f"WITH {LISTED} SELECT taxa, list, line, year, success, list_length FROM listed")
def _(spark, folder):
    return listed(spark, folder).select("taxa", "list", "line", "year", "success", "list_length")


@query(
    "list_lengths_by_visit",
    f"WITH {OCC} SELECT site, year, count(DISTINCT taxa) AS list_length FROM occ WHERE success > 0 GROUP BY site, year",
)
def _(spark, folder):
    return list_lengths(occurrences(spark, folder), "taxa", ["site", "year"])


@query(
    "unite_list",
    f"WITH {OCC} SELECT list, year, region, list || '_' || year || '_' || region AS name, count(*) AS n FROM occ GROUP BY ALL",
)
def _(spark, folder):
    named = occurrences(spark, folder).withColumn("name", unite(["list", "year", "region"]))
    return named.groupBy("list", "year", "region", "name").agg(F.count(F.lit(1)).alias("n"))


_REASONS = f"""{LISTED}, per_time AS (
  SELECT local_taxa, year, count(*) AS n, max(list_length) AS longest FROM listed WHERE success > 0 GROUP BY ALL),
gaps AS (SELECT *, year - lag(year, 1, year) OVER (PARTITION BY local_taxa ORDER BY year) AS gap FROM per_time),
measured AS (
  SELECT local_taxa, max(longest) AS longest_list, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS times,
         max(year) AS last_time, min(year) AS first_time, max(gap) AS largest_gap FROM gaps GROUP BY local_taxa),
reasons AS (
  SELECT *, longest_list <= 3 AS shortest_max, occurrences <= 5 AS min_occurrences, times <= 3 AS min_years,
         last_time <= 2000 AS max_year, first_time >= 1996 AS min_year, largest_gap >= 2 AS max_gap FROM measured)"""
_ANY = "(shortest_max OR min_occurrences OR min_years OR max_year OR min_year OR max_gap)"


@query("filter_reasons", f"WITH {_REASONS} SELECT *, {_ANY} AS removed FROM reasons")
def _(spark, folder):
    return filter_reasons(listed(spark, folder), "local_taxa", **FILTER)


@query(
    "filter_list_df",
    f"""WITH {_REASONS} SELECT local_taxa, list, line, year, success, list_length FROM listed
        WHERE local_taxa NOT IN (SELECT local_taxa FROM reasons WHERE {_ANY})""",
)
def _(spark, folder):
    kept = filter_list_df(listed(spark, folder), "local_taxa", **FILTER)
    return kept.select("local_taxa", "list", "line", "year", "success", "list_length")


def _rule(name: str) -> None:
    @query(f"rule_{name}", f"WITH {_REASONS} SELECT local_taxa FROM reasons WHERE {name}")
    def _(spark, folder):
        return filter_reasons(listed(spark, folder), "local_taxa", **FILTER).where(name).select("local_taxa")


for _name in RULES:
    _rule(_name)


@query(
    "reporting_rate",
    f"""WITH {_REASONS}, kept AS (
          SELECT * FROM listed WHERE local_taxa NOT IN (SELECT local_taxa FROM reasons
            WHERE shortest_max OR min_occurrences OR min_years))
        SELECT taxa, year, region, CAST(sum(success) AS BIGINT) AS success, count(success) AS trials,
               {r('sum(success) / count(success)')} AS prop FROM kept GROUP BY taxa, year, region""",
)
def well_sampled_rate(spark, folder):
    """Reporting rate of well-sampled taxa by year and region."""
    kept = filter_list_df(listed(spark, folder), "local_taxa", max_year=0, min_year=9999, max_gap=9999)
    return reporting_rate(kept, ["taxa", "year", "region"])


@query(
    "geo_mean",
    f"""WITH {OCC} SELECT taxa, {r('exp(avg(ln(price)))')} AS gm_price,
        CASE WHEN min(discount) > 0 THEN {r('exp(avg(CASE WHEN discount > 0 THEN ln(discount) END))')} END AS gm_discount
        FROM occ GROUP BY taxa""",
)
def _(spark, folder):
    return occurrences(spark, folder).groupBy("taxa").agg(
        geo_mean(F.col("price")).alias("gm_price"), geo_mean(F.col("discount")).alias("gm_discount")
    )


@query(
    "count_levels",
    f"""WITH {OCC} SELECT taxa, count(DISTINCT (region, nation)) AS places, count(DISTINCT site) AS sites
        FROM occ GROUP BY taxa""",
)
def _(spark, folder):
    return occurrences(spark, folder).groupBy("taxa").agg(
        count_levels("region", "nation").alias("places"), count_levels("site").alias("sites")
    )


@query(
    "group_quantiles",
    f"""WITH {OCC} SELECT region, {r('quantile_cont(price, 0.005)')} AS q00_5, {r('quantile_cont(price, 0.1)')} AS q10,
        {r('quantile_cont(price, 0.5)')} AS q50, {r('quantile_cont(price, 0.975)')} AS q97_5 FROM occ GROUP BY region""",
)
def _(spark, folder):
    return group_quantiles(occurrences(spark, folder), "region", "price", [0.005, 0.1, 0.5, 0.975])


@query(
    "group_quantiles_counts",
    f"""WITH {LISTED} SELECT taxa, {r('quantile_cont(list_length, 0.25)')} AS q25, {r('quantile_cont(list_length, 0.5)')} AS q50,
        {r('quantile_cont(list_length, 0.9)')} AS q90 FROM listed WHERE list_length IS NOT NULL GROUP BY taxa""",
)
def _(spark, folder):
    return group_quantiles(listed(spark, folder).where("list_length is not null"), "taxa", "list_length", [0.25, 0.5, 0.9], few_values=True)


_SCALE = "(VALUES " + ", ".join(f"({i + 1}, {m}e0, '{w}')" for i, (m, w) in enumerate(LIKELIHOOD)) + ") AS s(ord, max_val, likelihood)"
_RATES = f"""{OCC}, rates AS (
  SELECT local_taxa, year, sum(success) / count(*) AS prop FROM occ GROUP BY ALL)"""
_LABEL = f"(SELECT min(ord) FROM {_SCALE} WHERE prop <= max_val)"


@query(
    "likelihood_label",
    f"""WITH {_RATES}, placed AS (SELECT *, {_LABEL} AS ord FROM rates)
        SELECT local_taxa, year, {r('prop')} AS prop, s.likelihood, placed.ord AS likelihood_ord
        FROM placed JOIN {_SCALE} ON s.ord = placed.ord""",
)
def _(spark, folder):
    rates = reporting_rate(occurrences(spark, folder), ["local_taxa", "year"]).drop("success", "trials")
    return add_likelihood(rates, "prop")


@query(
    "likelihood_classes",
    f"""WITH {_RATES}, placed AS (SELECT *, {_LABEL} AS ord FROM rates),
        years AS (SELECT DISTINCT year FROM rates), counts AS (SELECT year, ord, count(*) AS n FROM placed GROUP BY ALL)
        SELECT years.year, s.ord AS likelihood_ord, s.likelihood, coalesce(n, 0) AS rows
        FROM years CROSS JOIN {_SCALE} LEFT JOIN counts ON counts.year = years.year AND counts.ord = s.ord""",
)
def _(spark, folder):
    rates = reporting_rate(occurrences(spark, folder), ["local_taxa", "year"])
    return count_classes(rates, "prop", ["year"])


@query(
    "link_functions",
    f"""WITH {OCC}, rates AS (SELECT taxa, (sum(success) + 0.5e0) / (count(*) + 1e0) AS mu FROM occ GROUP BY taxa)
        SELECT taxa, {r('ln(mu / (1 - mu))')} AS logit, {r('mu')} AS back, {r('ln(mu)')} AS log_mu,
        {r('round_even(mu, 2)')} AS short, CAST(sign(mu - 0.33) AS INTEGER) AS side FROM rates""",
)
def _(spark, folder):
    rates = occurrences(spark, folder).groupBy("taxa").agg(((F.sum("success") + 0.5) / (F.count(F.lit(1)) + 1.0)).alias("mu"))
    logit = link(F.col("mu"))
    return rates.select(
        "taxa", logit.alias("logit"), inverse_link(logit).alias("back"), link(F.col("mu"), "log").alias("log_mu"),
        F.bround("mu", 2).alias("short"), F.signum(F.col("mu") - 0.33).cast("int").alias("side"),
    )


@query(
    "edge_times",
    f"""WITH {OCC}, yearly AS (SELECT DISTINCT local_taxa, year FROM occ WHERE success > 0),
        ends AS (SELECT local_taxa, min(year) AS lo, max(year) AS hi FROM yearly GROUP BY ALL)
        SELECT y.local_taxa, y.year, CASE WHEN y.year = lo THEN 'min' ELSE 'max' END AS edge
        FROM yearly y JOIN ends USING (local_taxa) WHERE y.year = lo OR y.year = hi""",
)
def _(spark, folder):
    seen = occurrences(spark, folder).where("success > 0").select("local_taxa", "year").distinct()
    return edge_times(seen, ["local_taxa"], "year")


@query(
    "latest_time",
    f"""WITH {OCC}, ends AS (SELECT local_taxa, max(year) AS hi FROM occ GROUP BY ALL)
        SELECT o.local_taxa, o.list, o.line, o.year FROM occ o JOIN ends e ON o.local_taxa = e.local_taxa AND o.year = hi""",
)
def _(spark, folder):
    return latest_time(occurrences(spark, folder), ["local_taxa"], "year").select("local_taxa", "list", "line", "year")


@query(
    "attach_levels",
    f"""WITH {OCC}, n AS (SELECT taxa, count(DISTINCT year) AS levels FROM occ WHERE success > 0 GROUP BY taxa)
        SELECT taxa, list, line, levels FROM occ JOIN n USING (taxa) WHERE success > 0""",
)
def _(spark, folder):
    seen = occurrences(spark, folder).where("success > 0")
    return attach_levels(seen, ["taxa"], "year").select("taxa", "list", "line", "levels")


@query(
    "pending_models",
    f"""WITH {OCC} SELECT DISTINCT local_taxa FROM occ EXCEPT SELECT local_taxa FROM occ WHERE year >= 2001""",
)
def _(spark, folder):
    occ = occurrences(spark, folder)
    return pending_models(occ, occ.where("year >= 2001"), by="local_taxa")


# Visits of a site in a year, ordered by survey and line.
_VISITS = f"""{OCC}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY year, region, site ORDER BY list, line, taxa, quantity, price, success) AS visit FROM occ)"""
_ORDER = ["list", "line", "taxa", "quantity", "price", "success"]


@query("visit_number", f"WITH {_VISITS} SELECT year, region, site, list, line, visit FROM numbered")
def _(spark, folder):
    numbered = number_visits(occurrences(spark, folder), ["year", "region", "site"], _ORDER)
    return numbered.select("year", "region", "site", "list", "line", "visit")


@query("detection_history", f"WITH {_VISITS} SELECT year, region, site, visit, success FROM numbered")
def _(spark, folder):
    return detection_history(occurrences(spark, folder), ["year", "region"], ["site"], _ORDER)


@query(
    "visits_wide",
    f"""WITH {_VISITS} SELECT year, region, site, count(*) AS n_visits, string_agg(success, ',' ORDER BY visit) AS successes
        FROM numbered GROUP BY year, region, site""",
)
def _(spark, folder):
    """The wide columns, whose number depends on the data, side by side in one text."""
    wide = visits_wide(occurrences(spark, folder), ["year", "region"], ["site"], _ORDER)
    visits = F.array(*[F.col(c) for c in wide.columns if c.startswith("visit_")])
    known = F.filter(visits, lambda x: x.isNotNull())
    return wide.select("year", "region", "site", F.size(known).cast("long").alias("n_visits"), F.array_join(known, ",").alias("successes"))


_SITES = f"""{OCC}, sites AS (
  SELECT year, region, site, count(success) AS n_visits, count(*) FILTER (WHERE success > 0) AS n_det FROM occ GROUP BY ALL)"""


@query("occupancy_histogram", f"WITH {_SITES} SELECT year, region, n_visits, n_det, count(*) AS n_sites FROM sites GROUP BY ALL")
def _(spark, folder):
    return occupancy_histogram(occurrences(spark, folder), ["year", "region"], ["site"])


_EM = f"""{_SITES}, hist AS (SELECT year, region, n_visits, count(*) AS c FROM sites WHERE n_det = 0 GROUP BY ALL),
lists AS (SELECT year, region, list({{'n': CAST(n_visits AS DOUBLE), 'c': CAST(c AS DOUBLE)}}) AS missed FROM hist GROUP BY ALL),
cells AS (
  SELECT year, region, count(*) AS n_sites, CAST(sum(n_visits) AS BIGINT) AS visits, CAST(sum(n_det) AS BIGINT) AS detections,
         CAST(count(*) FILTER (WHERE n_det > 0) AS DOUBLE) AS d,
         CAST(coalesce(sum(n_visits) FILTER (WHERE n_det > 0), 0) AS DOUBLE) AS dv
  FROM sites GROUP BY ALL HAVING count(*) > 2),
geos AS (SELECT region, count(*) AS years FROM cells GROUP BY ALL HAVING count(*) > 3),
kept AS (SELECT cells.*, years, missed FROM cells JOIN geos USING (region) LEFT JOIN lists USING (year, region)),
em AS (
  SELECT 0 AS it, year, region, n_sites, visits, detections, years, d, dv, missed,
         least((d / n_sites + 1) / 2, 0.999e0) AS psi, detections / dv * 0.9e0 AS p, 1e0 AS moved FROM kept
  UNION ALL
  SELECT it + 1, year, region, n_sites, visits, detections, years, d, dv, missed, psi2, p2, greatest(abs(psi2 - psi), abs(p2 - p)) FROM (
    SELECT *, (d + coalesce(list_sum([h.c * psi * pow(1 - p, h.n) / (psi * pow(1 - p, h.n) + 1 - psi) for h in missed]), 0)) / n_sites AS psi2,
           detections / (dv + coalesce(list_sum([h.c * h.n * psi * pow(1 - p, h.n) / (psi * pow(1 - p, h.n) + 1 - psi) for h in missed]), 0)) AS p2
    FROM em WHERE moved > 1e-11))"""


@query(
    "occupancy_fit",
    f"""WITH RECURSIVE {_EM} SELECT region, year, n_sites, visits, detections, years,
        {r('CASE WHEN psi = 0 THEN 1e-8 WHEN psi = 1 THEN 1 - 1e-8 ELSE psi END')} AS occ, {r('p')} AS det, true AS converged, 'ok' AS status
        FROM em WHERE moved <= 1e-11""",
)
def _(spark, folder):
    return occupancy_fit(occurrences(spark, folder), ["region"], ["site"])


_PRES = f"""{OCC}, pres AS (SELECT DISTINCT kind AS taxon, list AS site FROM occ WHERE success > 0),
big AS (SELECT CAST(count(DISTINCT site) AS DOUBLE) AS n FROM pres),
taxa AS (SELECT taxon, count(*) AS sites FROM pres GROUP BY taxon),
shared AS (
  SELECT a.taxon AS taxon_a, b.taxon AS taxon_b, count(*) AS observed
  FROM pres a JOIN pres b ON a.site = b.site AND a.taxon < b.taxon GROUP BY ALL),
pairs AS (
  SELECT a.taxon AS taxon_a, b.taxon AS taxon_b, a.sites AS sites_a, b.sites AS sites_b, CAST(n AS BIGINT) AS all_sites,
         coalesce(observed, 0) AS observed, a.sites * b.sites / n AS expected, a.sites * b.sites / n / n AS prob, n
  FROM taxa a JOIN taxa b ON a.taxon < b.taxon CROSS JOIN big
  LEFT JOIN shared ON shared.taxon_a = a.taxon AND shared.taxon_b = b.taxon
  WHERE a.sites * b.sites >= n)"""


@query(
    "cooccur_pairs",
    f"""WITH {_PRES} SELECT taxon_a, taxon_b, sites_a, sites_b, all_sites, observed, {r('expected')} AS expected, {r('prob')} AS prob
        FROM pairs""",
)
def _(spark, folder):
    return cooccur_pairs(occurrences(spark, folder), "kind", ["list"], success_col="success")


_LCHOOSE = "(lgamma({a} + 1) - lgamma({b} + 1) - lgamma({a} - {b} + 1))"
_PMF = (
    "exp(" + _LCHOOSE.format(a="sites_a", b="j") + " + " + _LCHOOSE.format(a="(n - sites_a)", b="(sites_b - j)")
    + " - " + _LCHOOSE.format(a="n", b="sites_b") + ")"
)


@query(
    "cooccur_test",
    f"""WITH {_PRES}, support AS (
          SELECT *, unnest(generate_series(CAST(greatest(0, sites_a + sites_b - n) AS BIGINT), least(sites_a, sites_b))) AS j FROM pairs),
        tails AS (
          SELECT taxon_a, taxon_b, sum(CASE WHEN j <= observed THEN {_PMF} ELSE 0 END) AS p_lt,
                 sum(CASE WHEN j >= observed THEN {_PMF} ELSE 0 END) AS p_gt FROM support GROUP BY ALL)
        SELECT taxon_a, taxon_b, sites_a, sites_b, all_sites, observed, {r('expected')} AS expected, {r('prob')} AS prob,
               {r('p_lt')} AS p_lt, {r('p_gt')} AS p_gt,
               CASE WHEN p_gt < 0.05 THEN 'positive' WHEN p_lt < 0.05 THEN 'negative'
                    WHEN abs(observed - expected) <= 0.1 * n THEN 'random' ELSE 'unclassifiable' END AS class
        FROM pairs JOIN tails USING (taxon_a, taxon_b)""",
)
def _(spark, folder):
    return cooccur_test(occurrences(spark, folder), "kind", ["list"], success_col="success")


@query(
    "cooccur_by_region",
    f"""WITH {OCC}, pres AS (SELECT DISTINCT region, kind AS taxon, site FROM occ WHERE success > 0),
        big AS (SELECT region, count(DISTINCT site) AS n FROM pres GROUP BY ALL),
        taxa AS (SELECT region, taxon, count(*) AS sites FROM pres GROUP BY ALL),
        shared AS (SELECT a.region, a.taxon AS taxon_a, b.taxon AS taxon_b, count(*) AS observed
          FROM pres a JOIN pres b ON a.region = b.region AND a.site = b.site AND a.taxon < b.taxon GROUP BY ALL)
        SELECT a.region, a.taxon AS taxon_a, b.taxon AS taxon_b, a.sites AS sites_a, b.sites AS sites_b, n AS all_sites,
               coalesce(observed, 0) AS observed, {r('a.sites * b.sites / n')} AS expected, {r('a.sites * b.sites / n / n')} AS prob
        FROM taxa a JOIN taxa b ON a.region = b.region AND a.taxon < b.taxon JOIN big ON big.region = a.region
        LEFT JOIN shared s ON s.region = a.region AND s.taxon_a = a.taxon AND s.taxon_b = b.taxon WHERE a.sites * b.sites >= n""",
)
def _(spark, folder):
    return cooccur_pairs(occurrences(spark, folder), "kind", ["site"], by=["region"], success_col="success")


_YEARS = list(range(1995, 2002))


@query(
    "presence_matrix",
    f"WITH {OCC} SELECT local_taxa, "
    + ", ".join(f"max(CASE WHEN year = {y} THEN 1 ELSE 0 END) AS year_{y}" for y in _YEARS)
    + " FROM occ WHERE success > 0 GROUP BY local_taxa",
)
def _(spark, folder):
    return presence_matrix(occurrences(spark, folder), "local_taxa", "year", _YEARS, success_col="success")
