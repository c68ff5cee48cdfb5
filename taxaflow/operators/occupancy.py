"""Occupancy and detection per time and geography."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.functions.keys import join_same, names
from taxaflow.functions.links import OCCUPANCY_MARGIN, clamp_proportion
from taxaflow.operators.detection import site_counts

# Sites a cell must exceed, years a geography must exceed before
# and after estimation, and cells a taxon must exceed to be estimated at all.
MIN_SITES = 2
MIN_YEARS_BEFORE = 2
MIN_YEARS_AFTER = 3
MIN_CELLS = 2


def occupancy_counts(df: DataFrame, keys: Iterable[str], site_cols: Iterable[str], success_col: str = "success") -> DataFrame:
    """Sufficient counts of a cell: sums over detected sites, and undetected sites by visits.

    A detected site adds only to sums, so the array per cell is as long as the
    number of different visit counts among its undetected sites.
    """
    keys = names(keys)
    per_site = site_counts(df, keys, site_cols, success_col).where(F.col("n_visits") > 0)
    missed = F.col("n_det") == 0
    by_visits = per_site.groupBy(*keys, F.when(missed, F.col("n_visits")).alias("__visits")).agg(
        F.count(F.lit(1)).alias("__sites"),
        F.sum("n_visits").alias("__all_visits"),
        F.sum("n_det").alias("__det"),
        F.max("n_visits").alias("__most"),
    )
    seen = F.col("__visits").isNull()
    one = F.when(~seen, F.struct(F.col("__visits").cast("double").alias("n"), F.col("__sites").cast("double").alias("c")))
    return by_visits.groupBy(*keys).agg(
        F.sum("__sites").alias("n_sites"),
        F.coalesce(F.sum(F.when(seen, F.col("__sites"))), F.lit(0)).alias("detected"),
        F.coalesce(F.sum(F.when(seen, F.col("__all_visits"))), F.lit(0)).alias("detected_visits"),
        F.sum("__det").alias("detections"),
        F.sum("__all_visits").alias("visits"),
        F.max("__most").alias("most_visits"),
        F.array_sort(F.collect_list(one)).alias("missed"),
    )


#: Estimation ends when the detection probability moves by no more than this share of itself, or (not converged) after so many steps.
TOLERANCE, MOST_STEPS = 1e-12, 60


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def sums(missed: Column, **terms: Callable[[Column, Column], Column]) -> Column:
    """Struct of one sum for each term over the undetected sites, given ``n`` visits at ``c`` sites."""
    return F.aggregate(
        missed,
        F.struct(*[F.lit(0.0).alias(name) for name in terms]),
        lambda acc, h: F.struct(*[(acc[name] + term(h["n"], h["c"])).alias(name) for name, term in terms.items()]),
    )


def most_likely_odds(detected: Column, missed: Column, q: Column, steps: int = MOST_STEPS) -> Column:
    """Odds of occupancy that are most likely when a visit misses with probability ``q``; null where occupancy is 1.

    The score falls and is convex in the odds, so Newton steps from a start below
    the root rise to it and never pass it.
    """
    at_one = sums(missed, gap=lambda n, c: c * (1 - F.pow(q, n)) * F.coalesce(F.try_divide(F.lit(1.0), F.pow(q, n)), F.lit(float("inf"))))["gap"]
    seen = sums(missed, g=lambda n, c: c * (1 - F.pow(q, n)))["g"]

    def step(state: Column, _: Column) -> Column:
        t = state["t"]
        both = sums(
            missed,
            f=lambda n, c: c * t * (1 - F.pow(q, n)) / (1 + t * F.pow(q, n)),
            d=lambda n, c: c * (1 - F.pow(q, n)) / F.pow(1 + t * F.pow(q, n), 2),
        )
        new = let(both, lambda x: F.struct((t + (detected - x["f"]) / x["d"]).alias("t"), ((detected - x["f"]) / x["d"] <= 1e-13 * t).alias("done")))
        return F.when(state["done"], state).otherwise(new)

    start = F.struct((detected / seen).alias("t"), F.lit(False).alias("done"))
    return F.when(at_one > detected, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["t"])


def estimate(counts: DataFrame, tol: float = TOLERANCE, most_steps: int = MOST_STEPS) -> DataFrame:
    """``psi`` and ``p`` of greatest likelihood inside one column expression, and whether they ``converged``.

    Occupancy is profiled out: for every detection probability it takes its most
    likely value, at most 1.  Newton steps on the remaining score stay inside a
    bracket that each one narrows, and halve it where they would leave it.  A cell
    that has settled passes its remaining steps at no cost.  Where no site has a
    second visit the two are not separable: both are null and ``status`` says so;
    it also says where the steps did not suffice.
    """
    detected, detections = F.col("detected").cast("double"), F.col("detections").cast("double")
    absences = F.col("detected_visits").cast("double") - detections
    missed = F.col("missed")

    def occupancy(odds: Column) -> Column:
        return F.coalesce(odds / (1 + odds), F.lit(1.0))

    def step(state: Column, _: Column) -> Column:
        p, q = state["p"], 1 - state["p"]

        def scores(odds: Column) -> Column:
            psi = occupancy(odds)
            left = lambda n: 1 - psi * (1 - F.pow(q, n))
            parts = sums(
                missed,
                p=lambda n, c: c * psi * n * F.pow(q, n - 1) / left(n),
                pp=lambda n, c: c * psi * n * F.pow(q, n - 2) * ((n - 1) * left(n) - psi * n * F.pow(q, n)) / F.pow(left(n), 2),
                psi=lambda n, c: c * F.pow((1 - F.pow(q, n)) / left(n), 2),
                cross=lambda n, c: c * n * F.pow(q, n - 1) / F.pow(left(n), 2),
            )
            inner = odds.isNotNull()
            return let(
                parts,
                lambda x: F.struct(
                    (detections / p - absences / q - x["p"]).alias("score"),
                    (
                        x["pp"] - detections / (p * p) - absences / (q * q)
                        + F.when(inner, x["cross"] * x["cross"] / (detected / (psi * psi) + x["psi"])).otherwise(0.0)
                    ).alias("slope"),
                ),
            )

        def move(x: Column) -> Column:
            low, high = F.when(x["score"] > 0, p).otherwise(state["low"]), F.when(x["score"] > 0, state["high"]).otherwise(p)
            newton = F.when(x["slope"] < 0, p - x["score"] / x["slope"])
            # Bounds far apart are halved by their ratio, so that tiny probabilities are reached too.
            middle = F.when(low > 0, F.sqrt(low * high)).otherwise(high / 16)
            inside = (newton > low) & (newton < high)
            new = F.when(x["score"] == 0, p).when(F.coalesce(inside, F.lit(False)), newton).otherwise(middle)
            return let(
                F.struct(new.alias("p"), low.alias("low"), high.alias("high")),
                lambda s: F.struct(s["p"].alias("p"), s["low"].alias("low"), s["high"].alias("high"), (F.abs(s["p"] - p) <= tol * p).alias("done")),
            )

        new = let(most_likely_odds(detected, missed, q), lambda odds: let(scores(odds), move))
        return F.when(state["done"], state).otherwise(new)

    top = detections / (detections + absences)
    start = F.struct((top * 0.9).alias("p"), F.lit(0.0).alias("low"), top.alias("high"), F.lit(False).alias("done"))
    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(most_steps)), start, step)
    settled = F.struct(top.alias("p"), F.lit(0.0).alias("low"), top.alias("high"), F.lit(True).alias("done"))
    # Without a miss at a detected site, or without an undetected site, the score is never negative below the top.
    certain = (absences == 0) | (F.size(missed) == 0)
    separable = (F.col("most_visits") > 1) & (F.col("detections") > 0)
    fit = F.when(separable, F.when(certain, settled).otherwise(fitted))
    found = counts.withColumn("__fit", fit)
    psi = let(F.col("__fit.p"), lambda p: occupancy(most_likely_odds(detected, missed, 1 - p)))
    return found.withColumns(
        {
            "psi": F.when(F.col("detections") == 0, F.lit(0.0)).when(F.col("__fit").isNotNull(), psi),
            "p": F.col("__fit.p"),
            "converged": F.coalesce(F.col("__fit.done"), F.lit(True)),
            "status": F.when(F.col("detections") == 0, F.lit("no detections"))
            .when(~separable, F.lit("not separable"))
            .when(~F.col("__fit.done"), F.lit("not converged"))
            .otherwise(F.lit("ok")),
        }
    ).drop("__fit")


def occupancy_fit(
    df: DataFrame,
    geo_cols: Iterable[str],
    site_cols: Iterable[str],
    by: Iterable[str] = (),
    time_col: str = "year",
    success_col: str = "success",
) -> DataFrame:
    """Occupancy per time and geography for every taxon in ``by``.

    Cells need more than two sites and geographies more than two times; a taxon
    needs more than two such cells.  Estimates are moved off 0 and 1, and
    geographies with more than three estimated times are returned.
    """
    by, geo = names(by), names(geo_cols)
    cells = occupancy_counts(df, [*by, *geo, time_col], site_cols, success_col).where(F.col("n_sites") > MIN_SITES)
    years = cells.groupBy(*by, *geo).agg(F.count(F.lit(1)).alias("years")).where(F.col("years") > MIN_YEARS_BEFORE)
    # The time count of a geography is also its cell count, so taxon totals need no second pass.
    if by:
        enough = years.groupBy(*by).agg(F.sum("years").alias("__cells")).where(F.col("__cells") > MIN_CELLS).select(*by)
        years = join_same(years, enough, by, "left_semi")
    years = years.where(F.col("years") > MIN_YEARS_AFTER)
    kept = join_same(cells, years, [*by, *geo], "inner")
    return estimate(kept).select(
        *by, *geo, time_col, "n_sites", "visits", "detections", "years",
        clamp_proportion(F.col("psi"), OCCUPANCY_MARGIN).alias("occ"), F.col("p").alias("det"), "converged", "status",
    )
