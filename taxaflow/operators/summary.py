"""Summaries of predictions and change draws."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.functions import draws as D
from taxaflow.functions.keys import attach, join_same, names, require, share
from taxaflow.functions.likelihood import LIKELIHOOD, Scale, add_likelihood, likelihood
from taxaflow.functions.text import declining_text, interval_text, lower_text, sentence_list
from taxaflow.operators.quantiles import group_quantiles

# Default quantiles of the two kinds of summary.
RES_Q = (0.1, 0.5, 0.9)
OVERALL_Q = (0.005, 0.025, 0.05, 0.25, 0.5, 0.75, 0.95, 0.975, 0.995)


def to_arrays(draws: DataFrame, keys: Iterable[str], n_draws: int, draw_col: str = "draw", value_col: str = "pred") -> DataFrame:
    """Rows per draw as one array per key, in draw order, at least ``n_draws`` long.

    Draws are numbered from 0 or from 1, or in any other way: the array goes from
    the first number of the whole table to the last, so no draw is left out and
    the arrays of all keys pair up.  A draw without a row becomes a null element;
    each (key, draw) must be unique.
    """
    keys = names(keys)
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col(draw_col).cast("long"), F.col(value_col).cast("double"))))
    found = draws.groupBy(*keys).agg(pairs.alias("__m"))
    low, high = F.min(F.col(draw_col).cast("long")), F.max(F.col(draw_col).cast("long"))
    # numbered from 0 or 1 where that holds all draws; one row, whatever the table
    first = F.when((low >= 0) & (high < n_draws), F.lit(0)).when((low >= 1) & (high <= n_draws), F.lit(1)).otherwise(low)
    bounds = draws.agg(first.cast("long").alias("__first"), high.alias("__high"))
    numbers = F.sequence(F.col("__first"), F.greatest(F.col("__first") + (n_draws - 1), F.col("__high")))
    arrays = found.join(F.broadcast(bounds))
    return arrays.select(*keys, F.transform(numbers, lambda i: F.try_element_at(F.col("__m"), i)).alias(value_col))


def to_rows(pred: DataFrame, keys: Iterable[str], value_col: str = "pred", draw_col: str = "draw") -> DataFrame:
    """One row per draw."""
    return pred.select(*names(keys), F.posexplode(value_col).alias(draw_col, value_col))


def posterior_summary(
    pred: DataFrame, keys: Iterable[str], n_draws: int, res_q: Sequence[float] = RES_Q, ps_thresh: float = 0.05
) -> DataFrame:
    """One row per prediction: checks, direction, significance, quantiles, probabilities of change.

    Needs the arrays ``pred``, ``diff`` and ``diff_prop``.  The arrays are sorted
    once; everything else reads the sorted copies.
    """
    keys = names(keys)
    require(pred, *keys, "pred", "diff", "diff_prop")
    base = pred.withColumns({"__p": D.ordered(F.col("pred")), "__d": D.ordered(F.col("diff"))})
    diff, complete = F.col("__d"), D.count_known(F.col("diff_prop")) == F.size("__p")
    measured = base.select(
        *keys,
        (F.size("__p") - n_draws).cast("long").alias("check"),
        F.size("__p").cast("long").alias("n_draws"),
        D.direction(diff).alias("pd"),
        D.significance(diff, ps_thresh).alias("ps"),
        F.when(complete, D.geo_mean_of(F.col("diff_prop"))).alias("diff_prop_gm"),
        *[c.alias(n) for n, c in D.quantile_columns(F.col("__p"), res_q).items()],
        *[c.alias(n) for n, c in D.quantile_columns(diff, res_q, "diff_").items()],
        D.quantile(diff, 0.5).alias("__middle"),
    )
    return with_change_probabilities(measured, "__middle").drop("__middle")


def with_change_probabilities(df: DataFrame, middle: str = "diff_q50", ps: str = "ps") -> DataFrame:
    """Add ``positive``, ``negative`` and ``stable`` from the median difference and ``ps``."""
    sign, ps = F.signum(F.col(middle)), F.col(ps)
    return df.withColumns(
        {
            "positive": F.when(sign > 0, ps).when(sign < 0, 1 - ps).when(sign == 0, F.lit(0.0)),
            "negative": F.when(sign < 0, ps).when(sign > 0, 1 - ps).when(sign == 0, F.lit(0.0)),
        }
    ).withColumn("stable", 1 - F.col("positive") - F.col("negative"))


def divergent_summary(pred: DataFrame, keys: Iterable[str], n_draws: int, res_q: Sequence[float] = RES_Q) -> DataFrame:
    """Quantiles of ``pred`` and ``diff`` for divergent and other draws apart.

    Needs the array ``divergent`` in draw order beside ``pred`` and ``diff``.
    """
    keys = names(keys)
    require(pred, *keys, "pred", "diff", "divergent")
    flagged = pred.select(
        *keys, "pred", "diff", F.col("divergent").alias("__flags"), F.explode(F.array(F.lit(False), F.lit(True))).alias("divergent")
    )
    flags = F.col("__flags")

    def part(col: str):
        both = F.arrays_zip(F.col(col).alias("d"), flags.alias("f"))
        return F.array_sort(
            F.transform(
                F.filter(both, lambda s: (s["f"] == F.col("divergent")) & s["d"].isNotNull()), lambda s: s["d"]
            )
        )

    split = flagged.withColumns({"__p": part("pred"), "__d": part("diff")}).where(F.size("__p") > 0)
    return split.select(
        *keys,
        "divergent",
        (F.size("__p") - n_draws).cast("long").alias("check"),
        F.size("__p").cast("long").alias("n_draws"),
        *[c.alias(n) for n, c in D.quantile_columns(F.col("__p"), res_q).items()],
        *[c.alias(n) for n, c in D.quantile_columns(F.col("__d"), res_q, "diff_").items()],
    )


def population_summary(pred: DataFrame, keys: Iterable[str], n_check: int) -> DataFrame:
    """Mean, median, 90% interval and its text per prediction."""
    base = pred.withColumn("__p", D.ordered(F.col("pred")))
    found = base.select(
        *names(keys),
        F.size("__p").cast("long").alias("n"),
        F.lit(n_check).cast("long").alias("n_check"),
        D.mean(F.col("__p")).alias("mean"),
        D.quantile(F.col("__p"), 0.5).alias("median"),
        D.quantile(F.col("__p"), 0.05).alias("ci90_low"),
        D.quantile(F.col("__p"), 0.95).alias("ci90_high"),
    )
    return found.withColumn("text", interval_text(F.col("median"), F.col("ci90_low"), F.col("ci90_high")))


def change_summary(
    wide: DataFrame,
    geo_cols: Iterable[str],
    time_col: str = "year",
    quants: Sequence[float] = (0.05, 0.95),
    scale: Scale = LIKELIHOOD,
    islands: Iterable[str] = (),
) -> DataFrame:
    """Change per geography: shares, mean, median, interval, likelihood of a decline and its text."""
    geo_cols = names(geo_cols)
    base = wide.withColumn("__d", D.ordered(F.col("diff"))).where(F.size("__d") > 0)
    diff = F.col("__d")
    found = base.select(
        *geo_cols,
        F.size(diff).cast("long").alias("n_check"),
        D.share_of(diff, lambda x: x < 0).alias("lower"),
        D.share_of(diff, lambda x: x > 0).alias("higher"),
        D.mean(diff).alias("mean_diff"),
        D.quantile(diff, 0.5).alias("median_diff"),
        D.quantile(diff, quants[0]).alias("ci_low"),
        D.quantile(diff, quants[-1]).alias("ci_high"),
        F.col(f"{time_col}_reference").alias("reference"),
        F.col(f"{time_col}_recent").alias("recent"),
    )
    return add_likelihood(found, "lower", scale).withColumn(
        "text", lower_text(F.col("likelihood"), F.col("lower"), F.col(geo_cols[-1]), islands)
    )


def with_lower_share(long_draws: DataFrame, by: Iterable[str], diff_col: str = "diff") -> DataFrame:
    """Share of negative differences of the group, kept on every draw row."""
    by = names(by)
    return attach(long_draws, long_draws.groupBy(*by).agg(share(F.col(diff_col) < 0).alias("lower")), by)


def overall_change(
    draws: DataFrame, by: Iterable[str] = ("taxa",), quants: Sequence[float] = OVERALL_Q, scale: Scale = LIKELIHOOD, diff_col: str = "diff"
) -> DataFrame:
    """All models' change draws of a taxon pooled, every draw with the same weight."""
    by = names(by)
    draws = draws.where(F.col(diff_col).isNotNull())
    basic = draws.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        share(F.col(diff_col) > 0).alias("increase"),
        share(F.col(diff_col) < 0).alias("decline"),
        F.avg(diff_col).alias("mean_effect"),
    )
    ranked = group_quantiles(draws, by, diff_col, sorted({*quants, 0.5}), few_values=False)
    out = join_same(basic, ranked, by).withColumn("median_effect", F.col("q50"))
    out = out.withColumn("likelihood", likelihood(F.col("decline"), scale))
    return out.withColumn("text", declining_text(F.col("likelihood"), F.col("decline")))


def overall_text(
    draws: DataFrame,
    overall: DataFrame,
    area: str,
    by: str = "taxa",
    type_col: str = "type",
    geo_col: str = "geo",
    geo_kind: str = "IBRA Subregions",
    common_col: str | None = None,
) -> DataFrame:
    """One paragraph per taxon from ``overall_change`` and the models and places behind it."""
    parts = draws.select(by, type_col, geo_col).distinct().groupBy(by).agg(
        F.collect_set(type_col).alias("__types"), F.collect_set(geo_col).alias("__geos")
    )
    both = join_same(overall, parts, [by])
    common = F.coalesce(F.concat(F.lit(" ("), F.col(common_col), F.lit(")")), F.lit("")) if common_col else F.lit("")
    sentence = F.concat(
        F.lit("_"), F.col(by), F.lit("_"), common, F.lit(" was "), F.col("text"), F.lit(f" across {area} based on "),
        F.size("__types").cast("string"), F.lit(" models ("), sentence_list(F.col("__types")),
        F.lit(") using data from "), F.size("__geos").cast("string"), F.lit(f" {geo_kind} ("),
        sentence_list(F.col("__geos")), F.lit(")"),
    )
    return both.select(*[c for c in overall.columns if c != "text"], sentence.alias("overall_text"))


def stack_models(models: dict[str, DataFrame], type_col: str = "type") -> DataFrame:
    """Change draws of several model types as one table with the type as a column."""
    tables = [df.withColumn(type_col, F.lit(kind)) for kind, df in models.items()]
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def sample_draws(draws: DataFrame, n: int, by: Iterable[str] = (), draw_col: str = "draw", seed: int = 1) -> DataFrame:
    """Keep ``n`` draws per model, the same ones wherever the rows lie.

    Draw numbers are few and are ordered by a hash, so the choice depends on
    nothing but the seed and the number.
    """
    by = names(by)
    numbers = draws.select(*by, draw_col).distinct()
    order = F.struct(F.md5(F.concat_ws(":", F.lit(seed), F.col(draw_col))).alias("h"), F.col(draw_col).alias("d"))
    chosen = numbers.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(order)), 1, n).alias("__s"))
    chosen = chosen.select(*by, F.explode("__s.d").alias(draw_col))
    return attach(draws, chosen, [*by, draw_col], "left_semi")


