"""Predictions against a reference category, time or lag, draw by draw."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.functions import draws as D
from taxaflow.functions.keys import attach, join_same, names, require


def with_difference(pred: DataFrame) -> DataFrame:
    """Add ``diff`` and ``diff_prop`` from the draw arrays ``pred`` and ``ref``."""
    return pred.withColumns(
        {"diff": D.difference(F.col("pred"), F.col("ref")), "diff_prop": D.ratio(F.col("pred"), F.col("ref"))}
    )


def contrast_category(pred: DataFrame, ref: str, var_col: str, cat_col: str, keys: Iterable[str] = ()) -> DataFrame:
    """Against category ``ref`` at the same time and the same ``keys`` (model, covariate, random level)."""
    keys = [*names(keys), var_col]
    require(pred, cat_col, *keys, "pred")
    base = pred.where(F.col(cat_col) == ref).select(*keys, F.col("pred").alias("ref"))
    return with_difference(join_same(pred, base, keys))


def contrast_time(
    pred: DataFrame, ref: float, var_col: str, cat_col: str, keys: Iterable[str] = (), ref_centred: bool = False
) -> DataFrame:
    """Against time ``ref`` of the same category and ``keys``.

    ``ref`` is on the original scale; ``ref_centred`` compares the median-centred
    column ``var`` instead.
    """
    keys = [*names(keys), cat_col]
    require(pred, var_col, *keys, "pred")
    at = F.col("var" if ref_centred else var_col) == ref
    base = pred.where(at).select(*keys, F.col("pred").alias("ref"))
    return with_difference(join_same(pred, base, keys))


def contrast_lag(pred: DataFrame, lag: float, var_col: str, cat_col: str, keys: Iterable[str] = ()) -> DataFrame:
    """Against the value ``-lag`` time units earlier; null where there is none."""
    if lag >= 0:
        raise ValueError("lag must be negative")
    keys = [*names(keys), cat_col, var_col]
    require(pred, *keys, "pred")
    moved = (F.col(var_col) - lag).cast(pred.schema[var_col].dataType)
    base = pred.select(*[c for c in keys if c != var_col], moved.alias(var_col), F.col("pred").alias("ref"))
    return with_difference(join_same(pred, base, keys))


def contrast(
    pred: DataFrame,
    ref: str | float = -20,
    var_col: str = "year",
    cat_col: str = "cat",
    keys: Iterable[str] = (),
    ref_centred: bool = False,
) -> DataFrame:
    """Category if ``ref`` is text, lag if negative, else a fixed time."""
    if isinstance(ref, str):
        return contrast_category(pred, ref, var_col, cat_col, keys)
    if ref < 0:
        return contrast_lag(pred, ref, var_col, cat_col, keys)
    return contrast_time(pred, ref, var_col, cat_col, keys, ref_centred)


def contrast_draws(contrasted: DataFrame, keys: Iterable[str]) -> DataFrame:
    """One row per draw with ``pred, ref, diff, diff_prop``; without a reference the last three are null."""
    others = ("ref", "diff", "diff_prop")
    rows = F.transform(
        "pred",
        lambda x, i: F.struct(x.alias("pred"), *[F.try_element_at(F.col(c), i + 1).alias(c) for c in others]),
    )
    named = contrasted.select(*names(keys), F.posexplode(rows).alias("draw", "__s"))
    named = named.select(*names(keys), "draw", *[F.col(f"__s.{c}").alias(c) for c in ("pred", *others)])
    return named.where(F.col("pred").isNotNull())


def years_to_test(recent: int | Iterable[int], ref: int) -> dict[str, int]:
    """The pair of times a lag contrast compares, from the recent year or years."""
    latest = recent if isinstance(recent, int) else max(recent)
    return {"reference": latest + ref, "recent": latest}


def eligible_contexts(data: DataFrame, geo_cols: Iterable[str], time_col: str, reference: float, recent: float) -> DataFrame:
    """Geographies with data at or before ``reference`` and at or after ``recent``, in two different times."""
    geo_cols = names(geo_cols)
    span = data.groupBy(*geo_cols).agg(F.min(time_col).alias("min"), F.max(time_col).alias("max"))
    return span.where((F.col("max") >= recent) & (F.col("min") <= reference) & (F.col("max") > F.col("min")))


def expand_tests(contexts: DataFrame, reference: int, recent: int, time_col: str = "year") -> DataFrame:
    """Every context at both test times, as rows ``(..., type, time)``."""
    tests = F.array(
        *[
            F.struct(F.lit(kind).alias("type"), F.lit(at).alias(time_col))
            for kind, at in (("reference", reference), ("recent", recent))
        ]
    )
    return contexts.select(*contexts.columns, F.inline(tests))


def year_diff(
    pred: DataFrame, data: DataFrame, geo_cols: Iterable[str], reference: int, recent: int, time_col: str = "year", limit_preds: bool = True
) -> DataFrame:
    """Change draws ``recent - reference`` per geography.

    ``pred`` holds one draw array per geography and time.  With ``limit_preds``
    only geographies whose data span both test times are kept.  Both values
    come from one conditional aggregate over the two test times.
    """
    geo_cols = names(geo_cols)
    tests = pred.where(F.col(time_col).isin(reference, recent))
    if limit_preds:
        eligible = eligible_contexts(data, geo_cols, time_col, reference, recent).select(*geo_cols)
        tests = attach(tests, eligible, geo_cols, "left_semi")

    def at(when: int):
        return F.first(F.when(F.col(time_col) == when, F.col("pred")), ignorenulls=True)

    both = tests.groupBy(*geo_cols).agg(at(reference).alias("pred_reference"), at(recent).alias("pred_recent"))
    return (
        both.where(F.col("pred_reference").isNotNull() & F.col("pred_recent").isNotNull())
        .withColumn(f"{time_col}_reference", F.lit(reference))
        .withColumn(f"{time_col}_recent", F.lit(recent))
        .withColumn("diff", D.difference(F.col("pred_recent"), F.col("pred_reference")))
    )


def year_diff_draws(wide: DataFrame) -> DataFrame:
    """Change draws as one row per draw, draws without a difference dropped."""
    arrays = ("pred_reference", "pred_recent", "diff")
    kept = [c for c in wide.columns if c not in arrays]
    zipped = wide.select(*kept, F.posexplode(F.arrays_zip(*arrays)).alias("draw", "__s"))
    return zipped.where(F.col("__s.diff").isNotNull()).select(*kept, "draw", *[F.col(f"__s.{a}").alias(a) for a in arrays])
