"""Summaries of arrays of posterior draws, one array element per draw.

Arrays keep the draws of one prediction in one row: no shuffle on the draw, and
pairing two predictions draw by draw is a ``zip_with``.  A missing draw is a
null element.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from taxaflow.functions.text import quantile_name


def known(draws: Column) -> Column:
    """Draws that are present."""
    return F.filter(draws, lambda x: x.isNotNull())


def count_known(draws: Column) -> Column:
    return F.size(known(draws)).cast("long")


def total(draws: Column) -> Column:
    return F.aggregate(known(draws), F.lit(0.0), lambda acc, x: acc + x)


def mean(draws: Column) -> Column:
    return F.try_divide(total(draws), count_known(draws))


def share_of(draws: Column, test) -> Column:
    """Share of the present draws that pass ``test``, null without any."""
    return F.try_divide(F.size(F.filter(draws, test)).cast("double"), count_known(draws))


def quantile(ordered: Column, p: float) -> Column:
    """Linear-interpolation quantile of an array that is sorted and without nulls."""
    n = F.size(ordered)
    place = (n - 1) * F.lit(float(p))
    low = F.floor(place).cast("int")
    at_low = F.try_element_at(ordered, low + 1)
    at_high = F.try_element_at(ordered, F.least(low + 2, n))
    return F.when(n > 0, at_low + (at_high - at_low) * (place - low))


def quantile_columns(ordered: Column, probs: Sequence[float], prefix: str = "") -> dict[str, Column]:
    """One named column per probability, from a sorted array."""
    return {quantile_name(p, prefix): quantile(ordered, p) for p in probs}


def ordered(draws: Column) -> Column:
    """Present draws in ascending order."""
    return F.array_sort(known(draws))


def direction(draws: Column) -> Column:
    """Probability of direction: the larger of P(x > 0) and P(x < 0)."""
    return F.greatest(share_of(draws, lambda x: x > 0), share_of(draws, lambda x: x < 0))


def significance(draws: Column, threshold: float = 0.05) -> Column:
    """Practical significance: the larger of P(x > t) and P(x < -t)."""
    return F.greatest(share_of(draws, lambda x: x > threshold), share_of(draws, lambda x: x < -threshold))


def geo_mean_of(draws: Column) -> Column:
    """Geometric mean of the present draws; null if one is not positive or none is there."""
    logs = F.aggregate(known(draws), F.lit(0.0), lambda acc, x: acc + F.when(x > 0, F.ln(x)))
    return F.when(count_known(draws) > 0, F.exp(logs / count_known(draws)))


def difference(a: Column, b: Column) -> Column:
    """Draw by draw ``a - b``."""
    return F.zip_with(a, b, lambda x, y: x - y)


def ratio(a: Column, b: Column) -> Column:
    """Draw by draw ``a / b``, null where ``b`` is 0."""
    return F.zip_with(a, b, lambda x, y: F.try_divide(x, y))


def keep_where(draws: Column, flags: Column, wanted: bool) -> Column:
    """Draws whose flag equals ``wanted``; an unknown flag matches neither."""
    return F.transform(
        F.filter(F.arrays_zip(draws.alias("d"), flags.alias("f")), lambda s: s["f"] == wanted), lambda s: s["d"]
    )
