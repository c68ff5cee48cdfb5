"""Short statements for reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantile_name(p: float, prefix: str = "") -> str:
    """Column name of a quantile: ``q05`` for 0.05, ``q02_5`` for 0.025."""
    whole, _, part = f"{round(100 * p, 6):.6f}".rstrip("0").partition(".")
    return f"{prefix}q{int(whole):02d}" + (f"_{part}" if part else "")


def plain_number(value: Column, digits: int = 2) -> Column:
    """Value rounded half to even, without trailing zeros."""
    fixed = F.bround(value, digits).cast(f"decimal(38,{digits})").cast("string")
    return F.regexp_replace(fixed, r"\.?0+$", "") if digits else fixed


def percent(share: Column) -> Column:
    """Share as whole percent, rounded half to even."""
    return F.round(F.bround(share, 2) * 100).cast("int").cast("string")


def interval_text(middle: Column, low: Column, high: Column, digits: int = 2) -> Column:
    """``0.42 (0.31 to 0.55)``"""
    return F.concat(
        plain_number(middle, digits), F.lit(" ("), plain_number(low, digits), F.lit(" to "), plain_number(high, digits), F.lit(")")
    )


def lower_text(likelihood: Column, share: Column, place: Column, islands: Iterable[str] = ()) -> Column:
    """``likely to be lower in <place> (71% chance)``; islands take ``on``."""
    islands = list(islands)
    preposition = F.when(place.isin(islands), F.lit(" on ")).otherwise(F.lit(" in ")) if islands else F.lit(" in ")
    return F.concat(F.lower(likelihood), F.lit(" to be lower"), preposition, place, F.lit(" ("), percent(share), F.lit("% chance)"))


def declining_text(likelihood: Column, share: Column) -> Column:
    """``likely to be declining (71% chance)``"""
    return F.concat(F.lower(likelihood), F.lit(" to be declining ("), percent(share), F.lit("% chance)"))


def sentence_list(items: Column) -> Column:
    """Array of texts as ``a, b and c``, sorted."""
    ordered = F.array_sort(items)
    count = F.size(ordered)
    return (
        F.when(count == 0, F.lit(""))
        .when(count == 1, F.try_element_at(ordered, F.lit(1)))
        .otherwise(
            F.concat(
                F.array_join(F.slice(ordered, 1, F.greatest(count - 1, F.lit(1))), ", "),
                F.lit(" and "),
                F.try_element_at(ordered, F.lit(-1)),
            )
        )
    )
