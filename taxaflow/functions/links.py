"""Link functions, clamps and means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How far a proportion is kept off 0 and 1, for a Beta response
# and for an estimated occupancy.
BETA_MARGIN = 0.000001
OCCUPANCY_MARGIN = 0.00000001


def inverse_link(eta: Column, link: str = "logit") -> Column:
    """Response scale from the linear predictor."""
    if link == "logit":
        return 1 / (1 + F.exp(-eta))
    if link == "log":
        return F.exp(eta)
    if link == "identity":
        return eta
    raise ValueError(f"unknown link {link!r}")


def link(mu: Column, name: str = "logit") -> Column:
    """Linear predictor from the response scale."""
    if name == "logit":
        return F.ln(mu / (1 - mu))
    if name == "log":
        return F.ln(mu)
    if name == "identity":
        return mu
    raise ValueError(f"unknown link {name!r}")


def clamp_proportion(value: Column, margin: float = BETA_MARGIN) -> Column:
    """Exact 0 and exact 1 moved inside by ``margin``."""
    return F.when(value == 0, F.lit(margin)).when(value == 1, F.lit(1 - margin)).otherwise(value)


def proportion(success: Column, trials: Column) -> Column:
    """``success / trials``, null without trials."""
    return F.try_divide(success.cast("double"), trials.cast("double"))


def geo_mean(value: Column, na_rm: bool = False) -> Column:
    """Aggregate: geometric mean.

    Null for an empty group, for a value at or below zero and, unless ``na_rm``,
    for a missing value.  NaN is missing.
    """
    value = F.nanvl(value.cast("double"), F.lit(None))
    mean = F.when(F.min(value) > 0, F.exp(F.avg(F.when(value > 0, F.ln(value)))))
    return mean if na_rm else F.when(F.count(value) == F.count(F.lit(1)), mean)
