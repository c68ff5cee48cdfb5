"""Checks on posterior draws."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.functions import draws as D
from taxaflow.functions.keys import names, require, share

# A parameter fails at or above this Rhat, or below this effective size.
RHAT_LIMIT = 1.05
N_EFF_LIMIT = 100


def diagnostics_check(params: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Parameters, failures and pass per diagnostic, from a table with ``Rhat`` and ``n_eff``."""
    by = names(by)
    require(params, *by, "Rhat", "n_eff")
    long = params.select(*by, F.col("Rhat").cast("double"), F.col("n_eff").cast("double")).unpivot(by, ["Rhat", "n_eff"], "diagnostic", "value")
    fail = F.when(F.col("diagnostic") == "Rhat", F.col("value") >= RHAT_LIMIT).otherwise(F.col("value") < N_EFF_LIMIT)
    counted = long.groupBy(*by, "diagnostic").agg(F.count(F.lit(1)).alias("parameters"), F.count_if(fail).alias("failed"))
    return counted.withColumn("pass", F.col("failed") == 0)


def divergence_summary(draws: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Number and share of divergent draws per model, one row per draw in ``draws``."""
    return draws.groupBy(*names(by)).agg(
        F.count_if("divergent").alias("num_divergent"), share(F.col("divergent")).alias("prop_divergent"), F.count(F.lit(1)).alias("n_draws")
    )


def divergence_flags(draws: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Flags of a model's draws as one array in draw order."""
    ordered = F.array_sort(F.collect_list(F.struct("draw", "divergent")))
    return draws.groupBy(*names(by)).agg(F.transform(ordered, lambda s: s["divergent"]).alias("divergent"))


def _split_chains(chains) -> np.ndarray:
    """Halves of the chains, all as long as the shortest chain allows."""
    shortest = min(len(c) for c in chains)
    rows = np.array([np.asarray(c, dtype=float)[:shortest] for c in chains])
    half = rows.shape[1] // 2
    return np.concatenate([rows[:, :half], rows[:, rows.shape[1] - half :]])


def rhat_and_size(chains) -> tuple[float, float]:
    """Split-chain potential scale reduction and effective sample size (Vehtari and others 2021)."""
    x = _split_chains(chains)
    m, n = x.shape
    if n < 2:
        return float("nan"), float("nan")
    centred = x - x.mean(axis=1, keepdims=True)
    within = centred.var(axis=1, ddof=1).mean()
    between = n * x.mean(axis=1).var(ddof=1) if m > 1 else 0.0
    pooled = (n - 1) / n * within + between / n
    if within == 0:
        return float("nan"), float("nan")
    spectrum = np.fft.rfft(centred, 2 * n, axis=1)
    autocov = np.fft.irfft(spectrum * spectrum.conj(), axis=1)[:, :n] / n
    rho = 1 - (within - autocov.mean(axis=0) * n / (n - 1)) / pooled
    rho[0] = 1.0
    pair_sums = rho[: n // 2 * 2].reshape(-1, 2).sum(axis=1)
    negative = np.flatnonzero(pair_sums < 0)
    pair_sums = np.minimum.accumulate(pair_sums[: negative[0] if len(negative) else len(pair_sums)])
    tau = max(2 * pair_sums.sum() - 1, 1 / np.log10(m * n)) if m * n > 1 else 1.0
    return float(np.sqrt(pooled / within)), float(m * n / tau)


def chain_stats(chains: pd.Series) -> pd.DataFrame:
    """``rhat_and_size`` for a batch of parameters."""
    return pd.DataFrame([rhat_and_size(c) for c in chains], columns=["Rhat", "n_eff"])


def parameter_summary(draws: DataFrame, by: Iterable[str] = (), probs: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Mean, sd, quantiles, ``n_eff`` and ``Rhat`` per parameter from rows ``(parameter, chain, draw, value)``.

    Draws of one parameter are a few thousand numbers and travel as one array per chain.
    Chains of unequal length are compared over the length of the shortest.
    """
    by = names(by)
    require(draws, *by, "parameter", "chain", "draw", "value")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("draw", "value"))), lambda s: s["value"])
    chains = draws.groupBy(*by, "parameter", "chain").agg(in_order.alias("__x"))
    whole = chains.groupBy(*by, "parameter").agg(F.collect_list("__x").alias("__chains"))
    stats = F.pandas_udf(chain_stats, "struct<Rhat: double, n_eff: double>")
    base = whole.withColumns({"__all": D.ordered(F.flatten("__chains")), "__s": stats("__chains")})
    every = F.col("__all")
    centre = D.mean(every)
    squares = F.aggregate(every, F.lit(0.0), lambda acc, x: acc + F.pow(x - F.col("mean"), 2))
    base = base.withColumn("mean", centre)
    return base.select(
        *by, "parameter", "mean", F.sqrt(F.try_divide(squares, F.size(every) - 1)).alias("sd"),
        *[c.alias(n) for n, c in D.quantile_columns(every, probs).items()], "__s.n_eff", "__s.Rhat",
    )


def coefficient_counts(spec: DataFrame) -> DataFrame:
    """Fixed and random coefficients, and whether the covariate is in each model.

    Random coefficients are those named ``b[...]``, as samplers export them, or
    the level effects that our own fit keeps apart.
    """
    require(spec, "coefficients")
    is_random = lambda c: c.startswith("b[")
    apart = F.coalesce("n_level_effects", F.lit(0)) if "n_level_effects" in spec.columns else F.lit(0)
    return spec.withColumns(
        {
            "n_fixed_coefs": F.size(F.filter("coefficients", lambda c: ~is_random(c))).cast("long"),
            "n_random_coefs": F.size(F.filter("coefficients", is_random)) + apart.cast("long"),
            "has_cov": F.array_contains("coefficients", "use_cov"),
        }
    ).drop("coefficients")
