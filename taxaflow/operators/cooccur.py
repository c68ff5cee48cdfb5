"""Which taxa occur together more or less often than by chance."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaflow.functions.keys import attach, join_same, names, require
from taxaflow.operators.lists import presences

#: Taxa to a block, on average: a task holds the counts of one pair of blocks.
BLOCK = 1024
#: Presence rows of a bucket of sites, on average, and so at most the sites of a bit row.
TASK_ROWS = 32_768
#: Key of the one group there is when no ``by`` is given.
WHOLE = "__whole"


def presence(df: DataFrame, taxa_col: str, context: Iterable[str], by: Iterable[str] = (), success_col: str | None = None) -> DataFrame:
    """Distinct ``(by, taxon, site)``; the context columns become one site key."""
    by, context = names(by), names(context)
    require(df, *by, taxa_col, *context)
    if success_col:
        df = presences(df, success_col)
    site = F.col(context[0]) if len(context) == 1 else F.to_json(F.struct(*context), {"ignoreNullFields": "false"})
    return df.select(*by, F.col(taxa_col).alias("taxon"), site.alias("site")).distinct()


def taxon_sites(pres: DataFrame, by: Iterable[str]) -> DataFrame:
    """Sites of each taxon, totals of its group, and the taxon's place: a block by hash and a slot in it.

    Only the taxa of one block are ever put in order together.
    """
    by = names(by)
    counts = pres.groupBy(*by, "taxon").agg(F.count(F.lit(1)).alias("sites"))
    of_taxa = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("taxa"), F.max("sites").alias("most"), F.sum("sites").alias("rows"))
    of_sites = pres.select(*by, "site").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("all_sites"))
    placed = attach(counts, join_same(of_taxa, of_sites, by, "inner"), by, "inner").withColumns(
        {"blocks": F.ceil(F.col("taxa") / BLOCK).cast("int"), "buckets": F.ceil(F.col("rows") / TASK_ROWS).cast("int")}
    )
    in_block = W.partitionBy(*by, "block").orderBy("taxon")
    return placed.withColumn("block", F.pmod(F.xxhash64("taxon"), F.col("blocks")).cast("int")).withColumn(
        "slot", F.row_number().over(in_block) - 1
    )


def _block_pairs(block, others):
    """Every pair of ``block`` with one of ``others``, as structs ``(low, high)``."""
    return F.transform(others, lambda other: F.struct(F.least(block, other).alias("low"), F.greatest(block, other).alias("high")))


def shared_sites(pres: DataFrame, taxa: DataFrame, by: Iterable[str]) -> DataFrame:
    """Sites shared by each pair of taxa that share any, as ``(by, low, slot_low, high, slot_high, shared)``.

    The taxon-by-site matrix is cut into blocks of taxa and buckets of sites.  A
    taxon's sites of a bucket travel as one row of positions, and only to the
    blocks that occur in the bucket.  A task packs the rows of a pair of blocks
    into bits, and counts the bits of ANDed rows; pairs are never listed per site.
    """
    by = names(by)
    place = taxa.select(*by, "taxon", "block", "slot", "buckets")
    bucket = F.pmod(F.xxhash64("site"), F.col("buckets")).cast("int")
    placed = attach(pres, place, [*by, "taxon"], "inner").select(*by, "site", "block", "slot", bucket.alias("bucket"))
    numbered = placed.withColumn("position", F.dense_rank().over(W.partitionBy(*by, "bucket").orderBy("site")) - 1)
    rows = numbered.groupBy(*by, "bucket", "block", "slot").agg(F.collect_list("position").alias("positions"))
    found = rows.groupBy(*by, "bucket").agg(F.collect_set("block").alias("__found"))
    spread = join_same(rows, found, [*by, "bucket"], "inner").select(
        *by, "bucket", "block", "slot", "positions", F.inline(_block_pairs(F.col("block"), F.col("__found")))
    )
    schema = T.StructType(
        [pres.schema[c] for c in by]
        + [T.StructField(c, T.IntegerType()) for c in ("low", "slot_low", "high", "slot_high")]
        + [T.StructField("part", T.LongType())]
    )

    def multiply(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        low, high = key[-2], key[-1]
        left, right = rows[rows["block"] == low], rows[rows["block"] == high]
        a, b, count = shared_bits(left["positions"].tolist(), right["positions"].tolist())
        a, b = left["slot"].to_numpy()[a], right["slot"].to_numpy()[b]
        keep = a < b if low == high else np.ones(len(a), dtype=bool)
        out = pd.DataFrame({"low": low, "slot_low": a[keep], "high": high, "slot_high": b[keep], "part": count[keep]})
        for name, value in zip(reversed(by), reversed(key[: len(by)])):
            out.insert(0, name, value)
        return out

    parts = spread.groupBy(*by, "bucket", "low", "high").applyInPandas(multiply, schema)
    return parts.groupBy(*by, "low", "slot_low", "high", "slot_high").agg(F.sum("part").alias("shared"))


def pack(rows: list, width: int) -> np.ndarray:
    """Lists of positions below ``width`` as rows of 64-bit words."""
    bits = np.zeros((len(rows), -(-width // 64) * 64), dtype=np.uint8) if len(rows) * width < 1 << 24 else None
    if bits is None:  # so many bits that only one row at a time is held unpacked
        return np.concatenate([pack([row], width) for row in rows])
    for line, row in zip(bits, rows):
        line[row] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def shared_bits(left: list, right: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``left`` and ``right`` with common positions, and how many.  A row meets only words where it has bits."""
    none = np.empty(0, dtype=np.int64)
    if not left or not right:
        return none, none, none
    width = max(max(row) for row in [*left, *right]) + 1
    across = np.ascontiguousarray(pack(right, width).T)
    a, b, count = [], [], []
    for i, row in enumerate(pack(left, width)):
        words = np.flatnonzero(row)
        both = np.bitwise_count(across[words] & row[words, None]).sum(axis=0, dtype=np.int64)
        j = np.flatnonzero(both)
        a.append(np.full(len(j), i))
        b.append(j)
        count.append(both[j])
    return np.concatenate(a), np.concatenate(b), np.concatenate(count)


def cooccur_pairs(
    df: DataFrame,
    taxa_col: str = "taxa",
    context: Iterable[str] = (),
    by: Iterable[str] = (),
    success_col: str | None = None,
    thresh: bool = True,
) -> DataFrame:
    """Sites of both taxa, shared sites and the number expected by chance, pairs without a shared site included.

    With ``thresh`` pairs expected at less than one site are left out, which also
    spares the taxa that cannot reach it with any partner.  Pairs of taxa are
    formed block by block, so their number in a task is bounded.
    """
    by = names(by)
    pres, groups = presence(df, taxa_col, context, by, success_col), by or [WHOLE]
    if not by:
        pres = pres.withColumn(WHOLE, F.lit(0))
    taxa = taxon_sites(pres, groups)
    table = taxa.where(F.col("sites") * F.col("most") >= F.col("all_sites")) if thresh else taxa
    spread = table.select(
        *groups, "taxon", "sites", "all_sites", "block", "slot",
        F.inline(_block_pairs(F.col("block"), F.sequence(F.lit(0), F.col("blocks") - 1))),
    )
    keys = [*groups, "low", "high"]

    def side(which: str):
        return spread.where(F.col("block") == F.col(which)).select(
            *keys, F.struct("taxon", "sites").alias(f"of_{which}"), F.col("slot").alias(f"slot_{which}"), *(["all_sites"] if which == "low" else [])
        )

    pairs = join_same(side("low"), side("high"), keys, "inner").where(
        (F.col("low") < F.col("high")) | (F.col("slot_low") < F.col("slot_high"))
    )
    product = F.col("of_low.sites") * F.col("of_high.sites")
    if thresh:
        pairs = pairs.where(product >= F.col("all_sites"))
    counted = join_same(pairs, shared_sites(pres, taxa, groups), [*groups, "low", "slot_low", "high", "slot_high"])
    # Structs compare by taxon first, a null taxon before all others.
    a, b = F.least("of_low", "of_high"), F.greatest("of_low", "of_high")
    expected = product / F.col("all_sites")
    return counted.select(
        *by, a["taxon"].alias("taxon_a"), b["taxon"].alias("taxon_b"), a["sites"].alias("sites_a"), b["sites"].alias("sites_b"), "all_sites",
        F.coalesce("shared", F.lit(0)).alias("observed"), expected.alias("expected"),
        (expected / F.col("all_sites")).alias("prob"),
    )


#: From here on the series for the error of Stirling's formula is exact in double precision.
SERIES_FROM = 16


def stirling_error(n: Column) -> Column:
    """``ln n!`` less Stirling's formula for it; a whole ``n`` of 1 or more."""
    small = [0.0] + [math.lgamma(k + 1) - 0.5 * math.log(2 * math.pi * k) - k * math.log(k) + k for k in range(1, SERIES_FROM)]
    table = F.array(*[F.lit(v) for v in small])
    square = n * n
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - (1 / 1188) / square) / square) / square) / square) / n
    return F.when(n < SERIES_FROM, F.get(table, F.least(n, F.lit(SERIES_FROM)).cast("int"))).otherwise(series)


def log_binomial(x: Column, n: Column, p: Column, q: Column) -> Column:
    """Log probability of ``x`` out of ``n``; large terms cancel before they are formed, so it keeps its digits."""

    def deviance(seen: Column, mean: Column) -> Column:
        return seen * F.log1p((seen - mean) / mean) - (seen - mean)

    y = n - x
    inside = (
        stirling_error(n) - stirling_error(x) - stirling_error(y) - deviance(x, n * p) - deviance(y, n * q)
        + 0.5 * F.ln(n / (2 * math.pi * x * y))
    )
    return F.when(n == 0, F.lit(0.0)).when(x == 0, n * F.ln(q)).when(y == 0, n * F.ln(p)).otherwise(inside)


def add_tail_probabilities(pairs: DataFrame) -> DataFrame:
    """Add ``p_lt`` = P(shared <= observed) and ``p_gt`` = P(shared >= observed), both tails with the observed count.

    The probability of the observed count comes from log-gamma series; the tail
    on its side of the mode is summed from there outward by ratios of terms, so
    its relative error stays small however far out it is.  Ratios only fall on
    the way: what a sum leaves out is below 1e-20 of the tail.  The other tail,
    always the larger one, is the rest.
    """
    big, a, b, observed = (F.col(c).cast("double") for c in ("all_sites", "sites_a", "sites_b", "observed"))
    p, q = b / big, (big - b) / big
    at = F.exp(log_binomial(observed, a, p, q) + log_binomial(b - observed, big - a, p, q) - log_binomial(b, big, p, q))
    upper = observed >= F.floor((a + 1) * (b + 1) / (big + 2))
    # Shared sites below the mode are sites of b without a above the mode of those.
    base = pairs.withColumns(
        {"__at": at, "__upper": upper, "__x": F.when(upper, observed).otherwise(b - observed), "__a": F.when(upper, a).otherwise(big - a)}
    )
    x, side = F.col("__x"), F.col("__a")

    def ratio(j: Column) -> Column:
        """Probability of ``j + 1`` by that of ``j``."""
        return F.try_divide((side - j) * (b - j), (j + 1) * (big - side - b + j + 1))

    spread = F.coalesce(F.sqrt(a * b / big * (1 - a / big) * F.try_divide(big - b, big - 1)), F.lit(0.0))
    first = ratio(x)
    shrinking = F.when((first > 0) & (first < 1), F.ceil(-50 / F.ln(first)))
    steps = F.least(F.least(side, b) - x, F.ceil(10 * spread + 30), shrinking).cast("int")
    start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("all"))

    def step(s, i):
        w = s["w"] * ratio(x + i - 1)
        return F.struct(w.alias("w"), (s["all"] + w).alias("all"))

    numbers = F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    near = F.least(F.col("__at") * F.aggregate(numbers, start, step)["all"], F.lit(1.0))
    summed = base.withColumn("__near", near)
    rest = F.least(1 - F.col("__near") + F.col("__at"), F.lit(1.0))
    return summed.withColumns(
        {"p_lt": F.when(F.col("__upper"), rest).otherwise(F.col("__near")), "p_gt": F.when(F.col("__upper"), F.col("__near")).otherwise(rest)}
    ).drop("__at", "__upper", "__x", "__a", "__near")


def cooccur_test(
    df: DataFrame,
    taxa_col: str = "taxa",
    context: Iterable[str] = (),
    by: Iterable[str] = (),
    success_col: str | None = None,
    thresh: bool = True,
    true_rand: float = 0.1,
    alpha: float = 0.05,
) -> DataFrame:
    """Probabilistic co-occurrence test for every pair of taxa, with its class."""
    tested = add_tail_probabilities(cooccur_pairs(df, taxa_col, context, by, success_col, thresh))
    near = F.abs(F.col("observed") - F.col("expected")) <= true_rand * F.col("all_sites")
    kind = (
        F.when(F.col("p_gt") < alpha, "positive")
        .when(F.col("p_lt") < alpha, "negative")
        .when(near, "random")
        .otherwise("unclassifiable")
    )
    return tested.withColumn("class", kind)


def presence_matrix(df: DataFrame, taxa_col: str, context_col: str, values: Iterable, success_col: str | None = None) -> DataFrame:
    """Optional wide form for a given list of sites: 1 where the taxon was present, else 0."""
    pres = presence(df, taxa_col, [context_col], (), success_col)
    values = list(values)
    cells = [F.max(F.when(F.col("site") == v, 1).otherwise(0)).alias(f"{context_col}_{v}") for v in values]
    return pres.groupBy(F.col("taxon").alias(taxa_col)).agg(*cells)
