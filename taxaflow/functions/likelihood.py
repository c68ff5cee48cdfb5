"""Words for probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaflow.functions.keys import join_same, names

# Upper bound and word of each likelihood class (IPCC guidance
# note on consistent treatment of uncertainties, 2010).
LIKELIHOOD = (
    (0.01, "Exceptionally unlikely"),
    (0.05, "Extremely unlikely"),
    (0.1, "Very unlikely"),
    (0.33, "Unlikely"),
    (0.66, "About as likely as not"),
    (0.9, "Likely"),
    (0.95, "Very likely"),
    (0.99, "Extremely likely"),
    (1.0, "Virtually certain"),
)

Scale = Sequence[tuple[float, str]]


def _by_class(probability: Column, values: Sequence, scale: Scale) -> Column:
    out = F.when(probability < 0, F.lit(None))
    for (upper, _), value in zip(scale, values):
        out = out.when(probability <= upper, F.lit(value))
    return out


def likelihood(probability: Column, scale: Scale = LIKELIHOOD) -> Column:
    """Word of the class ``(previous bound, bound]``; 0 is in the first, outside is null."""
    return _by_class(probability, [word for _, word in scale], scale)


def likelihood_order(probability: Column, scale: Scale = LIKELIHOOD) -> Column:
    """Position of the class, from 1."""
    return _by_class(probability, list(range(1, len(scale) + 1)), scale)


def add_likelihood(df: DataFrame, col: str, scale: Scale = LIKELIHOOD) -> DataFrame:
    """Add ``likelihood`` and its ``likelihood_ord`` for the probability in ``col``."""
    return df.withColumns(
        {"likelihood": likelihood(F.col(col), scale), "likelihood_ord": likelihood_order(F.col(col), scale)}
    )


def scale_table(spark: SparkSession, scale: Scale = LIKELIHOOD) -> DataFrame:
    """The scale as rows ``(likelihood_ord, max_val, likelihood)``."""
    rows = [(i + 1, float(upper), word) for i, (upper, word) in enumerate(scale)]
    return spark.createDataFrame(rows, "likelihood_ord int, max_val double, likelihood string")


def count_classes(df: DataFrame, col: str, by: Sequence[str] = (), scale: Scale = LIKELIHOOD) -> DataFrame:
    """Rows per likelihood class and group, classes without a row included as 0."""
    by = names(by)
    found = add_likelihood(df, col, scale).where(F.col("likelihood").isNotNull())
    counts = found.groupBy(*by, "likelihood_ord").agg(F.count(F.lit(1)).alias("rows"))
    classes = F.array(
        *[F.struct(F.lit(i + 1).alias("likelihood_ord"), F.lit(w).alias("likelihood")) for i, (_, w) in enumerate(scale)]
    )
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    every = groups.select(*by, F.inline(classes))
    return join_same(every, counts, [*by, "likelihood_ord"]).withColumn("rows", F.coalesce("rows", F.lit(0)))
