"""List lengths and list names of survey visits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.functions.keys import join_same, names, nan_to_null, require


def presences(df: DataFrame, success_col: str = "success") -> DataFrame:
    """Rows that record a presence."""
    require(df, success_col)
    return nan_to_null(df, success_col).where(F.col(success_col) > 0)


def list_lengths(
    df: DataFrame, taxa_col: str | Iterable[str] = "taxa", context: Iterable[str] = (), success_col: str = "success"
) -> DataFrame:
    """Distinct taxa among the presences of each context.

    The distinct shuffles on (context, taxon), so a context with very many rows
    is spread over all tasks and arrives at its own task as one partial count
    per map task.
    """
    taxa, context = names(taxa_col), names(context)
    require(df, *taxa, *context)
    seen = presences(df, success_col).select(*taxa, *context).distinct()
    return seen.groupBy(*context).agg(F.count(F.lit(1)).alias("list_length"))


def unite(cols: Iterable[str], sep: str = "_") -> Column:
    """Columns pasted into one text, a null written as NA."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in names(cols)])


def add_list_length(
    df: DataFrame,
    taxa_col: str | Iterable[str] = "taxa",
    context: Iterable[str] = (),
    create_list_col: bool = False,
    sep: str = "_",
    success_col: str = "success",
) -> DataFrame:
    """Add ``list_length`` to every row, null where its context has no presence.

    With ``create_list_col`` the context is also written as one text, ``list``.
    """
    context = names(context)
    df = df.drop("list_length")
    out = join_same(df, list_lengths(df, taxa_col, context, success_col), context, "left")
    return out.withColumn("list", unite(context, sep)) if create_list_col else out
