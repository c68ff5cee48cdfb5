"""Column checks and null-aware keys shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def names(cols: str | Iterable[str] | None) -> list[str]:
    """One name, several names or none, as a list."""
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def require(df: DataFrame, *cols: str) -> None:
    """Raise on a column that ``df`` does not have."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns {missing}; the table has {df.columns}")


def is_floating(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType))


def is_integral(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def nan_to_null(df: DataFrame, *cols: str) -> DataFrame:
    """Turn NaN into null, so comparisons and aggregates treat it as missing."""
    floating = [c for c in cols if is_floating(df, c)]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in floating}) if floating else df


def join_same(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "left", tiny: bool = False) -> DataFrame:
    """Equi-join on ``keys`` where null matches null; key columns stay those of ``left``.

    ``tiny`` is for a right side with a row bound known from the call itself, such
    as one row per column of a table; only then is it broadcast by hint.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("a join needs at least one key")
    hidden = {k: f"__right_{k}" for k in keys}
    right = right.select(*[F.col(k).alias(hidden[k]) for k in keys], *[c for c in right.columns if c not in keys])
    match = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(hidden[k])) for k in keys])
    joined = left.join(F.broadcast(right) if tiny else right, match, how)
    return joined if how in ("left_anti", "left_semi") else joined.drop(*hidden.values())


#: Ways a group's rows are split when a per-group table is attached to them.
SALTS = 8


def attach(rows: DataFrame, groups: DataFrame, keys: Iterable[str], how: str = "left", tiny: bool = False) -> DataFrame:
    """Join a table of one row per group to rows of which one group may hold very many.

    Each group's row is repeated once per salt, and rows take a salt from a hash of
    their other columns, so a hot group arrives at several tasks.  The salt also
    keeps a later ``groupBy`` on the same keys from reusing this partitioning:
    it pre-aggregates and shuffles afresh, which leaves adaptive execution free
    to split the join further.
    """
    if tiny:
        return join_same(rows, groups, keys, how, tiny=True)
    keys = list(keys)
    others = [c for c in rows.columns if c not in keys]
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int") if others else F.lit(0))
    repeated = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return join_same(salted, repeated, [*keys, "__salt"], how).drop("__salt")


def count_levels(*cols: str) -> Column:
    """Number of distinct combinations, a null counting as one more value."""
    return F.count_distinct(F.struct(*cols))


def share(condition: Column) -> Column:
    """Share of rows (with a known condition) where ``condition`` holds."""
    return F.avg(condition.cast("double"))
