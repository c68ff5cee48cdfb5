"""The catalog: named queries over the order and event tables, most with a DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaflow.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its SQL, if SQL can express it."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return rounded(fn(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.round(F.col(c), digits) for c in doubles}) if doubles else df


def r(expression: str) -> str:
    """The SQL counterpart of ``rounded``, without negative zero."""
    return f"(round(CAST({expression} AS DOUBLE), 6) + 0e0)"


OCC = """occ AS (
  SELECT p_brand || '/' || p_type AS taxa, p_brand || '/' || p_type || '@' || n_name AS local_taxa, p_name AS kind,
         l_orderkey AS list, l_linenumber AS line, o_custkey AS site, CAST(year(o_orderdate) AS INTEGER) AS year,
         r_name AS region, n_name AS nation, CAST(l_returnflag = 'R' AS INTEGER) AS success, p_size AS size,
         l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

LISTED = OCC + """, lengths AS (
  SELECT list, count(DISTINCT taxa) AS list_length FROM occ WHERE success > 0 GROUP BY list),
listed AS (SELECT occ.*, list_length FROM occ LEFT JOIN lengths USING (list))"""

DRAWS = """draws AS (
  SELECT 'model ' || (user_id % 3) AS type, 'taxon ' || (user_id % 4) AS taxa, event_type AS geo,
         CAST(day(ts) AS INTEGER) AS year, CAST(event_id % 20 AS INTEGER) AS draw, ln(1 + avg(value)) AS pred
  FROM events GROUP BY ALL)"""
