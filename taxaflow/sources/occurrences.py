"""Occurrence records from parquet."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaflow.functions.keys import nan_to_null


def read_occurrences(spark: SparkSession, path: str, mapping: Mapping[str, str | Column]) -> DataFrame:
    """Read parquet and name its columns for the operators.

    ``mapping`` gives each wanted column as a source column name or expression;
    only those columns are scanned.
    """
    raw = spark.read.parquet(path)
    chosen = raw.select(*[(F.col(e) if isinstance(e, str) else e).alias(name) for name, e in mapping.items()])
    return nan_to_null(chosen, *chosen.columns)


def read_order_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrence records built from a folder of order tables.

    An order is a survey list, a customer a site, a product a taxon, a returned
    line a presence; regions and nations are the geography.
    """

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    orders = table("orders").select(
        F.col("o_orderkey").alias("list"), "o_custkey", F.col("o_orderdate").alias("seen_at")
    )
    parts = table("part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("taxa"), "p_name", "p_size")
    places = (
        table("customer")
        .select("c_custkey", "c_nationkey")
        .join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    )
    return (
        table("lineitem")
        .join(orders, F.col("l_orderkey") == F.col("list"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(places, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "taxa",
            F.concat_ws("@", "taxa", "nation").alias("local_taxa"),
            F.col("p_name").alias("kind"),
            "list",
            F.col("l_linenumber").alias("line"),
            F.col("o_custkey").alias("site"),
            F.year("seen_at").alias("year"),
            "region",
            "nation",
            (F.col("l_returnflag") == "R").cast("int").alias("success"),
            F.col("p_size").alias("size"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("discount"),
        )
    )


def read_event_draws(spark: SparkSession, folder: str, n_draws: int = 20) -> DataFrame:
    """Draws built from a folder's event table: ``(type, geo, taxa, year, draw, pred)``.

    A day of the month stands for a year, an event type for a geography or
    category; values that share all keys are averaged, so keys are unique, and put on a log scale.
    """
    events = spark.read.parquet(f"{folder}/events.parquet")
    named = events.select(
        F.concat(F.lit("model "), F.pmod("user_id", F.lit(3)).cast("string")).alias("type"),
        F.concat(F.lit("taxon "), F.pmod("user_id", F.lit(4)).cast("string")).alias("taxa"),
        F.col("event_type").alias("geo"),
        F.dayofmonth("ts").alias("year"),
        F.pmod("event_id", F.lit(n_draws)).cast("int").alias("draw"),
        F.col("value").alias("pred"),
    )
    keys = ("type", "taxa", "geo", "year", "draw")
    return named.groupBy(*keys).agg(F.log1p(F.avg("pred")).alias("pred"))
