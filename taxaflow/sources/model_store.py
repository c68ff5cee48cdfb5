"""Model tables in parquet, one folder per table, partitioned by model."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaflow.functions.keys import join_same, names


def write_model(tables: Mapping[str, DataFrame], path: str, by: str = "model_id", partition: bool = True) -> None:
    """Write each table under ``path``; only the models in the table are replaced.

    Rows of one model are brought together before writing to keep files few; the
    rebalance hint lets adaptive execution cut a very large model into several.
    """
    for name, table in tables.items():
        if partition:
            writer = table.hint("rebalance", F.col(by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by)
        else:
            writer = table.write.mode("overwrite")
        writer.parquet(f"{path}/{name}")


def read_model(spark: SparkSession, path: str, names_: Iterable[str], model_ids: Iterable[str] | None = None, by: str = "model_id") -> dict[str, DataFrame]:
    """Read tables back; ``model_ids`` becomes a partition filter."""
    out = {}
    for name in names(names_):
        table = spark.read.parquet(f"{path}/{name}")
        out[name] = table.where(F.col(by).isin(list(model_ids))) if model_ids is not None else table
    return out


def pending_models(models: DataFrame, done: DataFrame | None, force_new: bool = False, by: str | Iterable[str] = "model_id") -> DataFrame:
    """Models still to run: all of them if forced, else those without results."""
    by = names(by)
    wanted = models.select(*by).distinct()
    return wanted if force_new or done is None else join_same(wanted, done.select(*by).distinct(), by, "left_anti")
