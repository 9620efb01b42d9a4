"""Named Parquet tables below one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumq.session import one_per_key, ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks, one row for each block_id (the latest loaded)."""
    return one_per_key(table(spark, folder, "blocks"), ["block_id"], ["loaded_at"])


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks, one row for each chunk_ord (the latest loaded)."""
    return one_per_key(table(spark, folder, "chunks"), ["chunk_ord"], ["loaded_at"])
