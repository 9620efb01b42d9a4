"""Problem 3: flat tables of chunks and regions from typed rows and from raw JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumq.operators.shred import json_tables, typed_child
from vellumq.session import one_per_key
from vellumq.sources.tables import chunks, table

#: Where a region's corner may stand in the JSON layouts (fixed values).
CORNERS = {
    "page": ["page"],
    "x0": ["bbox.x0", "bbox.min.x", "bbox[]:0"],
    "y0": ["bbox.y0", "bbox.min.y", "bbox[]:1"],
    "x1": ["bbox.x1", "bbox.max.x", "bbox[]:2"],
    "y1": ["bbox.y1", "bbox.max.y", "bbox[]:3"],
}


def _whole(c: str) -> F.Column:
    return F.expr(f"cast(try_cast({c} as double) as bigint)")


def typed_regions(c: DataFrame, leaves: list[str]) -> DataFrame:
    """Regions of typed chunks, tied to chunk_id; a region without a page takes page_start."""
    kids = typed_child(c, "chunk_ord", "regions", leaves)
    return kids.join(c.select("chunk_ord", "chunk_id", "page_start"), "chunk_ord").withColumn("page", F.coalesce(_whole("page"), F.col("page_start").cast("bigint")))


def latest(files: DataFrame) -> DataFrame:
    """(file_key, payload): the latest version of each file; a file without a name is known by its content."""
    at = F.col("loaded_at") if "loaded_at" in files.columns else F.lit(None).cast("timestamp")
    one = files.filter("payload is not null").select(F.coalesce("file_name", F.concat(F.lit("#"), F.sha2("payload", 256))).alias("file_key"), "payload", at.alias("loaded_at"))
    return one_per_key(one, ["file_key"], ["loaded_at"]).select("file_key", "payload")


def json_regions(files: DataFrame, corners: dict[str, list[str]]) -> DataFrame:
    """Regions of raw chunk files, tied to chunk_id; pages as in `typed_regions`, else of the page around the chunk."""
    rec, kids = json_tables(latest(files), "file_key", "payload", "chunk_id", ["page_start", "page_end"], "regions", corners, ["page"])
    j = kids.join(rec, ["file_key", "base", "idx"]).filter("chunk_id is not null")
    return j.withColumn("page", F.coalesce(_whole("page"), _whole("page_start"), _whole("above_page")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    a = typed_regions(chunks(spark, folder), ["page"])
    b = json_regions(table(spark, folder, "chunk_files"), {"page": ["page"]})
    cols = ["chunk_id", F.col("n").cast("bigint").alias("region_no"), "page"]
    return a.select(*cols).union(b.select(*cols)).distinct()


def p3_regions(spark: SparkSession, folder: str) -> DataFrame:
    """All regions with their corners."""
    a = typed_regions(chunks(spark, folder), ["page", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1"])
    for x in ("x0", "y0", "x1", "y1"):
        a = a.withColumnRenamed(f"bbox.{x}", x)
    b = json_regions(table(spark, folder, "chunk_files"), CORNERS)
    cols = ["chunk_id", F.col("n").cast("bigint").alias("region_no"), "page", *[F.expr(f"try_cast({x} as double)").alias(x) for x in ("x0", "y0", "x1", "y1")]]
    return a.select(*cols).union(b.select(*cols)).distinct()


def p3_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All chunks of both sources with their pages."""
    a = chunks(spark, folder).select("chunk_id", F.col("page_start").cast("bigint").alias("page_start"), F.col("page_end").cast("bigint").alias("page_end"))
    rec, _ = json_tables(latest(table(spark, folder, "chunk_files")), "file_key", "payload", "chunk_id", ["page_start", "page_end"], "regions", {"page": ["page"]}, ["page"])
    b = rec.filter("chunk_id is not null").select("chunk_id", F.coalesce(_whole("page_start"), _whole("above_page")).alias("page_start"), _whole("page_end").alias("page_end"))
    return a.union(b).distinct()


def queries() -> dict:
    return {"p3_found": p3_found, "p3_regions": p3_regions, "p3_chunks": p3_chunks}
