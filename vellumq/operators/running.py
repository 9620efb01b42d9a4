"""Running sums that no single task has to hold, whatever share of the rows one group has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumq.session import cut

SLICE = 4096


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def prefix_sums(df: DataFrame, group: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """Adds <s>_upto for each s in `sums`: the sum of s over the rows of the group up to and including this one.

    Two levels, so that a group may hold any share of all rows: rows are range-partitioned by (group, order) and the
    partition number is fixed by a written table; sums run within (partition, group) and get the totals of the
    group's earlier partitions, of which there are no more than partitions. (group, order) must be unique.
    """
    n = partitions(df)
    placed = cut(df.repartitionByRange(n, *group, *order).withColumn("__part", F.spark_partition_id()))
    local = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*group, "__part").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    totals = totals.select(*group, "__part", *[F.coalesce(F.sum(f"__t_{s}").over(before), F.lit(0)).alias(f"__o_{s}") for s in sums])
    out = placed.select("*", *[F.sum(s).over(local).alias(f"{s}_upto") for s in sums]).join(totals, [*group, "__part"])
    for s in sums:
        out = out.withColumn(f"{s}_upto", F.col(f"{s}_upto") + F.col(f"__o_{s}"))
    return out.drop("__part", *[f"__o_{s}" for s in sums])


def prefix_sums_by_number(df: DataFrame, group: list[str], number: str, value: str, out: str, size: int = SLICE) -> DataFrame:
    """As `prefix_sums` for one value in order of a whole number, without range partitions: sums run within slices of
    `size` numbers, and a slice gets the totals of the group's earlier slices, one row each. Rows of equal number in a
    group must be few; which of them comes first is undefined."""
    x = df.withColumn("__slice", F.floor(F.col(number) / size))
    local = Window.partitionBy(*group, "__slice").orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("__run", F.sum(value).over(local))
    before = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = x.groupBy(*group, "__slice").agg(F.max("__run").alias("__t")).select(*group, "__slice", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"))
    return x.join(totals, [*group, "__slice"]).withColumn(out, F.col("__run") + F.col("__o")).drop("__slice", "__run", "__o")
