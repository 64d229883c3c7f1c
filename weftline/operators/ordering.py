"""Global order without a single task: rows are dealt by ranges and numbered in two steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut


def numbered(df: DataFrame, order: Sequence[str], name: str, partitions: int | None = None) -> DataFrame:
    """df with the place of each row in a global order, from 1. Ties keep an arbitrary but fixed order."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = dealt.withColumn("__within", F.row_number().over(Window.partitionBy("__part").orderBy("__row")))
    return within.join(F.broadcast(before.select("__part", "__before")), "__part").withColumn(name, F.col("__before") + F.col("__within")).drop("__part", "__row", "__before", "__within")
