"""Running totals over one global order, without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written


def with_running_totals(rows: DataFrame, order: list[Column], totals: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """``rows`` plus inclusive running sums in ``order``, which must be total.

    Rows are range-partitioned, each range sums on its own, and the few range totals are summed
    once more and added as offsets: two narrow passes instead of one unpartitioned window.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumns({f"_{k}": v for k, v in totals.items()}).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "ranges")  # the range of a row must not change between the passes
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in totals])
    offsets = offsets.select("_part", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in totals])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # one row per range: never more than the number of shuffle partitions
    joined = dealt.join(F.broadcast(offsets), "_part")
    sums = {k: F.sum(f"_{k}").over(within) + F.col(f"_o_{k}") for k in totals}
    return joined.withColumns(sums).drop("_part", *[f"_{k}" for k in totals], *[f"_o_{k}" for k in totals])
