"""Connected components of a distributed graph by alternating large and small stars.

Edges are never gathered: each round is two aggregations (the least neighbour of a node) and two
joins.  The least-neighbour aggregation combines on the map side and the joins are ordinary
shuffled ones that adaptive execution may split, so a hub costs no single task.  Rounds are
written to the shared folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import drop_written, shared_dir, written

MAX_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge already leads from the larger to the smaller node
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node in ``edges`` (u, v); a component is its least node."""
    spark = edges.sparkSession
    shared_dir(spark)
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), name)
    mark = _mark(now)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        after = written(_small_star(_large_star(now)), name)
        for path in {f.rsplit("/", 1)[0] for f in now.inputFiles()}:
            drop_written(spark, path)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
