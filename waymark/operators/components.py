"""Connected components of an edge table by alternating star contractions (Kiveris et al. 2014).

Both star steps are an aggregation (with map-side combine) followed by an equi-join whose one side has a single
row per key, so a hub never has to fit into one task: adaptive execution may split the other side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.session import cut_lineage


def _lowest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(down)
    moved = down.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Component of every node that has an edge: ``(node, component)``, the component being its smallest node.

    ``edges``: two columns of one orderable type; direction, repeats, self-loops and nulls do not matter (rows with a
    null end are ignored). An empty table gives an empty table. Nodes without an edge to another node are left out.
    """
    a, b = edges.columns[:2]
    current = cut_lineage(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    )
    seen = None
    for _ in range(max_rounds):
        current = cut_lineage(_small_star(_large_star(current).where("u <> v")).where("u <> v").distinct())
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def dense_numbers(values: DataFrame, column: str, into: str = "number") -> DataFrame:
    """The different values of a column with their ranks from 0, without sorting them in one task.

    Values are dealt out by range; each range numbers its own, behind the counts of the ranges before it. Those counts,
    one a partition, are all that comes to the driver.
    """
    ranged = cut_lineage(values.select(column).distinct().repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    table = values.sparkSession.createDataFrame(offsets, "_part int, _before long")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(column))
    return ranged.join(F.broadcast(table), "_part").select(column, (F.col("_before") + own - 1).alias(into))
