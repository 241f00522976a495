"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.storage import remove, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every end of a link (a, b); root is one node of the component.

    Each round maps every node to the least node next to it or itself, then contracts the links to what their ends
    map to, so long chains shrink by a factor; earlier maps are composed with the new one. Only counts reach the driver."""
    spark = links.sparkSession
    edges, edge_path = written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    maps, map_path = written(ends.withColumn("root", F.col("node")), "roots")
    while edges.limit(1).count():
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        step = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to"))
        step, step_path = written(step, "step")
        # a node may map to one that maps on: follow once more
        on = step.select(F.col("u").alias("to"), F.col("to").alias("further"))
        step2 = step.join(on, "to", "left").select("u", F.coalesce("further", "to").alias("to"))
        step2, step2_path = written(step2, "step")
        new_maps, new_map_path = written(maps.join(step2.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        a = edges.join(step2.select(F.col("u").alias("a"), F.col("to").alias("x")), "a").select("b", "x")
        new = a.join(step2.select(F.col("u").alias("b"), F.col("to").alias("y")), "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        new, new_path = written(new, "links")
        remove(spark, edge_path, map_path, step_path, step2_path)
        edges, edge_path, maps, map_path = new, new_path, new_maps, new_map_path
    remove(spark, edge_path)
    return maps
