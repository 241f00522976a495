"""Edges kept by endpoint, in bucketed tables that hops join without moving them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.storage import new_path, remove


@dataclass(frozen=True)
class Adjacency:
    """Two tables of the same edges (from_node, to_node, edge_type, ordinal, source_id), in buckets of one end each and
    sorted by it. Their names are in the session's catalog, their files in the shared folder."""

    spark: SparkSession
    name: str
    buckets: int

    def by(self, end: str) -> DataFrame:
        """All edges, in buckets of `from_node` or `to_node`."""
        return self.spark.table(f"{self.name}_{end}")

    def at(self, nodes: DataFrame, types: list[str] | None = None, ends: tuple[str, ...] = ("from_node", "to_node")) -> DataFrame:
        """Edges of the nodes (node) as node, neighbour, edge_type, ordinal, source_id and direction, by their types."""
        out = None
        for end, other in (("from_node", "to_node"), ("to_node", "from_node")):
            if end in ends:
                e = self.by(end) if types is None else self.by(end).filter(F.col("edge_type").isin(*types))
                x = nodes.select("node").distinct().join(e, F.col("node") == F.col(end)).select("node", F.col(other).alias("neighbour"), "edge_type", "ordinal", "source_id", F.lit("out" if end == "from_node" else "in").alias("direction"))
                out = x if out is None else out.unionByName(x)
        return out

    def upserted(self, edges: DataFrame, sources: DataFrame) -> Adjacency:
        """Tables in which the sources (source_id) have these edges alone. The tables before
        stay until `drop`."""
        gone = sources.select("source_id").distinct()
        tables = {end: self.by(end).join(gone, "source_id", "left_anti").unionByName(edges.select(self.by(end).columns).distinct()) for end in ("from_node", "to_node")}
        return _made(self.spark, tables, self.buckets)

    def drop(self) -> None:
        for end in ("from_node", "to_node"):
            path = self.spark.sql(f"DESCRIBE FORMATTED {self.name}_{end}").filter("col_name = 'Location'").first()["data_type"]
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{end}")
            remove(self.spark, path)


def _made(spark: SparkSession, tables: dict[str, DataFrame], buckets: int) -> Adjacency:
    name = f"adjacency_{uuid.uuid4().hex}"
    for end, edges in tables.items():
        edges.repartition(buckets, end).write.option("path", new_path(spark, name)).bucketBy(buckets, end).sortBy(end).saveAsTable(f"{name}_{end}")
    return Adjacency(spark, name, buckets)


def kept(edges: DataFrame, buckets: int | None = None) -> Adjacency:
    """Edges (from_node, to_node, edge_type, ordinal, source_id) as an adjacency; equal rows once.

    By default there are as many buckets as shuffle partitions, so that what meets them is dealt alike. A node's edges are
    one bucket's: a hub's bucket is as large as the hub."""
    x = edges.select("from_node", "to_node", "edge_type", "ordinal", "source_id").distinct()
    return _made(edges.sparkSession, {end: x for end in ("from_node", "to_node")}, buckets or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
