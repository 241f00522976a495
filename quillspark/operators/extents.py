"""Scan scopes as intervals of ids over tables sorted by id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.storage import written

#: Ids of one block, in which runs are found on their own; ranges that a scan names; ids up to which a scope is a list of runs.
BLOCK, MOST_RANGES, MOST_IDS = 1 << 20, 64, 1 << 20


def _runs(x: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals (first, last) of x that follow each other without a gap, as one; keys part them."""
    w = Window.partitionBy(*keys).orderBy("first")
    new = F.coalesce(F.col("first") > F.lag("last").over(w) + 1, F.lit(True)).cast("int")
    x = x.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return x.groupBy(*keys, "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def extents(ids: DataFrame) -> DataFrame:
    """(first, last) of each run of consecutive ids (id long). Repeats count once, nulls not.

    Runs are found in blocks of BLOCK ids; then runs that meet at the border of a block are joined, of which a block has
    two at most."""
    x = ids.filter("id IS NOT NULL").select(F.col("id").cast("long").alias("first")).distinct().withColumn("last", F.col("first")).withColumn("block", F.floor(F.col("first") / BLOCK))
    x = _runs(x, ["block"])
    inner = (F.col("first") > F.col("block") * BLOCK) & (F.col("last") < F.col("block") * BLOCK + BLOCK - 1)
    return x.filter(inner).select("first", "last").unionByName(_runs(x.filter(~inner).select("first", "last", F.lit(0).alias("all")), ["all"]).select("first", "last"))


def shape(scope: DataFrame) -> str:
    """empty, contiguous (one extent), sorted_run (few ids) or sparse, of a scope's extents."""
    n, size = scope.agg(F.count(F.lit(1)), F.sum(F.col("last") - F.col("first") + 1)).first()
    return "empty" if not n else "contiguous" if n == 1 else "sorted_run" if size <= MOST_IDS else "sparse"


def sorted_by_id(rows: DataFrame, key: str) -> DataFrame:
    """rows as a table whose files and row groups are ranges of the key, so that a scan of an interval reads few of them."""
    return written(rows.repartitionByRange(key).sortWithinPartitions(key), "sorted")[0]


def covering(scope: DataFrame, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """At most `most` ranges that hold all extents: those between the widest gaps."""
    low, high = scope.agg(F.min("first"), F.max("last")).first()
    if low is None:
        return []
    # a gap lies before an extent that no other one touches; the widest are few, whatever the number of extents
    starts = scope.select("first", "last", F.floor(F.col("first") / BLOCK).alias("block"))
    w = Window.partitionBy("block").orderBy("first")
    within = starts.withColumn("before", F.lag("last").over(w))
    edge = starts.groupBy("block").agg(F.min("first").alias("first"), F.max("last").alias("last")).withColumn("before", F.lag("last").over(Window.orderBy("block")))
    gaps = within.filter("before IS NOT NULL").select("before", "first").unionByName(edge.filter("before IS NOT NULL").select("before", "first"))
    widest = sorted((r["before"], r["first"]) for r in gaps.orderBy(F.desc(F.col("first") - F.col("before")), "first").limit(most - 1).collect())
    return list(zip([low, *(b for _, b in widest)], [*(a for a, _ in widest), high]))


def in_extents(rows: DataFrame, key: str, scope: DataFrame, most: int = MOST_RANGES) -> DataFrame:
    """Rows whose key lies in an extent (first, last) of the scope; an empty scope leaves none.

    Up to `most` ranges that cover the scope stand in the filter, which the scan of a sorted table uses to skip row groups.
    Where extents are more, rows then meet them by block of BLOCK ids, and only those of their own block."""
    ranges = covering(scope, most)
    if not ranges:
        return rows.filter(F.lit(False))
    x = rows.filter(reduce(lambda a, b: a | b, [F.col(key).between(a, b) for a, b in ranges]))
    if scope.limit(most + 1).count() <= most:
        return x
    block = F.floor(F.col(key) / BLOCK).alias("_block")
    parts = scope.select("first", "last", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor(F.col("last") / BLOCK))).alias("_block"))
    x, parts = x.withColumn("_block", block).alias("x"), parts.alias("p")
    return x.join(parts, (F.col("x._block") == F.col("p._block")) & F.col(f"x.{key}").between(F.col("p.first"), F.col("p.last")), "left_semi").drop("_block")
