"""Pairs of rows that share a key which few values have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the larger side that meet a key's rows of the smaller one in one block.
BLOCK = 1000


def paired(few: DataFrame, many: DataFrame, key: str, place: str) -> DataFrame:
    """few joined with many on key, with the work dealt evenly however many rows share a value of the key.

    A value's rows of many are cut into blocks of about BLOCK by their `place`, and its rows of few go to each block. The
    number of partitions is set, as the tables are small beside their pairs and Spark would deal by the tables' size."""
    partitions = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = many.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    a = few.join(sizes, key).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    b = many.join(sizes, key).withColumn("_block", F.pmod(F.xxhash64(place), "_blocks").cast("int"))
    a, b = (x.drop("_blocks").repartition(partitions, key, "_block") for x in (a, b))
    # a merge join holds one block of many at once
    return a.join(b, [key, "_block"]).drop("_block")
