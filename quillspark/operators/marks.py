"""Marks of keys by which rows are told apart before they are dealt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.storage import written

#: Bits of the marks by which `likely` tells rows apart: 8 MB, whatever the tables.
MARKS = 1 << 26


def likely(rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, str]:
    """rows with a column `likely`, which is false only where no row of keys has their values in `on`, and the path of the
    marks. A join with keys may follow for the likely rows alone, so the others need not be dealt.

    Each key marks one of MARKS bits by its hash; the marks, which that number bounds, are sent to every executor."""
    place = F.pmod(F.xxhash64(*on), F.lit(MARKS)) + 1
    marks = keys.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("marks"))
    marks, path = written(marks, "marks")
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("marks"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    x = rows.withColumn("bucket", F.bitmap_bucket_number(place)).join(F.broadcast(marks), "bucket", "left")
    return x.select(*rows.columns, bit.alias("likely")), path
