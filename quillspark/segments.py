"""Tables in segments that are written once: a generation lists its segments, and which sources later ones have replaced."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.storage import content, created, generation, publish, published, remove, settled


class Segments:
    """Segments under `root`, each a folder of tables whose rows have a source_id.

    To replace a source is to write a segment with its new rows and to list it as removed from the segments before, so no
    row of another source is written again. Readers see one generation, whole, with all its tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @property
    def _lists(self) -> str:
        return f"{self.root}/generations"

    def generation(self) -> int:
        return generation(self.spark, self._lists)

    def segments(self, number: int | None = None) -> list[str]:
        return [r["segment"] for r in published(self.spark, self._lists, "segments", number).orderBy("number").collect()]

    def write(self, segment: str, name: str, rows: DataFrame, by: list[str] | None = None) -> None:
        rows.write.partitionBy(*by or []).parquet(f"{self.root}/segments/{segment}/{name}")
        # a table without rows has no file that tells its columns
        created(self.spark, f"{self.root}/segments/{segment}/{name}.schema", rows.schema.json())

    def table(self, segment: str, name: str) -> DataFrame:
        path = f"{self.root}/segments/{segment}/{name}"
        return self.spark.read.schema(StructType.fromJson(json.loads(content(self.spark, f"{path}.schema")))).parquet(path)

    def read(self, name: str, number: int | None = None, cut: list[Callable[[DataFrame], DataFrame]] | None = None, living: bool = True) -> DataFrame:
        """The living rows of a table with their segment, or with `living` false those of replaced sources too; `cut` is
        applied to each segment's scan."""
        number = number or self.generation()
        names, out = self.segments(number), None
        for s in names:
            x = self.table(s, name)
            for f in cut or []:
                x = f(x)
            x = x.withColumn("segment", F.lit(s))
            out = x if out is None else out.unionByName(x, allowMissingColumns=True)
        if len(names) < 2 or not living:
            return out
        return out.join(self.removed(number), ["segment", "source_id"], "left_anti")

    def removed(self, number: int | None = None) -> DataFrame:
        """(segment, source_id) of the sources that later segments have replaced."""
        return published(self.spark, self._lists, "removed", number or self.generation())

    def _publish(self, names: list[str], removed: DataFrame, after: int) -> int:
        listed = self.spark.createDataFrame(list(enumerate(names)), "number int, segment string")
        return publish(self.spark, self._lists, {"segments": listed.coalesce(1), "removed": removed}, after=after)

    def _new(self, write: Callable[[str], None], sources: DataFrame) -> str:
        name = uuid.uuid4().hex
        write(name)
        self.write(name, "sources", sources.select("source_id").distinct())
        return name

    def rewrite(self, write: Callable[[str], None], sources: DataFrame) -> int:
        """A generation of one segment, whose tables `write` puts there; its number."""
        now = settled(self.spark, self._lists)
        new = self._new(write, sources)
        return self._publish([new], sources.limit(0).select(F.lit("").alias("segment"), "source_id"), now)

    def replace(self, write: Callable[[str], None], sources: DataFrame, replaced: DataFrame) -> int:
        """A generation with one segment more, in which the `replaced` sources have the new segment's rows alone."""
        now = settled(self.spark, self._lists)
        if not now:
            return self.rewrite(write, sources)
        new = self._new(write, sources)
        held = self.read("sources", now).join(replaced.select("source_id").distinct(), "source_id", "left_semi").select("segment", "source_id")
        removed = self.removed(now).unionByName(held).distinct()
        return self._publish([*self.segments(now), new], removed, now)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete segments that neither the newest generation nor the `keep` before it list; their names."""
        now = settled(self.spark, self._lists)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/segments")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        there = {x.getPath().getName() for x in files.listStatus(path)}
        gone = there - {s for g in range(max(1, now - keep), now + 1) for s in self.segments(g)}
        remove(self.spark, *(f"{self.root}/segments/{s}" for s in gone))
        return sorted(gone)
