"""Incremental ingest and event logs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.catalog import latest
from quillspark.operators.ingest import paragraphs
from quillspark.storage import publish, published, remove, settled


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def ingest_changed(batch: DataFrame, sources: str, units: str) -> None:
    """Append units of the batch's sources (source_id, text, version) whose text is new or changed.

    `sources` keeps (source_id, hash, version) of everything ingested, `units` the units with the version that made
    them; a reader takes each source's latest version. A batch that is delivered again changes nothing."""
    spark = batch.sparkSession
    x = latest(batch.withColumn("hash", F.sha2("text", 256)), ["source_id"], [F.desc("version")])
    if _exists(spark, sources):
        known = latest(spark.read.parquet(sources), ["source_id"], [F.desc("version")])
        same = (x["source_id"] == known["source_id"]) & ((x["hash"] == known["hash"]) | (x["version"] <= known["version"]))
        x = x.join(known, same, "left_anti")
    x = x.persist()
    made = paragraphs(x, lines_are_units=True).join(x.select("source_id", "version"), "source_id")
    made.write.mode("append").parquet(units)
    x.select("source_id", "hash", "version").write.mode("append").parquet(sources)
    x.unpersist()


def current_units(spark: SparkSession, sources: str, units: str) -> DataFrame:
    now = latest(spark.read.parquet(sources), ["source_id"], [F.desc("version")]).select("source_id", "version")
    # an attempt that failed between the two writes leaves equal units behind
    return spark.read.parquet(units).join(now, ["source_id", "version"]).dropDuplicates(["source_id", "position"])


def start_ingest(stream: DataFrame, sources: str, units: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run ingest_changed on every micro-batch; `every` is the trigger that debounces changes, else what is there once."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: ingest_changed(batch, sources, units))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def watch_files(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """Files that appear under a folder, as (source_id, text, version); most_files bounds a batch."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", most_files).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("source_id"), F.decode("content", "UTF-8").alias("text"), F.unix_micros("modificationTime").alias("version"))


def applied_mutations(batch: DataFrame, state: str) -> int:
    """Fold versioned upserts and deletes (id, version, op, value) into the next generation of a state table; its number.

    Readers see one generation or the next, never part of one. A batch that is delivered again changes nothing, and the
    generation before the last is deleted."""
    spark = batch.sparkSession
    now = settled(spark, state)
    rows = batch.select("id", "version", "op", "value")
    if now:
        rows = rows.unionByName(published(spark, state, "rows"))
    new = publish(spark, state, {"rows": latest(rows, ["id"], [F.desc("version"), F.col("op")])}, after=now)
    remove(spark, f"{state}/gen={new - 2}")
    return new


def _timed(events: DataFrame, late: str) -> DataFrame:
    x = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return x.withWatermark("ts", late) if events.isStreaming else x


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts by type in tumbling windows, or sliding ones, of an event stream with a watermark, or of a table."""
    at = F.window("ts", window, slide) if slide else F.window("ts", window)
    return _timed(events, late).groupBy(at, "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Each user's sessions (start, end, n): events less than a gap apart; a session ends a gap after its last event. Takes a
    stream, for which a session comes out once the watermark has passed its end, or a table."""
    x = _timed(events, late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return x.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
