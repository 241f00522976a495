"""Folders that are walked level by level and kept in step with their files: new, changed, deleted and renamed ones."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions.text import ignored
from quillspark.operators.ingest import paragraphs
from quillspark.segments import Segments
from quillspark.storage import remove, written

#: Levels below a root that are entered.
MOST_DEPTH = 32
LISTED = "root string, path string, logical string, real string, folder boolean, bytes long, modified long"


def _listed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What stands in each folder; links are followed, and `real` is where they lead."""
    from pyarrow import fs

    names = [x.split()[0] for x in LISTED.split(", ")]
    for pdf in parts:
        rows = []
        for root, path, logical in zip(pdf["root"], pdf["path"], pdf["logical"]):
            store, inside = fs.FileSystem.from_uri(path)
            local = isinstance(store, fs.LocalFileSystem)
            for x in store.get_file_info(fs.FileSelector(inside, recursive=False, allow_not_found=True)):
                name = f"{logical}/{x.base_name}" if logical else x.base_name
                real = os.path.realpath(x.path) if local else x.path
                modified = None if x.mtime_ns is None else x.mtime_ns // 1000
                rows.append((root, f"{path.rstrip('/')}/{x.base_name}", name, real, x.type == fs.FileType.Directory, x.size, modified))
        yield pd.DataFrame(rows, columns=names).astype({"bytes": "Int64", "modified": "Int64"})


def walk(spark: SparkSession, roots: list[str], ignore: list[str] | None = None, most_depth: int = MOST_DEPTH) -> tuple[DataFrame, DataFrame]:
    """Files (root, path, logical, bytes, modified in microseconds) under the roots, URIs of folders that all executors
    see, and what was not entered (path, fault): loop, a folder that a link or another root has led to before, and
    too_deep.

    A round lists all folders of one level, as rows that are dealt over tasks; only whether there are more reaches the
    driver. Globs are matched with the path below the root, and an ignored folder is not entered. A root that is not
    there is empty."""
    roots = [(r.rstrip("/"), r.rstrip("/"), "") for r in (r if "://" in r else f"file://{os.path.abspath(r)}" for r in roots)]
    frontier = spark.createDataFrame(roots, "root string, path string, logical string").distinct()
    real = [os.path.realpath(p.removeprefix("file://")) if p.startswith("file://") else "/" + p.partition("://")[2].partition("/")[2] for p, _, _ in roots]
    seen = spark.createDataFrame([(r,) for r in real], "real string").distinct()
    files = faults = None
    paths: list[str] = []
    for depth in range(1, most_depth + 2):
        found, path = written(frontier.repartition("path").mapInPandas(_listed, LISTED), "listed")
        paths.append(path)
        if ignore:
            found = found.filter(~ignored(F.col("logical"), ignore, F.col("folder")))
        own = found.filter("NOT folder").select("root", "path", "logical", "bytes", "modified")
        files = own if files is None else files.unionByName(own)
        folders = found.filter("folder")
        if depth > most_depth:
            late = folders.select("path", F.lit("too_deep").alias("fault"))
            faults = late if faults is None else faults.unionByName(late)
            break
        first = folders.join(seen, "real", "left_anti").groupBy("real").agg(F.min(F.struct("path", "root", "logical")).alias("x")).select("x.root", "x.path", "x.logical", "real")
        first, path = written(first, "folders")
        paths.append(path)
        again = folders.join(first.select("path"), "path", "left_anti").select("path", F.lit("loop").alias("fault"))
        faults = again if faults is None else faults.unionByName(again)
        if not first.limit(1).count():
            break
        seen = seen.unionByName(first.select("real"))
        frontier = first.select("root", "path", "logical")
    out = written(files, "files")[0], written(faults, "faults")[0]
    remove(spark, *paths)
    return out


def changes(files: DataFrame, known: DataFrame | None) -> DataFrame:
    """(source_id, op, modified, bytes): put for a file that is new or whose time or size differs, delete for one that is
    gone; a renamed file is both."""
    now = files.select(F.col("path").alias("source_id"), "modified", "bytes")
    if known is None:
        return now.withColumn("op", F.lit("put"))
    then = known.select("source_id", F.col("modified").alias("_modified"), F.col("bytes").alias("_bytes"), F.lit(True).alias("known"))
    x = now.withColumn("there", F.lit(True)).join(then, "source_id", "full")
    same = F.col("modified").eqNullSafe(F.col("_modified")) & F.col("bytes").eqNullSafe(F.col("_bytes"))
    op = F.when(F.col("there").isNull(), "delete").when(F.col("known").isNull() | ~same, "put")
    return x.select("source_id", op.alias("op"), "modified", "bytes").filter("op IS NOT NULL")


def synced(spark: SparkSession, folder: str, store: Segments, ignore: list[str] | None = None, most_files: int = 1000) -> dict[str, int]:
    """Take the next most_files changes under the folder into the store: its `files` (the listing) and `units`.

    Both are in one segment, so a generation holds a listing and just its files' units; a crash leaves the one before, and
    the same changes come again. Deletions go first, then files by time and path. Returns how many were put and deleted;
    the folder is in step once both are 0."""
    files, _ = walk(spark, [folder], ignore)
    known = store.read("files") if store.generation() else None
    batch = changes(files, known).orderBy("op", "modified", "source_id").limit(most_files).collect()  # bounded by most_files
    put, gone = ([r for r in batch if r["op"] == op] for op in ("put", "delete"))
    if batch:
        listing = spark.createDataFrame([(r["source_id"], r["modified"], r["bytes"]) for r in put], "source_id string, modified long, bytes long")
        if put:
            content = spark.read.format("binaryFile").load([r["source_id"] for r in put])
            # a reader names the same file with other slashes
            name = F.regexp_replace("path", "^file:/+", "file:///")
            texts = content.select(name.alias("source_id"), F.decode("content", "UTF-8").alias("text"))
        else:
            texts = spark.createDataFrame([], "source_id string, text string")

        def write(segment: str) -> None:
            store.write(segment, "files", listing.coalesce(1))
            store.write(segment, "units", paragraphs(texts, lines_are_units=True))

        replaced = spark.createDataFrame([(r["source_id"],) for r in batch], "source_id string")
        store.replace(write, listing, replaced)
    return {"put": len(put), "deleted": len(gone)}


def start_sync(spark: SparkSession, folder: str, store: Segments, checkpoint: str, every: str = "10 seconds", ignore: list[str] | None = None) -> StreamingQuery:
    """Keep the store in step with the folder: at each trigger, all changes that are there."""

    def step(_batch: DataFrame, _number: int) -> None:
        while sum(synced(spark, folder, store, ignore).values()):
            pass

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(processingTime=every).start()
