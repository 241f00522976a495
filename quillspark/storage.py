"""Tables in the folder that driver and executors share, and clean-up of what no plan reads any more."""

from __future__ import annotations

import atexit
import gc
import hashlib
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Seconds after which a writer that has not finished counts as dead.
LEASE = 3600.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset and Spark is local, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + (own := tempfile.mkdtemp(prefix="quillspark-"))
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, which survives lost executors, and its path."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables that no later plan reads."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def generation(spark: SparkSession, root: str) -> int:
    """The newest generation published under root; 0 if there is none."""
    p, fs = _fs(spark, root)
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return max([0, *(int(x[4:]) for x in names if x.startswith("gen="))])


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files under a path; it changes when the table does."""
    p, fs = _fs(spark, path)
    files, found = fs.listFiles(p, True), []
    while files.hasNext():
        x = files.next()
        found.append(f"{x.getPath()} {x.getLen()} {x.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def content(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def created(spark: SparkSession, path: str, text: str) -> None:
    """Create a file with a short text; raises if there is one."""
    p, fs = _fs(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()


def _claim(spark: SparkSession, root: str, number: int, folder: str) -> None:
    """Create the claim of a generation, which names the written folder; raises if there is one."""
    created(spark, f"{root}/claim={number}", folder)


def _finish(spark: SparkSession, root: str, number: int, folder: str) -> bool:
    """Rename the written folder that the claim names to its generation, which makes readers see it."""
    (source, fs), (target, _), (claim, _) = (_fs(spark, f"{root}/{x}") for x in (folder, f"gen={number}", f"claim={number}"))
    if not fs.exists(source) or fs.exists(target) or not fs.exists(claim) or content(spark, f"{root}/claim={number}") != folder:
        return False
    return fs.rename(source, target)


def settled(spark: SparkSession, root: str, lease: float = LEASE) -> int:
    """The newest generation, after a writer that died on its way has been dealt with.

    A claim names a folder that was whole before the claim was made, so whoever finds a claim without its generation
    renames the folder. A claim without a name, whose writer died while it wrote the name, is set aside once it is
    `lease` seconds old; until then its generation is taken."""
    now = generation(spark, root)
    claim, fs = _fs(spark, f"{root}/claim={now + 1}")
    if not fs.exists(claim):
        return now
    folder = content(spark, f"{root}/claim={now + 1}")
    if folder:
        _finish(spark, root, now + 1, folder)
    elif time.time() - fs.getFileStatus(claim).getModificationTime() / 1000 > lease:
        fs.rename(claim, _fs(spark, f"{root}/abandoned-{uuid.uuid4().hex}")[0])
    return generation(spark, root)


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], after: int) -> int:
    """Publish tables as the generation that follows `after`, for which they were made.

    They are written aside; then the generation's claim is created, which only one writer can do and which names the
    folder; then the folder is renamed, which makes readers see it. A writer that comes second raises and changes
    nothing. After a crash at any moment readers find the old generation or the new one, whole, and the next writer
    finishes what a claim names (`settled`). Older generations stay until `remove`, folders of dead writers until
    `tidied`. The file system must create files exclusively and rename folders at once, as HDFS and local disks do;
    object stores that only imitate renames do not."""
    folder = f"writing-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{folder}/{name}")
    new = after + 1
    try:
        if settled(spark, root) != after:
            raise RuntimeError(f"generation {new} has been published meanwhile")
        _claim(spark, root, new, folder)
    except Exception as e:
        remove(spark, f"{root}/{folder}")
        raise RuntimeError(f"generation {new} is taken") from e
    if not _finish(spark, root, new, folder) and generation(spark, root) < new:
        raise RuntimeError(f"generation {new} could not be renamed")
    return new


def tidied(spark: SparkSession, root: str, lease: float = LEASE) -> list[str]:
    """Delete and name folders that writers have left behind: older than the lease, and named by no open claim."""
    now, (p, fs) = settled(spark, root, lease), _fs(spark, root)
    open_ = content(spark, f"{root}/claim={now + 1}") if fs.exists(_fs(spark, f"{root}/claim={now + 1}")[0]) else ""
    old = [x.getPath().getName() for x in fs.listStatus(p) if time.time() - x.getModificationTime() / 1000 > lease]
    gone = [x for x in old if x.startswith(("writing-", "abandoned-")) and x != open_]
    remove(spark, *(f"{root}/{x}" for x in gone))
    return sorted(gone)


def published(spark: SparkSession, root: str, name: str, number: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{root}/gen={number or generation(spark, root)}/{name}")
