"""Deterministic sharded WARC archives: written by range of page, rolled by compressed size, committed by a manifest."""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import remove, written

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
#: Bytes of payload of one shard, and most shards: beyond, shards grow, so the list of their first keys has a bound.
SHARD_BYTES, MOST_SHARDS = 8 << 20, 100_000
MANIFEST = "temp string, file string, records long, bytes long, sha256 string, first_page long, last_page long"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", compresslevel=level, mtime=0)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 6) -> bytes:
    """One gzip member with a response record, or a revisit of page refers_to, whose payload is left out."""
    digest = hashlib.sha256(payload).hexdigest()
    http = HTTP + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    target = "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url or "about:blank")
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"), ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    return _member(headers, block, level)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed stream, one at a time."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not the start of a record: {line[:80]!r}")
        headers = {}
        while line := stream.readline().rstrip(b"\r\n"):
            k, _, v = line.decode().partition(": ")
            headers[k] = v
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield headers, block


def payloads(pages: DataFrame) -> DataFrame:
    """(page_id, digest, bytes) of each payload that a page_id has, with the bytes of all its rows in `total`."""
    payload = F.coalesce("html", F.lit(""))
    slim = pages.select(F.col("page_id").cast("long"), F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    return slim.groupBy("page_id", "digest").agg(F.min("bytes").alias("bytes"), F.sum("bytes").alias("total"))


def revisits(slim: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, digest, refers_to) of the payloads that a smaller page_id has too."""
    slim = slim.filter((F.col("bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return slim.join(first, "digest").filter("page_id <> refers_to").select("page_id", "digest", "refers_to")


def _within(digest: Column) -> Column:
    """A place among the payloads of one page_id, so that an id with very many rows is cut too."""
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("long")


def _key(page_id: int | None, within: int) -> int:
    return (-(1 << 63) - 1 if page_id is None else int(page_id)) * 65_536 + int(within)


def shard_keys(slim: DataFrame, shard_bytes: int, most: int = MOST_SHARDS) -> list[int]:
    """First key of each shard: places in the order of page_id (null first) at which as many bytes lie before.

    Ranges are sampled and differ from run to run, but prefix sums over them do not: the sums of whole ranges, one row
    each, and then of the rows in a range."""
    order = [F.col("page_id").asc_nulls_first(), "within"]
    sizes = slim.groupBy("page_id", _within(F.col("digest")).alias("within")).agg(F.sum("total").alias("total"))
    sizes, path = written(sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()), "sizes")
    sums = sizes.groupBy("range").agg(F.sum("total").alias("of_range"))
    total = sums.agg(F.sum("of_range")).first()[0] or 0
    before = F.sum("of_range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    within = F.sum("total").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("range", F.coalesce(before, F.lit(0)).alias("before"))
    x = sizes.withColumn("inside", F.coalesce(within, F.lit(0))).join(sums, "range")
    size = max(1, shard_bytes, -(-total // most))
    first = x.groupBy(F.floor((F.col("before") + F.col("inside")) / size).alias("shard")).agg(F.min(F.struct("page_id", "within")).alias("k"))
    keys = sorted(_key(r["k"]["page_id"], r["k"]["within"]) for r in first.collect())
    remove(slim.sparkSession, path)
    return keys


def write_archives(pages: DataFrame, root: str, roll_bytes: int = 64 << 20, least: int = 100, level: int = 6, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write pages under `root` and return the manifest (file, records, bytes, sha256, first and last page).

    Shards are ranges of page_id with about shard_bytes of payload, cut by exact prefix sums. A shard is sorted and
    written by one task; its files end once they have `roll_bytes`. Tasks write under temporary names that no
    other attempt shares; only files that the manifest of finished tasks names get their final name, the rest goes with
    the temporary folder. Names, headers and digests depend on the pages alone, not on partitions, so reruns give equal
    files. Rows of one page_id are cut by payload; rows equal in both are in one shard."""
    spark = pages.sparkSession
    slim, slim_path = written(payloads(pages), "payloads")
    keys = np.array(shard_keys(slim, shard_bytes), dtype=object)

    @F.pandas_udf("long")
    def shard_of(page_id: pd.Series, within: pd.Series) -> pd.Series:
        own = np.array([_key(None if pd.isna(p) else p, w) for p, w in zip(page_id.astype("object"), within)], dtype=object)
        return pd.Series(np.searchsorted(keys, own, "right") - 1, dtype="int64")

    null = F.lit(None).cast("string")
    marks = revisits(slim, least).select("page_id", F.lit(0).alias("kind"), "digest", "refers_to", null.alias("url"), null.alias("html"))
    rows = pages.select(F.col("page_id").cast("long"), F.lit(1).alias("kind"), F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"), F.lit(None).cast("long").alias("refers_to"), "url", "html")
    # ids go to Python as text: a column of longs with nulls would turn to doubles
    both = marks.unionByName(rows).withColumn("within", _within(F.col("digest")))
    # a task gets one shard, whatever the number of shuffle partitions
    both = both.withColumn("shard", shard_of(F.col("page_id").cast("string"), "within")).repartitionById(max(1, len(keys)), F.col("shard").cast("int"))
    # a mark precedes the pages of its id: one shuffle of the texts serves sorting and deduplication
    both = both.sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "within", "kind", "digest", "url", "html")
    both = both.select("page_id", "kind", "digest", "refers_to", "url", "html", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        temp = f"{base}/_temporary/{uuid.uuid4().hex}"
        done: list[tuple] = []
        out, sha, size, count, first, last, marks_of, at, part, rolled = None, None, 0, 0, None, None, {}, None, None, 0

        def close():
            out.close()
            done.append((name, f"{base}/part-{part:06d}-{rolled:05d}.warc.gz", count, size, sha.hexdigest(), first, last))

        for batch in batches:
            ids, kinds, digests, refers, urls = (batch.column(i).to_pylist() for i in range(5))
            for i, (page_id, shard) in enumerate(zip(ids, batch.column(6).to_pylist())):
                if shard != part:
                    if out is not None:
                        close()
                    out, part, rolled, at = None, shard, 0, ()
                if page_id != at:
                    at, marks_of = page_id, {}
                if not kinds[i]:
                    marks_of[digests[i]] = refers[i]
                    continue
                payload = (batch.column(5)[i].as_py() or "").encode()
                member = record(page_id, urls[i], payload, marks_of.get(digests[i]), level)
                if out is None:
                    store.create_dir(temp, recursive=True)
                    name = f"{temp}/{len(done):05d}.warc.gz"
                    out, sha, size, count, first = store.open_output_stream(name, compression=None), hashlib.sha256(), 0, 0, page_id
                out.write(member)
                sha.update(member)
                size, count, last = size + len(member), count + 1, page_id
                if size >= roll_bytes:
                    close()
                    out, rolled = None, rolled + 1
        if out is not None:
            close()
        columns = list(zip(*done)) if done else [[]] * 7
        kinds_of = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_of)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for temp, final in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if store.get_file_info(temp).type != fs.FileType.NotFound:  # else an earlier attempt has moved it
                    store.move(temp, final)
            yield batch

    both.mapInArrow(run, MANIFEST).write.parquet(f"{root}/_temporary_manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/_temporary_manifest")
    manifest.mapInArrow(rename, MANIFEST).drop("temp").write.parquet(f"{root}/_manifest")
    remove(spark, f"{root}/_temporary", f"{root}/_temporary_manifest", slim_path)
    return spark.read.parquet(f"{root}/_manifest")


def read_archives(manifest: DataFrame, root: str) -> DataFrame:
    """Every record that the manifest's files hold: page_id, url, payload_bytes, payload_digest, record_type, refers_to, html.

    Files are streamed record by record. Digests of blocks and payloads are computed again and must equal the headers'."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(root)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_file(path) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for h, block in parse(stream):
                        if h["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
                            raise ValueError(f"block digest of {h['WARC-Record-ID']} in {path}")
                        length, digest, payload = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha256:"), None
                        if h["WARC-Type"] == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            if digest != hashlib.sha256(payload).hexdigest() or length != len(payload):
                                raise ValueError(f"payload digest of {h['WARC-Record-ID']} in {path}")
                        page, ref = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
                        rows.append((page and int(page), h["WARC-Target-URI"], length, digest, h["WARC-Type"], ref and int(ref), payload and payload.decode()))
                        size += len(block)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return manifest.select("file").repartition(n, "file").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def archive(pages: DataFrame, root: str, **how) -> DataFrame:
    """Write the pages as archives under root, a new folder, and read them back.

    Takes page_id, url and html. Of records with equal payloads of at least 100 bytes those with the smallest page_id
    are responses and others revisits of it, so rows that repeat the smallest id are all responses. A null html is
    empty, a null url about:blank; a null page_id is written first, as a response that nothing refers to. Payloads
    of revisits come back null. An empty table gives an empty manifest and no rows; other columns are ignored."""
    return read_archives(write_archives(pages, root, **how), root)


#: What op5 returns, in DuckDB.
WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS h FROM {pages}),
f AS (SELECT *, CASE WHEN n >= 100 AND page_id <> min(page_id) OVER (PARTITION BY h) THEN min(page_id) OVER (PARTITION BY h) END AS first FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN first IS NULL THEN 'response' ELSE 'revisit' END AS record_type, first AS refers_to FROM f
"""
