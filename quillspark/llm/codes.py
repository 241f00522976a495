"""Product quantization of vectors in exact integers: codebooks, codes, errors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors whose distances are held at once; integers below this in size keep every sum inside 64 bits.
ROWS, SAFE = 2048, 1 << 27
#: The greatest long.
MOST = (1 << 63) - 1


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (parts, rows, entries) of x (parts, rows, d) and entries (parts, entries, d), as |x|^2 - 2xc + |c|^2."""
    if max((int(np.abs(v).max()) for v in (x, entries) if v.size), default=0) >= SAFE:
        x, entries = x.astype(object), entries.astype(object)  # Python's integers
    return (x * x).sum(2)[:, :, None] - 2 * (x @ entries.transpose(0, 2, 1)) + (entries * entries).sum(2)[:, None, :]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each part (parts, rows), and its squared distance."""
    d = distances(x, entries)
    code = d.argmin(2)
    return code, np.take_along_axis(d, code[:, :, None], 2)[:, :, 0]


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and x = floor(scale * component), of the rows whose vector is there and holds finite numbers alone."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return vectors.filter(F.col("embedding").isNotNull() & good).select(F.col("vec_id").cast("long"), "label", F.transform(v, lambda c: F.floor(c * scale)).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], at: int, width: int, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, which of them have `width` components, and those rows' parts (parts, rows, d)."""
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS):
            batch = whole.slice(lo, ROWS)
            fits = np.array([len(v) == width for v in batch.column(at)], bool)
            flat = batch.column(at).filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
            yield batch, fits, flat.reshape(-1, parts, width // parts).transpose(1, 0, 2)


def _sums(kept: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """The entries after one round: what each task has summed for an entry is merged by a shuffle of sums.

    What reaches the driver has the size of the codebooks."""
    parts, n, d = books.shape
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value
        count, total = np.zeros((parts, n), np.int64), np.zeros((parts, n, d), np.int64)
        for _, _, x in _matrices(batches, 0, width, parts):
            code, _ = nearest(x, entries)
            for p in range(parts):
                count[p] += np.bincount(code[p], minlength=n)
                np.add.at(total[p], code[p], x[p])
        p, e = np.nonzero(count)
        place = [np.repeat(v, d) for v in (p, e, count[p, e])]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (place[0], place[1], np.tile(np.arange(d), len(p)), place[2], total[p, e].ravel())], names=["part", "entry", "place", "n", "total"])

    # sums of whole columns may pass 64 bits
    merged = kept.select("x").mapInArrow(run, "part long, entry long, place long, n long, total long").groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    new = books.copy()
    for r in merged.collect():
        new[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    shared.unpersist()
    return new


def codebooks(kept: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray | None:
    """(parts, entries, width / parts): the parts of the smallest vec_ids' vectors, then `rounds` rounds of means."""
    seeds = [r["x"] for r in kept.filter("size(x) > 0").select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()]
    seeds = [x for x in seeds if len(x) == len(seeds[0])]
    if not seeds or len(seeds[0]) % parts:
        return None
    books = np.array(seeds, np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = _sums(kept, books, len(seeds[0]))
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error, label_error (over rows of one label, nulls together) and the
    digest of the codebooks, for every vector of finite components.

    Takes vec_id, embedding and label. The table is read once for the seeds, once a round and once for the codes;
    codebooks, of a size that the parameters fix, are broadcast, and tasks send one sum an entry and component. With
    fewer vectors than entries there are as many entries as vectors. Rows that repeat an id count each, seeds with
    equal ids go by their components; a null id never precedes another as a seed. Vectors that have not the width of the
    first seed, or whose width the parts do not divide, have a null code and error. Errors beyond
    64 bits are the greatest long; integers beyond 2^40 in size may pass 64 bits in a task's sums. An empty table gives no rows; other columns are ignored."""
    kept = integers(vectors, scale)
    books = codebooks(kept, parts, entries, rounds)
    if books is None:
        coded = kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    else:
        width, shared = books.shape[0] * books.shape[2], kept.sparkSession.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, fits, x in _matrices(batches, 2, width, parts):
                code, far = nearest(x, shared.value)
                own, error = iter([bytes(c).hex() for c in code.T.astype(np.uint8)]), iter(far.sum(0).tolist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([next(own) if f else None for f in fits], pa.string()), pa.array([min(next(error), MOST) if f else None for f in fits], pa.int64())], names=["vec_id", "label", "code", "error"])

        coded = kept.select("vec_id", "label", "x").mapInArrow(run, f"vec_id long, label {dict(kept.dtypes)['label']}, code string, error long")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.when(total > MOST, F.lit(MOST)).otherwise(total.cast("long")).alias("label_error"))
    out = coded.join(totals, coded["label"].eqNullSafe(totals["of"]), "left")
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(books_digest(books) if books is not None else None).cast("string").alias("codebooks_sha256"))


_NEAR = """d{i} AS (SELECT vec_id, label, v.part, v.x, c.entry, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v JOIN c{i} c USING (part)),
a{i} AS (SELECT vec_id, label, part, any_value(x) AS x, arg_min(entry, d * 64 + entry) AS entry, min(d)::BIGINT AS d FROM d{i} GROUP BY vec_id, label, part)"""
_NEXT = """m{i} AS (SELECT part, entry, place, floor(sum(x[place]) / count(*)::DOUBLE)::BIGINT AS mean FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS place FROM a{p}) GROUP BY ALL),
c{i} AS (SELECT part, entry, coalesce(m.x, c.x) AS x FROM c{p} c LEFT JOIN (SELECT part, entry, list(mean ORDER BY place) AS x FROM m{i} GROUP BY ALL) m USING (part, entry))"""
#: The same in DuckDB, for distinct ids and vectors of one width.
CODES_SQL = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM {{embeddings}}
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
v AS (SELECT vec_id, label, part, x[part * w + 1 : (part + 1) * w] AS x FROM (SELECT *, len(x) // 16 AS w, unnest(range(0, 16)) AS part FROM k)),
c0 AS (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, x FROM v QUALIFY entry < 64),
{_NEAR.format(i=0)}, {_NEXT.format(i=1, p=0)}, {_NEAR.format(i=1)}, {_NEXT.format(i=2, p=1)}, {_NEAR.format(i=2)},
o AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY ALL),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM o, h
"""
