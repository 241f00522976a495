"""Exact top-k inner products over a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import remove, written

#: Rows of one block of the index; queries of one row that is sent to it.
BLOCK, CHUNK = 65_536, 16
INDEX = "dim int, block int, n int, bits int, ids binary, low binary, slices binary"


def quantised(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null if the vector is null or a component is null or not finite."""
    x = embedding.cast("array<double>")
    good = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.when(good, F.transform(x, lambda v: F.floor(v * scale)))


def build(ids: np.ndarray, values: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Bits a component, each component's least value, and slices[component, bit]: a bitmap over rows, 64 to a word."""
    low = values.min(0)
    bits = max(1, int(values.max(0).__sub__(low).max()).bit_length())
    x = (values - low).T
    words = -(-len(ids) // 64)
    slices = np.zeros((x.shape[0], bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((x >> b) & 1).astype(np.uint8), axis=1, bitorder="little")
        slices[:, b, : packed.shape[1]] = packed
    return bits, low, slices.view(np.uint64)


def scores(q: np.ndarray, bits: int, low: np.ndarray, slices: np.ndarray) -> tuple[list[np.ndarray], int]:
    """The inner product with q of every row, as bitmaps from the least significant slice up, less a constant.

    A slice of weight 2^b times a bit of |q| of weight 2^k is a slice of weight 2^(b+k); where q is negative, the slices'
    complement counts down from the component's highest value. Full adders reduce three slices of one weight to a sum of
    that weight and a carry of the next, until one slice of each weight is left."""
    size, flip = np.abs(q), np.where(q < 0, ~np.uint64(0), np.uint64(0))
    top = low + (1 << bits) - 1
    constant = int((q * np.where(q < 0, top, low)).sum())
    by_weight: dict[int, list] = {}
    for k in range(int(size.max()).bit_length() if len(size) else 0):
        d = np.flatnonzero(size >> k & 1)
        for b in range(bits):
            by_weight.setdefault(b + k, []).append(slices[d, b] ^ flip[d, None])
    out, w = [], 0
    while by_weight:
        x = np.concatenate(parts) if (parts := by_weight.pop(w, [])) else np.zeros((0, slices.shape[2]), np.uint64)
        while len(x) > 1:
            m = len(x) // 3
            if m:
                a, b, c = x[:m], x[m : 2 * m], x[2 * m : 3 * m]
                half = a ^ b
                by_weight.setdefault(w + 1, []).append((a & b) | (half & c))
                x = np.concatenate([half ^ c, x[3 * m :]])
            else:
                by_weight.setdefault(w + 1, []).append((x[0] & x[1])[None])
                x = (x[0] ^ x[1])[None]
        out.append(x[0] if len(x) else np.zeros(slices.shape[2], np.uint64))
        w += 1
    return out, constant


def select(slices: list[np.ndarray], rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows (among `rows`) surely in the top k, and of those tied at its boundary, from the top slice down."""
    sure, open_ = np.zeros_like(rows), rows
    have = 0
    for s in reversed(slices):
        ones = open_ & s
        n = have + int(np.bitwise_count(ones).sum())
        if n > k:
            open_ = ones
        elif n < k:
            sure, open_, have = sure | ones, open_ & ~s, n
        else:
            return sure | ones, np.zeros_like(rows)
    return sure, open_


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def search(q: np.ndarray, own: int, ids: np.ndarray, index: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
    """vec_ids (sorted in the index) and scores of the k best rows that do not carry the id `own`."""
    bits, low, slices = index
    sums, constant = scores(q, bits, low, slices)
    rows = np.zeros(slices.shape[2] * 64, np.uint8)
    rows[: len(ids)] = 1
    rows[np.searchsorted(ids, own, "left") : np.searchsorted(ids, own, "right")] = 0
    rows = np.packbits(rows, bitorder="little").view(np.uint64)
    sure, tied = select(sums, rows, k)
    places = _places(sure)
    places = np.concatenate([places, _places(tied)[: k - len(places)]])  # ids ascend with places: ties to smaller ids
    value = np.full(len(places), constant, np.int64)
    for w, s in enumerate(sums):
        value += ((s[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << w
    return ids[places], value


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k highest integer inner products, ties to smaller ids.

    Takes vec_id and embedding. Queries are the rows whose id is divisible by `every`, candidates all rows with
    another id and as many components. The index is built once for each block of BLOCK rows, chosen by a hash of the
    id, and is shuffled once: queries are sent to the blocks, in rows of CHUNK, and each block answers with at most k
    rows a query, which are merged. Where there are fewer blocks than shuffle partitions, blocks are copied so often that
    each partition has one, and their queries are shared out. Rows with a null id, a null vector, or a component that is null or not finite take no part;
    neither do empty vectors. Rows that repeat an id are all candidates (never of that id itself), and that id asks
    once with each different vector it has. An empty table gives no rows; other columns are ignored."""
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long"), quantised(F.col("embedding"), scale).alias("x")).filter("vec_id IS NOT NULL AND x IS NOT NULL AND size(x) > 0").withColumn("dim", F.size("x"))
    v, v_path = written(v, "vectors")
    n, n_queries = v.agg(F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    blocks, chunks = max(1, -(-n // BLOCK)), max(1, -(-n_queries // CHUNK))

    def make(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        dim = table.column("dim")[0].as_py()
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(len(ids), dim)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        bits, low, slices = build(ids, x)
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([table.column("block")[0].as_py()], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "bits": pa.array([bits], pa.int32()), "ids": [ids.tobytes()], "low": [low.tobytes()], "slices": [slices.tobytes()]})

    index = v.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("dim", "block").applyInArrow(make, INDEX)
    index, index_path = written(index, "index")
    parts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks))
    asked = v.filter(F.col("vec_id") % every == 0).distinct().withColumn("chunk", F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(chunks)))
    asked = asked.groupBy("dim", "chunk").agg(F.collect_list(F.struct("vec_id", "x")).alias("q")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.select("dim", "block", F.pmod("chunk", F.lit(parts)).cast("int").alias("part"), "q")
    placed = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).unionByName(asked, allowMissingColumns=True)
    # in each (dim, block, part) the row of the index comes first
    placed = placed.repartition("dim", "block", "part").sortWithinPartitions("dim", "block", "part", F.col("q").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, made = None, None, None
        for batch in batches:
            out = []
            for row in range(len(batch)):
                key, bits, own, low, slices, q = batch.column(0)[row].as_py(), *(batch.column(i)[row] for i in range(1, 6))
                if not q.is_valid:
                    at, ids, low = key, np.frombuffer(own.as_buffer(), np.int64), np.frombuffer(low.as_buffer(), np.int64)
                    made = bits.as_py(), low, np.frombuffer(slices.as_buffer(), np.uint64).reshape(key["dim"], bits.as_py(), -1)
                elif key == at:  # else no candidate has as many components
                    out += [(x["vec_id"], *search(np.array(x["x"]), x["vec_id"], ids, made, k)) for x in q.as_py()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([a for a, _, _ in out], [len(b) for _, b, _ in out]), pa.int64()), pa.array(np.concatenate([b for _, b, _ in out])), pa.array(np.concatenate([c for _, _, c in out]))], names=["query_id", "vec_id", "score"])

    best = placed.select(F.struct("dim", "block", "part").alias("key"), "bits", "ids", "low", "slices", "q").mapInArrow(run, "query_id long, vec_id long, score long")
    best, _ = written(best, "best")
    remove(spark, v_path, index_path)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same in DuckDB, by brute force.
TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM {embeddings}
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
