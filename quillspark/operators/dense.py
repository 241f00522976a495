"""Exact top-k of a query set over vectors: each block gives its k best for every query, then those are merged."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import vector as V
from quillspark.operators.lexical import ranked

#: Bytes of the vectors of one block, queries that are compared with it at once, scores that are held at once,
#: and queries for which a copy of a block is made where there are more partitions than blocks.
BLOCK_BYTES, QUERY_BLOCK, CELLS, SHARE = 1 << 26, 512, 1 << 21, 16
#: Scores are rounded to six places, so what differs by less may be a tie.
ROUNDING = 1e-6


class Best:
    """The k best items of each query by rounded score, ties to the smaller place, of what has been offered so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.query, self.place, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def offer(self, query: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        score = np.round(score, 6)
        good = score > -np.inf  # NaN is none
        q, p, s = (np.concatenate([a, b[good]]) for a, b in ((self.query, query), (self.place, place), (self.score, score)))
        order = np.lexsort((p, -s, q))
        q, p, s = q[order], p[order], s[order]
        turn = np.arange(len(q)) - np.searchsorted(q, q)
        last = turn == self.k - 1
        self.floor[q[last]] = s[last]
        self.query, self.place, self.score = (x[turn < self.k] for x in (q, p, s))


def _similar(q: np.ndarray, x: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (low, high) of the similarities of each q and each x.

    Squared distances come from |q|^2 - 2qx + |x|^2, whose rounding error is bounded by the norms."""
    if metric == "l2":
        qq, xx = (q**2).sum(1)[:, None], (x**2).sum(1)[None, :]
        d = qq + xx - 2 * (q @ x.T)
        error = (qq + xx) * (4 * (q.shape[1] + 4) * np.finfo(float).eps)
        score = lambda v: 1 / (1 + np.sqrt(np.maximum(v, 0)))
        return score(d + error), score(d - error)
    if metric == "cosine":
        q, x = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) for v in (q, x))
    s = q @ x.T
    return s, s


def _nearest(items: np.ndarray, bounds: np.ndarray, queries: np.ndarray, q_bounds: np.ndarray, own: np.ndarray | None, k: int, metric: str) -> Best:
    """The k best rows of items for each row of queries; scores are held for a tile of rows."""
    best, queries = Best(len(queries), k), queries.astype(float)
    for lo in range(0, len(items), step := max(k, CELLS // len(queries))):
        x = items[lo : lo + step].astype(float)
        low, high = _similar(queries, x, metric)
        low = np.where(np.isnan(low), -np.inf, low)
        # a tile's k best raise the floor; what may be rounded to it stays in
        own_floor = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(queries), -np.inf)
        at, place = np.nonzero(high >= (np.maximum(own_floor, best.floor) - ROUNDING)[:, None])
        score = high[at, place]
        if metric == "l2":
            for i in range(0, len(at), part := max(1, CELLS // x.shape[1])):
                some = slice(i, i + part)
                score[some] = 1 / (1 + np.sqrt(((queries[at[some]] - x[place[some]]) ** 2).sum(1)))
        best.offer(at, place + lo, score)
    return best


def _late(items: np.ndarray, bounds: np.ndarray, queries: np.ndarray, q_bounds: np.ndarray, own: np.ndarray | None, k: int, metric: str) -> Best:
    """The k best items for each query, by the sum over its rows of the best product with a row of the item; an item
    at the place `own` takes no part."""
    best = Best(len(q_bounds) - 1, k)
    for i, (a, b) in enumerate(zip(q_bounds, q_bounds[1:])):
        first = 0
        while first < len(bounds) - 1:
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + CELLS // max(1, b - a), "right")) - 1)
            s = queries[a:b] @ items[bounds[first] : bounds[last]].T
            total = np.maximum.reduceat(s, bounds[first:last] - bounds[first], axis=1).sum(0)
            if first <= own[i] < last:
                total[own[i] - first] = -np.inf
            best.offer(np.full(last - first, i), np.arange(first, last), total)
            first = last
    return best


def _block_join(items: DataFrame, queries: DataFrame, k: int, kernel: Callable, metric: str = "") -> DataFrame:
    """query_id, chunk_id, score and rank: `kernel` for every block of items and all queries of their width.

    Items and queries have id, width and x, an array of rows of that width. Items are dealt once into blocks of
    BLOCK_BYTES; every query goes to every block. Where there are fewer blocks than partitions, a block is copied and its
    queries are shared out. A task holds one block and streams its queries past it, QUERY_BLOCK at a time, so
    neither table passes through the driver."""
    partitions = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = {name: dict(t.dtypes)["id"] for name, t in (("chunk_id", items), ("query_id", queries))}
    size = 4 if dict(items.dtypes)["x"] == "array<float>" else 8
    blocks = items.groupBy("width").agg(F.ceil(F.sum(F.size("x").cast("long")) * size / BLOCK_BYTES).cast("int").alias("blocks")).filter("width > 0")
    asks = queries.groupBy("width").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
    dealt = blocks.join(asks, "width").withColumn("parts", F.least(F.ceil(partitions / F.col("blocks")).cast("int"), F.col("shares")))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    v = items.join(dealt, "width").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("part", numbers("parts"))
    q = queries.join(dealt, "width").withColumn("part", F.pmod(F.xxhash64(F.lit(7), "id"), "parts").cast("int")).withColumn("block", numbers("blocks"))
    one = lambda t, asks, a, b: t.select("width", "block", "part", F.lit(asks).alias("asks"), a.alias("chunk_id"), b.alias("query_id"), "x")
    none = {name: F.lit(None).cast(kind) for name, kind in kinds.items()}
    both = one(v, False, F.col("id"), none["query_id"]).unionByName(one(q, True, none["chunk_id"], F.col("id")))
    both = both.repartition("width", "block", "part").sortWithinPartitions("width", "block", "part", "asks", "chunk_id", "query_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, asked, block = None, [], [], None

        def rows(some: list[pa.RecordBatch], id_column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ids = np.concatenate([b.column(id_column).to_numpy(zero_copy_only=False) for b in some])
            sizes = np.concatenate([np.diff(b.column(6).offsets.to_numpy()) for b in some]) // key[0]
            x = np.concatenate([b.column(6).flatten().to_numpy(zero_copy_only=False) for b in some]).reshape(-1, key[0])
            return ids, x, np.r_[0, np.cumsum(sizes)]

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal block
            if block is None and held:
                block = rows(held, 4)
                held.clear()
            if block and asked:
                ids, x, bounds = block
                who, q, q_bounds = rows(asked, 5)
                place = {v: i for i, v in enumerate(ids.tolist())} if kernel is _late else {}
                for lo in range(0, len(who), QUERY_BLOCK):
                    hi = min(lo + QUERY_BLOCK, len(who))
                    own = np.array([place.get(v, -1) for v in who[lo:hi].tolist()])
                    best = kernel(x, bounds, q[q_bounds[lo] : q_bounds[hi]], q_bounds[lo : hi + 1] - q_bounds[lo], own, k, metric)
                    yield pa.RecordBatch.from_arrays([pa.array(who[lo:hi][best.query]), pa.array(ids[best.place]), pa.array(best.score)], names=["query_id", "chunk_id", "score"])
            asked.clear()

        for batch in batches:
            where = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            # a slice is the part of one block that holds items, or queries
            turns = np.flatnonzero(np.any([np.diff(w.astype(int)) != 0 for w in where], axis=0)) + 1
            for lo, hi in zip([0, *turns], [*turns, batch.num_rows]):
                if hi == lo:
                    continue
                if (now := tuple(int(w[lo]) for w in where[:3])) != key:
                    yield from answers()
                    key, block = now, None
                    held.clear()
                (asked if where[3][lo] else held).append(batch.slice(lo, hi - lo))
                if sum(b.num_rows for b in asked) >= QUERY_BLOCK:
                    yield from answers()
        yield from answers()

    return ranked(both.mapInArrow(run, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double"), k)


def _with_id(rows: DataFrame, name: str) -> DataFrame:
    """Integers are ids as longs, other ids stay what they are."""
    whole = dict(rows.dtypes)[name] in ("tinyint", "smallint", "int", "bigint")
    return rows.withColumn("id", F.col(name).cast("long") if whole else F.col(name))


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """query_id, chunk_id, score and rank for vectors (chunk_id, embedding) and queries (query_id, embedding).

    Null vectors and scores that are no numbers take no part; a query meets the vectors of its own length. Distances of
    what may be among the k best are summed from exact differences; floats are dealt as floats and become doubles, which
    hold them exactly, where they are compared. Ids are integers or text."""
    kind = "float" if all(dict(t.dtypes)["embedding"] == "array<float>" for t in (vectors, queries)) else "double"
    v, q = (_with_id(t, name).select("id", F.col("embedding").cast(f"array<{kind}>").alias("x")).filter("x IS NOT NULL").withColumn("width", F.size("x")) for t, name in ((vectors, "chunk_id"), (queries, "query_id")))
    return _block_join(v, q, k, _nearest, metric)


def rescored(pool: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The pool (query_id, chunk_id) again by full-precision cosine similarity."""
    v = vectors.select("chunk_id", F.col("embedding").alias("v"))
    q = queries.select("query_id", F.col("embedding").alias("q"))
    x = pool.select("query_id", "chunk_id").join(v, "chunk_id").join(q, "query_id")
    return ranked(x.select("query_id", "chunk_id", V.cosine(F.col("q"), F.col("v")).alias("score")), k)


def max_sim_top_k(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Late interaction: sum over query tokens of the best product with a document token; the k best other documents.

    docs: chunk_id and d_tokens, queries: query_id and q_tokens (arrays of vectors of one length; others take no
    part). Ids of docs are unique. The same join of blocks as dense_top_k."""
    d, q = (
        _with_id(t, name).select("id", F.size(F.get(tokens, F.lit(0))).alias("width"), F.col(tokens).cast("array<array<double>>").alias("t"))
        .filter("width > 0 AND forall(t, v -> size(v) = width)").select("id", "width", F.flatten("t").alias("x"))
        for t, name, tokens in ((docs, "chunk_id", "d_tokens"), (queries, "query_id", "q_tokens"))
    )
    return _block_join(d, q, k, _late)
