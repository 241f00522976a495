"""BM25 of few questions over texts that no index holds: texts are cut once, and scored where they lie."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from quillspark.functions.text import normalize_key
from quillspark.operators import postings
from quillspark.operators.dense import Best
from quillspark.operators.lexical import B, K1, index_top_k, query_terms, ranked
from quillspark.storage import remove, written

#: Terms of all questions together up to which these are sent to every task; with more, postings are joined.
MOST_ASKED = 100_000
#: Sums that are held at once.
CELLS = 1 << 20


def _coded(docs: DataFrame, fields: list[str], known: list[str]) -> DataFrame:
    """chunk_id, and for each field i the number of terms n<i>, places in `known` of those that are known, t<i>, each once, and how
    often they are there, c<i>; one row for each text. A task gathers GATHERED_BYTES of texts, or one that is longer."""
    kind = dict(docs.dtypes)["chunk_id"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(known, pa.string())
        for batch in batches:
            sizes = sum(pc.fill_null(pc.binary_length(batch.column(i + 1)), 0).to_numpy(zero_copy_only=False) for i in range(len(fields)))
            for lo, hi in postings._runs(sizes, postings.GATHERED_BYTES):
                columns, rows = [batch.column(0).slice(lo, hi - lo)], np.arange(hi - lo + 1)
                for i in range(len(fields)):
                    text = pc.fill_null(batch.column(i + 1).slice(lo, hi - lo), "")
                    words = pc.split_pattern(text, " ")
                    n = np.diff(words.offsets.to_numpy())
                    code = pc.fill_null(pc.index_in(words.flatten(), value_set=values), -1).to_numpy()
                    key, times = np.unique((np.repeat(rows[:-1], n) * len(known) + code)[code >= 0], return_counts=True)
                    at, term = np.divmod(key, max(len(known), 1))
                    ends = pa.array(np.searchsorted(at, rows), pa.int32())
                    none = pc.equal(text, "").to_numpy(zero_copy_only=False)
                    columns += [pa.array(np.where(none, 0, n), pa.int32()), *(pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (term, times))]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk_id", *(f"{x}{i}" for i in range(len(fields)) for x in "ntc")])

    # the terms of a text, joined by single spaces
    x = docs.select("chunk_id", *(normalize_key(F.col(f)).alias(f"f{i}") for i, f in enumerate(fields)))
    return x.mapInArrow(gather, f"chunk_id {kind}, " + ", ".join(f"n{i} int, t{i} array<int>, c{i} array<int>" for i in range(len(fields))))


def scanned_top_k(docs: DataFrame, queries: DataFrame, k: int, fields: dict[str, float], k1: float = K1, b: float = B) -> DataFrame:
    """`index_top_k` of queries (query_id, text) over docs (chunk_id, source_id and the fields) that no index holds.

    Texts are read once, and of each a row with the counts of the asked terms is written. Each task scores its rows and keeps
    the k best of each query, so no posting is dealt. Where questions have more than MOST_ASKED terms, where an id is no
    integer, null or on two rows, or a field weighs nothing, postings are joined, pruned at every size."""
    session, q = queries.sparkSession, query_terms(queries)
    pairs = q.limit(MOST_ASKED + 1).collect() if dict(docs.dtypes)["chunk_id"] in ("tinyint", "smallint", "int", "bigint") and min(fields.values()) > 0 else None
    known = sorted({r["term"] for r in pairs or []})
    if pairs is not None and len(pairs) <= MOST_ASKED:
        rows, path = written(_coded(docs, list(fields), known), "coded")
        if not rows.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR chunk_id IS NULL").limit(1).count():
            out, _ = written(ranked(_scored(rows, pairs, known, q.schema["query_id"].dataType, k, list(fields.values()), k1, b), k), "best")
            remove(session, path)
            return out
        remove(session, path)
    held = postings.Scanned(docs, q, list(fields))
    out = index_top_k(held, queries, k, fields=fields, k1=k1, b=b, prune_from=0)
    remove(session, held.path)
    return out


def _scored(rows: DataFrame, pairs: list, known: list[str], query_kind: DataType, k: int, boosts: list[float], k1: float, b: float) -> DataFrame:
    """(query_id, chunk_id, score): each task's k best rows of `_coded` for each query of pairs (query_id, term)."""
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"n{i}").alias(f"m{i}") for i in range(len(boosts)))).first()
    idf = np.zeros((len(boosts), len(known)))
    for i, boost in enumerate(boosts):
        for term, df in rows.select(F.explode(f"t{i}").alias("t")).groupBy("t").count().collect():
            idf[i, term] = boost * max(math.log((stats["n"] - df + 0.5) / (df + 0.5)), 1e-6)
    means = [stats[f"m{i}"] or 1.0 for i in range(len(boosts))]
    ids = list(dict.fromkeys(r["query_id"] for r in pairs))
    place, spot = {x: i for i, x in enumerate(ids)}, {t: i for i, t in enumerate(known)}
    # the queries of each term stand side by side
    by_term = np.array(sorted((spot[r["term"]], place[r["query_id"]]) for r in pairs), np.int64).reshape(-1, 2)
    starts = np.searchsorted(by_term[:, 0], np.arange(len(known) + 1))
    asking, many, n_queries = by_term[:, 1], np.diff(starts), len(ids)
    chunk_kind = rows.schema["chunk_id"].dataType
    types = to_arrow_type(query_kind), to_arrow_type(chunk_kind)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(n_queries, k)
        for batch in (whole.slice(i, postings.GATHERED) for whole in batches for i in range(0, whole.num_rows, postings.GATHERED)):
            chunk, parts = batch.column(0).to_numpy().astype(np.int64), []
            for i in range(len(boosts)):
                n, t, c = (batch.column(1 + 3 * i + j) for j in range(3))
                row = np.repeat(np.arange(len(chunk)), pc.list_value_length(t).to_numpy())
                term, tf = t.flatten().to_numpy(), c.flatten().to_numpy()
                parts.append((row, term, idf[i][term] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * n.to_numpy()[row] / means[i])))))
            row, term, weight = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(row, kind="stable")
            row, term, weight = row[order], term[order], weight[order]
            sizes = np.maximum(np.bincount(row, many[term], len(chunk)), n_queries) if len(row) else np.zeros(len(chunk))
            for lo, hi in postings._runs(sizes, CELLS) if len(row) else ():
                a, z = np.searchsorted(row, [lo, hi])
                each = many[term[a:z]]
                which = np.repeat(np.arange(a, z), each)
                query = asking[np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(starts[term[a:z]], each)]
                sums = np.bincount((row[which] - lo) * n_queries + query, weight[which], (hi - lo) * n_queries).reshape(hi - lo, n_queries)
                at, query = np.nonzero((sums > 0) & (np.round(sums, 6) >= best.floor))
                best.offer(query, chunk[lo + at], sums[at, query])
        yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in best.query], types[0]), pa.array(best.place, types[1]), pa.array(best.score)], names=["query_id", "chunk_id", "score"])

    return rows.mapInArrow(score, f"query_id {query_kind.simpleString()}, chunk_id {chunk_kind.simpleString()}, score double")
