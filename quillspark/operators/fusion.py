"""Fusion of ranked lists, explanations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.lexical import ranked

RRF_K = 60


def rrf(lists: DataFrame, k: int, constant: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, chunk_id, rank) rows of any number of lists."""
    return ranked(lists.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score")), k)


def normalized(scores: DataFrame, how: str) -> DataFrame:
    """Scores of each list and query as min-max (0 to 1; 1 where all are equal) or z-scores (0 where all are equal)."""
    w = Window.partitionBy("list", "query_id")
    s = F.col("score")
    if how == "minmax":
        low, high = F.min(s).over(w), F.max(s).over(w)
        value = F.when(high > low, (s - low) / (high - low)).otherwise(1.0)
    else:
        spread = F.stddev_pop(s).over(w)
        value = F.when(spread > 1e-12, (s - F.avg(s).over(w)) / spread).otherwise(0.0)
    return scores.withColumn("score", value)


def weighted(lists: DataFrame, weights: dict[str, float], k: int, how: str = "minmax") -> DataFrame:
    """Weighted sum of normalised scores of (list, query_id, chunk_id, score); weights add up to 1."""
    if abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must add up to 1")
    w = F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("list"))
    return ranked(normalized(lists, how).groupBy("query_id", "chunk_id").agg(F.sum(F.col("score") * w).alias("score")), k)


def with_precedence(fused: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Rows that exact references name come first, each part in its own order."""
    mark = exact.select("query_id", "chunk_id", F.lit(0).alias("part")).distinct()
    x = fused.join(mark, ["query_id", "chunk_id"], "left").withColumn("part", F.coalesce("part", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("part", F.desc("score"), "chunk_id"))
    return x.withColumn("rank", rank).filter(F.col("rank") <= k)


def max_fused(lists: DataFrame, k: int) -> DataFrame:
    return ranked(lists.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), k)


def explained(fused: DataFrame, **lists: DataFrame) -> DataFrame:
    """Each fused row's rank in each list, null where it is not in it."""
    for name, one in lists.items():
        fused = fused.join(one.select("query_id", "chunk_id", F.col("rank").alias(f"{name}_rank")), ["query_id", "chunk_id"], "left")
    return fused


def page(rows: DataFrame, number: int, size: int, limit: int) -> DataFrame:
    """Ranks of one page; pages count from 1 and end at the limit."""
    start = (max(number, 1) - 1) * size
    return rows.filter((F.col("rank") > start) & (F.col("rank") <= min(limit, start + size)))


def after(rows: DataFrame, score: float, chunk_id: int, n: int) -> DataFrame:
    """The n rows of a query that follow a keyset cursor (score, chunk_id)."""
    return rows.filter((F.col("score") < score) | ((F.col("score") == score) & (F.col("chunk_id") > chunk_id))).orderBy(F.desc("score"), "chunk_id").limit(n)


def reranked(fused: DataFrame, relevance: DataFrame, top: int = 50) -> DataFrame:
    """The first `top` rows of each query by a model's relevance (query_id, chunk_id, relevance), ties in fused order.

    Values that are null, NaN or infinite do not count, of repeated ones the highest does; rows without one are left
    out. A query for which the model gave nothing keeps its fused order."""
    good = relevance.filter(~F.isnan("relevance") & (F.abs("relevance") < float("inf"))).groupBy("query_id", "chunk_id").agg(F.max("relevance").alias("relevance"))
    x = fused.filter(F.col("rank") <= top).join(good, ["query_id", "chunk_id"], "left")
    any_good = F.max(F.col("relevance").isNotNull()).over(Window.partitionBy("query_id"))
    x = x.withColumn("fused_rank", F.col("rank")).withColumn("any", any_good).filter("NOT any OR relevance IS NOT NULL")
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "fused_rank")
    return x.withColumn("rank", F.row_number().over(order)).drop("any")


def source_pack(hits: DataFrame, evidence: DataFrame, most: int) -> DataFrame:
    """Evidence (chunk_id, evidence_id) behind ranked hits, each once a query where it comes first, labelled E1 to E<most>."""
    first = hits.join(evidence, "chunk_id").groupBy("query_id", "evidence_id").agg(F.min(F.struct("rank", "chunk_id")).alias("x"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("x.rank", "x.chunk_id", "evidence_id"))
    return first.withColumn("n", n).filter(F.col("n") <= most).select("query_id", F.concat(F.lit("E"), "n").alias("label"), "evidence_id", F.col("x.chunk_id").alias("chunk_id"))


def shared_budget(lists: DataFrame, budget: int) -> DataFrame:
    """Candidates (query_id, space, chunk_id, rank) of all spaces that one budget of a query allows: rank by rank, spaces by name."""
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "space", "chunk_id"))
    return lists.withColumn("turn", turn).filter(F.col("turn") <= budget)
