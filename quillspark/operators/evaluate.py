"""Retrieval evaluation and audits: recall, nDCG, reciprocal rank, overlap, coverage and gates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall(pool: DataFrame, final: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Per query: truth found anywhere in the pool and in the final rows, each at most k, over the smaller of |truth| and k."""
    def hits(rows: DataFrame, name: str) -> DataFrame:
        found = rows.select("query_id", "chunk_id").distinct().join(truth, ["query_id", "chunk_id"], "left_semi")
        return found.groupBy("query_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias(name))

    size = truth.groupBy("query_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("size"))
    x = size.join(hits(pool, "candidate"), "query_id", "left").join(hits(final, "final"), "query_id", "left").fillna(0, ["candidate", "final"])
    return x.select("query_id", "candidate", "final", F.round(F.col("candidate") / F.col("size"), 6).alias("candidate_recall"), F.round(F.col("final") / F.col("size"), 6).alias("final_recall"))


def ndcg(rows: DataFrame, relevance: DataFrame, k: int) -> DataFrame:
    """nDCG@k, reciprocal rank and average precision of ranked rows against relevance (query_id, chunk_id, rel > 0)."""
    gain = lambda rel, rank: rel / F.log2(rank + 1.0)
    top = rows.filter(F.col("rank") <= k).join(relevance, ["query_id", "chunk_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    so_far = F.sum((F.col("rel") > 0).cast("int")).over(Window.partitionBy("query_id").orderBy("rank"))
    got = top.withColumn("so_far", so_far).groupBy("query_id").agg(
        F.sum(gain(F.col("rel"), F.col("rank"))).alias("dcg"), F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first"), F.sum(F.when(F.col("rel") > 0, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("precisions"))
    ideal = relevance.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "chunk_id"))).filter(F.col("rank") <= k).groupBy("query_id").agg(F.sum(gain(F.col("rel"), F.col("rank"))).alias("ideal"), F.count(F.lit(1)).alias("n"))
    x = got.join(ideal, "query_id", "left")
    return x.select("query_id", F.round(F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)), 6).alias("ndcg"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(F.coalesce(F.col("precisions") / F.col("n"), F.lit(0.0)), 6).alias("average_precision"))


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Per query of a: rows that both lists have among their first k."""
    x, y = (t.filter(F.col("rank") <= k).select("query_id", "chunk_id") for t in (a, b))
    both = x.join(y, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("shared"))
    return x.select("query_id").distinct().join(both, "query_id", "left").fillna(0, ["shared"])


def quota(rows: DataFrame, group: str, most: int) -> DataFrame:
    """At most so many rows of each group and query, ranks renumbered."""
    kept = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", group).orderBy("rank"))).filter(F.col("_n") <= most).drop("_n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def coverage(claims: DataFrame, classes: list[str]) -> DataFrame:
    """Claims of each class by group, and the share of those that the first class counts."""
    counts = claims.groupBy("group").agg(F.count(F.lit(1)).alias("claims"), *[F.count_if(F.col("class") == c).alias(c) for c in classes])
    return counts.withColumn("ratio", F.round(F.col(classes[0]) / F.col("claims"), 6))


def completeness(sources: DataFrame) -> DataFrame:
    """Verdict of an exhaustive audit by group: blocked before incomplete before unable before exhaustive."""
    verdict = F.when(F.bool_or("blocked"), "blocked").when(F.bool_or(~F.col("scanned")), "incomplete").when(F.bool_or("unreadable"), "unable").otherwise("exhaustive")
    return sources.groupBy("group").agg(verdict.alias("verdict"), F.count(F.lit(1)).alias("n"))


def gates(metrics: DataFrame, bars: dict[str, float], required: list[str]) -> DataFrame:
    """Each metric against its bar; a required metric that is missing is an error, another is left out."""
    spark = metrics.sparkSession
    b = spark.createDataFrame([(k, float(v), k in required) for k, v in sorted(bars.items())], "metric string, bar double, required boolean")
    x = b.join(metrics, "metric", "left").filter("value IS NOT NULL OR required")
    return x.select("metric", "bar", "value", F.when(F.col("value").isNull(), "missing").when(F.col("value") >= F.col("bar"), "pass").otherwise("fail").alias("verdict"))


def selections(chosen: DataFrame, allowed: DataFrame, kinds: list[str]) -> DataFrame:
    """A verdict on each evidence id that an answer selects (answer, position, evidence_id) against what is stored and
    allowed (evidence_id, kind, allowed): unknown, not_allowed, not_citable, repeated (in its answer) or ok."""
    again = F.row_number().over(Window.partitionBy("answer", "evidence_id").orderBy("position")) > 1
    x = chosen.withColumn("again", again).join(allowed, "evidence_id", "left")
    verdict = F.when(F.col("kind").isNull(), "unknown").when(~F.col("allowed"), "not_allowed").when(~F.col("kind").isin(*kinds), "not_citable").when(F.col("again"), "repeated").otherwise("ok")
    return x.select("answer", "position", "evidence_id", verdict.alias("verdict"))


def diversified(pool: DataFrame, vectors: DataFrame, k: int, share: float = 0.7) -> DataFrame:
    """Maximal marginal relevance: k rows a query, each the best by share * score - (1 - share) * its highest cosine
    similarity to those before it, ties to smaller chunk ids. A group is one query's pool, a ranked list of bounded length."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_id").reset_index(drop=True)
        v = np.array(pdf["embedding"].tolist(), float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        score, near, left, out = pdf["score"].to_numpy(), np.zeros(len(pdf)), np.ones(len(pdf), bool), []
        while left.any() and len(out) < k:
            i = int(np.argmax(np.where(left, np.round(share * score - (1 - share) * near, 6), -np.inf)))
            near = v @ v[i] if not out else np.maximum(near, v @ v[i])
            left[i] = False
            out.append(i)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[out], "chunk_id": pdf["chunk_id"].iloc[out], "rank": range(1, len(out) + 1)})

    x = pool.select("query_id", "chunk_id", "score").join(vectors.select("chunk_id", F.col("embedding").cast("array<double>")), "chunk_id")
    return x.groupBy("query_id").applyInPandas(pick, "query_id long, chunk_id long, rank int")
