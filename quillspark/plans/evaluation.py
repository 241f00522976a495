"""Diversity, audits and retrieval quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import dense, evaluate
from quillspark.plans.registry import query
from quillspark.plans.retrieval import EVERY, dense_sql, query_vectors, vectors
from quillspark.storage import table


def near(spark, d, k):
    return dense.dense_top_k(vectors(spark, d), query_vectors(spark, d), k, "cosine")


def relevant(spark, d):
    """Chunks with the query's label."""
    v = vectors(spark, d).select("chunk_id", "label")
    q = v.filter(F.col("chunk_id") % EVERY == 0).select(F.col("chunk_id").alias("query_id"), "label")
    return q.join(v, "label").filter("chunk_id <> query_id").select("query_id", "chunk_id")


REL = f"t AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % {EVERY} = 0)"


@query(f"""WITH {dense_sql('p', 'cosine', k=100)}, {REL}, s AS (SELECT query_id, least(count(*), 20) AS size FROM t GROUP BY 1),
c AS (SELECT query_id, least(count(*), 20) AS candidate, least(count(*) FILTER (WHERE rank <= 20), 20) AS final FROM p JOIN t USING (query_id, chunk_id) GROUP BY 1)
SELECT query_id, coalesce(candidate, 0)::INT AS candidate, coalesce(final, 0)::INT AS final, round(coalesce(candidate, 0) / size, 6) AS candidate_recall, round(coalesce(final, 0) / size, 6) AS final_recall FROM s LEFT JOIN c USING (query_id)""")
def recall_at_k(spark, d):
    pool = near(spark, d, 100)
    out = evaluate.recall(pool, pool.filter("rank <= 20"), relevant(spark, d), 20)
    return out.withColumns({c: F.col(c).cast("int") for c in ("candidate", "final")})


@query(f"""WITH {dense_sql('p', 'cosine', k=10)}, {REL}, r AS (SELECT query_id, chunk_id, 1 + (chunk_id % 3) AS rel FROM t),
g AS (SELECT p.query_id, p.rank, coalesce(rel, 0) AS rel, sum((rel > 0)::INT) OVER (PARTITION BY p.query_id ORDER BY rank) AS so_far FROM p LEFT JOIN r USING (query_id, chunk_id)),
a AS (SELECT query_id, sum(rel / log2(rank + 1)) AS dcg, min(rank) FILTER (WHERE rel > 0) AS first, sum(CASE WHEN rel > 0 THEN so_far / rank ELSE 0 END) AS pr FROM g GROUP BY 1),
i AS (SELECT query_id, sum(rel / log2(n + 1)) AS ideal, count(*) AS m FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, chunk_id) AS n FROM r) WHERE n <= 10 GROUP BY 1)
SELECT query_id, round(coalesce(dcg / ideal, 0), 6) AS ndcg, round(coalesce(1 / first, 0), 6) AS reciprocal_rank, round(coalesce(pr / m, 0), 6) AS average_precision FROM a LEFT JOIN i USING (query_id)""")
def ranking_quality(spark, d):
    return evaluate.ndcg(near(spark, d, 10), relevant(spark, d).withColumn("rel", 1 + F.col("chunk_id") % 3), 10)


@query(f"""WITH {dense_sql('a', 'cosine', k=10)}, {dense_sql('b', 'dot', where='e.label < 6', k=10)}
SELECT query_id, count(b.chunk_id) AS shared FROM a LEFT JOIN b USING (query_id, chunk_id) GROUP BY 1""")
def topk_overlap(spark, d):
    other = dense.dense_top_k(vectors(spark, d).filter("label < 6"), query_vectors(spark, d), 10, "dot")
    return evaluate.overlap(near(spark, d, 10), other, 10)


def _quota_sql(most: int) -> str:
    return f"""WITH {dense_sql('p', 'cosine', k=60)}, q AS (SELECT p.*, label FROM p JOIN embeddings e ON e.vec_id = p.chunk_id QUALIFY row_number() OVER (PARTITION BY p.query_id, label ORDER BY rank) <= {most})
SELECT query_id, chunk_id, score, label, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS rank FROM q"""


@query(_quota_sql(3))
def source_quota(spark, d):
    x = near(spark, d, 60).join(vectors(spark, d).select("chunk_id", "label"), "chunk_id")
    return evaluate.quota(x, "label", 3).select("query_id", "chunk_id", "score", "label", "rank")


@query("SELECT sha256(text) AS text_hash, min(doc_id) AS representative, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.min("doc_id").alias("representative"), F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("""SELECT user_id AS "group", count(*) AS claims, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, round(count(*) FILTER (WHERE event_type = 'click') / count(*), 6) AS ratio FROM events GROUP BY 1""")
def claim_coverage(spark, d):
    return evaluate.coverage(table(spark, d, "events").select(F.col("user_id").alias("group"), F.col("event_type").alias("class")), ["click", "view"])


@query("""SELECT o_custkey AS "group", CASE WHEN bool_or(o_orderpriority LIKE '1%' AND o_orderkey % 5 = 0) THEN 'blocked' WHEN bool_or(o_orderstatus = 'P') THEN 'incomplete' WHEN bool_or(o_totalprice > 300000) THEN 'unable' ELSE 'exhaustive' END AS verdict, count(*) AS n FROM orders GROUP BY 1""")
def exhaustive_completeness(spark, d):
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("group"), (F.col("o_orderpriority").startswith("1") & (F.col("o_orderkey") % 5 == 0)).alias("blocked"), (F.col("o_orderstatus") != "P").alias("scanned"), (F.col("o_totalprice") > 300000).alias("unreadable"))
    return evaluate.completeness(x)


@query("""WITH s AS (SELECT event_type, max(value) FILTER (WHERE user_id % 2 = 0) AS a, max(value) FILTER (WHERE user_id % 2 = 1) AS b FROM events GROUP BY 1)
SELECT event_type, a, b, CASE WHEN a IS NULL OR b IS NULL THEN 'missing' WHEN a = b THEN 'agreement' ELSE 'difference' END AS alignment FROM s""")
def compare_sources_cells(spark, d):
    x = table(spark, d, "events").withColumn("side", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"))
    s = x.groupBy("event_type").pivot("side", ["a", "b"]).agg(F.max("value"))
    return s.withColumn("alignment", F.when(F.col("a").isNull() | F.col("b").isNull(), "missing").when(F.col("a") == F.col("b"), "agreement").otherwise("difference"))


@query("""SELECT user_id, min(event_id) AS first_seen, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS parts, bool_or(value > 2) AS is_direct, arg_min(event_type, event_id) FILTER (WHERE value > 1) AS pack FROM events GROUP BY 1""")
def merge_attributed(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(
        F.min("event_id").alias("first_seen"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("parts"), F.bool_or(F.col("value") > 2).alias("is_direct"), F.min_by("event_type", F.when(F.col("value") > 1, F.col("event_id"))).alias("pack"))


@query("""WITH m AS (SELECT 'mean_value' AS metric, avg(value) AS value FROM events UNION ALL SELECT 'rows', count(*) FROM events)
SELECT metric, bar, round(value, 6) AS value, CASE WHEN value IS NULL THEN 'missing' WHEN value >= bar THEN 'pass' ELSE 'fail' END AS verdict FROM (VALUES ('mean_value', 100.0::DOUBLE), ('rows', 10.0::DOUBLE), ('recall', 0.95::DOUBLE)) b(metric, bar) LEFT JOIN m USING (metric)""")
def gate_verdict(spark, d):
    e = table(spark, d, "events")
    m = e.agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).cast("double").alias("rows")).unpivot([], ["mean_value", "rows"], "metric", "value")
    return evaluate.gates(m, {"mean_value": 100.0, "rows": 10.0, "recall": 0.95}, ["recall"]).withColumn("value", F.round("value", 6))
