"""Reranking, source packs, selected evidence, diversity."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.text import rerank_text, support_score
from quillspark.operators import dense, evaluate, fusion
from quillspark.plans.registry import query, terms_sql
from quillspark.plans.retrieval import BM25_K, COLUMNS, LIMIT, bm25_sql, chunks, lexical_list, query_vectors, questions, vectors
from quillspark.storage import table


@query(f"""WITH {bm25_sql('b')},
h AS (SELECT b.*, round(len(list_filter({terms_sql('q.text')}, lambda w: list_contains({terms_sql("substr(d.text, 1, 8000)")}, w))) / len({terms_sql('q.text')}), 6) AS relevance
  FROM b JOIN benchmark q ON q.item_id = query_id JOIN documents d ON d.doc_id = chunk_id WHERE b.rank <= 20)
SELECT query_id, chunk_id, score, relevance, rank AS fused_rank, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, rank)::INT AS rank FROM h""")
def rerank_topk(spark, d):
    """The best lexical hits again, by the share of the question's terms in the text that a reranker reads."""
    hits = lexical_list(spark, d, BM25_K).select(*COLUMNS)
    pairs = hits.filter("rank <= 20").select("query_id", "chunk_id").join(chunks(spark, d).select("chunk_id", "text"), "chunk_id").join(questions(spark, d).withColumnRenamed("text", "question"), "query_id")
    relevance = pairs.select("query_id", "chunk_id", F.round(support_score(F.col("question"), rerank_text(F.lit(""), F.col("text"))), 6).alias("relevance"))
    return fusion.reranked(hits, relevance, 20).select(*COLUMNS, "relevance", "fused_rank")


@query(f"""WITH {bm25_sql('b')}, e AS (SELECT b.query_id, b.rank, b.chunk_id, sha256(text) AS evidence_id FROM b JOIN documents ON doc_id = chunk_id),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY query_id, evidence_id ORDER BY rank, chunk_id) = 1)
SELECT query_id, 'E' || row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS label, evidence_id, chunk_id FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) <= {LIMIT}""")
def source_pack(spark, d):
    hits = lexical_list(spark, d, BM25_K)
    return fusion.source_pack(hits.select("query_id", "rank", "chunk_id"), chunks(spark, d).select("chunk_id", F.sha2("text", 256).alias("evidence_id")), LIMIT)


@query("""WITH c AS (SELECT l_suppkey AS answer, l_orderkey * 10 + l_linenumber AS position, l_partkey AS evidence_id FROM lineitem)
SELECT answer, position, evidence_id, CASE WHEN p_partkey IS NULL THEN 'unknown' WHEN p_size > 45 THEN 'not_allowed' WHEN split_part(p_type, ' ', 1) NOT IN ('STANDARD', 'SMALL', 'MEDIUM', 'LARGE') THEN 'not_citable'
  WHEN row_number() OVER (PARTITION BY answer, evidence_id ORDER BY position) > 1 THEN 'repeated' ELSE 'ok' END AS verdict FROM c LEFT JOIN part ON p_partkey = evidence_id""")
def selected_evidence(spark, d):
    chosen = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("answer"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), F.col("l_partkey").alias("evidence_id"))
    stored = table(spark, d, "part").select(F.col("p_partkey").alias("evidence_id"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind"), (F.col("p_size") <= 45).alias("allowed"))
    return evaluate.selections(chosen, stored, ["STANDARD", "SMALL", "MEDIUM", "LARGE"])


@query()
def mmr_topk(spark, d):
    pool = dense.dense_top_k(vectors(spark, d), query_vectors(spark, d), 80, "cosine")
    return evaluate.diversified(pool, vectors(spark, d), LIMIT)


@query("SELECT md5(text) AS canonical_id, min(doc_id) AS first_seen, max(doc_id) AS last_seen, count(*) AS occurrences, count(DISTINCT source) AS n_sources FROM documents GROUP BY 1")
def candidate_occurrences(spark, d):
    x = table(spark, d, "documents").groupBy(F.md5("text").alias("canonical_id"))
    return x.agg(F.min("doc_id").alias("first_seen"), F.max("doc_id").alias("last_seen"), F.count(F.lit(1)).alias("occurrences"), F.countDistinct("source").alias("n_sources"))
