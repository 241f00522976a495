"""Text, key, label and vector functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions import vector as V
from quillspark.operators.pairs import paired
from quillspark.plans.registry import norm_key_sql, query, terms_sql, tokens_sql
from quillspark.storage import table


@query(f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT conv_id, turn, {tokens_sql("concat_ws(' ', role, text)")} AS tokens FROM conversations WHERE role <> '' AND text <> ''")
def spaced_token_estimate(spark, d):
    return table(spark, d, "conversations").filter("role <> '' AND text <> ''").select("conv_id", "turn", X.spaced_token_estimate(F.array("role", "text")).alias("tokens"))


@query(r"""SELECT item_id, array_to_string(list_transform(list_filter(string_split_regex(text, '[^\p{L}\p{N}]+'), lambda w: w <> ''), lambda w: '"' || w || '"'), ' OR ') AS expression FROM benchmark""")
def match_expression(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.match_expression(F.col("text")).alias("expression"))


@query(f"""SELECT c.conv_id, c.turn, round(coalesce(len(list_filter({terms_sql('q.text')}, lambda w: list_contains({terms_sql('c.text')}, w)))::DOUBLE / nullif(len({terms_sql('q.text')}), 0), 0), 6) AS support
FROM conversations c JOIN conversations q ON c.conv_id = q.conv_id AND q.turn = 0""")
def support_score(spark, d):
    c = table(spark, d, "conversations")
    q = c.filter("turn = 0").select("conv_id", F.col("text").alias("question"))
    return c.join(q, "conv_id").select("conv_id", "turn", F.round(X.support_score(F.col("question"), F.col("text")), 6).alias("support"))


@query(f"""WITH s AS (SELECT c.conv_id, c.turn, round(coalesce(len(list_filter({terms_sql('q.text')}, lambda w: list_contains({terms_sql('c.text')}, w)))::DOUBLE / nullif(len({terms_sql('q.text')}), 0), 0), 3) AS support
FROM conversations c JOIN conversations q ON c.conv_id = q.conv_id AND q.turn = 0 WHERE c.turn > 0)
SELECT conv_id, turn, support FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY support DESC, turn) = 1""")
def best_support(spark, d):
    c = table(spark, d, "conversations")
    q = c.filter("turn = 0").select("conv_id", F.col("text").alias("question"))
    s = c.filter("turn > 0").join(q, "conv_id").select("conv_id", "turn", F.round(X.support_score(F.col("question"), F.col("text")), 3).alias("support"))
    return s.groupBy("conv_id").agg(F.max_by("turn", F.struct("support", -F.col("turn"))).alias("turn"), F.max("support").alias("support"))


@query(rf"SELECT item_id, list_distinct(list_filter({terms_sql('text')}, lambda w: NOT (length(w) <= 2 AND regexp_full_match(w, '[\x00-\x7F]*')))).list_sort().array_to_string(' ') AS tokens FROM benchmark")
def token_sets(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(X.token_set(F.col("text"))), " ").alias("tokens"))


@query(f"SELECT p_partkey, {norm_key_sql('p_name')} AS key, CASE WHEN {norm_key_sql('p_type')} <> '' THEN {norm_key_sql('p_type')} ELSE 'raw:' || substr(sha256(p_type), 1, 16) END AS lookup FROM part")
def normalize_key(spark, d):
    return table(spark, d, "part").select("p_partkey", X.normalize_key(F.col("p_name")).alias("key"), X.lookup_key(F.col("p_type")).alias("lookup"))


@query("""WITH s AS (SELECT p_partkey, p_brand, CASE WHEN trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'section' ELSE trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') END AS base FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, base ORDER BY p_partkey) AS n FROM s)
SELECT p_partkey, base || CASE WHEN n > 1 THEN '-' || (n - 1) ELSE '' END AS slug FROM n""")
def heading_slug(spark, d):
    from quillspark.sources.markdown import unique_slugs

    return unique_slugs(table(spark, d, "part"), "p_brand", "p_name", ["p_partkey"]).select("p_partkey", "slug")


@query("""SELECT event_id, array_to_string(list_sort(list_distinct(['E' || event_id % 7, 'E' || user_id % 5])), ',') AS labels, (event_id % 7 = user_id % 5) AS resolved FROM events""")
def citation_labels(spark, d):
    e = table(spark, d, "events")
    one, two = F.concat(F.lit("E"), F.col("event_id") % 7), F.concat(F.lit("E"), F.col("user_id") % 5)
    answer = F.concat(F.lit("see ["), one, F.lit(", "), two, F.lit("] and ["), one, F.lit(", x]"))
    return e.select("event_id", F.array_join(X.citation_labels(answer), ",").alias("labels"), X.citations_resolved(answer, F.array(one)).alias("resolved"))


@query("SELECT l_orderkey, l_linenumber, l_partkey::VARCHAR AS chunk_id, l_linenumber::BIGINT AS lo, l_suppkey AS hi FROM lineitem")
def source_spans(spark, d):
    raw = F.concat("l_partkey", F.lit(":"), "l_linenumber", F.lit("-"), "l_suppkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.source_span(raw).alias("s")).select("l_orderkey", "l_linenumber", "s.*")


@query(r"""SELECT page_id, regexp_replace(url, '^https?://', '') AS path,
  regexp_matches(regexp_replace(url, '^https?://', ''), '^.*\.pdf$') OR len(list_filter(string_split(regexp_replace(url, '^https?://', ''), '/'), lambda s: regexp_full_match(s, 'p.ge.*'))) > 0 AS ignored FROM pages""")
def glob_filter(spark, d):
    path = F.regexp_replace("url", "^https?://", "")
    return table(spark, d, "pages").select("page_id", path.alias("path"), (path.rlike(r"^.*\.pdf$") | X.ignored(path, ["p?ge*"])).alias("ignored"))


@query(r"SELECT page_id, array_to_string(list_filter(string_split(replace(url, '\', '/'), '/'), lambda s: s <> '' AND s <> '.'), '/') AS path FROM pages")
def logical_path(spark, d):
    return table(spark, d, "pages").select("page_id", X.logical_path(F.col("url")).alias("path"))


@query("SELECT doc_id, 'doc:v1:' || sha256(strlen(source) || ':' || source || strlen(doc_id::VARCHAR) || ':' || doc_id || '64:' || sha256(text)) AS id FROM documents WHERE source IS NOT NULL AND text IS NOT NULL")
def ident_hash(spark, d):
    x = table(spark, d, "documents").filter("source IS NOT NULL AND text IS NOT NULL")
    return x.select("doc_id", X.stable_id("doc", F.col("source"), F.col("doc_id"), F.sha2("text", 256)).alias("id"))


@query("SELECT doc_id, CASE WHEN coalesce(lang, '') = '' THEN text ELSE lang || ' ' || text END AS search_text, substr(CASE WHEN coalesce(lang, '') = '' THEN text ELSE lang || ' ' || text END, 1, 8000) AS rerank_text, sha256(concat_ws(chr(10), nullif(source, ''), text)) AS input_hash FROM documents")
def search_projection(spark, d):
    return table(spark, d, "documents").select("doc_id", X.search_text(F.col("lang"), F.col("text")).alias("search_text"), X.rerank_text(F.col("lang"), F.col("text")).alias("rerank_text"), F.sha2(X.embedding_input(F.col("source"), F.col("text")), 256).alias("input_hash"))


@query("SELECT event_id, nullif(trim(json_extract_string(props, '$.page')), '') AS page, nullif(trim(json_extract_string(props, '$.k')), '') AS k FROM events")
def metadata_strings(spark, d):
    return table(spark, d, "events").select("event_id", X.metadata_string(F.col("props"), "page").alias("page"), X.metadata_string(F.col("props"), "k").alias("k"))


@query("SELECT doc_id, 1 + length(text) - length(replace(text, chr(10), '')) AS line FROM documents")
def line_numbers(spark, d):
    """The line at which each text ends."""
    return table(spark, d, "documents").select("doc_id", X.line_at(F.col("text"), F.octet_length("text")).cast("long").alias("line"))


@query("""WITH q AS (SELECT vec_id AS q_id, embedding AS q, label FROM embeddings WHERE vec_id % 100 = 0)
SELECT q_id, vec_id, round(list_sum(list_transform(list_zip(q, embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) AS dot,
  round(list_sum(list_transform(list_zip(q, embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS cosine,
  round(1 / (1 + sqrt(list_sum(list_transform(list_zip(q, embedding), lambda z: power(z[1]::DOUBLE - z[2]::DOUBLE, 2))))), 6) AS l2_score,
  abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) <= 1e-4 AS is_unit
FROM q JOIN embeddings e ON e.label = q.label AND e.vec_id <> q_id""")
def exact_kernels(spark, d):
    """What is known of one vector is computed once, not for each of its pairs."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding", V.norm(F.col("embedding")).alias("norm"), V.is_unit(F.col("embedding")).alias("is_unit"))
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"), F.col("norm").alias("q_norm"), "label")
    a, b = F.col("q"), F.col("embedding")
    x = paired(q, e, "label", "vec_id").filter("vec_id <> q_id").withColumn("_dot", V.dot(a, b))
    cosine = F.col("_dot") / F.nullif(F.col("q_norm") * F.col("norm"), F.lit(0.0))
    return x.select("q_id", "vec_id", F.round("_dot", 6).alias("dot"), F.round(cosine, 6).alias("cosine"), F.round(V.l2_score(a, b), 6).alias("l2_score"), "is_unit")
