"""Hits that still hold, caches, tasks, pages, citations and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import citations as C
from quillspark.functions.text import lookup_key
from quillspark.operators import evidence as E
from quillspark.plans.registry import norm_key_sql, query
from quillspark.storage import table


@query("""WITH h AS (SELECT l_orderkey AS query_id, l_partkey AS chunk_id, l_linenumber AS position FROM lineitem),
v AS (SELECT query_id, chunk_id, min(position) AS position FROM h JOIN part ON chunk_id = p_partkey AND position % 2 = p_size % 2 WHERE p_brand <> 'Brand#1' GROUP BY ALL)
SELECT query_id, chunk_id, position, row_number() OVER (PARTITION BY query_id ORDER BY position, chunk_id)::INT AS rank FROM v QUALIFY rank <= 2""")
def valid_hits(spark, d):
    hits = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("chunk_id"), F.col("l_linenumber").alias("position"), (F.col("l_linenumber") % 2).alias("generation"))
    chunks = table(spark, d, "part").filter("p_brand <> 'Brand#1'").select(F.col("p_partkey").alias("chunk_id"), (F.col("p_size") % 2).alias("generation"))
    return E.valid_hits(hits, chunks, 2).select("query_id", "chunk_id", "position", "rank")


@query("SELECT event_type AS list, user_id AS query_id, event_id AS chunk_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id)::INT AS rank FROM events WHERE value < 50")
def identity_filtered_lists(spark, d):
    x = table(spark, d, "events").select(F.col("event_type").alias("list"), F.col("user_id").alias("query_id"), F.col("event_id").alias("chunk_id"), F.col("event_id").alias("rank"))
    return E.identity_filtered(x, table(spark, d, "events").filter("value < 50").select(F.col("event_id").alias("chunk_id"))).select("list", "query_id", "chunk_id", "rank")


#: Keys from customers and events from nations, of all nine kinds.
KEYS = "SELECT c_custkey AS key_id, c_nationkey AS principal, c_custkey % 5 AS source_generation, c_custkey % 3 AS acl_scope, c_custkey % 701 AS model_fingerprint, c_custkey % 911 AS query_plan_hash, c_custkey % 811 AS policy_version FROM customer"
EVENTS = "SELECT ['edit', 'delete', 'snapshot', 'lifecycle', 'acl', 'model', 'profile', 'graph', 'retention'][(n_nationkey % 9 + 1)::INT] AS kind, n_nationkey AS principal, n_nationkey % 5 AS source_generation, n_nationkey % 3 AS acl_scope, n_nationkey AS model_fingerprint, n_nationkey AS query_plan_hash, n_nationkey AS policy_version FROM nation WHERE n_nationkey % 9 <> 7 OR n_nationkey = 7"


@query(f"""WITH k AS ({KEYS}), e AS ({EVENTS})
SELECT DISTINCT key_id FROM k JOIN e ON (e.kind IN ('edit', 'delete', 'snapshot', 'lifecycle') AND k.principal = e.principal AND k.source_generation = e.source_generation) OR (e.kind = 'acl' AND k.principal = e.principal AND k.acl_scope = e.acl_scope)
  OR (e.kind = 'model' AND k.model_fingerprint = e.model_fingerprint) OR (e.kind = 'profile' AND k.query_plan_hash = e.query_plan_hash) OR (e.kind = 'graph' AND k.source_generation = e.source_generation) OR (e.kind = 'retention' AND k.policy_version = e.policy_version)""")
def cache_invalidation(spark, d):
    k = table(spark, d, "customer")
    n = F.col("c_custkey")
    keys = k.select(n.alias("key_id"), F.col("c_nationkey").alias("principal"), (n % 5).alias("source_generation"), (n % 3).alias("acl_scope"), (n % 701).alias("model_fingerprint"), (n % 911).alias("query_plan_hash"), (n % 811).alias("policy_version"))
    n = F.col("n_nationkey").cast("long")
    kinds = F.array(*map(F.lit, ["edit", "delete", "snapshot", "lifecycle", "acl", "model", "profile", "graph", "retention"]))
    events = table(spark, d, "nation").filter("n_nationkey % 9 <> 7 OR n_nationkey = 7").select(kinds[(n % 9).cast("int")].alias("kind"), F.col("n_nationkey").alias("principal"), (n % 5).alias("source_generation"), (n % 3).alias("acl_scope"), n.alias("model_fingerprint"), n.alias("query_plan_hash"), n.alias("policy_version"))
    return E.invalidated(keys, events)


@query("""WITH t AS (SELECT o_orderkey AS task_id, o_orderpriority || (o_custkey % 40) AS kind, CASE WHEN o_orderkey % 97 = 0 THEN 'running' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'done' END AS status FROM orders)
SELECT task_id, kind FROM t WHERE status = 'queued' AND NOT EXISTS (SELECT 1 FROM t r WHERE r.kind = t.kind AND r.status = 'running')""")
def startable_tasks(spark, d):
    status = F.when(F.col("o_orderkey") % 97 == 0, "running").when(F.col("o_orderstatus") == "O", "queued").otherwise("done")
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.concat("o_orderpriority", (F.col("o_custkey") % 40).cast("string")).alias("kind"), status.alias("status"))
    return E.startable(x).select("task_id", "kind")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IN ('3', '14', '15')")
def payload_mentions(spark, d):
    return E.mentioning(table(spark, d, "events"), "props", ["3", "14", "15"]).select("event_id")


CONVERSATION = "SELECT conv_id AS source_id, turn // 2 AS page, turn, role, text FROM conversations"


def _turns(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("source_id"), F.expr("turn div 2").alias("page"), "turn", "role", "text")


@query(f"WITH c AS ({CONVERSATION}) SELECT a.source_id, a.turn AS seed, b.turn AS image FROM c a JOIN c b USING (source_id, page) WHERE a.role = 'user' AND b.role = 'assistant'")
def page_images(spark, d):
    """Turns of a pair share a page; answers stand for its images."""
    x = _turns(spark, d)
    seeds = x.filter("role = 'user'").select("source_id", "page", F.col("turn").alias("seed"))
    return seeds.join(x.filter("role = 'assistant'").select("source_id", "page", F.col("turn").alias("image")), ["source_id", "page"]).select("source_id", "seed", "image")


@query(f"""WITH c AS ({CONVERSATION}), i AS (SELECT source_id, page, source_id || '/' || turn AS image_id, substr(text, 1, 3) AS nearby FROM c WHERE role = 'assistant')
SELECT DISTINCT image_id, source_id || '/' || turn AS unit_id FROM i JOIN c USING (source_id, page) WHERE role = 'user' AND trim(nearby, ' ') <> '' AND contains(text, trim(nearby, ' '))""")
def image_near_text(spark, d):
    x = _turns(spark, d).withColumn("id", F.concat("source_id", F.lit("/"), "turn"))
    images = x.filter("role = 'assistant'").select("source_id", "page", F.col("id").alias("image_id"), F.substring("text", 1, 3).alias("nearby"))
    return E.near_text(images, x.filter("role = 'user'").select("source_id", "page", F.col("id").alias("unit_id"), "text"))


@query(f"""WITH c AS ({CONVERSATION}), p AS (SELECT DISTINCT source_id, 'page:' || source_id || ':' || page AS node, source_id || '/' || turn AS unit FROM c)
SELECT 'same_page' AS edge_type, node AS from_node, unit AS to_node FROM p UNION ALL SELECT 'same_page', unit, node FROM p UNION ALL SELECT DISTINCT 'child', 'source:' || source_id, node FROM p""")
def page_graph(spark, d):
    return E.page_graph(_turns(spark, d).withColumn("unit_id", F.concat("source_id", F.lit("/"), "turn")))


@query("SELECT DISTINCT l_partkey AS from_unit, l_suppkey AS to_unit FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20) AND l_suppkey IN (SELECT p_partkey FROM part WHERE p_size > 20)")
def package_relations(spark, d):
    """Relations of a package whose two ends are units."""
    units = table(spark, d, "part").filter("p_size > 20").select(F.col("p_partkey").alias("unit_id"))
    return E.relation_edges(table(spark, d, "lineitem").select(F.col("l_partkey").alias("from_unit"), F.col("l_suppkey").alias("to_unit")), units)


@query("SELECT vec_id AS chunk_id, label, source FROM embeddings JOIN documents ON vec_id = doc_id")
def vector_sync_records(spark, d):
    """Vectors whose chunk is there, with its source."""
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label").join(chunks, "chunk_id")


@query(f"WITH n AS (SELECT DISTINCT p_name AS label FROM part) SELECT p_partkey AS claim_id, n.label AS node FROM part JOIN n ON {norm_key_sql('upper(p_name)')} = {norm_key_sql('n.label')}")
def claims_at_nodes(spark, d):
    """Claims find their nodes by the key of a label, whatever its case and punctuation."""
    x = table(spark, d, "part")
    nodes = x.select(F.col("p_name").alias("node")).distinct().withColumn("key", lookup_key(F.col("node")))
    claims = x.select(F.col("p_partkey").alias("claim_id"), F.array(F.concat(F.upper("p_name"), F.lit("!"))).alias("labels"))
    claims = claims.select("claim_id", F.explode("labels").alias("label")).withColumn("key", lookup_key(F.col("label")))
    return claims.join(nodes, "key").select("claim_id", "node").distinct()


@query("SELECT source, count(*) AS enumerated, count(*) FILTER (WHERE lang = 'en') AS matched, count(*) FILTER (WHERE lang = 'en') / nullif(count(*), 0)::DOUBLE AS ratio FROM documents GROUP BY 1")
def coverage_ratios(spark, d):
    x = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("enumerated"), F.count_if(F.coalesce(F.col("lang") == "en", F.lit(False))).alias("matched"))
    return x.withColumn("ratio", F.when(F.col("enumerated") > 0, F.col("matched") / F.col("enumerated")))


@query("SELECT user_id AS query_id, 5 AS requested_k, count(*) AS evaluated, count(*) FILTER (WHERE value <= 100) AS filtered, least(count(*) FILTER (WHERE value > 100), 5) AS returned FROM events GROUP BY 1")
def candidate_counters(spark, d):
    """How many candidates of each query a stage has read, filtered and returned."""
    x = table(spark, d, "events").groupBy(F.col("user_id").alias("query_id")).agg(F.lit(5).alias("requested_k"), F.count(F.lit(1)).alias("evaluated"), F.count_if(F.col("value") <= 100).alias("filtered"), F.count_if(F.col("value") > 100).alias("left"))
    return x.select("query_id", "requested_k", "evaluated", "filtered", F.least("left", F.lit(5)).alias("returned"))


@query("""WITH p AS (SELECT lang AS series, doc_id + 1 AS x, max(strlen(text)) AS bytes FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY ALL)
SELECT series, x, round((bytes - lag(bytes) OVER w) / (x - lag(x) OVER w), 6) AS step FROM p WINDOW w AS (PARTITION BY series ORDER BY x) QUALIFY step IS NOT NULL""")
def growth_series(spark, d):
    points = table(spark, d, "documents").filter("lang IS NOT NULL AND text IS NOT NULL").groupBy(F.col("lang").alias("series"), (F.col("doc_id") + 1).alias("x")).agg(F.max(F.octet_length("text")).alias("bytes"))
    return E.growth_steps(points).select("series", "x", F.round("step", 6).alias("step"))


@query("SELECT l_orderkey AS from_node, l_returnflag AS edge_type, l_linenumber AS edge_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, CASE WHEN l_linenumber % 3 <> 0 THEN 10 - l_linenumber END NULLS FIRST, l_linenumber)::INT AS place FROM lineitem")
def ordered_edges(spark, d):
    n = F.col("l_linenumber")
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("from_node"), F.col("l_returnflag").alias("edge_type"), n.alias("edge_id"), F.when(n % 3 != 0, 10 - n).alias("ordinal"))
    return E.ordered_edges(x).drop("ordinal")


@query("SELECT conv_id, substr('Conversation ' || conv_id || '. ' || string_agg(CASE WHEN text LIKE '%.' THEN text ELSE text || '.' END, ' ' ORDER BY turn), 1, 300) AS summary FROM (SELECT conv_id, turn, min(coalesce(text, '')) AS text FROM conversations GROUP BY ALL) GROUP BY conv_id")
def report_summaries(spark, d):
    x = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    x = x.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("c"))
    return x.select("conv_id", C.report_summary(F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")), F.col("c.text"), 300).alias("summary"))


#: Four pieces of evidence that every answer may cite.
PIECES = [("E1", "text", "p. 1", None), ("E2", "generated", "p. 2", "img-7"), ("E3", "footnote", "p. 3", None), ("E2", "ocr", "p. 4", None)]


@query(r"""WITH a AS (SELECT DISTINCT conv_id, turn, role || ' says so [E' || (turn % 4 + 1) || '] and [E3, x]' AS answer, 'E' || (turn % 4 + 1) AS one FROM conversations WHERE role IS NOT NULL)
SELECT conv_id, turn, answer || chr(10) || chr(10) || 'References:' || chr(10) || CASE WHEN one = 'E1' THEN '[E1] original_text: p. 1' || chr(10) ELSE '' END || CASE WHEN one = 'E2' THEN '[E2] image_caption_generated: p. 2; derived from img-7' || chr(10) ELSE '' END || '[E3] footnote: p. 3' || chr(10) AS rendered FROM a""")
def rendered_citations(spark, d):
    """Each answer with the references that it cites, labels once."""
    x = table(spark, d, "conversations").filter("role IS NOT NULL").select("conv_id", "turn", F.concat("role", F.lit(" says so [E"), (F.col("turn") % 4 + 1).cast("string"), F.lit("] and [E3, x]")).alias("answer")).distinct()
    pieces = F.array(*(F.struct(F.lit(a).alias("label"), F.lit(b).alias("kind"), F.lit(c).alias("locator"), F.lit(e).cast("string").alias("derived_from")) for a, b, c, e in PIECES))
    return x.select("conv_id", "turn", C.references_block(F.col("answer"), C.cited_only(F.col("answer"), pieces)).alias("rendered"))


@query("""WITH e AS (SELECT event_id, ['text', 'verse', 'footnote', 'ocr', 'image', 'generated'][(event_id % 6 + 1)::INT] AS kind, event_id % 4 = 1 AS derived, event_id % 10 = 0 AS report FROM events)
SELECT event_id, CASE kind WHEN 'text' THEN 'original_text' WHEN 'verse' THEN 'verse' WHEN 'footnote' THEN 'footnote' WHEN 'ocr' THEN 'ocr_text' WHEN 'image' THEN 'image_artifact' ELSE CASE WHEN derived THEN 'image_caption_generated' ELSE 'generated' END END AS citation,
  CASE WHEN report THEN 'graph_report' WHEN kind IN ('text', 'verse', 'footnote') THEN 'original_text' WHEN kind = 'ocr' THEN 'ocr_text' WHEN kind = 'image' THEN 'image_artifact' WHEN derived THEN 'image_caption_generated' ELSE 'generated' END AS role FROM e""")
def evidence_kinds(spark, d):
    n = F.col("event_id")
    kind = F.array(*map(F.lit, ["text", "verse", "footnote", "ocr", "image", "generated"]))[(n % 6).cast("int")]
    derived, origin = F.when(n % 4 == 1, "e"), F.when(n % 10 == 0, "graph_report").otherwise("dense")
    return table(spark, d, "events").select("event_id", C.citation_kind(kind, derived).alias("citation"), C.evidence_role(origin, kind, derived).alias("role"))


@query("""WITH v AS (SELECT p_partkey, list_concat(string_split(p_name, ' '), CASE WHEN p_size % 2 = 0 THEN [p_size::VARCHAR, p_type] ELSE [] END) AS v FROM part)
SELECT p_partkey, lower(replace(array_to_string(v, ':'), ' ', '')) AS normalised, CASE WHEN len(v) >= 3 THEN v[1] || ' ' || v[2] || ':' || array_to_string(v[3:], ':') ELSE array_to_string(v, ' ') END AS rendered FROM v""")
def reference_forms(spark, d):
    more = F.when(F.col("p_size") % 2 == 0, F.array(F.col("p_size").cast("string"), "p_type")).otherwise(F.array().cast("array<string>"))
    x = table(spark, d, "part").select("p_partkey", F.concat(F.split("p_name", " "), more).alias("v"))
    return x.select("p_partkey", C.normalised_reference(F.col("v")).alias("normalised"), C.rendered_reference(F.col("v")).alias("rendered"))


@query("""SELECT p_partkey, 'Instruct: Find parts' || chr(10) || 'Query: ' || p_name AS asked, 'Represent: ' || chr(10) || CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand || ': ' END || p_name AS embedded, to_json(string_split(p_name, ' '))::VARCHAR AS headings FROM part""")
def prepared_inputs(spark, d):
    """Query and document templates, and headings as a JSON array."""
    head = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", C.prepared_query(F.col("p_name"), "Find parts").alias("asked"), C.prepared_document(F.col("p_name"), head, "Represent: ").alias("embedded"), F.to_json(F.split("p_name", " ")).alias("headings"))


@query("""WITH v AS (SELECT event_id, [' Feature', 'COMPONENT ', 'Depends On', 'conflicts-with', 'other', 'unheard of'][(event_id % 6 + 1)::INT] AS value FROM events), n AS (SELECT event_id, replace(replace(lower(trim(value)), ' ', '_'), '-', '_') AS v FROM v)
SELECT event_id, CASE WHEN v IN ('feature', 'component', 'concept', 'file', 'function', 'issue', 'other') THEN v END AS entity, CASE WHEN v IN ('depends_on', 'implements', 'mentions', 'conflicts_with', 'supports', 'other') THEN v END AS relationship FROM n""")
def closed_types(spark, d):
    value = F.array(*map(F.lit, [" Feature", "COMPONENT ", "Depends On", "conflicts-with", "other", "unheard of"]))[(F.col("event_id") % 6).cast("int")]
    return table(spark, d, "events").select("event_id", C.closed_type(value, C.ENTITY_TYPES).alias("entity"), C.closed_type(value, C.RELATIONSHIP_TYPES).alias("relationship"))


@query("""WITH n AS (SELECT DISTINCT o_custkey AS node_id, l_partkey AS chunk_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey % 3 < 2)
SELECT chunk_id, array_to_string(list_sort(list(node_id)), ',') AS nodes FROM n WHERE chunk_id IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY 1""")
def nodes_of_chunks(spark, d):
    """Customers are entities, claims or sections; the parts that they have ordered are the chunks that they cite."""
    x = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("node_id")).agg(F.collect_list("l_partkey").alias("chunk_ids"))
    kind = F.array(F.lit("entity"), F.lit("claim"), F.lit("section"))[(F.col("node_id") % 3).cast("int")]
    out = E.nodes_of_chunks(x.withColumn("kind", kind), table(spark, d, "part").filter("p_size < 10").select(F.col("p_partkey").alias("chunk_id")))
    return out.select("chunk_id", F.array_join(F.transform("nodes", lambda n: n.cast("string")), ",").alias("nodes"))


@query("""WITH b AS (SELECT l_suppkey AS report_id, l_orderkey * 10 + l_linenumber AS ordinal, l_partkey AS chunk_id, l_orderkey AS evidence_id FROM lineitem),
m AS (SELECT DISTINCT l_partkey AS chunk_id, l_orderkey AS evidence_id FROM lineitem WHERE l_linenumber <> 2),
x AS (SELECT s_suppkey % 7 AS query_id, s_suppkey % 13 AS score, b.* FROM supplier JOIN b ON s_suppkey = report_id SEMI JOIN m USING (chunk_id, evidence_id) WHERE chunk_id % 3 = evidence_id % 3 AND chunk_id IN (SELECT p_partkey FROM part) AND evidence_id IN (SELECT o_orderkey FROM orders)),
f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY query_id, evidence_id ORDER BY score DESC, report_id, ordinal, chunk_id) = 1)
SELECT query_id, evidence_id, chunk_id, report_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, report_id, ordinal, evidence_id)::INT AS rank FROM f QUALIFY rank <= 20""")
def backing_evidence(spark, d):
    """Suppliers are reports found for seven queries, their order lines the evidence behind them."""
    line = table(spark, d, "lineitem")
    hits = table(spark, d, "supplier").select((F.col("s_suppkey") % 7).alias("query_id"), F.col("s_suppkey").alias("report_id"), (F.col("s_suppkey") % 13).alias("score"))
    backing = line.select(F.col("l_suppkey").alias("report_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.col("l_partkey").alias("chunk_id"), F.col("l_orderkey").alias("evidence_id"))
    chunks = table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), (F.col("p_partkey") % 3).alias("source_id"))
    evidence = table(spark, d, "orders").select(F.col("o_orderkey").alias("evidence_id"), (F.col("o_orderkey") % 3).alias("source_id"))
    members = line.filter("l_linenumber <> 2").select(F.col("l_partkey").alias("chunk_id"), F.col("l_orderkey").alias("evidence_id"))
    return E.backing_evidence(hits, backing, chunks, evidence, members, 20)


@query("""WITH r AS (SELECT CASE WHEN vec_id % 4 = 0 THEN 0 ELSE 9 * len(embedding) END AS j, CASE WHEN vec_id % 5 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN 4 * len(embedding) + 1 ELSE 4 * len(embedding) END AS b FROM embeddings)
SELECT CASE WHEN b > 0 AND b % 4 = 0 AND j > 0 THEN 'eligible' WHEN b > 0 AND b % 4 = 0 THEN 'already_clean' WHEN b > 0 THEN 'malformed_blob' WHEN j > 0 THEN 'json_only' ELSE 'missing_blob' END AS class, count(*) AS n FROM r GROUP BY 1""")
def vector_payload_classes(spark, d):
    n, v = F.size("embedding"), F.col("vec_id")
    x = table(spark, d, "embeddings").select(F.when(v % 4 != 0, 9 * n).alias("json_length"), F.when(v % 5 == 0, None).when(v % 7 == 0, 4 * n + 1).otherwise(4 * n).alias("blob_length"))
    return E.vector_payload_classes(x)


@query("SELECT source_id FROM (SELECT c_custkey AS source_id, c_custkey % 4 AS attempts, c_acctbal AS requested_at FROM customer) ORDER BY attempts, requested_at, source_id LIMIT 20")
def reconciliation_batch(spark, d):
    """Its limit is the batch."""
    x = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), (F.col("c_custkey") % 4).alias("attempts"), F.col("c_acctbal").alias("requested_at"))
    return E.reconciliation_batch(x, 20).select("source_id")


@query("""SELECT source_id, target FROM (SELECT c_custkey AS source_id, unnest(['sources', 'chunks', 'vectors', 'caches', 'backups']) AS target FROM customer)
EXCEPT SELECT o_custkey, CASE WHEN o_orderstatus = 'O' THEN 'chunks' ELSE 'vectors' END FROM orders""")
def erasure_plan(spark, d):
    done = table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.when(F.col("o_orderstatus") == "O", "chunks").otherwise("vectors").alias("target"))
    return E.erasure_plan(table(spark, d, "customer").select(F.col("c_custkey").alias("source_id")), ["sources", "chunks", "vectors", "caches", "backups"], done)


@query(r"""WITH c AS (SELECT doc_id AS claim_id, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE doc_id END AS evidence_id, CASE doc_id % 4 WHEN 0 THEN substr(text, 5, 20) WHEN 1 THEN replace(substr(text, 5, 20), ' ', '   ') WHEN 2 THEN '' ELSE 'not to be found' END AS quote FROM documents),
e AS (SELECT doc_id AS evidence_id, min(text) AS text FROM documents GROUP BY 1),
s AS (SELECT claim_id, CASE WHEN text IS NULL THEN 'unknown_evidence' WHEN coalesce(quote, '') = '' THEN 'not_provided' WHEN contains(text, quote) THEN 'match' WHEN contains(regexp_replace(lower(text), '\s+', ' ', 'g'), regexp_replace(lower(quote), '\s+', ' ', 'g')) THEN 'approximate' ELSE 'missing' END AS status FROM c LEFT JOIN e USING (evidence_id))
SELECT claim_id, status, status = 'match' AS publishable FROM s""")
def quotation_checks(spark, d):
    x, n = table(spark, d, "documents"), F.col("doc_id")
    part = F.substring("text", 5, 20)
    quote = F.when(n % 4 == 0, part).when(n % 4 == 1, F.replace(part, F.lit(" "), F.lit("   "))).when(n % 4 == 2, "").otherwise("not to be found")
    claims = x.select(n.alias("claim_id"), F.when(n % 7 == 0, -1).otherwise(n).alias("evidence_id"), quote.alias("quote"))
    return E.quotation_status(claims, x.groupBy(n.alias("evidence_id")).agg(F.min("text").alias("text")))


@query("SELECT event_id, field, origin FROM (SELECT event_id, event_type AS field, CASE WHEN event_id % 3 = 0 THEN 'hint_only' ELSE 'approved' END AS origin FROM events) WHERE origin <> 'hint_only'")
def approved_metadata(spark, d):
    x = table(spark, d, "events").select("event_id", F.col("event_type").alias("field"), F.when(F.col("event_id") % 3 == 0, "hint_only").otherwise("approved").alias("origin"))
    return x.filter("origin <> 'hint_only'")


@query("SELECT label AS profile, count(*) AS n FROM embeddings WHERE label <> 3 GROUP BY 1")
def profile_deletion(spark, d):
    """What is left of each profile's vectors after the data of one is deleted."""
    gone = spark.createDataFrame([(3,)], "label int")
    return table(spark, d, "embeddings").join(gone, "label", "left_anti").groupBy(F.col("label").alias("profile")).agg(F.count(F.lit(1)).alias("n"))
