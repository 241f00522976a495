"""Whole provenance checks, support of claims, proofs of erasure, sources that have moved, packs of evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.text import upper_letters
from quillspark.operators import catalog, erasure, ingest, packs
from quillspark.operators import evidence as E
from quillspark.plans.registry import query
from quillspark.storage import table

_TEXTS = "d AS (SELECT doc_id, min(text) AS text, min(source) AS source, min(lang) AS lang FROM documents WHERE text IS NOT NULL GROUP BY 1)"


def _texts(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("source").alias("source"), F.min("lang").alias("lang"))


@query(f"""WITH {_TEXTS}, s AS (SELECT *, strlen(text) AS size, doc_id % 8 AS kind FROM d)
SELECT CASE WHEN kind = 1 THEN -doc_id ELSE doc_id END AS chunk_id, CASE WHEN kind = 2 THEN -doc_id ELSE doc_id END AS evidence_id,
  CASE kind WHEN 1 THEN 'missing_chunk' WHEN 2 THEN 'missing_evidence' WHEN 3 THEN 'bytes' WHEN 4 THEN 'hash' WHEN 5 THEN 'locator' WHEN 6 THEN 'trust' END AS reason
FROM s WHERE (kind IN (1, 2) AND doc_id <> 0) OR kind IN (3, 4) OR (kind = 5 AND source IS NOT NULL) OR kind = 6""")
def span_provenance(spark, d):
    """Spans over whole texts with all that is checked of them; of every eight two hold, and one has each fault: a chunk or
    an evidence that is not there, an end past the text, a changed digest, another locator, the wrong trust."""
    x, n = _texts(spark, d), F.col("doc_id")
    kind, size = n % 8, F.octet_length("text")
    chunks = x.select(n.alias("chunk_id"), "text")
    derived = F.when(F.coalesce(F.col("lang") == "en", F.lit(False)), n)
    evidence = x.select(n.alias("evidence_id"), "text", F.col("source").alias("locator"), derived.alias("derived_from"))
    right = F.when(derived.isNull(), "direct").otherwise("derived")
    spans = x.select(
        F.when(kind == 1, -n).otherwise(n).alias("chunk_id"), F.when(kind == 2, -n).otherwise(n).alias("evidence_id"),
        F.lit(0).alias("chunk_start"), size.alias("chunk_end"), F.lit(0).alias("evidence_start"), (size + (kind == 3).cast("int")).alias("evidence_end"),
        F.sha2(F.when(kind == 4, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("evidence_text_hash"),
        F.when(kind == 5, F.concat("source", F.lit("#2"))).otherwise(F.col("source")).alias("locator"),
        F.when(kind == 6, F.when(right == "direct", "derived").otherwise("direct")).otherwise(right).alias("trust"))
    return ingest.span_faults(spans, chunks, evidence)


@query(f"""WITH {_TEXTS}, b AS (SELECT doc_id // 3 AS claim_id, CASE WHEN doc_id % 11 = 0 THEN -1 ELSE doc_id END AS evidence_id, CASE WHEN doc_id % 13 = 0 THEN 'against' ELSE 'for' END AS stance,
  CASE WHEN doc_id // 3 % 10 = 4 THEN 'not to be found' ELSE CASE doc_id % 5 WHEN 0 THEN substr(text, 5, 20) WHEN 1 THEN upper(substr(text, 5, 20)) WHEN 2 THEN '' WHEN 3 THEN 'not to be found' ELSE substr(text, 1, 9) END END AS quote FROM d),
s AS (SELECT claim_id, stance, CASE WHEN text IS NULL THEN 'unknown_evidence' WHEN coalesce(quote, '') = '' THEN 'not_provided' WHEN contains(text, quote) THEN 'match'
  WHEN contains(regexp_replace(lower(text), '\\s+', ' ', 'g'), regexp_replace(lower(quote), '\\s+', ' ', 'g')) THEN 'approximate' ELSE 'missing' END AS status FROM b LEFT JOIN d ON doc_id = evidence_id),
c AS (SELECT DISTINCT doc_id // 3 AS claim_id, doc_id // 3 % 7 AS pack_id, doc_id // 21 % 50 AS subject, doc_id // 1050 % 3 AS value, doc_id // 3 % 9 <> 0 AS factual FROM d),
n AS (SELECT c.*, count(CASE WHEN stance = 'for' THEN 1 END) AS bindings, count(CASE WHEN stance = 'for' AND status IN ('match', 'not_provided') THEN 1 END) AS holding,
  count(CASE WHEN stance = 'for' AND status = 'approximate' THEN 1 END) AS close, count(CASE WHEN stance = 'against' AND status = 'match' THEN 1 END) AS denied FROM c LEFT JOIN s USING (claim_id) GROUP BY ALL),
r AS (SELECT claim_id, bindings, holding, CASE WHEN NOT factual THEN 'non_factual' WHEN denied > 0 OR (holding > 0 AND EXISTS (SELECT 1 FROM n o WHERE o.factual AND o.holding > 0 AND o.pack_id = n.pack_id AND o.subject = n.subject AND o.value <> n.value)) THEN 'conflict'
  WHEN bindings > 0 AND holding = bindings THEN 'supported' WHEN holding + close > 0 THEN 'partial' ELSE 'unsupported' END AS support FROM n)
SELECT claim_id, support, bindings, holding, support = 'supported' AS publishable FROM r""")
def claim_support(spark, d):
    """Three documents back a claim, each with a quotation that is exact, of other case, absent, invented or short; of every ten claims one has invented ones alone."""
    x, n = _texts(spark, d), F.col("doc_id")
    part = F.substring("text", 5, 20)
    quote = F.when(n % 5 == 0, part).when(n % 5 == 1, upper_letters(part)).when(n % 5 == 2, "").when(n % 5 == 3, "not to be found").otherwise(F.substring("text", 1, 9))
    claim = F.floor(n / 3)
    quote = F.when(claim % 10 == 4, "not to be found").otherwise(quote)
    bindings = x.select(claim.alias("claim_id"), F.when(n % 11 == 0, -1).otherwise(n).alias("evidence_id"), F.when(n % 13 == 0, "against").otherwise("for").alias("stance"), quote.alias("quote"))
    claims = x.select(claim.alias("claim_id"), (claim % 7).alias("pack_id"), (F.floor(n / 21) % 50).alias("subject"), (F.floor(n / 1050) % 3).alias("value"), (claim % 9 != 0).alias("factual")).distinct()
    return E.claim_support(claims, bindings, x.select(n.alias("evidence_id"), "text"))


#: Plans are nations, their sources customers. Of each plan some customers wait for the replica, as dead letters say; plan 3
#: lacks local acknowledgements, plan 5 has some too early, plan 7 a letter about files, plan 9 no letters, plan 11 strangers.
_ERASURE = f"""t AS (SELECT unnest({list(erasure.TARGETS)}) AS target, unnest({list(erasure.TARGETS.values())}) AS phase),
s AS (SELECT c_nationkey AS plan_id, c_custkey AS source_id FROM customer),
a AS (SELECT plan_id, source_id, target, phase, CASE WHEN plan_id = 5 AND target = 'caches' THEN 500 ELSE phase * 1000 + source_id % 1000 END AS acked FROM s, t
  WHERE NOT (plan_id = 3 AND target = 'vectors' AND source_id % 2 = 0) AND NOT (target = 'replica' AND source_id % 4 = 0)),
w AS (SELECT plan_id, -source_id AS source_id FROM s WHERE plan_id = 11),
l AS (SELECT plan_id, source_id, 'replica' AS target, 3 AS phase FROM s WHERE source_id % 4 = 0 AND plan_id <> 9 UNION ALL SELECT plan_id, source_id, 'files', 1 FROM s WHERE plan_id = 7),
p AS (SELECT s.plan_id, s.source_id, t.target, t.phase FROM s, t WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.plan_id = s.plan_id AND a.source_id = s.source_id AND a.target = t.target)),
m AS (SELECT plan_id, phase, min(acked) AS lo, max(acked) AS hi FROM a GROUP BY ALL),
f AS (SELECT plan_id, 'out_of_scope' AS fault, count(*) AS n FROM w GROUP BY 1 UNION ALL SELECT plan_id, 'coverage', count(*) FROM p WHERE phase < 3 GROUP BY 1
  UNION ALL SELECT plan_id, 'order', count(*) FROM m WHERE lo < (SELECT max(o.hi) FROM m o WHERE o.plan_id = m.plan_id AND o.phase < m.phase) GROUP BY 1
  UNION ALL SELECT plan_id, 'local_letter', count(*) FROM l WHERE phase < 3 GROUP BY 1
  UNION ALL SELECT plan_id, 'mismatch', count(*) FROM ((SELECT plan_id, source_id FROM p WHERE phase = 3 EXCEPT SELECT plan_id, source_id FROM l WHERE phase = 3) UNION ALL (SELECT plan_id, source_id FROM l WHERE phase = 3 EXCEPT SELECT plan_id, source_id FROM p WHERE phase = 3)) GROUP BY 1)"""


def _erasure(spark, d):
    s = table(spark, d, "customer").select(F.col("c_nationkey").alias("plan_id"), F.col("c_custkey").alias("source_id"))
    targets = F.create_map(*(F.lit(x) for pair in erasure.TARGETS.items() for x in pair))
    a = s.select("*", F.explode(targets).alias("target", "phase")).filter("NOT (plan_id = 3 AND target = 'vectors' AND source_id % 2 = 0) AND NOT (target = 'replica' AND source_id % 4 = 0)")
    a = a.select("plan_id", "source_id", "target", F.when((F.col("plan_id") == 5) & (F.col("target") == "caches"), 500).otherwise(F.col("phase") * 1000 + F.col("source_id") % 1000).alias("at"))
    strangers = s.filter("plan_id = 11").select("plan_id", (-F.col("source_id")).alias("source_id"), F.lit("catalog").alias("target"), F.lit(0).cast("long").alias("at"))
    letters = s.filter("source_id % 4 = 0 AND plan_id <> 9").withColumn("target", F.lit("replica")).unionByName(s.filter("plan_id = 7").withColumn("target", F.lit("files")))
    return s, a.unionByName(strangers), letters


@query(f"WITH {_ERASURE} SELECT * FROM f")
def erasure_faults(spark, d):
    return erasure.erasure_faults(*_erasure(spark, d))


@query(f"""WITH {_ERASURE}, g AS (SELECT plan_id, substr(sha256(source_id::VARCHAR), 1, 3) AS part, count(*) AS n, sha256(string_agg(strlen(source_id::VARCHAR) || ':' || source_id::VARCHAR, '' ORDER BY source_id::VARCHAR)) AS h FROM s GROUP BY ALL),
c AS (SELECT plan_id, sum(n)::BIGINT AS sources, sha256(string_agg(part || h, '' ORDER BY part)) AS commitment FROM g GROUP BY 1),
x AS (SELECT plan_id, target, sources, commitment, (SELECT count(*) FROM p WHERE p.plan_id = c.plan_id AND p.target = t.target) AS pending FROM c, t WHERE plan_id NOT IN (SELECT plan_id FROM f))
SELECT *, CASE WHEN pending > 0 THEN 'pending_remote' ELSE 'confirmed' END AS outcome FROM x""")
def erasure_proofs(spark, d):
    return erasure.erasure_proofs(*_erasure(spark, d))


#: Of every ten documents three have moved, one under another extension; copies make targets ambiguous or contested.
_MOVED = "CASE WHEN doc_id % 10 < 2 THEN 'moved/' || doc_id || '.MD' WHEN doc_id % 10 = 2 THEN 'moved/' || doc_id || '.pdf' ELSE 'home/' || doc_id || '.md' END"


@query(f"""WITH {_TEXTS}, s AS (SELECT doc_id AS source_id, 'home/' || doc_id || '.md' AS path, sha256(text) AS hash FROM d),
f AS (SELECT {_MOVED} AS path, sha256(text) AS hash FROM d WHERE doc_id % 20 <> 1), u AS (SELECT * FROM f WHERE path NOT IN (SELECT path FROM s)), g AS (SELECT * FROM s WHERE path NOT IN (SELECT path FROM f)),
m AS (SELECT source_id, u.path AS target FROM g JOIN u USING (hash) WHERE lower(u.path) LIKE '%.md'), n AS (SELECT source_id, count(*) AS n, min(target) AS target FROM m GROUP BY 1),
r AS (SELECT g.source_id, n, n.target, (SELECT count(*) FROM n o WHERE o.n = 1 AND o.target = n.target) AS rivals, EXISTS (SELECT 1 FROM u WHERE u.hash = g.hash) AS known FROM g LEFT JOIN n USING (source_id)),
o AS (SELECT *, CASE WHEN n = 1 AND rivals = 1 THEN 'relocated' WHEN n = 1 THEN 'contested' WHEN n > 1 THEN 'ambiguous' WHEN known THEN 'unsupported' ELSE 'no_target' END AS outcome FROM r)
SELECT source_id, outcome, CASE WHEN outcome = 'relocated' THEN target END AS new_path FROM o""")
def source_relocations(spark, d):
    x = _texts(spark, d).select("doc_id", F.sha2("text", 256).alias("hash"))
    sources = x.select(F.col("doc_id").alias("source_id"), F.expr("'home/' || doc_id || '.md'").alias("path"), "hash", F.lit("markdown").alias("parser"))
    files = x.filter("doc_id % 20 <> 1").select(F.expr(_MOVED).alias("path"), "hash")
    return catalog.relocations(sources, files, {"markdown": ["md", "markdown"], "plaintext": ["txt"]})


#: Results are an order's lines, evidence of a part up to four, which neighbours share; of even parts one is selected.
_PACKS = """r AS (SELECT l_orderkey AS query_id, l_partkey AS chunk_id, l_linenumber AS rank, CASE WHEN l_suppkey % 10 = 0 THEN 'graph_report' ELSE 'search' END AS origin, CASE WHEN l_suppkey % 3 = 0 THEN l_partkey + 1 END AS seed_chunk_id FROM (SELECT l_orderkey, l_partkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL)),
e AS (SELECT p_partkey AS chunk_id, o AS ordinal, p_partkey + o AS evidence_id, CASE (p_partkey + o) % 5 WHEN 0 THEN 'Image' WHEN 1 THEN 'Verse' ELSE 'Text' END AS kind, p_partkey % 3 <> 0 AS canonical FROM (SELECT p_partkey, unnest(range(0, p_size % 4 + 1)) AS o FROM part)),
s AS (SELECT query_id, chunk_id, chunk_id + 1 AS chosen FROM (SELECT DISTINCT query_id, chunk_id FROM r) WHERE chunk_id % 2 = 0),
j AS (SELECT query_id, rank, r.chunk_id, ordinal, evidence_id, kind, origin, chosen, count(*) OVER w > 1 AND bool_and(canonical) OVER w AS one, first_value(evidence_id) OVER (w ORDER BY ordinal) AS head, max(CASE WHEN evidence_id = chosen THEN chosen END) OVER w AS pick
  FROM r JOIN e USING (chunk_id) LEFT JOIN s USING (query_id, chunk_id) WINDOW w AS (PARTITION BY query_id, rank, r.chunk_id))"""


def _packed_sql(entries: str) -> str:
    role = "CASE WHEN origin = 'graph_report' THEN 'graph_report' WHEN kind = 'Image' THEN 'image_artifact' ELSE 'original_text' END"
    return f"""u AS (SELECT * FROM {entries} QUALIFY row_number() OVER (PARTITION BY query_id, shown ORDER BY rank, chunk_id, ordinal) = 1)
SELECT query_id, 'E' || row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id, ordinal) AS label, rank, chunk_id, shown AS evidence_id, {role} AS role FROM u"""


def _pack_tables(spark, d):
    line = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"))
    part = table(spark, d, "part")
    n = F.col("l_suppkey")
    results = line.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("chunk_id"), F.col("l_linenumber").alias("rank"), F.lit(1.0).alias("score"), F.when(n % 10 == 0, "graph_report").otherwise("search").alias("origin"), F.when(n % 3 == 0, F.col("l_partkey") + 1).alias("seed_chunk_id"))
    e = part.select(F.col("p_partkey").alias("chunk_id"), F.explode(F.sequence(F.lit(0), (F.col("p_size") % 4).cast("int"))).alias("ordinal"), (F.col("p_partkey") % 3 != 0).alias("canonical"))
    e = e.withColumn("evidence_id", F.col("chunk_id") + F.col("ordinal"))
    e = e.withColumn("kind", F.when(F.col("evidence_id") % 5 == 0, "Image").when(F.col("evidence_id") % 5 == 1, "Verse").otherwise("Text")).withColumn("derived_from", F.lit(None).cast("long"))
    selected = results.filter("chunk_id % 2 = 0").select("query_id", "chunk_id", (F.col("chunk_id") + 1).alias("evidence_id")).distinct()
    return results, e, selected


PACK = ["query_id", "label", "rank", "chunk_id", "evidence_id", "role"]


@query(f"WITH {_PACKS}, f AS (SELECT *, evidence_id AS shown FROM j WHERE chosen IS NULL OR chosen = evidence_id), {_packed_sql('f')}")
def final_evidence_pack(spark, d):
    return packs.final_pack(*_pack_tables(spark, d)).select(*PACK)


@query(f"""WITH {_PACKS}, h AS (SELECT * FROM j WHERE NOT one OR evidence_id = head), v AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, evidence_id ORDER BY rank, chunk_id, ordinal) = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id, ordinal) - 1 AS place FROM v), k AS (SELECT p.* REPLACE (coalesce(e.kind, p.kind) AS kind), coalesce(e.evidence_id, p.evidence_id) AS shown
  FROM p LEFT JOIN e ON one AND place BETWEEN 1 AND 4 AND e.chunk_id = p.chunk_id AND e.evidence_id = pick), {_packed_sql('k')}""")
def display_evidence_pack(spark, d):
    """The page shows the places 1 to 4 of each query."""
    return packs.display_pack(*_pack_tables(spark, d), 1, 5).select(*PACK)


@query(f"""WITH {_PACKS}, g AS (SELECT chunk_id FROM e GROUP BY 1 HAVING bool_and(kind IN ('Text', 'Image')))
SELECT query_id, chunk_id, seed_chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id)::INT AS rank FROM r
WHERE chunk_id IN (SELECT chunk_id FROM g) AND (seed_chunk_id IS NULL OR seed_chunk_id IN (SELECT chunk_id FROM g))""")
def bounded_results(spark, d):
    results, e, _ = _pack_tables(spark, d)
    return packs.bounded_results(results, e).select("query_id", "chunk_id", "seed_chunk_id", "rank")
