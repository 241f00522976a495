"""Budgeted expansion, diversity collapse, and reports whose claims keep their evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import diversity, expansion, reports
from quillspark.plans.registry import query
from quillspark.plans.retrieval import BM25_K, bm25_sql, lexical_list
from quillspark.storage import table

PER_SEED, TOTAL, HOPS = 6, 30, 2
#: Ranks that the SQL goes through: more than any order has different parts (17 at sf0.1).
SEEDS = 20
TYPES = ["next", "previous", "same_source"]


def _expansion_sql() -> str:
    """The steps one after the other, without a limit on a node's neighbours."""
    ctes = [
        """l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, -l_suppkey AS s FROM lineitem)""",
        """g AS (SELECT a.p AS a, b.p AS b, 'next' AS t, a.o AS i FROM l a JOIN l b ON a.o = b.o AND a.n + 1 = b.n UNION ALL SELECT b.p, a.p, 'previous', a.o FROM l a JOIN l b ON a.o = b.o AND a.n + 1 = b.n
  UNION ALL SELECT p, s, 'same_source', 0 FROM l UNION ALL SELECT s, p, 'same_source', 0 FROM l UNION ALL SELECT p, p + 1, 'link', 0 FROM l)""",
        """e AS MATERIALIZED (SELECT a AS node, b AS nxt, row_number() OVER (PARTITION BY a ORDER BY f, b) AS turn FROM (SELECT a, b, min({'t': t, 'i': i}) AS f FROM g WHERE a > 0 AND b > 0 AND t <> 'link' GROUP BY ALL))""",
        """s AS MATERIALIZED (SELECT query_id, node, 1.0::DOUBLE / (60 + r) AS score, row_number() OVER (PARTITION BY query_id ORDER BY r, node) AS rank FROM (SELECT o AS query_id, p AS node, min(n) AS r FROM l GROUP BY ALL))""",
        "n0 AS (SELECT query_id, node AS seed, node, score, 0 AS hop, rank, 0 AS t FROM s WHERE false)",
        "v0 AS (SELECT query_id, node FROM s)",
    ]
    k = 0
    for r in range(1, SEEDS + 1):
        ctes.append(f"f{r}_0 AS (SELECT s.query_id, node AS seed, node, score, 1 AS t, least({PER_SEED}, {TOTAL} - coalesce(c, 0)) AS room FROM s LEFT JOIN (SELECT query_id, count(*) AS c FROM n{k} GROUP BY 1) USING (query_id) WHERE rank = {r})")
        for h in range(1, HOPS + 1):
            ctes.append(f"""x{r}_{h} AS MATERIALIZED (SELECT query_id, seed, node, score, room, row_number() OVER (PARTITION BY query_id ORDER BY f, node) AS t FROM (
  SELECT query_id, nxt AS node, any_value(seed) AS seed, any_value(score) AS score, any_value(room) AS room, min({{'a': t, 'b': turn}}) AS f FROM f{r}_{h - 1} JOIN e USING (node)
  WHERE room > 0 AND (query_id, nxt) NOT IN (SELECT (query_id, node) FROM v{k}) GROUP BY ALL) QUALIFY t <= room)""")
            ctes.append(f"f{r}_{h} AS (SELECT query_id, seed, node, score, t, room - count(*) OVER (PARTITION BY query_id) AS room FROM x{r}_{h})")
            ctes.append(f"n{k + 1} AS MATERIALIZED (SELECT * FROM n{k} UNION ALL SELECT query_id, seed, node, score, {h}, {r}, t FROM x{r}_{h})")
            ctes.append(f"v{k + 1} AS MATERIALIZED (SELECT * FROM v{k} UNION ALL SELECT query_id, node FROM x{r}_{h})")
            k += 1
    return f"WITH {', '.join(ctes)} SELECT query_id, seed, node, hop, round(score * power(0.5, hop), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rank, hop, t) AS place FROM n{k}"


@query(_expansion_sql())
def budgeted_expansion(spark, d):
    """Parts reached from the parts of every order: along orders' lines, never through a supplier, six a seed and thirty in all."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (-F.col("l_suppkey")).alias("supplier"))
    b = x.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("after"))
    pair = x.join(b, ["l_orderkey", "l_linenumber"])
    edge = lambda t, a, b, kind, ordinal: t.select(F.col(a).alias("from_node"), b.alias("to_node"), F.lit(kind).alias("edge_type"), ordinal.cast("long").alias("ordinal"))
    key, none = F.col("l_orderkey"), F.lit(0)
    e = edge(pair, "l_partkey", F.col("after"), "next", key).unionByName(edge(pair, "after", F.col("l_partkey"), "previous", key))
    e = e.unionByName(edge(x, "l_partkey", F.col("supplier"), "same_source", none)).unionByName(edge(x, "supplier", F.col("l_partkey"), "same_source", none)).unionByName(edge(x, "l_partkey", F.col("l_partkey") + 1, "link", none))
    seeds = x.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("node"))
    # a seed's score follows its rank after repeats are gone
    seeds = seeds.groupBy("query_id", "node").agg(F.min("rank").alias("rank")).withColumn("score", 1.0 / (60 + F.col("rank")))
    return expansion.expanded(seeds, e, PER_SEED, TOTAL, HOPS, TYPES, x.select(F.col("supplier").alias("node")).distinct())


MOST = {"thread": 12, "source": 5}

_IDENTITIES = [
    ("exact_duplicate", "md5(text)", "md5(text)", "true"),
    ("near_duplicate", "concat(source, '/', cast(n_chars div 40 as string))", "source || '/' || (n_chars // 40)", "true"),
    ("overlap", "md5(lower(split_part(text, '\\n', 1)))", "md5(lower(split_part(text, chr(10), 1)))", "doc_id % 2 = 0"),
    ("parent_child", "cast(doc_id div 4 as string)", "(doc_id // 4)::VARCHAR", "doc_id % 3 = 0"),
    ("mirror", "cast(doc_id div 22 as string)", "(doc_id // 22)::VARCHAR", "doc_id % 11 = 0"),
    ("version", "cast(doc_id div 26 as string)", "(doc_id // 26)::VARCHAR", "doc_id % 13 = 0"),
    ("thread", "lang", "lang", "true"),
    ("source", "source", "source", "true"),
]


def _collapse_sql() -> str:
    ids = " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, {sql} AS value FROM documents WHERE {where}" for kind, _, sql, where in _IDENTITIES)
    order = "list_position([" + ", ".join(f"'{k}'" for k in diversity.MERGING) + "], kind)"
    steps, last = [], "x0"
    for i, kind in enumerate(diversity.QUOTAS, 1):
        steps.append(f"""o{i} AS (SELECT query_id, hit_id, first_value(hit_id) OVER w AS head, row_number() OVER w AS turn FROM {last} JOIN ids ON ids.query_id = {last}.query_id AND ids.doc_id = hit_id AND kind = '{kind}' WHERE reason IS NULL WINDOW w AS (PARTITION BY {last}.query_id, value ORDER BY strength, rank, hit_id)),
x{i} AS (SELECT x.query_id, x.hit_id, x.rank, strength, coalesce(head, representative) AS representative, CASE WHEN head IS NOT NULL THEN '{kind}_quota' ELSE reason END AS reason FROM {last} x LEFT JOIN (SELECT * FROM o{i} WHERE turn > {MOST[kind]}) o ON o.query_id = x.query_id AND o.hit_id = x.hit_id)""")
        last = f"x{i}"
    steps = [s.replace("SELECT query_id, hit_id, first_value", f"SELECT {'x0' if i == 0 else f'x{i}'}.query_id, hit_id, first_value") for i, s in enumerate(steps)]
    return f"""WITH RECURSIVE {bm25_sql('b')}, h AS (SELECT query_id, chunk_id AS hit_id, rank, (chunk_id % 3)::INT AS strength, chunk_id % 5 = 0 AS protected FROM b),
i AS ({ids}), ids AS MATERIALIZED (SELECT h.query_id, i.* , h.protected FROM i JOIN h ON h.hit_id = i.doc_id WHERE trim(value) <> ''),
m AS MATERIALIZED (SELECT DISTINCT query_id, doc_id, kind, value FROM ids WHERE kind NOT IN ('thread', 'source') AND NOT (kind = 'near_duplicate' AND protected)),
p AS MATERIALIZED (SELECT DISTINCT a.query_id, a.doc_id AS x, b.doc_id AS y FROM m a JOIN m b USING (query_id, kind, value)),
reach(query_id, x, y) AS (SELECT query_id, hit_id, hit_id FROM h UNION SELECT r.query_id, r.x, p.y FROM reach r JOIN p ON p.query_id = r.query_id AND p.x = r.y),
c AS (SELECT query_id, x AS hit_id, arg_min(h.hit_id, {{'s': h.strength, 'r': h.rank}}) AS representative FROM reach r JOIN h ON h.query_id = r.query_id AND h.hit_id = r.y GROUP BY ALL),
k AS (SELECT query_id, doc_id AS hit_id, arg_min(kind, {order}) AS kind FROM m WHERE (query_id, kind, value) IN (SELECT (query_id, kind, value) FROM m GROUP BY query_id, kind, value HAVING count(*) > 1) GROUP BY ALL),
x0 AS (SELECT h.query_id, h.hit_id, h.rank, h.strength, representative, CASE WHEN h.hit_id <> representative THEN k.kind END AS reason FROM h JOIN c USING (query_id, hit_id) LEFT JOIN k USING (query_id, hit_id)),
{', '.join(steps)}
SELECT query_id, hit_id, rank, representative, reason, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY query_id, reason IS NULL ORDER BY rank, hit_id) END AS place FROM {last}"""


@query(_collapse_sql().replace("SELECT query_id, x AS hit_id", "SELECT r.query_id, r.x AS hit_id"))
def diversity_collapse(spark, d):
    """The lexical hits of every question, collapsed by all eight kinds of identity."""
    hits = lexical_list(spark, d, BM25_K).select("query_id", F.col("chunk_id").alias("hit_id"), "rank")
    hits = hits.withColumns({"strength": (F.col("hit_id") % 3).cast("int"), "protected": F.col("hit_id") % 5 == 0})
    docs, ids = table(spark, d, "documents"), None
    for kind, value, _, where in _IDENTITIES:
        one = docs.filter(where).select("doc_id", F.lit(kind).alias("kind"), F.expr(value).alias("value"))
        ids = one if ids is None else ids.unionByName(one)
    ids = hits.join(ids, hits["hit_id"] == ids["doc_id"]).select("query_id", "hit_id", "kind", "value")
    return diversity.collapsed(hits, ids, MOST)


MOST_CLAIMS, MOST_EVIDENCE = 60, 200

_REPORTS_SQL = f"""WITH k AS (SELECT c_nationkey AS community, o_orderkey AS claim_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderpriority || ' ' || o_custkey, o_orderkey) AS place FROM orders JOIN customer ON c_custkey = o_custkey QUALIFY place <= {MOST_CLAIMS}),
m AS (SELECT p_partkey AS chunk_id, p_partkey // 30 AS chunk_source, i AS unit, (p_partkey * 2 + i) // 3 AS evidence_id FROM part, (VALUES (0), (1)) u(i)),
v AS (SELECT DISTINCT evidence_id, (evidence_id * 3 // 2) // 30 AS evidence_source FROM m WHERE evidence_id % 41 <> 0),
c AS (SELECT community, claim_id, place, l_linenumber AS ordinal, l_partkey AS chunk_id, unit, evidence_id, coalesce(chunk_source = evidence_source, false) AS there FROM k JOIN lineitem ON l_orderkey = claim_id LEFT JOIN m ON m.chunk_id = l_partkey LEFT JOIN v USING (evidence_id)),
u AS (SELECT community, evidence_id, min({{'p': place, 'o': ordinal, 'c': chunk_id, 'u': unit}}) AS spot FROM c WHERE there GROUP BY ALL),
t AS (SELECT community, evidence_id, spot.c AS chunk_id, row_number() OVER (PARTITION BY community ORDER BY spot, evidence_id)::INT AS turn FROM u QUALIFY turn <= {MOST_EVIDENCE})"""


def _report_evidence(spark, d):
    claims = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("community"), F.col("o_orderkey").alias("claim_id"), F.concat("o_orderpriority", F.lit(" "), "o_custkey").alias("text"))
    spans = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("chunk_id"))
    members = table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.expr("p_partkey div 30").alias("source_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal")).withColumn("evidence_id", F.expr("(chunk_id * 2 + ordinal) div 3"))
    evidence = members.filter("evidence_id % 41 <> 0").select("evidence_id", F.expr("(evidence_id * 3 div 2) div 30").alias("source_id")).distinct()
    return reports.report_evidence(claims, spans, members, evidence, MOST_CLAIMS, MOST_EVIDENCE)


@query(f"""{_REPORTS_SQL} SELECT community, claim_id, place::INT AS place, count(DISTINCT evidence_id) AS n_evidence FROM c LEFT JOIN t USING (community, evidence_id) GROUP BY ALL HAVING bool_and(there AND turn IS NOT NULL)""")
def claims_with_evidence(spark, d):
    """Orders as claims of their nation: those whose every cited unit is there, agrees and fits."""
    return _report_evidence(spark, d)[0]


@query(f"{_REPORTS_SQL} SELECT community, evidence_id, chunk_id, turn FROM t")
def report_evidence_union(spark, d):
    return _report_evidence(spark, d)[1]
