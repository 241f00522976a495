"""Structural edges, expansion, communities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import graph
from quillspark.plans.registry import norm_key_sql, query, terms_sql
from quillspark.storage import table


@query("""WITH n AS (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
SELECT 'next' AS edge_type, event_id AS from_node, nxt AS to_node FROM n WHERE nxt IS NOT NULL UNION ALL SELECT 'previous', nxt, event_id FROM n WHERE nxt IS NOT NULL""")
def seq_edges(spark, d):
    return graph.sequence_edges(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_id")


@query("""WITH x AS (SELECT DISTINCT conv_id || '/' || turn AS c, coalesce(CASE WHEN turn % 3 = 0 THEN NULL ELSE role END, 'conv ' || conv_id) AS p FROM conversations)
SELECT 'parent' AS edge_type, c AS from_node, p AS to_node FROM x UNION ALL SELECT 'child', p, c FROM x""")
def hierarchy_edges(spark, d):
    x = table(spark, d, "conversations").select(F.concat("conv_id", F.lit("/"), "turn").alias("c"), "conv_id", "turn", "role")
    return graph.hierarchy_edges(x, "c", F.coalesce(F.when(F.col("turn") % 3 != 0, F.col("role")), F.concat(F.lit("conv "), "conv_id")))


@query("""WITH p AS (SELECT p_brand AS source_id, string_split(p_type, ' ') AS h FROM part), e AS (SELECT source_id, h, unnest(range(1, len(h) + 1)) AS i FROM p)
SELECT source_id, array_to_string(h[1:i], ' / ') AS section, i::INT AS depth, count(*) AS units FROM e GROUP BY ALL""")
def section_prefix_nodes(spark, d):
    return graph.section_nodes(table(spark, d, "part").select(F.col("p_brand").alias("source_id"), F.split("p_type", " ").alias("heading_path")))


@query("SELECT a.p_brand AS section, a.p_partkey AS seed, b.p_partkey AS chunk_id FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey WHERE a.p_partkey % 100 = 0")
def section_siblings(spark, d):
    members = table(spark, d, "part").select(F.col("p_brand").alias("section"), F.col("p_partkey").alias("chunk_id"))
    return graph.siblings(members, members.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("seed")))


#: Parts on consecutive lines of an order are linked.
LINKS_SQL = """e AS (SELECT DISTINCT a.l_partkey AS from_node, b.l_partkey AS to_node FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber WHERE a.l_partkey <> b.l_partkey)"""


def links(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    b = x.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("to_node"))
    return x.join(b, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("from_node"), "to_node").filter("from_node <> to_node").distinct()


@query(f"""WITH RECURSIVE {LINKS_SQL},
h(seed, node, hop) AS (SELECT DISTINCT from_node, from_node, 0 FROM e WHERE from_node % 100 = 0 UNION SELECT seed, to_node, hop + 1 FROM h JOIN e ON node = from_node WHERE hop < 2)
SELECT seed, node, min(hop)::INT AS hop, round(power(0.5, greatest(min(hop), 1)) / (seed + 1), 6) AS score FROM h GROUP BY seed, node HAVING min(hop) > 0""")
def khop_expand(spark, d):
    e = links(spark, d)
    seeds = e.filter("from_node % 100 = 0").select(F.col("from_node").alias("seed")).distinct().withColumn("score", 1.0 / (F.col("seed") + 1))
    return graph.hops(e, seeds, 2)


@query("""WITH RECURSIVE n AS (SELECT event_id AS a, lead(event_id) OVER w AS b, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT a, b FROM n WHERE gap < 43200000000), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, seen) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a)
SELECT node, min(seen) AS community FROM r GROUP BY 1""")
def connected_components(spark, d):
    """Sessions: a user's events that follow within twelve hours are linked."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    x = table(spark, d, "events").select(F.col("event_id").alias("a"), F.lead("event_id").over(w).alias("b"), (F.lead(at).over(w) - at).alias("gap"))
    return graph.communities(x.filter("gap < 43200000000").select("a", "b"))


@query(f"""SELECT p_brand AS entity_type, CASE WHEN {norm_key_sql('p_type')} <> '' THEN {norm_key_sql('p_type')} END AS key, array_to_string(list_sort(list_distinct(list(p_type))), '|') AS labels, count(DISTINCT p_partkey) AS n_nodes, count(DISTINCT p_size) AS n_sources FROM part GROUP BY ALL""")
def canonical_entities(spark, d):
    x = table(spark, d, "part").select(F.col("p_brand").alias("entity_type"), F.col("p_type").alias("label"), F.col("p_partkey").alias("node"), F.col("p_size").alias("source"))
    return graph.canonical_entities(x).withColumn("labels", F.array_join("labels", "|"))


REPORTS = """c AS (SELECT c_nationkey AS community, c_name || ' ' || c_mktsegment AS claim, c_mktsegment AS label, c_custkey AS node FROM customer),
k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY community ORDER BY claim, node) <= 5),
b AS (SELECT community, count(*) AS n_claims, string_agg(claim, ' ' ORDER BY claim, node) AS summary FROM k GROUP BY 1),
t AS (SELECT community, array_to_string(list_sort(list_distinct(list(label)))[1:3], ' / ') AS title FROM c GROUP BY 1), r AS (SELECT * FROM b JOIN t USING (community))"""


def reports(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("community"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("claim"), F.col("c_mktsegment").alias("label"), F.col("c_custkey").alias("node"))
    return graph.reports(c, 5)


@query(f"WITH {REPORTS} SELECT community, n_claims, summary, title FROM r")
def community_reports(spark, d):
    return reports(spark, d)


@query(f"""WITH {REPORTS}, s AS (SELECT community, len(list_intersect(['machinery', 'building'], {terms_sql("title || ' ' || summary")})) AS o, n_claims FROM r)
SELECT community, round(o + n_claims * 0.001::DOUBLE, 6) AS score FROM s WHERE o > 0""")
def community_report_rank(spark, d):
    return graph.report_scores(reports(spark, d), "machinery building").select("community", "score")
