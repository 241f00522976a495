"""Catalog maintenance and relational queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import catalog, filters
from quillspark.plans.registry import query
from quillspark.storage import table


@query("""SELECT source_id, CASE WHEN a.source_id IS NULL THEN 'added' WHEN b.source_id IS NULL THEN 'removed' ELSE 'unchanged' END AS status
FROM (SELECT DISTINCT o_custkey AS source_id FROM orders WHERE year(o_orderdate) = 1996) a FULL JOIN (SELECT DISTINCT o_custkey AS source_id FROM orders WHERE year(o_orderdate) = 1997) b USING (source_id)""")
def collection_diff(spark, d):
    """Customers of one year against those of the next."""
    in_year = lambda y: table(spark, d, "orders").filter(F.year("o_orderdate") == y).select(F.col("o_custkey").alias("source_id")).distinct()
    return catalog.membership_diff(in_year(1996), in_year(1997))


@query("SELECT doc_id AS source_id, 'old' AS stored_hash, sha256(text) AS current_hash FROM documents WHERE lang = 'de'")
def stale_sources(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), "lang", F.sha2("text", 256).alias("hash"))
    was = x.select("source_id", F.when(F.col("lang") == "de", "old").otherwise(F.col("hash")).alias("hash"))
    return catalog.stale(was, x.select("source_id", "hash"))


@query("""WITH c AS (SELECT source, count(*) AS n_children FROM documents GROUP BY 1), v AS (SELECT source, count(*) AS n_vectors FROM documents JOIN embeddings ON doc_id = vec_id GROUP BY 1)
SELECT source, n_children, coalesce(n_vectors, 0) AS n_vectors, (coalesce(n_vectors, 0) <> n_children OR source = 'src7') AS stale FROM c LEFT JOIN v USING (source)""")
def freshness(spark, d):
    docs = table(spark, d, "documents")
    v = docs.join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    status = docs.groupBy("source").agg(F.count(F.lit(1)).alias("recorded")).withColumn("status", F.when(F.col("source") == "src7", "Pending").otherwise("Embedded"))
    return catalog.freshness(docs.select("source"), v.select("source"), status)


@query("""(SELECT doc_id AS id, 'missing' AS fault FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) UNION ALL (SELECT vec_id, 'orphan' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents))""")
def missing_orphan_rows(spark, d):
    return catalog.index_faults(table(spark, d, "documents").select(F.col("doc_id").alias("id")), table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), "id")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def purge_unreferenced(spark, d):
    """Orders to which no returned line refers."""
    returned = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return catalog.unreferenced(table(spark, d, "orders").select("o_orderkey"), returned, "o_orderkey")


@query("""WITH t AS (SELECT user_id AS id, max(event_id % 10) AS version FROM events WHERE event_type = 'purchase' AND event_id % 4 <= 2 GROUP BY 1)
SELECT c_custkey AS id, c_custkey % 50 AS version FROM customer WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.id = c_custkey AND t.version >= c_custkey % 50)""")
def tombstone_exclude(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 50).alias("version"))
    t = table(spark, d, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("id"), (F.col("event_id") % 10).alias("version"), (F.col("event_id") % 4).alias("generation"))
    return filters.without_tombstones(rows, t, 2)


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def upsert_latest(spark, d):
    return catalog.latest(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.desc("event_id")])


@query("""WITH v AS (SELECT user_id AS source_id, event_type AS field, ['manual', 'canonical_package', 'embedded', 'filename', 'model_derived'][1 + event_id % 5] AS origin, event_id AS version, value::VARCHAR AS value, event_id % 5 AS r FROM events)
SELECT source_id, field, origin, version, superseded FROM (SELECT *, count(*) OVER (PARTITION BY source_id, field) - 1 AS superseded, row_number() OVER (PARTITION BY source_id, field ORDER BY (field = 'click' AND r = 4)::INT, r, version DESC) AS n FROM v) WHERE n = 1""")
def metadata_precedence(spark, d):
    origin = F.element_at(F.array(*map(F.lit, catalog.ORIGINS)), (F.col("event_id") % 5 + 1).cast("int"))
    v = table(spark, d, "events").select(F.col("user_id").alias("source_id"), F.col("event_type").alias("field"), origin.alias("origin"), F.col("event_id").alias("version"), F.col("value").cast("string").alias("value"))
    return catalog.precedence(v, ["click"]).select("source_id", "field", "origin", "version", "superseded")


@query("""WITH g AS (SELECT DISTINCT o_custkey AS profile, year(o_orderdate) * 12 + month(o_orderdate) AS generation FROM orders), c AS (SELECT profile, max(generation) - 6 AS current FROM g GROUP BY 1)
SELECT profile, generation, current FROM g JOIN c USING (profile) WHERE generation < current QUALIFY dense_rank() OVER (PARTITION BY profile ORDER BY generation DESC) > 2""")
def gc_generations(spark, d):
    g = table(spark, d, "orders").select(F.col("o_custkey").alias("profile"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("generation")).distinct()
    c = g.groupBy("profile").agg((F.max("generation") - 6).alias("current"))
    return catalog.collectable(g.join(c, "profile"), 2).select("profile", "generation", "current")


#: Ids that the turnover window spans, back from the newest.
TURNOVER = 5000


@query(f"SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, count(*) FILTER (WHERE value > 1) AS n_over_one FROM events WHERE event_id > (SELECT max(event_id) FROM events) - {TURNOVER} GROUP BY 1")
def task_turnover(spark, d):
    return catalog.turnover(table(spark, d, "events"), TURNOVER)


@query("SELECT coalesce(CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderpriority END, 'none given') AS reason, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, reason LIMIT 4")
def reason_buckets(spark, d):
    x = table(spark, d, "orders").select(F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")).alias("why"))
    return catalog.buckets(x, "why", "none given", 4)


@query("SELECT event_id, event_type, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS ahead FROM events")
def queue_position(spark, d):
    return catalog.queue_positions(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("event_id", "event_type", "ahead")


@query("SELECT url, count(*) AS n FROM (SELECT regexp_replace(url, '[0-9]+', '', 'g') AS url FROM pages) GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, url LIMIT 5")
def dup_paths(spark, d):
    x = table(spark, d, "pages").select(F.regexp_replace("url", "[0-9]+", "").alias("url"))
    return x.groupBy("url").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), "url").limit(5)


@query("""WITH b AS (SELECT l_orderkey AS id, count(*) AS n, min(year(l_shipdate) * 12 + month(l_shipdate)) AS version FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT id, CASE WHEN n > 1 THEN 'repeated' ELSE 'not_newer' END AS fault FROM b LEFT JOIN (SELECT o_orderkey AS id, year(o_orderdate) * 12 + month(o_orderdate) + 2 AS was FROM orders) USING (id) WHERE n > 1 OR version <= was""")
def mutation_faults(spark, d):
    """Returned lines as mutations of their orders, which must be newer than two months after the order."""
    month = lambda c: F.year(c) * 12 + F.month(c)
    b = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), month("l_shipdate").alias("version"))
    return catalog.mutation_faults(b, table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (month("o_orderdate") + 2).alias("version")))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderdate::DATE BETWEEN DATE '1994-01-01' AND DATE '1996-06-30' AND o_orderpriority IS NOT NULL AND o_custkey % 10 <> 3 AND left(o_orderpriority, 1) IN ('1', '2')")
def enterprise_predicate(spark, d):
    from datetime import date

    x = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("lifecycle"), F.col("o_orderdate").alias("date"), F.array((F.col("o_custkey") % 10).cast("string")).alias("acl"), F.create_map(F.lit("urgency"), F.substring("o_orderpriority", 1, 1)).alias("metadata"))
    allow = [str(i) for i in range(10)]
    p = [filters.Predicate("lifecycle", ("F", "O")), filters.Predicate("dates", (date(1994, 1, 1), date(1996, 6, 30))), filters.Predicate("acl_allow", tuple(allow)), filters.Predicate("acl_deny", ("3",))]
    first, second = (filters.compiled([*p, filters.Predicate("metadata", (v,), "urgency")]) for v in ("1", "2"))
    return x.filter(first | second).select("o_orderkey")


@query("SELECT o_custkey, count(*) AS n, CASE WHEN count(*) <= 5 THEN 'exact_scan' WHEN count(*) <= 12 THEN 'planner_selected' ELSE 'predicate_aware_ann' END AS path FROM orders GROUP BY 1")
def selectivity_class(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("path", filters.selectivity(F.col("n"), 5, 12))


@query("""SELECT l_orderkey, l_linenumber, coalesce(p.l_quantity, c.l_quantity) AS shown FROM lineitem c LEFT JOIN (SELECT l_orderkey, l_quantity FROM lineitem WHERE l_linenumber = 1) p USING (l_orderkey)""")
def parent_hydration(spark, d):
    c = table(spark, d, "lineitem")
    p = c.filter("l_linenumber = 1").select("l_orderkey", F.col("l_quantity").alias("parent_quantity"))
    return c.join(p, "l_orderkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("parent_quantity", "l_quantity").alias("shown"))


@query("SELECT event_type, approx.p50, approx.p95 FROM (SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1) approx")
def latency_percentiles(spark, d):
    x = catalog.percentiles(table(spark, d, "events"), "event_type", "value", [0.5, 0.95])
    at = lambda share: F.round(F.max(F.when(F.col("share") == share, F.col("value"))), 6)
    return x.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


@query("SELECT event_id, event_type, ts, (SELECT count(*) FROM events WHERE event_type = 'error') AS total FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 20")
def task_page(spark, d):
    return catalog.first_page(table(spark, d, "events").filter("event_type = 'error'").select("event_id", "event_type", "ts"), ["ts", "event_id"], 20)


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS active, min(ts) FILTER (WHERE event_type = 'view') AS oldest FROM events GROUP BY 1")
def active_tasks(spark, d):
    running = F.col("event_type") == "view"
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(running).alias("active"), F.min(F.when(running, F.col("ts"))).alias("oldest"))


@query("""SELECT lang, count(*) AS n_chunks, count(vec_id) AS n_vectors, count(l.doc_id) AS n_labels FROM documents d LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) ON vec_id = d.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY 1""")
def storage_counts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("v")).distinct()
    m = table(spark, d, "labels").select("doc_id", F.lit(1).alias("m")).distinct()
    return docs.join(v, "doc_id", "left").join(m, "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("n_chunks"), F.count("v").alias("n_vectors"), F.count("m").alias("n_labels"))


@query("""WITH g AS (SELECT DISTINCT o_custkey AS profile, year(o_orderdate) AS generation FROM orders),
l AS (SELECT DISTINCT o_custkey AS profile, year(o_orderdate) AS generation FROM orders WHERE o_orderstatus = 'O' AND o_orderdate > TIMESTAMP '1997-06-30')
SELECT profile, generation FROM g ANTI JOIN l USING (profile, generation)""")
def lease_reclaim(spark, d):
    """Open orders hold their customer's year until their date is past."""
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("profile"), F.year("o_orderdate").alias("generation"), F.col("o_orderdate").alias("expires"), "o_orderstatus")
    return catalog.reclaimable(x.select("profile", "generation").distinct(), x.filter("o_orderstatus = 'O'"), F.lit("1997-06-30 00:00:00").cast("timestamp"))


@query("""WITH s AS (SELECT o_custkey AS id, count(*) AS stored FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), i AS (SELECT o_custkey AS id, count(*) AS indexed FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1)
SELECT id, stored, indexed, CASE WHEN indexed IS NULL THEN 'missing' WHEN stored IS NULL THEN 'orphan' WHEN indexed < stored THEN 'behind' ELSE 'ahead' END AS finding FROM s FULL JOIN i USING (id) WHERE stored IS DISTINCT FROM indexed""")
def reconcile_findings(spark, d):
    count = lambda but: table(spark, d, "orders").filter(F.col("o_orderstatus") != but).groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("version"))
    return catalog.reconciled(count("P"), count("O"), "id")
