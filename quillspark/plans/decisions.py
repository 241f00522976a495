"""Decisions over tables of signals, and small text forms that other queries build on."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import catalog, filters
from quillspark.operators import decisions as D
from quillspark.plans.registry import query
from quillspark.sources.readers import parser_of
from quillspark.storage import table


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber * 2 - 2 < 9 THEN least(10 * (1 << (l_linenumber * 2 - 2)), 256, l_partkey) END::BIGINT AS ask FROM lineitem")
def overfetch_plan(spark, d):
    attempt = F.col("l_linenumber") * 2 - 2
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", D.overfetch(F.lit(10).cast("long"), attempt, F.col("l_partkey")).alias("ask"))


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) >= 0.2 OR count(*) >= 32 AS due FROM orders GROUP BY 1")
def compaction_due(spark, d):
    x = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("segments"), (F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1))).alias("ratio"))
    return x.select("o_custkey", D.compaction_due(tombstone_ratio=F.col("ratio"), segments=F.col("segments")).alias("due"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'keep' WHEN event_id % 5 = 0 THEN 'publish' WHEN event_id % 3 = 0 THEN 'discard' ELSE 'nothing' END AS decision FROM events")
def recovery_decisions(spark, d):
    n = F.col("event_id")
    return table(spark, d, "events").select("event_id", D.recovery(n % 3 == 0, n % 5 == 0, n % 7 == 0).alias("decision"))


@query("""WITH c AS (SELECT event_id, ['top_k', 'approximate', 'exhaustive'][(event_id % 3 + 1)::INT] AS retriever, ['TopK', 'Approximate', 'All', 'Only', 'None', 'Every', 'Most'][(event_id % 7 + 1)::INT] AS claim FROM events)
SELECT event_id, retriever, claim, (retriever = 'top_k' AND claim IN ('TopK', 'Approximate')) OR (retriever = 'approximate' AND claim = 'Approximate') OR (retriever = 'exhaustive' AND claim <> 'Most') AS allowed FROM c""")
def completeness_claims(spark, d):
    pick = lambda values: F.array(*map(F.lit, values))[(F.col("event_id") % len(values)).cast("int")]
    x = table(spark, d, "events").select("event_id", pick(["top_k", "approximate", "exhaustive"]).alias("retriever"), pick(["TopK", "Approximate", "All", "Only", "None", "Every", "Most"]).alias("claim"))
    return x.withColumn("allowed", D.may_claim(F.col("retriever"), F.col("claim")))


@query("""SELECT l_orderkey * 10 + l_linenumber AS request_id, CASE WHEN c_custkey IS NULL THEN 'fresh' WHEN c_custkey % 4 <> l_linenumber % 4 THEN 'conflict' WHEN c_acctbal > 0 THEN 'replay' ELSE 'in_progress' END AS state
FROM lineitem LEFT JOIN customer ON c_custkey = l_partkey""")
def request_states(spark, d):
    """Keys that are known are customers, requests order lines."""
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 4).alias("fingerprint"), (F.col("c_acctbal") > 0).alias("finished"))
    asked = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"), F.col("l_partkey").alias("key"), (F.col("l_linenumber") % 4).alias("fingerprint"))
    return D.request_states(asked, known)


@query("SELECT doc_id FROM documents WHERE source IN (SELECT DISTINCT source FROM documents WHERE lang = 'de' AND n_chars > 1000)")
def collection_scope(spark, d):
    """A collection's members are the sources of long German documents."""
    x = table(spark, d, "documents")
    members = x.filter("lang = 'de' AND n_chars > 1000").select("source", F.lit("german").alias("collection"))
    return filters.in_scope(x, filters.collection_scope(members, ["german"])).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang IN ('de', 'fr') AND source IN ('src1', 'src2')")
def language_predicate(spark, d):
    x = table(spark, d, "documents").withColumnRenamed("lang", "language")
    return x.filter(filters.compiled([filters.Predicate("language", ("de", "fr")), filters.Predicate("source", ("src1", "src2"))])).select("doc_id")


@query("""WITH f AS (SELECT p_partkey, 'docs/' || p_name || ['.md', '.txt', '.JSON', '.usfm', '.xyz', ''][(p_partkey % 6 + 1)::INT] AS path FROM part)
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'markdown' WHEN 1 THEN 'plaintext' WHEN 2 THEN 'json' WHEN 3 THEN 'usfm' END AS parser FROM f""")
def parser_names(spark, d):
    ending = F.array(*map(F.lit, [".md", ".txt", ".JSON", ".usfm", ".xyz", ""]))[(F.col("p_partkey") % 6).cast("int")]
    return table(spark, d, "part").select("p_partkey", parser_of(F.concat(F.lit("docs/"), "p_name", ending)).alias("parser"))


@query("SELECT p_partkey, sha256(CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_brand || chr(10) || p_name END) AS input_hash, greatest(floor(p_size * 3 / 4), 1)::BIGINT AS budget FROM part")
def embedding_inputs(spark, d):
    head = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", F.sha2(X.embedding_input(head, F.col("p_name")), 256).alias("input_hash"), X.embedding_budget(F.col("p_size")).cast("long").alias("budget"))


@query("SELECT user_id AS id, event_id AS version, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def mutation_state(spark, d):
    """What versioned upserts and deletes leave of each id."""
    x = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), "value")
    return catalog.latest(x, ["id"], [F.desc("version"), F.col("op")]).select("id", "version", "op", "value")


@query("""WITH x AS (SELECT event_id, event_type, time_bucket(INTERVAL 1 hour, ts) AS start FROM events) SELECT strftime(start, '%Y-%m-%d %H') AS start, event_type, count(*) AS n FROM x GROUP BY ALL""")
def event_windows(spark, d):
    """The tumbling windows of the event stream, over a table."""
    from quillspark.streaming.incremental import event_counts

    return event_counts(table(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")


@query("""WITH n AS (SELECT doc_id AS source_id, sha256(text) AS hash FROM documents), o AS (SELECT doc_id AS source_id, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 5 <> 0)
SELECT n.source_id, CASE WHEN o.source_id IS NULL THEN 'new' WHEN o.hash IS DISTINCT FROM n.hash THEN 'changed' ELSE 'same' END AS change FROM n LEFT JOIN o USING (source_id)""")
def content_changes(spark, d):
    """Which sources an incremental ingest would take: new ones and those with another hash."""
    n = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.sha2("text", 256).alias("hash"))
    o = n.filter("source_id % 5 <> 0").select("source_id", F.when(F.col("source_id") % 4 == 0, "old").otherwise(F.col("hash")).alias("known"), F.lit(True).alias("there"))
    change = F.when(F.col("there").isNull(), "new").when(~F.col("hash").eqNullSafe(F.col("known")), "changed").otherwise("same")
    return n.join(o, "source_id", "left").select("source_id", change.alias("change"))


SPACES = [("click", 64, ["nearest"]), ("view", 128, ["nearest", D.LATE]), ("purchase", 64, ["nearest", D.LATE, "sparse"]), ("error", 128, [D.LATE, "sparse"])]


@query(f"""WITH s(space, native, offered) AS (VALUES {', '.join(map(str, SPACES))}),
c AS (SELECT event_id // 2 AS plan_id, event_id AS position, event_type AS space, ['nearest', '{D.LATE}', 'sparse'][(event_id % 3 + 1)::INT] AS operation, CASE WHEN value < 10 THEN 64 ELSE 128 END AS dimension, event_id % 3 = 1 AS late FROM events),
f AS (SELECT *, CASE WHEN offered IS NULL THEN 'missing_vector_space' WHEN NOT list_contains(offered, operation) THEN 'unsupported_query_operation' WHEN dimension IS DISTINCT FROM native OR late <> (operation = '{D.LATE}') THEN 'incompatible_query_shape' END AS fault FROM c LEFT JOIN s USING (space))
SELECT plan_id, count(*) AS n_clauses, CASE WHEN count(DISTINCT space) < count(*) OR count(*) > {D.MOST_CLAUSES} THEN 'invalid_query_plan' ELSE arg_min(fault, position) FILTER (WHERE fault IS NOT NULL) END AS fault FROM f GROUP BY plan_id""")
def named_space_plans(spark, d):
    """Event types as spaces (one of them unknown); two events make a plan."""
    n = F.col("event_id")
    operation = F.array(*map(F.lit, ("nearest", D.LATE, "sparse")))[(n % 3).cast("int")]
    clauses = table(spark, d, "events").select(F.expr("event_id div 2").alias("plan_id"), n.alias("position"), F.col("event_type").alias("space"), operation.alias("operation"), F.when(F.col("value") < 10, 64).otherwise(128).alias("dimension"), (n % 3 == 1).alias("late"))
    return D.plan_faults(clauses, spark.createDataFrame(SPACES, "space string, dimension int, operations array<string>"))


def _pick(name: str, at: str) -> str:
    return f"(ARRAY{list(D.MATRIX[name])})[({at} % {len(D.MATRIX[name])} + 1)::INT] AS {name}"


RUNS = {"query_class": "event_id", "selectivity": "event_id // 7", "concurrency": "user_id", "cache_state": "floor(value)", "update_state": "user_id // 4"}


@query(f"""WITH r AS (SELECT {', '.join(_pick(k, v) for k, v in RUNS.items())} FROM events), n AS (SELECT *, count(*) AS runs FROM r GROUP BY ALL),
cells AS (SELECT * FROM {', '.join(f"(SELECT unnest({list(v)}) AS {k})" for k, v in D.MATRIX.items())})
SELECT c.*, coalesce(n.runs, 0) AS runs, c.cache_state IN ('cold', 'warm') AS required FROM cells c LEFT JOIN n USING ({', '.join(D.MATRIX)})""")
def query_matrix(spark, d):
    """Events as runs, dealt over the dimensions by their numbers."""
    pick = lambda name, at: F.array(*map(F.lit, D.MATRIX[name]))[(F.expr(at) % len(D.MATRIX[name])).cast("int")].alias(name)
    return D.matrix_coverage(table(spark, d, "events").select(*(pick(k, v.replace("//", "div")) for k, v in RUNS.items())))
