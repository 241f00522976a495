"""States from event logs, deletions under holds, question plans, scan extents, audited answers, sliding and session windows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from quillspark.operators import audit, dense, evidence, extents, folds, research
from quillspark.plans.registry import query
from quillspark.plans.retrieval import COLUMNS, DENSE_K, dense_sql, query_vectors, vectors
from quillspark.storage import table
from quillspark.streaming import incremental

#: A task's life: what an event makes of a state. Anything else is illegal.
TASK = {
    ("none", "signup"): "queued", ("queued", "click"): "running", ("queued", "error"): "cancelled", ("running", "view"): "paused", ("paused", "click"): "running",
    ("running", "purchase"): "done", ("running", "error"): "failed", ("failed", "signup"): "queued", ("cancelled", "signup"): "queued", ("done", "signup"): "queued",
}

_TASK_SQL = f"""t(s, e, n) AS (VALUES {', '.join(f"('{s}', '{e}', '{n}')" for (s, e), n in TASK.items())}),
v AS MATERIALIZED (SELECT user_id AS id, event_id AS seq, event_type AS event, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f(id, seq, event, k, before, after, legal) AS (SELECT id, seq, event, k, 'none', coalesce(n, 'none'), n IS NOT NULL FROM v LEFT JOIN t ON s = 'none' AND e = event WHERE k = 1
  UNION ALL SELECT v.id, v.seq, v.event, v.k, f.after, coalesce(t.n, f.after), t.n IS NOT NULL FROM f JOIN v ON v.id = f.id AND v.k = f.k + 1 LEFT JOIN t ON t.s = f.after AND t.e = v.event)"""


def _task_log(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("event"))
    return folds.folded(e, TASK, "none")


@query(f"WITH RECURSIVE {_TASK_SQL} SELECT id, seq, event, before, after, legal FROM f")
def task_steps(spark, d):
    return _task_log(spark, d)


@query(f"WITH RECURSIVE {_TASK_SQL} SELECT id, arg_max(after, seq) AS state, count(*) AS events, count(*) FILTER (NOT legal) AS illegal FROM f GROUP BY 1")
def task_states(spark, d):
    return folds.final_states(_task_log(spark, d))


NOW, PRODUCTS = datetime(2024, 1, 20), ["chunks", "vectors", "postings"]


@query("""WITH r AS (SELECT user_id AS id, min(ts) AS requested, CASE WHEN user_id % 3 = 0 THEN min(ts) + INTERVAL 9 DAY END AS until FROM events GROUP BY 1),
h AS (SELECT user_id AS id, ts AS begins, CASE WHEN user_id % 7 = 0 AND value > 450 THEN TIMESTAMP '9999-12-31' ELSE ts + to_hours(value::INT) END AS ends FROM events WHERE event_type = 'view' AND value >= 1),
o AS (SELECT id, begins, ends, sum((begins > coalesce(before, begins - INTERVAL 1 SECOND))::INT) OVER (PARTITION BY id ORDER BY begins, ends) AS island FROM (SELECT *, max(ends) OVER (PARTITION BY id ORDER BY begins, ends ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h)),
m AS (SELECT id, min(begins) AS begins, max(ends) AS ends FROM o GROUP BY id, island),
d AS (SELECT r.id, CASE WHEN m.ends >= TIMESTAMP '9999-12-31' THEN NULL ELSE coalesce(m.ends, greatest(requested, coalesce(until, requested))) END AS due FROM r LEFT JOIN m ON m.id = r.id AND m.begins <= greatest(requested, coalesce(until, requested)) AND greatest(requested, coalesce(until, requested)) < m.ends),
x AS (SELECT id, due, unnest(['chunks', 'vectors', 'postings']) AS product FROM d),
a AS (SELECT user_id AS id, ['chunks', 'vectors', 'postings'][1 + event_id % 3] AS product, ts AS tried, value > 300 AS ok FROM events WHERE event_type = 'error'),
w AS (SELECT x.id, x.product, bool_or(ok) AS ok FROM x JOIN a ON a.id = x.id AND a.product = x.product AND tried >= due GROUP BY ALL)
SELECT x.id, x.product, due, CASE WHEN due IS NULL THEN 'held' WHEN due > TIMESTAMP '2024-01-20' THEN 'waiting' WHEN ok THEN 'deleted' WHEN NOT ok THEN 'failed' ELSE 'pending' END AS outcome FROM x LEFT JOIN w ON w.id = x.id AND w.product = x.product""")
def deletion_outcomes(spark, d):
    """Users' first events ask for deletion; views hold it for as many hours as their value, errors are attempts."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    days = lambda n: F.make_dt_interval(F.lit(n))
    r = e.groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("requested")).withColumn("retained_until", F.when(F.col("id") % 3 == 0, F.col("requested") + days(9)))
    hours = F.make_dt_interval(F.lit(0), F.expr("cast(bround(value) as int)"))
    h = e.filter("event_type = 'view' AND value >= 1").select(F.col("user_id").alias("id"), F.col("ts").alias("begins"), F.when(~((F.col("user_id") % 7 == 0) & (F.col("value") > 450)), F.col("ts") + hours).alias("ends"))
    a = e.filter("event_type = 'error'").select(F.col("user_id").alias("id"), F.element_at(F.array(*map(F.lit, PRODUCTS)), (1 + F.col("event_id") % 3).cast("int")).alias("product"), F.col("ts").alias("at"), (F.col("value") > 300).alias("ok"))
    return folds.deletion_outcomes(r, h, a, PRODUCTS, NOW)


_PLANS_SQL = """n AS (SELECT DISTINCT l_orderkey AS plan_id, l_linenumber AS sub_id FROM lineitem),
dep AS (SELECT DISTINCT l_orderkey AS plan_id, l_linenumber AS sub_id, unnest(list_filter([CASE WHEN l_quantity > 15 AND l_linenumber > 1 THEN l_linenumber - 1 END, CASE WHEN l_quantity < 30 AND l_linenumber > 2 THEN l_linenumber - 2 END, CASE WHEN l_partkey % 50 = 0 THEN l_linenumber + 1 END, CASE WHEN l_partkey % 997 = 1 THEN 90 END], lambda x: x IS NOT NULL)) AS depends_on FROM lineitem),
k AS MATERIALIZED (SELECT dep.* FROM dep JOIN n ON n.plan_id = dep.plan_id AND n.sub_id = dep.depends_on),
reach(plan_id, a, b) AS (SELECT plan_id, sub_id, depends_on FROM k UNION SELECT r.plan_id, r.a, k.depends_on FROM reach r JOIN k ON k.plan_id = r.plan_id AND k.sub_id = r.b),
cyc AS (SELECT DISTINCT plan_id, a AS sub_id FROM reach WHERE a = b), bad AS (SELECT DISTINCT plan_id, sub_id FROM cyc UNION SELECT r.plan_id, r.a FROM reach r JOIN cyc ON cyc.plan_id = r.plan_id AND cyc.sub_id = r.b),
p(plan_id, sub_id, top, level) AS (SELECT plan_id, sub_id, sub_id, 0 FROM n WHERE (plan_id, sub_id) NOT IN (SELECT (plan_id, sub_id) FROM bad) UNION SELECT p.plan_id, k.depends_on, p.top, p.level + 1 FROM p JOIN k ON k.plan_id = p.plan_id AND k.sub_id = p.sub_id),
lv AS (SELECT plan_id, top AS sub_id, max(level) AS level FROM p GROUP BY ALL),
st AS (SELECT n.plan_id, CASE WHEN n.plan_id IN (SELECT plan_id FROM dep WHERE (plan_id, depends_on) NOT IN (SELECT (plan_id, sub_id) FROM n)) THEN 'unknown_dependency' WHEN n.plan_id IN (SELECT plan_id FROM bad) THEN 'cycle' ELSE 'ok' END AS status FROM n GROUP BY n.plan_id),
r AS MATERIALIZED (SELECT n.plan_id, n.sub_id, level::INT AS level, status FROM n JOIN st USING (plan_id) LEFT JOIN lv USING (plan_id, sub_id))"""


def _levels(spark, d):
    """The lines of an order as questions that wait for earlier ones, at times for the next or for one that is not there."""
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("sub_id"), "l_quantity", "l_partkey")
    n = F.col("sub_id")
    on = F.array_compact(F.array(F.when((F.col("l_quantity") > 15) & (n > 1), n - 1), F.when((F.col("l_quantity") < 30) & (n > 2), n - 2), F.when(F.col("l_partkey") % 50 == 0, n + 1), F.when(F.col("l_partkey") % 997 == 1, F.lit(90))))
    return research.levels(x.select("plan_id", "sub_id"), x.select("plan_id", "sub_id", F.explode(on).alias("depends_on")))


@query(f"WITH RECURSIVE {_PLANS_SQL} SELECT plan_id, sub_id, level, status FROM r")
def plan_levels(spark, d):
    return _levels(spark, d)


@query(f"""WITH RECURSIVE {_PLANS_SQL}, h AS (SELECT l_orderkey AS plan_id, l_linenumber AS sub_id, i AS rank, l_partkey // (20 * i) AS evidence_id, l_returnflag = 'N' AS direct FROM lineitem, (VALUES (1), (2)) u(i)),
g AS (SELECT plan_id, evidence_id, min({{'l': level, 's': sub_id, 'r': rank}}) AS f, list_sort(list_distinct(list(sub_id))) AS subs, bool_or(direct) AS direct FROM r JOIN h USING (plan_id, sub_id) WHERE status = 'ok' GROUP BY ALL)
SELECT plan_id, evidence_id, row_number() OVER (PARTITION BY plan_id ORDER BY f, evidence_id)::INT AS place, array_to_string(subs, ',') AS subs, direct FROM g""")
def merged_along_levels(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("sub_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"), "l_partkey", (F.col("l_returnflag") == "N").alias("direct"))
    found = x.withColumn("evidence_id", F.expr("l_partkey div (20 * rank)"))
    return research.merged_along(_levels(spark, d), found).withColumn("subs", F.array_join("subs", ","))


@query("SELECT min(vec_id) AS first, max(vec_id) AS last FROM (SELECT vec_id, vec_id - row_number() OVER (ORDER BY vec_id) AS g FROM embeddings WHERE vec_id // 40 % 3 <> 1) GROUP BY g")
def scope_extents(spark, d):
    return extents.extents(table(spark, d, "embeddings").filter("vec_id div 40 % 3 <> 1").select(F.col("vec_id").alias("id")))


@query(f"WITH {dense_sql('r', where='e.vec_id // 40 % 3 <> 1')} SELECT query_id, chunk_id, score, rank FROM r")
def dense_topk_extents(spark, d):
    """The scope stands in the scan of the vectors as ranges of ids."""
    held = extents.sorted_by_id(vectors(spark, d), "chunk_id")
    scope = extents.extents(held.filter("chunk_id div 40 % 3 <> 1").select(F.col("chunk_id").alias("id")))
    return dense.dense_top_k(extents.in_extents(held, "chunk_id", scope), query_vectors(spark, d), DENSE_K).select(*COLUMNS)


_ANSWERS_SQL = """t AS (SELECT conv_id * 1000 + turn AS answer_id, replace(text, '.', ' [E' || conv_id % 5 || ', E' || turn || '].') AS text FROM conversations WHERE role = 'assistant'),
p AS (SELECT answer_id, unnest(regexp_extract_all(text, '(?s)[^.!?]+[.!?]*[ \\t\\r\\n]*|[.!?]+[ \\t\\r\\n]*')) AS text, generate_subscripts(regexp_extract_all(text, '(?s)[^.!?]+[.!?]*[ \\t\\r\\n]*|[.!?]+[ \\t\\r\\n]*'), 1) - 1 AS claim FROM t),
q AS (SELECT answer_id, claim::INT AS claim, text, sum(strlen(text)) OVER (PARTITION BY answer_id ORDER BY claim)::BIGINT AS upto FROM p)"""


def _answers(spark, d):
    label = F.concat(F.lit(" [E"), (F.col("conv_id") % 5).cast("string"), F.lit(", E"), F.col("turn").cast("string"), F.lit("]."))
    return table(spark, d, "conversations").filter("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.replace("text", F.lit("."), label).alias("text"))


@query(f"""WITH {_ANSWERS_SQL}, l AS (SELECT answer_id, claim, unnest(regexp_extract_all(text, 'E[0-9]+')) AS label FROM (SELECT answer_id, claim, array_to_string(regexp_extract_all(text, '\\[E[0-9]+(?:, *E[0-9]+)*\\]'), ' ') AS text FROM q))
SELECT q.answer_id, q.claim, (upto - strlen(text))::BIGINT AS start, upto AS "end", coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM l WHERE l.answer_id = q.answer_id AND l.claim = q.claim), '') AS labels FROM q""")
def claims_with_citations(spark, d):
    """Every answer's sentences as byte ranges, with the labels that stand inside each."""
    answers = _answers(spark, d)
    c = audit.claims(answers)
    bound = audit.bound_citations(c, audit.citations(answers)).withColumn("labels", F.array_join("labels", ","))
    return c.select("answer_id", "claim", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).join(bound, ["answer_id", "claim"])


@query(f"""WITH {_ANSWERS_SQL}, m AS (SELECT answer_id, claim, upto - strlen(text) + (claim % 4 = 1)::INT AS a, upto + (claim % 6 = 2)::INT AS b, text FROM q WHERE claim % 7 <> 5),
r AS (SELECT *, coalesce(max(b) OVER (PARTITION BY answer_id ORDER BY a, b, claim ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM m),
f AS (SELECT answer_id, claim, unnest(list_filter([CASE WHEN a > reached THEN 'gap' WHEN a < reached THEN 'overlap' END, CASE WHEN claim % 4 = 1 OR (claim % 6 = 2 AND b <= strlen(w)) THEN 'text' END], lambda x: x IS NOT NULL)) AS fault FROM (SELECT r.*, t.text AS w FROM r JOIN t USING (answer_id)))
SELECT answer_id, claim, fault FROM f UNION ALL SELECT t.answer_id, NULL, 'gap' FROM t LEFT JOIN (SELECT answer_id, max(b) AS b FROM m GROUP BY 1) USING (answer_id) WHERE strlen(text) > 0 AND coalesce(b, 0) < strlen(text)""")
def claim_tiling_faults(spark, d):
    """Claims of which some are lost and the bounds of some are one byte off."""
    answers = _answers(spark, d)
    n = F.col("claim")
    c = audit.claims(answers).filter("claim % 7 <> 5").withColumns({"start": F.col("start") + (n % 4 == 1).cast("int"), "end": F.col("end") + (n % 6 == 2).cast("int")})
    return audit.tiling_faults(answers, c)


@query("""SELECT epoch_us(w)::BIGINT AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') - INTERVAL 45 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01'), INTERVAL 15 MINUTE)) AS w FROM events) GROUP BY ALL""")
def sliding_windows(spark, d):
    x = incremental.event_counts(table(spark, d, "events"), "1 hour", slide="15 minutes")
    return x.select(F.unix_micros("start").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT *, (ts > coalesce(lag(ts) OVER w, TIMESTAMP '1900-01-01') + INTERVAL 12 HOUR - INTERVAL 1 MICROSECOND)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, epoch_us(min(ts))::BIGINT AS start, epoch_us(max(ts) + INTERVAL 12 HOUR)::BIGINT AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, d):
    x = incremental.sessions(table(spark, d, "events"), "12 hours")
    return x.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query("""SELECT event_id FROM events WHERE event_id % 11 IN (2, 5)""")
def nested_mentions(spark, d):
    """Payloads that hold a value at any depth; keys and parts of values do not count."""
    n = (F.col("event_id") % 11).cast("string")
    key = F.concat(F.lit('{"k5": {"v2": [{"x": "v'), n, F.lit('"}, "v22"]}, "n": '), n, F.lit("}"))
    return evidence.mentioning(table(spark, d, "events").select("event_id", key.alias("payload")), "payload", ["v2", "v5"]).select("event_id")
