"""Ingest: units, boundaries, chunks, parents, spans, caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.text import stable_id
from quillspark.operators import ingest
from quillspark.plans.registry import query, tokens_sql
from quillspark.storage import table

#: Texts without blank lines: a marker stands in for one after every third line.
GAPPED = "regexp_replace(text, '((?:[^\\n]*\\n){3})', '\\1\\n', 'g')"


def units(spark, d, lines: bool = True):
    x = table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("source_id"), "text")
    return ingest.paragraphs(x, lines)


LINES = r"""lines AS (SELECT doc_id AS source_id, unnest(string_split_regex(text, '\r?\n')) AS raw, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS line FROM documents WHERE text IS NOT NULL),
units AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY line) - 1 AS position, line AS first_line, line AS last_line, trim(raw, ' ') AS text FROM lines WHERE trim(raw, ' ') <> '')"""


@query(f"WITH {LINES} SELECT source_id, position::INT AS position, first_line::INT AS first_line, last_line::INT AS last_line, text, sha256(text) AS text_hash FROM units")
def line_units(spark, d):
    return units(spark, d)


@query(r"""WITH g AS (SELECT doc_id AS source_id, regexp_replace(text, '((?:[^\n]*\n){3})', '\1' || chr(10), 'g') AS text FROM documents WHERE text IS NOT NULL),
l AS (SELECT source_id, trim(unnest(string_split(text, chr(10))), ' ') AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM g),
r AS (SELECT *, sum((raw = '')::INT) OVER (PARTITION BY source_id ORDER BY line) AS run FROM l),
p AS (SELECT source_id, min(line) AS first_line, max(line) AS last_line, string_agg(raw, ' ' ORDER BY line) AS text FROM r WHERE raw <> '' GROUP BY source_id, run)
SELECT source_id, (row_number() OVER (PARTITION BY source_id ORDER BY first_line) - 1)::INT AS position, first_line::INT AS first_line, last_line::INT AS last_line, text, sha256(text) AS text_hash FROM p""")
def paragraph_units(spark, d):
    x = table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("source_id"), F.regexp_replace("text", "\\G((?:[^\\n]*+\\n){3})", "$1\n").alias("text"))
    return ingest.paragraphs(x)


@query("""WITH x AS (SELECT user_id AS source_id, event_id AS position, event_type AS key FROM events),
c AS (SELECT *, (key IS DISTINCT FROM lag(key) OVER w AND row_number() OVER w > 1)::INT AS change FROM x WINDOW w AS (PARTITION BY source_id ORDER BY position))
SELECT source_id, position, key, sum(change) OVER (PARTITION BY source_id ORDER BY position)::BIGINT AS boundary FROM c""")
def boundary_islands(spark, d):
    x = table(spark, d, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("position"), F.col("event_type").alias("key"))
    return ingest.islands(x, "key")


def _children(spark, d):
    return ingest.children(units(spark, d).withColumn("boundary", F.lit(0)))


def quarters_sql(x: str) -> str:
    return f"(4 * length({x}) - 3 * coalesce(list_sum(list_transform(regexp_extract_all({x}, '[A-Za-z0-9]+'), lambda r: least(length(r), 24))), 0))::BIGINT"


TAIL = rf"right(open, list_max(list_filter(range(0, 321), lambda n: n <= length(open) AND {quarters_sql('right(open, n)')} <= 320)))"
#: The fold over `u`: each row has the open chunk with its spans (bytes), and the chunk that its unit has flushed.
FOLD = rf"""fold AS (SELECT source_id, seq, position, text AS open, quarters AS cost, position AS first, 0 AS child, [{{'unit': position, 'a': 0::BIGINT, 'b': strlen(text), 'c': 0::BIGINT}}] AS spans,
    NULL::VARCHAR AS flushed, NULL::BIGINT AS flushed_first, NULL::BIGINT AS flushed_last, NULL::STRUCT(unit BIGINT, a BIGINT, b BIGINT, c BIGINT)[] AS flushed_spans FROM u WHERE seq = 0
  UNION ALL SELECT source_id, seq, position, CASE WHEN carried = '' THEN text ELSE carried || ' ' || text END, CASE WHEN carried = '' THEN quarters ELSE {quarters_sql('carried')} + 4 + quarters END,
    CASE WHEN full_ THEN position ELSE first END, child + full_::INT,
    list_concat(list_transform(list_filter(spans, lambda s: greatest(s.a, lo) < least(s.b, lo + strlen(carried))), lambda s: {{'unit': s.unit, 'a': greatest(s.a, lo) - lo, 'b': least(s.b, lo + strlen(carried)) - lo, 'c': s.c + greatest(s.a, lo) - s.a}}),
      [{{'unit': position, 'a': CASE WHEN carried = '' THEN 0 ELSE strlen(carried) + 1 END, 'b': CASE WHEN carried = '' THEN 0 ELSE strlen(carried) + 1 END + strlen(text), 'c': 0::BIGINT}}]),
    CASE WHEN full_ THEN open END, CASE WHEN full_ THEN first END, CASE WHEN full_ THEN last END, CASE WHEN full_ THEN spans END
  FROM (SELECT *, CASE WHEN full_ THEN strlen(open) - strlen(regexp_replace(tail, '^\s+', '')) ELSE 0 END AS lo, CASE WHEN full_ THEN regexp_replace(tail, '^\s+|\s+$', '', 'g') ELSE open END AS carried
    FROM (SELECT *, CASE WHEN full_ THEN {TAIL} END AS tail
      FROM (SELECT u.*, open, first, child, spans, fold.position AS last, cost + 4 + quarters > 1440 AS full_ FROM fold JOIN u ON u.source_id = fold.source_id AND u.seq = fold.seq + 1)))),
children AS (SELECT source_id, child - 1 AS child, flushed AS text, flushed_first AS first_unit, flushed_last AS last_unit, flushed_spans AS spans FROM fold WHERE flushed IS NOT NULL
  UNION ALL SELECT source_id, child, open, first, position, spans FROM fold QUALIFY seq = max(seq) OVER (PARTITION BY source_id))"""
CHILDREN = f"{LINES}, u AS (SELECT source_id, position AS seq, position, text, {quarters_sql('text')} AS quarters FROM units), {FOLD}"


@query(f"WITH RECURSIVE {CHILDREN} SELECT source_id, 0::BIGINT AS boundary, child::BIGINT AS child, text, first_unit::BIGINT AS first_unit, last_unit::BIGINT AS last_unit, {tokens_sql('text')} AS tokens FROM children")
def chunk_children(spark, d):
    """Greedy packing with overlap; a whole document is one boundary."""
    return _children(spark, d).drop("chunk_id", "spans")


@query(f"WITH RECURSIVE {CHILDREN} SELECT source_id, 0::BIGINT AS boundary, (child // 5)::BIGINT AS parent, string_agg(text, ' ' ORDER BY child) AS text, count(*) AS n_children, min(first_unit)::BIGINT AS first_unit, max(last_unit)::BIGINT AS last_unit FROM children GROUP BY source_id, child // 5")
def parent_chunks(spark, d):
    return ingest.parents(_children(spark, d))


@query(f"WITH {LINES}, f AS (SELECT source_id, (position // 5)::BIGINT AS parent, string_agg(text, ' ' ORDER BY position) AS text, count(*) AS n FROM units GROUP BY ALL) SELECT source_id, parent, {tokens_sql('text')} AS tokens, n FROM f")
def parent_texts(spark, d):
    x = units(spark, d).select("source_id", F.lit(0).alias("boundary"), F.col("position").alias("child"), "text", F.col("position").alias("first_unit"), F.col("position").alias("last_unit"))
    from quillspark.functions.text import token_estimate

    return ingest.parents(x).select("source_id", "parent", token_estimate(F.col("text")).alias("tokens"), F.col("n_children").alias("n"))


@query(f"WITH {LINES} SELECT source_id, position::INT AS position, 'unit:v1:' || sha256(strlen(source_id::VARCHAR) || ':' || source_id || strlen(position::VARCHAR) || ':' || position || '64:' || sha256(text)) AS unit_id FROM units")
def unit_ids(spark, d):
    return units(spark, d).select("source_id", "position", stable_id("unit", F.col("source_id"), F.col("position"), F.col("text_hash")).alias("unit_id"))


@query("""SELECT doc_id AS chunk_id, doc_id AS evidence_id, CASE WHEN doc_id % 5 = 0 THEN 'hash' ELSE 'bytes' END AS reason FROM documents
WHERE text IS NOT NULL AND (doc_id % 5 = 0 OR (doc_id % 5 = 1 AND strlen(text) > 1 AND encode(text)[1:strlen(text) - 1] <> encode(text)[2:strlen(text)]))""")
def span_integrity(spark, d):
    """Spans over whole texts; of every five, one's evidence digest has changed and one's evidence bytes are shifted."""
    x = table(spark, d, "documents").filter("text IS NOT NULL").dropDuplicates(["doc_id"])
    chunks, evidence = x.select(F.col("doc_id").alias("chunk_id"), "text"), x.select(F.col("doc_id").alias("evidence_id"), "text")
    shift = ((F.col("doc_id") % 5 == 1) & (F.octet_length("text") > 0)).cast("int")
    size = F.octet_length("text")
    spans = x.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("evidence_id"), F.lit(0).alias("chunk_start"), (size - shift).alias("chunk_end"), shift.alias("evidence_start"), size.alias("evidence_end"), F.sha2(F.when(F.col("doc_id") % 5 == 0, "changed").otherwise(F.col("text")), 256).alias("evidence_text_hash"))
    return ingest.span_faults(spans, chunks, evidence)


@query("""WITH i AS (SELECT sha256(text) AS input_hash, count(*) AS inputs FROM documents GROUP BY 1), c AS (SELECT DISTINCT sha256(text) AS input_hash FROM documents WHERE lang = 'en')
SELECT input_hash, inputs, (c.input_hash IS NOT NULL) AS hit FROM i LEFT JOIN c USING (input_hash)""")
def embedding_cache_hits(spark, d):
    x = table(spark, d, "documents").select("lang", F.sha2("text", 256).alias("input_hash"))
    return ingest.cache_plan(x, x.filter("lang = 'en'"))


@query("SELECT doc_id AS source_id, (doc_id % 3 <> 0 AND doc_id % 4 <> 0) AS noop FROM documents")
def noop_ingest(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.sha2("text", 256).alias("hash"), F.lit("text").alias("parser"))
    stored = x.withColumn("hash", F.when(F.col("source_id") % 3 == 0, "old").otherwise(F.col("hash"))).withColumn("n_children", F.lit(2)).withColumn("n_vectors", F.when(F.col("source_id") % 4 == 0, 1).otherwise(2))
    return ingest.is_noop(x, stored.dropDuplicates(["source_id"]))


@query("SELECT event_id, je.path, je.value FROM (SELECT event_id, unnest(json_keys(props)) AS path, props FROM events) e, LATERAL (SELECT e.path, trim(json_extract_string(e.props, '$.' || e.path)) AS value) je WHERE je.value <> ''")
def json_flatten(spark, d):
    from quillspark.sources.readers import flattened_json

    return flattened_json(table(spark, d, "events"), "event_id", "props").select("event_id", "path", "value")


#: The fold over `cu` (units in order inside a boundary): `now` is the open chunk, `run` and `spent` count since a hard break.
CANONICAL = f"""cfold AS (SELECT source_id, boundary, seq, chapter, [{{'p': position, 't': text}}] AS now, 1 AS run, tokens AS spent, 0 AS child, NULL::STRUCT(p BIGINT, t VARCHAR)[] AS flushed FROM cu WHERE seq = 0
  UNION ALL SELECT source_id, boundary, seq, chapter, list_append(CASE WHEN fresh THEN [] WHEN full_ THEN list_slice(now, greatest(2, len(now) - 1), len(now)) ELSE now END, {{'p': position, 't': text}}),
    CASE WHEN fresh THEN 1 ELSE run + 1 END, CASE WHEN fresh THEN tokens ELSE spent + tokens END, child + (fresh OR full_)::INT, CASE WHEN fresh OR full_ THEN now END
  FROM (SELECT *, NOT fresh AND (len(now) >= 20 OR {tokens_sql("array_to_string(list_transform(list_append(now, {'p': position, 't': text}), lambda x: x.t), ' ')")} > 360) AS full_
    FROM (SELECT cu.*, now, run, spent, child, (cf.chapter IS NOT NULL AND cu.chapter IS DISTINCT FROM cf.chapter) OR run >= 20 OR spent + tokens > 600 AS fresh
      FROM cfold cf JOIN cu ON cu.source_id = cf.source_id AND cu.boundary = cf.boundary AND cu.seq = cf.seq + 1))),
cc AS (SELECT source_id, boundary, child - 1 AS child, flushed AS now FROM cfold WHERE flushed IS NOT NULL UNION ALL SELECT source_id, boundary, child, now FROM cfold QUALIFY seq = max(seq) OVER (PARTITION BY source_id, boundary)),
canonical AS (SELECT source_id, boundary::BIGINT AS boundary, child::BIGINT AS child, array_to_string(list_transform(now, lambda x: x.t), ' ') AS text, now[1].p::BIGINT AS first_unit, now[-1].p::BIGINT AS last_unit, len(now)::BIGINT AS n_units FROM cc)"""


def cu_sql(units: str) -> str:
    return f"""cb AS (SELECT *, sum((book IS NULL OR position = first OR book IS DISTINCT FROM before)::INT) OVER (PARTITION BY source_id ORDER BY position) AS boundary
  FROM (SELECT *, lag(book) OVER (PARTITION BY source_id ORDER BY position) AS before, min(position) OVER (PARTITION BY source_id) AS first FROM {units})),
cu AS (SELECT *, row_number() OVER (PARTITION BY source_id, boundary ORDER BY position) - 1 AS seq, {tokens_sql('text')} AS tokens FROM cb)"""


#: Lines as verses: eight make a chapter, a document's language is its book.
VERSES = f"{LINES}, verses AS (SELECT u.source_id, u.position, u.text, d.lang AS book, u.position // 8 AS chapter FROM units u JOIN documents d ON d.doc_id = u.source_id)"


def verses(spark, d):
    books = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.col("lang").alias("book")).dropDuplicates(["source_id"])
    return units(spark, d).join(books, "source_id").withColumn("chapter", F.expr("position div 8"))


@query(f"WITH RECURSIVE {VERSES}, {cu_sql('verses')}, {CANONICAL} SELECT * FROM canonical")
def canonical_chunks(spark, d):
    return ingest.canonical_children(verses(spark, d))


#: Notes stand between verses: lines that end in a full stop are canonical, all others go to the generic chunker.
MIXED = f"""{VERSES}, mixed AS (SELECT *, right(text, 1) = '.' AS canonical FROM verses), picked AS (SELECT * FROM mixed WHERE canonical),
u AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY position) - 1 AS seq, position, text, {quarters_sql('text')} AS quarters FROM mixed WHERE NOT canonical)"""


@query(f"""WITH RECURSIVE {MIXED}, {FOLD}, {cu_sql('picked')}, {CANONICAL},
a AS (SELECT source_id, boundary, child, text, first_unit, last_unit, 'canonical' AS strategy, first_unit AS least FROM canonical
  UNION ALL SELECT source_id, 0, child, text, first_unit, last_unit, 'generic', list_min(list_transform(spans, lambda s: s.unit)) FROM children),
l AS (SELECT source_id, CASE WHEN arg_min(canonical, position) THEN 'canonical' ELSE 'generic' END AS leads FROM mixed GROUP BY source_id)
SELECT source_id, boundary::BIGINT AS boundary, child::BIGINT AS child, text, first_unit::BIGINT AS first_unit, last_unit::BIGINT AS last_unit, strategy, least::BIGINT AS least,
  (row_number() OVER (PARTITION BY source_id ORDER BY least, strategy <> leads, boundary, child) - 1)::INT AS place FROM a JOIN l USING (source_id)""")
def mixed_chunks(spark, d):
    """Both chunkers over one source, merged by place."""
    x = verses(spark, d).withColumn("canonical", F.expr("right(text, 1) = '.'")).withColumn("boundary", F.lit(0))
    return ingest.mixed_children(x).drop("chunk_id")


@query(f"""WITH RECURSIVE {CHILDREN}, s AS (SELECT source_id, child, unnest(spans) AS s FROM children)
SELECT source_id, child::BIGINT AS child, s.unit AS unit, s.a AS chunk_start, s.b AS chunk_end, s.c AS evidence_start, s.c + s.b - s.a AS evidence_end FROM s""")
def chunk_spans(spark, d):
    """Which bytes of each chunk are which bytes of which unit."""
    return _children(spark, d).select("source_id", "child", F.inline("spans"))


@query(f"""WITH RECURSIVE {CHILDREN}, p AS (SELECT *, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY source_id, child // 5 ORDER BY child ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS moved FROM children),
s AS (SELECT source_id, child // 5 AS parent, moved, unnest(spans) AS s FROM p)
SELECT source_id, 0::BIGINT AS boundary, parent::BIGINT AS parent, s.unit AS unit, s.a + moved AS chunk_start, s.b + moved AS chunk_end, s.c AS evidence_start, s.c + s.b - s.a AS evidence_end FROM s""")
def parent_spans(spark, d):
    return ingest.parent_spans(_children(spark, d))
