"""Parsers, validators and writers over texts that are written from the tables' own columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import adjacency, graph
from quillspark.plans.graphs import links
from quillspark.plans.registry import query
from quillspark.plans.retrieval import BM25_K, bm25_sql, lexical_list
from quillspark.sources import markdown, readers, scripture
from quillspark.storage import new_path, table

_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"


def _markdown_sql() -> str:
    top, sub = _SLUG.format("p_brand"), _SLUG.format("p_type")
    both = "p_brand || '/' || p_type"
    blocks = [  # line, kind, level, path, slug, text
        (1, "heading", 1, "p_brand", top, "p_brand"), (3, "paragraph", 0, "p_brand", top, "p_name || ' [a](http://' || p_partkey || ')'"),
        (6, "heading", 2, both, sub, "p_type"), (7, "quote", 0, both, sub, "'size ' || p_size || ' more'"),
        (10, "list", 0, both, sub, "'item'"), (11, "list", 0, both, sub, "'other'"), (12, "code", 0, both, sub, "'code  ' || p_partkey"),
        (15, "heading", 2, both, f"{sub} || '-1'", "p_type"), (16, "paragraph", 0, both, f"{sub} || '-1'", "'end'"),
    ]
    rows = " UNION ALL ".join(f"SELECT p_partkey, {i} AS position, {line} AS line, '{kind}' AS kind, {level} AS level, {path} AS path, {slug} AS slug, {text} AS text FROM part" for i, (line, kind, level, path, slug, text) in enumerate(blocks))
    return f"SELECT p_partkey::VARCHAR AS source_id, position::BIGINT AS position, line::BIGINT AS line, kind, level::INT AS level, path, slug, text, sha256(kind || chr(10) || path || chr(10) || text) AS block_hash FROM ({rows})"


@query(_markdown_sql())
def markdown_blocks(spark, d):
    """Every part as a Markdown page: headings with slugs, kinds of blocks, and a hash of each."""
    text = F.concat(
        F.lit("# "), "p_brand", F.lit("\n\n"), "p_name", F.lit("\n[a](http://"), F.col("p_partkey").cast("string"), F.lit(")\n\n## "), "p_type", F.lit("\n> size "), F.col("p_size").cast("string"),
        F.lit("\n> more\n\n- item\n- other\n```\ncode  "), F.col("p_partkey").cast("string"), F.lit("\n```\n## "), "p_type", F.lit("\nend\n"))
    x = markdown.with_block_hash(markdown.parse(table(spark, d, "part").select(F.col("p_partkey").alias("source_id"), text.alias("text"))))
    return x.select("source_id", "position", "line", "kind", "level", F.array_join("heading_path", "/").alias("path"), "slug", "text", "block_hash")


_FRAMED = "strlen(coalesce({0}, '')) || ':' || coalesce({0}, '')"


@query(f"""WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS work, CASE WHEN p_partkey % 11 <> 0 THEN 'v1' END AS version, CASE WHEN p_partkey % 11 <> 0 THEN CASE WHEN p_size % 5 = 0 THEN '' ELSE 'size=' || p_size END END AS c,
  CASE WHEN p_partkey % 11 <> 0 THEN CASE WHEN p_size % 7 = 0 THEN ' ' ELSE p_name || ' "' || p_type || '"' END END AS t FROM part)
SELECT CASE WHEN k % 11 <> 0 THEN 'part ' || k END AS citation, 'cjson:v1:' || sha256({_FRAMED.format('work')} || {_FRAMED.format('version')} || {_FRAMED.format('c')} || {_FRAMED.format('sha256(t)')}) AS unit_id,
CASE WHEN k % 11 = 0 THEN 'malformed' WHEN c = '' THEN 'no_components' WHEN trim(t) = '' THEN 'no_text' END AS fault FROM p""")
def canonical_records(spark, d):
    """Parts as canonical JSON lines, some cut off, without components or without text."""
    p = table(spark, d, "part")
    none = F.array().cast("array<struct<level:string,value:string,ordinal:int>>")
    components = F.when(F.col("p_size") % 5 == 0, none).otherwise(F.array(F.struct(F.lit("size").alias("level"), F.col("p_size").cast("string").alias("value"), F.lit(1).alias("ordinal"))))
    text = F.when(F.col("p_size") % 7 == 0, F.lit(" ")).otherwise(F.concat("p_name", F.lit(' "'), "p_type", F.lit('"')))
    line = F.to_json(F.struct(F.lit("parts").alias("source_profile"), F.col("p_brand").alias("work_id"), F.lit("v1").alias("version_id"), components.alias("components"), F.concat(F.lit("part "), "p_partkey").alias("display_citation"), text.alias("text")))
    path = new_path(spark, "canonical")
    p.select(F.when(F.col("p_partkey") % 11 == 0, F.substring(line, 1, 40)).otherwise(line).alias("value")).write.text(path)
    return readers.read_canonical(spark, path).select(F.col("display_citation").alias("citation"), "unit_id", "fault")


@query("""WITH u AS (SELECT CASE WHEN p_partkey % 17 = 0 THEN p_partkey - 1 ELSE p_partkey END AS id, p_partkey % 13 = 0 AS wrong FROM part), r AS (SELECT DISTINCT unnest([l_partkey, l_partkey + 1]) AS id FROM lineitem)
SELECT 'u' || id AS unit_id, 'repeated_id' AS fault FROM u GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'u' || id, 'text_hash' FROM u WHERE wrong UNION ALL SELECT 'u' || id, 'relation_end' FROM r WHERE id NOT IN (SELECT id FROM u)""")
def package_faults(spark, d):
    """Parts as a package whose ids repeat, whose hashes are of other texts, and whose relations lead nowhere, at times."""
    p = table(spark, d, "part")
    unit = F.concat(F.lit("u"), F.when(F.col("p_partkey") % 17 == 0, F.col("p_partkey") - 1).otherwise(F.col("p_partkey")))
    units = p.select(unit.alias("unit_id"), F.col("p_name").alias("text"), F.sha2(F.when(F.col("p_partkey") % 13 == 0, F.concat("p_name", F.lit("x"))).otherwise(F.col("p_name")), 256).alias("text_hash"))
    ends = table(spark, d, "lineitem").select(F.concat(F.lit("u"), "l_partkey").alias("from_unit_id"), F.concat(F.lit("u"), F.col("l_partkey") + 1).alias("to_unit_id"))
    return readers.package_faults(units, ends)


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS c, p_name AS a, p_type AS b FROM part)
SELECT k::VARCHAR AS source_id, 0::BIGINT AS position, 'Verse' AS kind, 'BK' || k % 60 AS book, c::INT AS chapter, '1' AS verse, a AS text FROM p UNION ALL SELECT k::VARCHAR, 1, 'Footnote', 'BK' || k % 60, c, '1', b FROM p UNION ALL SELECT k::VARCHAR, 2, 'Verse', 'BK' || k % 60, c, '2', b || ' again' FROM p""")
def scripture_units(spark, d):
    """Every part as a small book in one of four formats, which all give the same units."""
    k, c = F.concat(F.lit("BK"), F.col("p_partkey") % 60), F.col("p_size").cast("string")
    usfm = F.concat(F.lit("\\id "), k, F.lit(" x\n\\c "), c, F.lit("\n\\p\n\\v 1 "), "p_name", F.lit(" \\f + \\ft "), "p_type", F.lit("\\f*\n\\v 2 "), "p_type", F.lit(" again\n"))
    usx = F.concat(F.lit('<usx version="3.0"><book code="'), k, F.lit('"/><chapter number="'), c, F.lit('" sid="x"/><para style="p"><verse number="1" sid="a"/>'), "p_name", F.lit(" <note>"), "p_type", F.lit('</note><verse eid="a"/><verse number="2" sid="b"/>'), "p_type", F.lit(' again<verse eid="b"/></para></usx>'))
    osis = F.concat(F.lit('<osis><osisText><div type="book" osisID="'), k, F.lit('"><chapter osisID="x.'), c, F.lit('"><verse osisID="x.1.1">'), "p_name", F.lit(" <note>"), "p_type", F.lit('</note></verse><verse osisID="x.1.2">'), "p_type", F.lit(" again</verse></chapter></div></osisText></osis>"))
    verse = lambda n: F.concat(F.lit('{"type": "verse", "number": "'), F.lit(n), F.lit('"}'))
    usj = F.concat(F.lit('{"type": "USJ", "content": [{"type": "book", "code": "'), k, F.lit('", "content": []}, {"type": "chapter", "number": "'), c, F.lit('"}, {"type": "para", "content": ['), verse("1"), F.lit(', "'), "p_name", F.lit(' ", {"type": "note", "content": ["'), "p_type", F.lit('"]}, '), verse("2"), F.lit(', "'), "p_type", F.lit(' again"]}]}'))
    n = F.col("p_partkey") % 4
    x = table(spark, d, "part").select(F.col("p_partkey").alias("source_id"), F.element_at(F.array(*map(F.lit, ["usfm", "usx", "osis", "usj"])), (n + 1).cast("int")).alias("parser"), F.when(n == 0, usfm).when(n == 1, usx).when(n == 2, osis).otherwise(usj).alias("text"))
    return scripture.parse(x)


_REFERENCES = """x AS (SELECT l_orderkey * 10 + l_linenumber AS ref_id, n_name AS alias, n_nationkey AS b, 1 + l_partkey % 6 AS c, 1 + l_suppkey % 40 AS v, l_linenumber AS e, l_partkey % 3 AS how FROM lineitem JOIN nation ON n_nationkey = l_orderkey % 25)"""


def _references(spark, d):
    """Lines of orders as references to chapters and verses of nations, in three forms; a tenth are something else."""
    x = table(spark, d, "lineitem").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("l_orderkey") % 25)
    c, v, how = (1 + F.col("l_partkey") % 6).cast("string"), (1 + F.col("l_suppkey") % 40).cast("string"), F.col("l_partkey") % 3
    text = F.when(how == 0, F.concat_ws(" ", "n_name", c)).when(how == 1, F.concat("n_name", F.lit(" "), c, F.lit(":"), v)).otherwise(F.concat(F.lit("  "), F.lower("n_name"), F.lit("  "), c, F.lit(":"), v, F.lit("-"), F.col("l_linenumber").cast("string")))
    return x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"), F.when(F.col("l_orderkey") % 10 == 3, F.concat(F.lit("see "), "n_name")).otherwise(text).alias("text"))


@query(f"""WITH {_REFERENCES} SELECT ref_id, lower(alias) AS book, c::INT AS chapter, CASE WHEN how > 0 THEN v END::INT AS verse, CASE WHEN how = 2 THEN e END::INT AS end_verse FROM x WHERE ref_id // 10 % 10 <> 3""")
def scripture_references(spark, d):
    x = _references(spark, d).withColumn("r", scripture.reference(F.col("text"))).filter("r IS NOT NULL")
    return x.select("ref_id", "r.book", "r.chapter", "r.verse", "r.end_verse")


@query(f"""WITH {_REFERENCES} SELECT ref_id, 'B' || b AS book, c::INT AS chapter, CASE WHEN how > 0 THEN v END::INT AS verse, c <= 5 AND (how = 0 OR v <= 10 + b) AS exists FROM x WHERE ref_id // 10 % 10 <> 3""")
def scripture_lookup(spark, d):
    n = table(spark, d, "nation")
    book = F.concat(F.lit("B"), F.col("n_nationkey").cast("string")).alias("book")
    bounds = n.select(book, F.explode(F.sequence(F.lit(1), F.lit(5))).alias("chapter"), (10 + F.col("n_nationkey")).cast("int").alias("verses"))
    return scripture.looked_up(_references(spark, d), n.select(F.col("n_name").alias("alias"), book), bounds)


@query(f"""WITH {_REFERENCES}, t AS (SELECT ref_id, alias, how, CASE WHEN ref_id // 10 % 10 = 3 THEN 'see ' || alias WHEN how = 0 THEN alias || ' ' || c WHEN how = 1 THEN alias || ' ' || c || ':' || v ELSE '  ' || lower(alias) || '  ' || c || ':' || v || '-' || e END AS text FROM x)
SELECT ref_id, CASE WHEN ref_id // 10 % 10 <> 3 AND how > 0 THEN 'verses' WHEN ref_id // 10 % 10 <> 3 THEN 'chapters' WHEN strpos(alias, 'A') > 0 THEN 'names' END AS profile FROM t""")
def reference_profiles(spark, d):
    """The first of several ways to read a reference that is sure of it."""
    r = scripture.reference(F.col("text"))
    ways = {"verses": r["verse"].isNotNull(), "chapters": r["chapter"].isNotNull(), "names": F.col("text").rlike("^see .*A")}
    return _references(spark, d).select("ref_id", X.first_profile(F.col("text"), ways).alias("profile"))


@query(f"""WITH {bm25_sql('r', k=5)} SELECT query_id, chunk_id, round(score, 6) AS score, rank, source, replace(replace(substr(text, 1, 60), chr(10), '", '), chr(13), '') AS snippet FROM r JOIN documents ON doc_id = chunk_id""")
def written_results(spark, d):
    """Results with quotes, commas and separators in their snippets, written as CSV and read back."""
    hits = lexical_list(spark, d, 5)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source", F.replace(F.replace(F.substring("text", 1, 60), F.lit("\n"), F.lit('", ')), F.lit("\r"), F.lit("")).alias("snippet"))
    path = new_path(spark, "results")
    readers.write_results(hits.join(docs, "chunk_id"), path, "csv")
    back = spark.read.schema("query_id long, rank int, chunk_id long, score double, source string, snippet string").option("header", "true").option("escape", '"').csv(path)
    return back.select("query_id", "chunk_id", "score", "rank", "source", "snippet")


@query("""WITH e AS (SELECT DISTINCT a.l_partkey AS f, b.l_partkey AS t, a.l_orderkey % 40 AS s, a.l_orderkey % 40 = 7 AS gone FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber WHERE a.l_partkey <> b.l_partkey),
k AS (SELECT f, t, s FROM e WHERE NOT gone UNION SELECT DISTINCT t, f, s FROM e WHERE gone)
SELECT f AS node, t AS neighbour, s AS source_id, 'out' AS direction FROM k WHERE f % 50 = 0 UNION ALL SELECT t, f, s, 'in' FROM k WHERE t % 50 = 0""")
def adjacent_edges(spark, d):
    """Edges of some nodes in both directions, after one source's edges have been turned round."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    b = x.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("to_node"))
    e = x.join(b, ["l_orderkey", "l_linenumber"]).filter("l_partkey <> to_node").select(F.col("l_partkey").alias("from_node"), "to_node", F.lit("next").alias("edge_type"), F.lit(0).alias("ordinal"), (F.col("l_orderkey") % 40).alias("source_id")).distinct()
    turned = e.filter("source_id = 7").select(F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node"), "edge_type", "ordinal", "source_id")
    held = adjacency.kept(e)
    now = held.upserted(turned, turned.select("source_id"))
    nodes = links(spark, d).select(F.explode(F.array("from_node", "to_node")).alias("node")).filter("node % 50 = 0")
    out = now.at(nodes, ["next"]).select("node", "neighbour", "source_id", "direction")
    held.drop()
    return out


@query("""WITH u AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations)
SELECT 'next' AS edge_type, a.conv_id || '/' || a.turn AS from_node, b.conv_id || '/' || b.turn AS to_node FROM u a JOIN u b ON a.conv_id = b.conv_id AND a.n + 1 = b.n UNION ALL SELECT 'previous', b.conv_id || '/' || b.turn, a.conv_id || '/' || a.turn FROM u a JOIN u b ON a.conv_id = b.conv_id AND a.n + 1 = b.n
UNION ALL SELECT DISTINCT 'parent', conv_id || '/' || turn, conv_id || '/' || role FROM u UNION ALL SELECT DISTINCT 'child', conv_id || '/' || role, conv_id || '/' || turn FROM u
UNION ALL SELECT DISTINCT 'child', 'conv ' || conv_id, conv_id || '/' || role FROM u UNION ALL SELECT DISTINCT 'parent', conv_id || '/' || role, 'conv ' || conv_id FROM u""")
def structural_graph(spark, d):
    """Turns in order, under their role's section, under their conversation: one graph of all structural edges."""
    u = table(spark, d, "conversations").withColumns({"unit": F.concat("conv_id", F.lit("/"), "turn"), "section": F.concat("conv_id", F.lit("/"), "role"), "top": F.concat(F.lit("conv "), "conv_id")})
    return graph.structural_edges(u, "conv_id", ["turn"], "unit", ["section", "top"])
