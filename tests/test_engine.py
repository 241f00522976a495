"""Library functions against plain Python, fixtures and the SQL of every query on the smallest tables."""

import json
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark import storage
from quillspark.engine import Engine
from quillspark.functions import text as X
from quillspark.functions import vector as V
from quillspark.operators import catalog, decisions, dense, evaluate, filters, fusion, graph, ingest, lexical
from quillspark.operators.components import components
from quillspark.plans import policies
from quillspark.plans.catalog import oracle_sql, queries
from quillspark.sources import markdown, readers, scripture
from quillspark.streaming import incremental

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(rows):
    value = lambda x: round(x, 9) + 0.0 if isinstance(x, float) else x
    return sorted((tuple(map(value, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = queries()[name](spark, DATA)
    columns = sorted(df.columns)
    sql = oracle_sql()[name]
    assert sorted(duck.sql(sql).columns) == columns
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({sql})").fetchall()
    assert plain(df.select(*columns).collect()) == plain(want)


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", list: "array<double>"}
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) and v and isinstance(v[0], str) else kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_token_estimate_equals_the_fold(spark):
    rng = random.Random(1)
    texts = ["", "a" * 24, "a" * 25, "abc def", "é漢字", "x.y"] + ["".join(rng.choice("ab1 .é\n") for _ in range(rng.randint(0, 90))) for _ in range(100)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.token_estimate(F.col("t"))).collect()
    assert all(n == ingest.estimate(t) for t, n in rows)


def test_text_functions(spark):
    t = F.col("t")
    assert one(spark, X.heading_slug(t), t="  Hello, World! ") == "hello-world" and one(spark, X.heading_slug(t), t="漢字") == "section"
    assert one(spark, X.citation_labels(t), t="a [E2, E10] b [E1] [x] E3") == ["E1", "E10", "E2"]
    assert one(spark, X.citations_resolved(t, F.array(F.lit("E1"))), t="so [E1]") is True
    assert one(spark, X.source_span(t), t="a:b:3-9") == ("a:b", 3, 9) and one(spark, X.source_span(t), t="a-3") is None
    assert one(spark, X.lookup_key(t), t="!!").startswith("raw:") and one(spark, X.normalize_key(t), t=" A--b ") == "a b"
    assert one(spark, X.logical_path(t), t="a\\.\\b//c/.") == "a/b/c"
    assert one(spark, X.ignored(t, ["*.tmp"]), t="x/y.tmp") and not one(spark, X.ignored(t, ["x/*.md"]), t="y/x/a.md") and one(spark, X.ignored(t, ["build/"], F.lit(True)), t="a/build")
    assert one(spark, X.line_at(t, F.lit(4)), t="é\na\nb") == 2
    assert one(spark, X.support_score(F.lit(""), t), t="x") == 0
    assert one(spark, X.embedding_budget(F.lit(1)), t="") == 1


def test_vector_functions(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, V.cosine(a, b), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, V.cosine(a, b), a=[0.0, 0.0], b=[1.0, 1.0]) is None and one(spark, V.l2(a, b), a=[1.0], b=[1.0, 2.0]) is None
    assert one(spark, V.is_unit(a), a=[0.6, 0.8]) and not one(spark, V.is_unit(a), a=[float("nan"), 1.0])


def test_bm25_small_corpus(spark):
    docs = spark.createDataFrame([(1, "the quick fox"), (2, "lazy dogs sleep"), (3, "fox fox den"), (4, "a"), (5, "b"), (6, "c")], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "Fox?"), (2, "nothing here"), (3, "")], "query_id long, text string")
    rows = lexical.bm25_top_k(docs, q, 5).orderBy("rank").collect()
    assert [(r["query_id"], r["chunk_id"]) for r in rows] == [(1, 3), (1, 1)]


def test_dense_blocks_give_the_same(spark, monkeypatch):
    v = spark.createDataFrame([(i, [math.sin(i), math.cos(i), i / 50]) for i in range(50)] + [(99, None), (98, [1.0])], "chunk_id long, embedding array<double>")
    q = v.filter("chunk_id < 7").withColumnRenamed("chunk_id", "query_id")
    whole = plain(dense.dense_top_k(v, q, 4).collect())
    monkeypatch.setattr(dense, "QUERY_BLOCK", 2)
    assert plain(dense.dense_top_k(v, q, 4).collect()) == whole and len(whole) == 28
    assert dense.dense_top_k(v, q.limit(0), 4).count() == 0


def test_fusion(spark):
    rows = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (1, 20, 1), (1, 30, 2)], "query_id long, chunk_id long, rank int")
    out = fusion.rrf(rows, 10).orderBy("rank").collect()
    assert [r["chunk_id"] for r in out] == [20, 10, 30] and out[0]["score"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-6)
    with pytest.raises(ValueError):
        fusion.weighted(rows, {"a": 0.5}, 3)
    last = out[0]
    assert [r["chunk_id"] for r in fusion.after(fusion.rrf(rows, 10), last["score"], last["chunk_id"], 5).collect()] == [10, 30]


def test_filters(spark):
    chunks = spark.range(4).withColumnRenamed("id", "chunk_id")
    evidence = spark.createDataFrame([(0, "Text"), (0, "Image"), (1, "Text"), (1, "Generated"), (2, None)], "chunk_id long, kind string")
    assert [r[0] for r in filters.source_bounded(chunks, evidence).collect()] == [0]
    assert filters.in_scope(chunks.withColumn("source", F.lit("a")), spark.createDataFrame([], "source string")).count() == 0
    rows = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "id long, version long")
    t = spark.createDataFrame([(1, 5, 1), (2, 4, 1), (3, 9, 7)], "id long, version long, generation long")
    assert sorted(r["id"] for r in filters.without_tombstones(rows, t, 3).collect()) == [2, 3]
    with pytest.raises(ValueError):
        filters.compiled([])


def plain_children(units, target, overlap):
    limit, out, text, first, last = target + target // 5, [], "", None, None
    for p, u in units:
        if text and ingest.estimate(f"{text} {u}") > limit:
            out.append((text, first, last))
            tail = text[ingest.overlap_start(text, overlap) :].strip()
            text, first = (f"{tail} {u}" if tail else u), p
        else:
            text, first = (f"{text} {u}" if text else u), p if first is None else first
        last = p
    return out + ([(text, first, last)] if text else [])


def test_children_and_parents(spark):
    rng = random.Random(2)
    units = [(s, 0, p, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 60)))) for s in (1, 2) for p in range(25)]
    got = ingest.children(spark.createDataFrame(units, "source_id long, boundary long, position long, text string"), 40, 8)
    for s in (1, 2):
        rows = got.filter(F.col("source_id") == s).orderBy("child").collect()
        assert [(r["text"], r["first_unit"], r["last_unit"]) for r in rows] == plain_children([(p, t) for x, _, p, t in units if x == s], 40, 8)
    parents = ingest.parents(got)
    assert parents.agg(F.sum("n_children")).first()[0] == got.count() and got.select("chunk_id").distinct().count() == got.count()
    assert ingest.overlap_start("aaaa bbbb", 1) == 5 and ingest.overlap_start("ab", 5) == 0


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6)], "from_node long, to_node long")
    seeds = spark.createDataFrame([(1, 1.0)], "seed long, score double")
    assert {(r["node"], r["hop"], r["score"]) for r in graph.hops(edges, seeds, 2).collect()} == {(2, 1, 0.5), (3, 2, 0.25)}
    closed = spark.createDataFrame([(2,)], "node long")
    assert {r["node"] for r in graph.hops(edges, seeds, 3, closed).collect()} == {2}
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = components(chain).groupBy("root").count().collect()
    assert sorted(r["count"] for r in got) == [2, 201]


def test_catalog_and_evaluation(spark):
    g = spark.createDataFrame([("p", i, 5) for i in range(1, 8)], "profile string, generation long, current long")
    assert sorted(r["generation"] for r in catalog.collectable(g, 2).collect()) == [1, 2]
    truth = spark.createDataFrame([(1, c) for c in (1, 2, 3, 4)], "query_id long, chunk_id long")
    pool = spark.createDataFrame([(1, c) for c in (1, 2, 5, 6)], "query_id long, chunk_id long")
    r = evaluate.recall(pool, pool.filter("chunk_id = 1"), truth, 3).first()
    assert (r["candidate"], r["final"]) == (2, 1)
    gates = {r["metric"]: r["verdict"] for r in evaluate.gates(spark.createDataFrame([("a", 0.5)], "metric string, value double"), {"a": 0.9, "b": 0.1, "c": 0.1}, ["b"]).collect()}
    assert gates == {"a": "fail", "b": "missing"}


def test_policies(spark):
    c = policies.Cursor("q", 3, "me", 0.5, 7, 100.0)
    sealed = policies.seal(c, b"k")
    assert policies.open_cursor(sealed, b"k", "q", 3, "me", 50) == c
    for bad in ((sealed + " ", b"k", "q", 3, "me", 50), (sealed, b"k", "q", 4, "me", 50), (sealed, b"k", "q", 3, "me", 500)):
        with pytest.raises(ValueError):
            policies.open_cursor(*bad)
    assert one(spark, decisions.overfetch(F.col("k"), F.col("a"), F.col("n")), k=10, a=5, n=10_000) == 256 and one(spark, decisions.overfetch(F.col("k"), F.col("a"), F.col("n")), k=10, a=9, n=10_000) is None
    assert one(spark, decisions.overfetch(F.col("k"), F.col("a"), F.col("n")), k=10, a=3, n=12) == 12
    assert one(spark, decisions.may_claim(F.col("r"), F.col("c")), r="exhaustive", c="All") and not one(spark, decisions.may_claim(F.col("r"), F.col("c")), r="top_k", c="All")


USFM = "\\id JHN Test\n\\c 3\n\\p\n\\v 16 For God \\f + \\ft a note\\f* so loved\n\\v 17 next \\nd Lord\\nd* verse\n"
USX = '<usx version="3.0"><book code="JHN"/><chapter number="3" sid="JHN 3"/><para style="p"><verse number="16" sid="JHN 3:16"/>For God <note>a note</note>so loved<verse eid="JHN 3:16"/><verse number="17" sid="x"/>next Lord verse<verse eid="x"/></para></usx>'
OSIS = '<osis><osisText><div type="book" osisID="JHN"><chapter osisID="JHN.3"><verse osisID="JHN.3.16">For God <note>a note</note>so loved</verse><verse osisID="JHN.3.17">next Lord verse</verse></chapter></div></osisText></osis>'
USJ = json.dumps({"type": "USJ", "content": [{"type": "book", "code": "JHN", "content": ["x"]}, {"type": "chapter", "number": "3"}, {"type": "para", "content": [{"type": "verse", "number": "16"}, "For God ", {"type": "note", "content": ["a note"]}, "so loved ", {"type": "verse", "number": "17"}, "next Lord verse"]}]})


def test_scripture_formats_agree(spark):
    files = spark.createDataFrame([("a", "usfm", USFM), ("b", "usx", USX), ("c", "osis", OSIS), ("d", "usj", USJ), ("e", "usx", "<broken")], "source_id string, parser string, text string")
    want = [("Verse", "JHN", 3, "16", "For God so loved"), ("Footnote", "JHN", 3, "16", "a note"), ("Verse", "JHN", 3, "17", "next Lord verse")]
    rows = scripture.parse(files).orderBy("source_id", "position").collect()
    for s in "abcd":
        assert [tuple(r)[2:] for r in rows if r["source_id"] == s] == want, s
    assert [r["kind"] for r in rows if r["source_id"] == "e"] == ["Fault"]
    assert one(spark, scripture.reference(F.col("t")), t="1 John 3:16-4:2") == ("1 john", 3, 16, 4, 2)
    refs = spark.createDataFrame([(1, "Jn 3:16"), (2, "John 3:99"), (3, "John 3"), (4, "x")], "ref_id long, text string")
    got = scripture.looked_up(refs, spark.createDataFrame([("jn", "JHN"), ("John", "JHN")], "alias string, book string"), spark.createDataFrame([("JHN", 3, 36)], "book string, chapter int, verses int"))
    assert sorted((r["ref_id"], r["exists"]) for r in got.collect()) == [(1, True), (2, False), (3, True)]


def test_markdown(spark):
    text = "# Top\n\npara one\nline two [a](http://x)\n\n## Sub\n> quoted\n> more\n\n- item\n- other\n\n```\ncode  here\n```\n## Sub\nend"
    rows = markdown.parse(spark.createDataFrame([("f", text)], "source_id string, text string")).orderBy("position").collect()
    assert [(r["kind"], r["text"], r["slug"]) for r in rows] == [("heading", "Top", "top"), ("paragraph", "para one line two [a](http://x)", "top"), ("heading", "Sub", "sub"), ("quote", "quoted more", "sub"), ("list", "item", "sub"), ("list", "other", "sub"), ("code", "code  here", "sub"), ("heading", "Sub", "sub-1"), ("paragraph", "end", "sub-1")]
    assert rows[1]["links"] == ["http://x"] and rows[3]["heading_path"] == ["Top", "Sub"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one\ntwo\n\nthree")
    (tmp_path / "in/b.md").write_text("# T\nbody")
    (tmp_path / "in/c.json").write_text('{"a": {"b": [1, null, " x "]}, "c": ""}')
    (tmp_path / "in/skip.tmp").write_text("no")
    (tmp_path / "in/v.usfm").write_text(USFM)
    e = Engine(spark, str(tmp_path / "e"))
    got = {(os.path.basename(r["source_id"]), r["kind"], r["text"]) for r in e.ingest_folder(str(tmp_path / "in"), ["*.tmp"]).collect()}
    assert {("a.txt", "paragraph", "one two"), ("a.txt", "paragraph", "three"), ("b.md", "heading", "T"), ("c.json", "scalar", "a.b[0]: 1"), ("c.json", "scalar", "a.b[2]: x"), ("v.usfm", "Verse", "For God so loved")} <= got
    good = {"source_profile": "p", "work_id": "w", "version_id": None, "components": [{"level": "chapter", "value": "1", "ordinal": 1}], "display_citation": "c", "text": "t", "metadata": {}}
    (tmp_path / "c.jsonl").write_text(json.dumps(good) + "\n" + json.dumps(good | {"components": []}) + "\n{bad\n")
    assert sorted(str(r["fault"]) for r in readers.read_canonical(spark, str(tmp_path / "c.jsonl")).collect()) == ["None", "malformed", "no_components"]
    units = spark.createDataFrame([("u1", "x", "bad")], "unit_id string, text string, text_hash string")
    rel = spark.createDataFrame([("u1", "u9")], "from_unit_id string, to_unit_id string")
    assert {tuple(r) for r in readers.package_faults(units, rel).collect()} == {("u1", "text_hash"), ("u9", "relation_end")}
    rows = spark.createDataFrame([(1, 1, 5, 0.5, "s", 'say "hi", you')], "query_id long, rank int, chunk_id long, score double, source string, snippet string")
    for kind in ("csv", "tsv", "json", "markdown", "snippets"):
        readers.write_results(rows, str(tmp_path / kind), kind)
    assert spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv")).first()["snippet"] == 'say "hi", you'


def test_engine_round_trip(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.ingest(spark.createDataFrame([(1, "alpha beta\ngamma"), (2, "delta alpha alpha"), (3, "x"), (4, "y"), (5, "z")], "source_id long, text string"))
    q = spark.createDataFrame([(1, "alpha")], "query_id long, text string")
    hits = e.retrieve(q)
    assert [r["source_id"] for r in hits.orderBy("rank").collect()] == [2, 1]
    assert e.retrieve(q, scope=spark.createDataFrame([(1,)], "source_id long")).count() == 1
    assert sorted(r["text"] for r in e.evidence(hits).collect()) == ["alpha beta", "delta alpha alpha", "gamma"]
    assert e.generation() == 1 and e.ingest(spark.createDataFrame([(1, "new")], "source_id long, text string")) == 2


def test_publishing_takes_one_writer_a_generation(spark, tmp_path):
    root, rows = str(tmp_path / "r"), spark.range(3)
    assert storage.generation(spark, root) == 0 and storage.publish(spark, root, {"x": rows}, after=0) == 1
    with pytest.raises(RuntimeError):
        storage.publish(spark, root, {"x": spark.range(5)}, after=0)
    assert storage.published(spark, root, "x").count() == 3 and sorted(x for x in os.listdir(root) if not x.startswith(".")) == ["claim=1", "gen=1"]
    e = Engine(spark, str(tmp_path / "e"))
    e.ingest(spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "source_id long, text string"))
    assert e.replace(spark.createDataFrame([(2, "zwei"), (3, None), (4, "vier")], "source_id long, text string")) == 2
    assert sorted(r["text"] for r in e.table("units").collect()) == ["one", "vier", "zwei"] == sorted(r["text"] for r in e.table("chunks").collect())


def test_streams(spark, tmp_path):
    src, units, checkpoint = (str(tmp_path / x) for x in ("sources", "units", "cp"))
    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        incremental.start_ingest(incremental.watch_files(spark, str(folder)), src, units, checkpoint).awaitTermination()

    (folder / "a.txt").write_text("one\ntwo")
    (folder / "b.txt").write_text("three")
    run()
    (folder / "c.txt").write_text("four")
    run()
    assert sorted(r["text"] for r in incremental.current_units(spark, src, units).collect()) == ["four", "one", "three", "two"]
    again = spark.createDataFrame([("s", "one", 1), ("s", "one\nmore", 2)], "source_id string, text string, version long")
    incremental.ingest_changed(again, src, units)
    incremental.ingest_changed(again, src, units)
    assert sorted(r["text"] for r in incremental.current_units(spark, src, units).filter("source_id = 's'").collect()) == ["more", "one"]
    state = str(tmp_path / "state")
    incremental.applied_mutations(spark.createDataFrame([(1, 1, "put", "a"), (2, 1, "put", "b")], "id long, version long, op string, value string"), state)
    incremental.applied_mutations(spark.createDataFrame([(1, 2, "delete", None), (2, 0, "put", "old")], "id long, version long, op string, value string"), state)
    assert sorted((r["id"], r["op"], r["value"]) for r in storage.published(spark, state, "rows").collect()) == [(1, "delete", None), (2, "put", "b")]
    events = spark.readStream.schema(spark.read.parquet(f"{DATA}/events.parquet").schema).parquet(DATA + "/events*") if os.path.isdir(DATA) else None
    if events is not None:
        q = incremental.event_counts(events).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.sql("SELECT sum(n) FROM counts").first()[0] == spark.read.parquet(f"{DATA}/events.parquet").count()


def test_reranking_keeps_the_fused_order_without_relevance(spark):
    fused = spark.createDataFrame([(1, c, 1.0 / c, c) for c in range(1, 6)] + [(2, c, 1.0 / c, c) for c in range(1, 4)], "query_id long, chunk_id long, score double, rank int")
    got = spark.createDataFrame([(1, 3, 0.9), (1, 2, 0.9), (1, 1, float("nan")), (1, 4, None), (1, 2, 0.1), (1, 5, 1.0), (2, 1, float("inf")), (3, 1, 1.0)], "query_id long, chunk_id long, relevance double")
    rows = {(r["query_id"], r["rank"]): r["chunk_id"] for r in fusion.reranked(fused, got, 4).collect()}
    assert rows == {(1, 1): 2, (1, 2): 3, (2, 1): 1, (2, 2): 2, (2, 3): 3}
    assert fusion.reranked(fused.limit(0), got).count() == 0


def test_source_pack_labels_each_evidence_once(spark):
    hits = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 12)], "query_id long, rank int, chunk_id long")
    evidence = spark.createDataFrame([(10, "a"), (11, "a"), (11, "b"), (12, "c")], "chunk_id long, evidence_id string")
    rows = {(r["query_id"], r["label"]): (r["evidence_id"], r["chunk_id"]) for r in fusion.source_pack(hits, evidence, 2).collect()}
    assert rows == {(1, "E1"): ("a", 10), (1, "E2"): ("b", 11), (2, "E1"): ("c", 12)}


def test_selections(spark):
    chosen = spark.createDataFrame([(1, i, e) for i, e in enumerate(["a", "a", "b", "c", "x"])], "answer long, position long, evidence_id string")
    stored = spark.createDataFrame([("a", "Text", True), ("b", "Text", False), ("c", "Report", True)], "evidence_id string, kind string, allowed boolean")
    assert [r["verdict"] for r in evaluate.selections(chosen, stored, ["Text"]).orderBy("position").collect()] == ["ok", "repeated", "not_allowed", "not_citable", "unknown"]


def test_diversity_equals_brute_force(spark):
    rng = random.Random(5)
    v = {c: [rng.uniform(-1, 1) for _ in range(4)] for c in range(20)}
    s = {(q, c): round(rng.random(), 6) for q in (1, 2) for c in range(20)}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    want = []
    for q in (1, 2):
        taken = []
        for rank in range(1, 8):
            c = min((c for c in v if c not in taken), key=lambda c: (-round(0.7 * s[q, c] - 0.3 * max([cos(v[c], v[t]) for t in taken], default=0), 6), c))
            taken.append(c)
            want.append((q, c, rank))
    pool = spark.createDataFrame([(q, c, x) for (q, c), x in s.items()], "query_id long, chunk_id long, score double")
    got = evaluate.diversified(pool, spark.createDataFrame(list(v.items()), "chunk_id long, embedding array<double>"), 7)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def canonical_by_hand(units, target, overlap, most):
    """Runs first (book, chapter, size), then chunks inside each run."""
    runs, before, used = [], None, 0
    for u in units:
        cost = ingest.estimate(u[3])
        book = before is None or u[1] is None or u[1] != before[1]
        turned = not book and before[2] is not None and u[2] != before[2]
        if book or turned or len(runs[-1]) >= most or used + cost > 2 * target:
            runs.append([])
            used = 0
        runs[-1].append(u)
        used, before = used + cost, u
    out = []
    for run in runs:
        start = at = 0
        while at < len(run):
            at += 1
            full = at < len(run) and (at - start >= most or ingest.estimate(" ".join(x[3] for x in run[start : at + 1])) > target + target // 5)
            if full or at == len(run):
                out.append((run[start][0], run[at - 1][0], at - start))
                start = max(start + 1, at - overlap)
    return out


def test_canonical_chunks_equal_runs_and_windows(spark):
    rng = random.Random(3)
    units, book, chapter = [], "a", 1
    for i in range(300):
        book = rng.choice([None, "b", "c"]) if rng.random() < 0.03 else book
        chapter = chapter + 1 if rng.random() < 0.05 else chapter
        units.append((i, book, chapter, " ".join(rng.choice(["grace", "и", "peace1"]) for _ in range(rng.randint(1, 30)))))
    df = spark.createDataFrame([(7, *u) for u in units], "source_id long, position long, book string, chapter long, text string")
    for target, overlap, most in ((40, 2, 6), (300, 2, 20), (25, 0, 3)):
        got = ingest.canonical_children(df, target, overlap, most).orderBy("boundary", "child").collect()
        assert [(r["first_unit"], r["last_unit"], r["n_units"]) for r in got] == canonical_by_hand(units, target, overlap, most)



def test_spans_point_at_equal_bytes(spark):
    rng = random.Random(8)
    units = [(s, b, p, " ".join(rng.choice(["a1", "שלום", "naïve", "日本", "tail\t", " x"]) for _ in range(rng.randint(1, 25)))) for s in (1, 2) for b in (0, 1) for p in range(40)]
    df = spark.createDataFrame(units, "source_id long, boundary long, position long, text string")
    source = {(s, b, p): t.encode() for s, b, p, t in units}
    made = ingest.children(df, 40, 8)
    chunks = made.collect()
    assert any(r["spans"][0]["unit"] < r["first_unit"] for r in chunks)
    for r in chunks:
        at = 0
        for s in r["spans"]:
            assert r["text"].encode()[s["chunk_start"] : s["chunk_end"]] == source[r["source_id"], r["boundary"], s["unit"]][s["evidence_start"] : s["evidence_end"]]
            assert s["chunk_start"] == at
            at = s["chunk_end"] + 1
        assert at == len(r["text"].encode()) + 1
    whole = {(r["source_id"], r["boundary"], r["parent"]): r["text"].encode() for r in ingest.parents(made).collect()}
    spans = ingest.parent_spans(made).collect()
    assert len(spans) == sum(len(r["spans"]) for r in chunks)
    for r in spans:
        assert whole[r["source_id"], r["boundary"], r["parent"]][r["chunk_start"] : r["chunk_end"]] == source[r["source_id"], r["boundary"], r["unit"]][r["evidence_start"] : r["evidence_end"]]


def test_mixed_chunks_keep_each_unit_with_its_chunker(spark):
    rows = [(1, 0, "verse one", 0, True, "John", 3), (1, 1, "a note", 0, False, None, None), (1, 2, "verse two", 0, True, "John", 3), (2, 0, "plain", 0, None, None, None)]
    df = spark.createDataFrame(rows, "source_id long, position long, text string, boundary long, canonical boolean, book string, chapter long")
    got = [(r["source_id"], r["place"], r["strategy"], r["text"]) for r in ingest.mixed_children(df).orderBy("source_id", "place").collect()]
    assert got == [(1, 0, "canonical", "verse one verse two"), (1, 1, "generic", "a note"), (2, 0, "generic", "plain")]
    assert ingest.mixed_children(df.limit(0)).count() == 0


def test_dense_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_BYTES", 640)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 3)
    rng = random.Random(4)
    point = lambda w: [float(rng.randint(-2, 2)) for _ in range(w)]
    held = [(i, point(4)) for i in range(90)] + [(100 + i, point(3)) for i in range(30)] + [(200, None), (201, [math.nan] * 4), (202, [])]
    asked = [(i, point(4)) for i in range(8)] + [(50 + i, point(3)) for i in range(4)] + [(60, None), (61, point(5)), (62, [])]
    want = []
    for q, x in asked:
        near = sorted((-round(sum(a * b for a, b in zip(x, v)), 6), c) for c, v in held if x and v and len(v) == len(x) and not math.isnan(v[0]))
        want += [(q, c, -s, n + 1) for n, (s, c) in enumerate(near[:7])]
    tables = [spark.createDataFrame(t, f"{n} long, embedding array<double>") for t, n in ((held, "chunk_id"), (asked, "query_id"))]
    assert sorted(map(tuple, dense.dense_top_k(*tables, 7, "dot").select("query_id", "chunk_id", "score", "rank").collect())) == sorted(want)
    assert dense.dense_top_k(tables[0].limit(0), tables[1], 7).count() == dense.dense_top_k(tables[0], tables[1].limit(0), 7).count() == 0
