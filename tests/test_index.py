"""The kept index, segments, publication after crashes, and dense search against plain versions."""

import math
import os
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark import storage
from quillspark.engine import Engine
from quillspark.operators import dense, lexical, postings
from quillspark.operators import scanned as scoring
from quillspark.operators.postings import Index, Scanned
from quillspark.plans import answers, retrieval
from quillspark.segments import Segments

DOCS = "chunk_id long, source_id string, text string, title string, lang string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


def some_docs(n=60, seed=1):
    rng = random.Random(seed)
    text = lambda most: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, most)))
    return [(i, f"s{i % 5}", text(25), text(4), None) for i in range(n)] + [(1000, "s0", None, None, "x"), (1001, None, "", "alpha", None)]


def plain_scores(rows, query, fields):
    """BM25 of the query's distinct terms, summed over weighted fields; rows without any of them are left out."""
    out = {}
    for at, boost in fields:
        texts = {r[0]: (r[at] or "").split() for r in rows}
        mean = sum(map(len, texts.values())) / len(texts)
        for t in set(query.split()):
            df = sum(t in w for w in texts.values())
            for i, w in texts.items():
                if tf := w.count(t):
                    idf = max(math.log((len(texts) - df + 0.5) / (df + 0.5)), 1e-6)
                    out[i] = out.get(i, 0) + boost * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return {i: round(v, 6) for i, v in out.items()}


def found(df):
    return {r["chunk_id"]: round(r["score"], 6) for r in df.collect()}


def near(a, b):
    return a.keys() == b.keys() and all(abs(a[k] - b[k]) < 2e-6 for k in a)


def files(root):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(f"{root}/segments") for f in names}


@pytest.mark.parametrize("most", [postings.MOST_TERMS, 0])
def test_index_follows_its_sources(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(postings, "MOST_TERMS", most)
    rows = some_docs()
    index = Index(Segments(spark, str(tmp_path)), fields=["text", "title"], keep=["lang"], buckets=4)
    q = spark.createDataFrame([(1, "alpha zeta"), (2, ""), (3, None), (4, "unheard")], "query_id long, text string")
    fields, weights = {"text": 1.0, "title": 2.0}, [(2, 1.0), (3, 2.0)]
    docs = spark.createDataFrame(rows, DOCS)
    assert index.maintain(docs) == {"status": "built", "reason": "no_index", "missing": 0, "orphan": 0}
    assert near(found(lexical.index_top_k(index, q, 1000, fields=fields)), plain_scores(rows, "alpha zeta", weights))
    assert index.maintain(docs)["status"] == "skipped"
    # one source has other chunks, one has none left, one is new
    before = files(tmp_path)
    new = [(i, "s1", "alpha alpha zeta beta", None, "y") for i in (1, 501)] + [(700, "s9", "zeta", "zeta", None)]
    rows = [r for r in rows if r[1] not in ("s1", "s2")] + new
    assert index.replace(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("s1",), ("s2",), ("s9",)], "source_id string")) == 2
    after = files(tmp_path)
    assert all(after[f] == t for f, t in before.items())
    assert near(found(lexical.index_top_k(index, q, 1000, fields=fields)), plain_scores(rows, "alpha zeta", weights))
    # faults are named and only the sources that have them are written again
    rows = [r for r in rows if r[0] != 501] + [(800, "s3", "alpha", "", None)]
    docs = spark.createDataFrame(rows, DOCS)
    assert {tuple(r) for r in index.faults(docs).collect()} == {(501, "orphan"), (800, "missing")}
    assert index.maintain(docs) == {"status": "repaired", "reason": "missing_rows", "missing": 1, "orphan": 1}
    newest = spark.read.parquet(f"{tmp_path}/segments/{index.store.segments()[-1]}/sources")
    assert {r[0] for r in newest.collect()} == {"s1", "s3"}
    assert near(found(lexical.index_top_k(index, q, 1000, fields=fields)), plain_scores(rows, "alpha zeta", weights))
    within = spark.createDataFrame([(r[0],) for r in rows if r[0] % 2], "chunk_id long")
    assert near(found(lexical.index_top_k(index, q, 1000, within=within)), plain_scores([r for r in rows if r[0] % 2], "alpha zeta", [(2, 1.0)]))
    index.merge()
    assert len(index.store.segments()) == 1 and index.maintain(docs)["status"] == "skipped"
    assert near(found(lexical.index_top_k(index, q, 1000, fields=fields)), plain_scores(rows, "alpha zeta", weights))
    assert len(index.store.vacuum(keep=0)) == 3 and near(found(lexical.index_top_k(index, q, 1000, fields=fields)), plain_scores(rows, "alpha zeta", weights))
    other = Index(index.store, fields=["text", "title"], keep=["lang"], buckets=8)
    assert other.maintain(docs)["reason"] == "version_mismatch" and other.maintain(docs)["status"] == "skipped"


def test_index_of_nothing(spark, tmp_path):
    index = Index(Segments(spark, str(tmp_path)), fields=["text"])
    index.build(spark.createDataFrame([], DOCS))
    q = spark.createDataFrame([(1, "alpha +beta")], "query_id long, text string")
    assert lexical.index_top_k(index, q, 5).count() == 0 == lexical.boolean_top_k(index, q, 5).count() == index.docs().count()
    index.replace(spark.createDataFrame([(1, "s", "alpha beta", "", "")], DOCS), spark.createDataFrame([("s",)], "source_id string"))
    assert lexical.boolean_top_k(index, q, 5).count() == 1


def test_search_scans_only_the_buckets_and_terms_asked_for(spark, tmp_path):
    index = Index(Segments(spark, str(tmp_path)), buckets=4)
    index.build(spark.createDataFrame(some_docs(), DOCS))
    x = index.postings(spark.createDataFrame([("alpha",)], "term string"))
    plan = x.select("chunk_id", "tf")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    bucket = spark.range(1).select(postings.bucket_of(F.lit("alpha"), 4)).first()[0]
    assert f"(bucket#" in scan and f"= {bucket})" in scan.replace(" IN (", " = ") and "EqualTo(term,alpha)" in scan.replace("In(term, [alpha])", "EqualTo(term,alpha)")
    assert "positions" not in scan.partition("ReadSchema")[2]


@pytest.mark.parametrize("k, first", [(1, 8), (3, 1), (10, 1), (10, 8), (500, 8)])
def test_pruned_search_equals_scoring_every_posting(spark, tmp_path, monkeypatch, k, first):
    """Frequent and rare words, ties, repeated texts, sources replaced since; queries whose words all, some or none are rare."""
    monkeypatch.setattr(lexical, "FIRST", first)
    rng = random.Random(k + first)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=n))
    rows = [(i, f"s{i % 4}", text(rng.choice([0, 1, 5, 30, 200])), text(rng.randint(0, 3)), None) for i in range(300)]
    rows += [(1000 + i, "s9", rows[7][2], "w0", None) for i in range(20)] + [(2000, None, None, None, None)]
    index = Index(Segments(spark, str(tmp_path)), fields=["text", "title"], buckets=3)
    index.build(spark.createDataFrame(rows, DOCS))
    rows = [r for r in rows if r[1] != "s1" or r[0] % 3]
    index.replace(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("s1",)], "source_id string"))
    asked = {1: "w0 w1 w2 w40 w55", 2: "w0 w1", 3: "w58 w59 nothing", 4: text(80), 5: "w0", 6: rows[7][2] + " w57", 7: "", 8: "nothing"}
    q = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    for fields, weights in (({"text": 1.0}, [(2, 1.0)]), ({"text": 1.0, "title": 2.5}, [(2, 1.0), (3, 2.5)])):
        got = {}
        for r in lexical.index_top_k(index, q, k, fields=fields, prune_from=0).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
        for i, t in asked.items():
            whole = plain_scores(rows, t, weights)
            best = sorted(whole.items(), key=lambda x: (-x[1], x[0]))[:k]
            mine = got.get(i, [])
            assert len(mine) == len(best) and all(abs(a[1] - b[1]) < 2e-6 and abs(whole[a[0]] - a[1]) < 2e-6 for a, b in zip(mine, best, strict=True))


def test_frequent_words_find_no_candidates(spark, tmp_path, monkeypatch):
    """A word of every chunk, beside rare ones, is looked up for candidates alone."""
    rows = [(i, "s", "the " * (1 + i % 3) + f"r{i % 50} of", None, None) for i in range(2000)]
    index = Index(Segments(spark, str(tmp_path)))
    index.build(spark.createDataFrame(rows, DOCS))
    sizes, plain = {}, lexical.written

    def counting(df, name):
        out = plain(df, name)
        sizes[name] = out[0].count()
        return out

    monkeypatch.setattr(lexical, "written", counting)
    q = spark.createDataFrame([(i, f"the r{i} of") for i in range(5)], "query_id long, text string")
    assert lexical.index_top_k(index, q, 10, prune_from=0).count() == 50
    # of 2,000 chunks, 40 hold a question's rare word, and blocks of long ones cannot reach the tenth of these
    assert 5 * 10 <= sizes["held"] <= sizes["found"] <= 5 * 40


def plain_clauses(rows, parsed):
    """Scores of one query's clauses (sign, fields, terms) over rows with fields text (2) and title (3)."""
    place = {"text": 2, "title": 3}
    texts = {f: {r[0]: (r[at] or "").split() for r in rows} for f, at in place.items()}
    total, held = {}, {}
    for n, (sign, fields, ts) in enumerate(parsed):
        for f in fields:
            mean = sum(map(len, texts[f].values())) / len(rows)
            idf = 0
            for t in ts:
                df = sum(t in w for w in texts[f].values())
                idf += max(math.log((len(rows) - df + 0.5) / (df + 0.5)), 1e-6)
            for i, w in texts[f].items():
                if tf := sum(w[k : k + len(ts)] == ts for k in range(len(w))):
                    held.setdefault(i, set()).add(n)
                    if sign != "-":
                        total[i] = total.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    needed = {n for n, c in enumerate(parsed) if c[0] == "+"}
    barred = {n for n, c in enumerate(parsed) if c[0] == "-"}
    return {i: round(v, 6) for i, v in total.items() if needed <= held[i] and not barred & held[i]}


def test_clauses_equal_plain_ones(spark, tmp_path):
    rows = some_docs(120, 3)
    index = Index(Segments(spark, str(tmp_path)), fields=["text", "title"], buckets=2)
    index.build(spark.createDataFrame(rows, DOCS))
    both = ["text", "title"]
    asked = {
        'alpha "beta gamma" -title:delta': [("", both, ["alpha"]), ("", both, ["beta", "gamma"]), ("-", ["title"], ["delta"])],
        '+text:"alpha alpha" zeta': [("+", ["text"], ["alpha", "alpha"]), ("", both, ["zeta"])],
        '+alpha +"eta theta" -beta': [("+", both, ["alpha"]), ("+", both, ["eta", "theta"]), ("-", both, ["beta"])],
        "-alpha": [("-", both, ["alpha"])],
        '"alpha beta gamma" nofield:alpha': [("", both, ["alpha", "beta", "gamma"]), ("", both, ["nofield", "alpha"])],
        "+unheard alpha": [("+", both, ["unheard"]), ("", both, ["alpha"])],
        '"" ... "!?" eta-theta': [("", both, ["eta", "theta"])],
        "": [],
    }
    q = spark.createDataFrame([(i, t) for i, t in enumerate(asked)] + [(99, None)], "query_id long, text string")
    got = {}
    for r in lexical.boolean_top_k(index, q, 1000).collect():
        got.setdefault(r["query_id"], {})[r["chunk_id"]] = r["score"]
    for i, parsed in enumerate(asked.values()):
        assert near(got.get(i, {}), plain_clauses(rows, parsed)), i
    assert sum(map(len, got.values())) > 50 and 99 not in got


def test_engine_keeps_other_sources_and_reads_spans(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    long = "\n".join(f"line{i} " + "word " * 60 for i in range(40))
    e.ingest(spark.createDataFrame([(1, long), (2, "alpha beta"), (3, "gamma\ndelta alpha")], "source_id long, text string"))
    before = files(tmp_path)
    assert e.replace(spark.createDataFrame([(2, "alpha epsilon"), (3, None)], "source_id long, text string")) == 2
    assert before.items() <= files(tmp_path).items()
    q = spark.createDataFrame([(1, "alpha"), (2, "line5")], "query_id long, text string")
    hits = e.retrieve(q)
    assert {(r["query_id"], r["source_id"]) for r in hits.collect()} == {(1, 2), (2, 1)}
    chunk = e.table("chunks").filter("source_id = 1 AND child = 1").first()
    one = spark.createDataFrame([(2, 1, chunk["chunk_id"])], "query_id long, rank int, chunk_id string")
    # what the chunk carries over from the one before is evidence too
    assert {r["position"] for r in e.evidence(one).collect()} == {s["unit"] for s in chunk["spans"]} > set(range(chunk["first_unit"], chunk["last_unit"] + 1))
    assert [r["source_id"] for r in e.search(spark.createDataFrame([(7, '+"alpha epsilon"')], "query_id long, text string")).collect()] == [2]
    v = spark.createDataFrame([(r["chunk_id"], [1.0 + i, 0.0]) for i, r in enumerate(e.table("chunks").collect())], "chunk_id string, embedding array<double>")
    both = e.retrieve(q, vectors=v, question_vectors=spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>"))
    assert both.filter("query_id = 1").count() == min(12, e.table("chunks").count())


def test_engine_takes_only_what_differs(spark, tmp_path):
    asked = []

    def embed(inputs, profile):
        rows = inputs.collect()
        asked.append(sorted(r["text"] for r in rows))
        return spark.createDataFrame([(r["input_hash"], [float(len(r["text"])), 1.0]) for r in rows], "input_hash string, embedding array<double>")

    e = Engine(spark, str(tmp_path), embed)
    frame = lambda *rows: spark.createDataFrame(rows, "source_id long, text string")
    assert e.sync(frame((1, "alpha"), (2, "beta"), (3, "alpha"), (4, None))) == {"added": 3, "changed": 0, "removed": 0, "same": 0}
    assert e.build_vectors("p") == {"sources": 3, "embedded": 2, "known": 0} and e.build_vectors("p") == {"sources": 0, "embedded": 0, "known": 0}
    assert e.sync(frame((1, "alpha"), (2, "beta"), (3, "alpha"))) == {"added": 0, "changed": 0, "removed": 0, "same": 3} and e.generation() == 1
    before = files(tmp_path)
    assert e.sync(frame((1, "alpha"), (2, "gamma alpha"), (5, "beta"))) == {"added": 1, "changed": 1, "removed": 1, "same": 1}
    assert before.items() <= files(tmp_path).items()
    assert sorted((r["source_id"], r["text"]) for r in e.table("units").collect()) == [(1, "alpha"), (2, "gamma alpha"), (5, "beta")]
    # what a vector has been made of before is not embedded again
    assert e.build_vectors("p") == {"sources": 3, "embedded": 1, "known": 1} and asked[0] == ["alpha", "beta"] and asked[-1] == ["gamma alpha"]
    assert sorted(r["embedding"][0] for r in e.vectors("p").collect()) == [4.0, 5.0, 11.0]
    assert e.sync(frame((2, "gamma alpha"), (5, None)), whole=False) == {"added": 0, "changed": 0, "removed": 1, "same": 2}
    assert e.sync(frame((1, "alpha")), force=True, whole=False)["changed"] == 1 and e.table("units").count() == 2


# publication


@pytest.mark.parametrize("step", ["created", "content", "_finish"])
def test_publication_goes_on_after_a_crash(spark, tmp_path, monkeypatch, step):
    """A writer dies before its claim, after a claim without a name, or before the rename."""
    root = str(tmp_path / step)
    assert storage.publish(spark, root, {"x": spark.range(1)}, after=0) == 1

    class Died(BaseException):
        pass

    def die(*a):
        if step == "content":
            p, fs = storage._fs(spark, f"{root}/claim=2")
            fs.create(p, False).close()
        raise Died

    with monkeypatch.context() as m:
        m.setattr(storage, "_finish" if step == "_finish" else "_claim", die)
        with pytest.raises(Died):
            storage.publish(spark, root, {"x": spark.range(2)}, after=1)
    assert storage.generation(spark, root) == 1 and storage.published(spark, root, "x").count() == 1
    if step == "content":
        with pytest.raises(RuntimeError):  # its writer may still live
            storage.publish(spark, root, {"x": spark.range(3)}, after=1)
        assert storage.settled(spark, root, lease=0) == 1
    if step == "_finish":
        with pytest.raises(RuntimeError):  # the dead writer's generation comes first
            storage.publish(spark, root, {"x": spark.range(3)}, after=1)
        assert storage.published(spark, root, "x").count() == 2
    now = storage.settled(spark, root)
    assert storage.publish(spark, root, {"x": spark.range(3)}, after=now) == now + 1
    assert storage.published(spark, root, "x").count() == 3
    left = storage.tidied(spark, root, lease=0)
    assert len(left) == {"created": 1, "content": 2, "_finish": 0}[step] and not [x for x in os.listdir(root) if x.startswith(("writing", "abandoned"))]
    assert storage.published(spark, root, "x").count() == 3


# dense search


def plain_dense(ids, x, asked, q, k, score):
    out = []
    for i, v in zip(asked, q):
        s = [(-round(float(score(v, w)), 6), j) for j, w in zip(ids, x)]
        out += [(i, j, -v) for v, j in sorted(s)[:k]]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 8000.0])
@pytest.mark.parametrize("cells", [40, 1 << 21])
def test_distances_keep_their_digits(spark, monkeypatch, scale, cells):
    monkeypatch.setattr(dense, "CELLS", cells)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    x = (centre / np.linalg.norm(centre) * scale) + rng.normal(size=(80, 16)).round(2) * 1e-3
    x[40:50] = x[:10]  # ties go to smaller ids
    v = spark.createDataFrame([(f"c{i:03d}", r.tolist()) for i, r in enumerate(x)] + [("null", None)], "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 80, 7)], "query_id long, embedding array<double>")
    got = sorted((r["query_id"], r["chunk_id"], round(r["score"], 6)) for r in dense.dense_top_k(v, q, 9).collect())
    l2 = lambda a, b: 1 / (1 + math.sqrt(math.fsum((a - b) ** 2)))
    assert got == plain_dense([f"c{i:03d}" for i in range(80)], x, list(range(0, 80, 7)), x[::7], 9, l2)


def test_late_interaction_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(dense, "CELLS", 30)
    rng = np.random.default_rng(6)
    docs = {i: rng.normal(size=(rng.integers(1, 5), 4)).round(3) for i in range(40)}
    rows = [(i, t.tolist()) for i, t in docs.items()]
    d = spark.createDataFrame([*rows, (90, None), (91, []), (92, [[1.0, 2.0]])], "chunk_id int, d_tokens array<array<double>>")
    q = spark.createDataFrame([r for r in rows if r[0] % 6 == 0], "query_id long, q_tokens array<array<double>>")
    got = sorted((r["query_id"], r["chunk_id"], round(r["score"], 6)) for r in dense.max_sim_top_k(d, q, 7).collect())
    want = []
    for i in range(0, 40, 6):
        s = sorted((-round(float((docs[i] @ t.T).max(1).sum()), 6), j) for j, t in docs.items() if j != i)
        want += [(i, j, -v) for v, j in s[:7]]
    assert got == sorted(want)


def test_a_full_block_keeps_its_memory():
    rng = np.random.default_rng(7)
    for width in (64, 8):
        x, q = rng.normal(size=(dense.BLOCK_BYTES // 8 // width, width)), rng.normal(size=(dense.QUERY_BLOCK, width))
        tracemalloc.start()
        best = dense._nearest(x, None, q, None, None, 80, "l2")
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(best.query) == 80 * dense.QUERY_BLOCK and peak < 200e6


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_floats_are_dealt_as_floats(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(40)]
    some = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    whole = some.withColumn("embedding", F.col("embedding").cast("array<double>"))
    asked = lambda v: v.filter("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    for metric in ("l2", "cosine", "dot"):
        out = dense.dense_top_k(some, asked(some), 5, metric)
        assert "array<double>" not in out._jdf.queryExecution().analyzed().toString()
        assert sorted(out.collect()) == sorted(dense.dense_top_k(whole, asked(whole), 5, metric).collect())


def test_texts_are_gathered_some_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "s", "alpha beta alpha" if i % 3 else None) for i in range(1200)], "chunk_id long, source_id string, text string")
    kept = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, schema: kept.append(run))
    postings.counted(docs, ["text"])
    batch = pa.RecordBatch.from_arrays([pa.array(["text"] * 1200), pa.array(range(1200)), pa.array(["s"] * 1200), pa.array([["alpha", "beta", "alpha"] if i % 3 else None for i in range(1200)])], names=["field", "chunk_id", "source_id", "terms"])
    out = list(kept[0](iter([batch])))
    assert len(out) >= 3 and max(b.num_rows for b in out) <= 1000
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [("text", i, "s", 3, t, n, p) for i in range(1200) if i % 3 for t, n, p in (("alpha", 2, [0, 2]), ("beta", 1, [1]))]


def test_postings_are_dealt_by_chunk_and_counts_come_from_blocks(spark, tmp_path):
    rows = some_docs()
    index = Index(Segments(spark, str(tmp_path)), fields=["text", "title"], keep=["lang"])
    index.build(spark.createDataFrame(rows, DOCS))
    q = spark.createDataFrame([(1, "alpha zeta"), (2, "zeta")], "query_id long, text string")
    scoped = lexical.index_top_k(index, q, 5, scope=["source_id"])
    assert not re.search(r"hashpartitioning\((query_id#\d+L?, chunk_id|source_id|term)", plan_of(scoped))
    per = {s: plain_scores([r for r in rows if r[1] == s], "alpha zeta", [(2, 1.0)]) for s in {r[1] for r in rows}}
    best = sorted(((-v, i) for x in per.values() for i, v in x.items()))[:5]
    assert [(r["chunk_id"], r["score"]) for r in scoped.filter("query_id = 1").orderBy("rank").collect()] == [(i, pytest.approx(-v, abs=2e-6)) for v, i in best]
    phrases = lexical.boolean_top_k(index, spark.createDataFrame([(1, '+alpha "beta zeta"')], "query_id long, text string"), 5)
    assert not re.search(r"hashpartitioning\((query_id#\d+L?, clause|field|term)", plan_of(phrases))
    counts = index.frequencies()
    assert not any("/postings/" in f for f in counts.inputFiles())
    assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in index.postings().groupBy("field", "term").count().collect()}


@pytest.mark.parametrize("prune_from", [0, lexical.PRUNE_FROM])
def test_a_scan_answers_as_an_index_does(spark, prune_from):
    rows = [*some_docs(80, 5), (2000, "s1", "  ALPHA...zeta\nzeta ", None, None), (2001, None, "?!", None, None)]
    docs = spark.createDataFrame(rows, DOCS).select("chunk_id", "source_id", "text")
    q = spark.createDataFrame([(1, "alpha zeta"), (2, "Beta unheard"), (3, None), (4, "")], "query_id long, text string")
    scanned = Scanned(docs, lexical.query_terms(q))
    assert {r["term"] for r in scanned.postings(lexical.query_terms(q)).collect()} == {"alpha", "beta", "zeta"}
    assert scanned.docs().count() == len(rows)
    plain = [r if r[0] < 2000 else (r[0], r[1], {2000: "alpha zeta zeta", 2001: ""}[r[0]]) for r in rows]
    for k in (5, 1000):
        got = lexical.index_top_k(scanned, q, k, prune_from=prune_from).collect()
        for i, text in ((1, "alpha zeta"), (2, "beta")):
            want = sorted(plain_scores(plain, text, [(2, 1.0)]).items(), key=lambda x: (-x[1], x[0]))[:k]
            mine = sorted((r["rank"], r["chunk_id"], r["score"]) for r in got if r["query_id"] == i)
            assert [m[1:] for m in mine] == [(c, pytest.approx(v, abs=2e-6)) for c, v in want]
        assert {r["query_id"] for r in got} == {1, 2}
    within = docs.filter("chunk_id % 2 = 0").select("chunk_id")
    assert near(found(lexical.index_top_k(scanned, q.filter("query_id = 1"), 1000, within=within)), plain_scores([r for r in plain if r[0] % 2 == 0], "alpha zeta", [(2, 1.0)]))


def test_questions_asked_once_write_no_index(spark, tmp_path, monkeypatch):
    """Fused and reranked lists of tables that no index holds come from a scan, and are those of the index."""
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 12))), "en", f"s{i % 3}") for i in range(40)]
    for name, rows, columns in (
        ("documents", texts, "doc_id long, text string, lang string, source string"), ("benchmark", [(i, " ".join(WORDS[i : i + 3])) for i in range(4)], "item_id long, text string"),
        ("embeddings", [(i, [float(i % 7), 1.0], i % 3) for i in range(40)], "vec_id long, embedding array<float>, label int"),
    ):
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}.parquet")

    def none(_):
        raise AssertionError("an index was made")

    queries = [retrieval.max_fuse_truncate, retrieval.exact_reference_precedence, retrieval.hybrid_retrieve, answers.rerank_topk]
    with monkeypatch.context() as m:
        m.setattr(retrieval, "new_index", none)
        scanned = [sorted(map(str, f(spark, str(tmp_path)).collect())) for f in queries]
    retrieval.index(spark, str(tmp_path))
    assert all(scanned) and scanned == [sorted(map(str, f(spark, str(tmp_path)).collect())) for f in queries]


@pytest.mark.parametrize("name", ["clauses_topk", "bm25f_topk"])
def test_fields_and_clauses_asked_once_write_no_index(spark, tmp_path, monkeypatch, name):
    """without a kept index, headings and positions come from a scan for the asked terms, and answer as the index does."""
    rng = random.Random(6)
    text = lambda most: " ".join(rng.choices(WORDS, k=rng.randint(0, most)))
    texts = [(i, f"{text(3)}\n{text(14)}", "en", f"s{i % 3}") for i in range(60)] + [(90, None, "en", "s0"), (91, "", "en", None), (92, "Alpha-beta\n\n" + text(9).upper(), "en", "s1")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 8)))) for i in range(12)] + [(20, "unheard alpha"), (21, None), (22, ""), (23, "alpha x beta beta")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    f, rows = getattr(retrieval, name), lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 5)) for r in df.collect())

    def none(_):
        raise AssertionError("an index was made")

    scanned = []
    for most in (postings.MOST_TERMS, 2):
        with monkeypatch.context() as m:
            m.setattr(retrieval, "new_index", none)
            m.setattr(postings, "MOST_TERMS", most)
            m.setattr(scoring, "MOST_ASKED", most)
            scanned.append(rows(f(spark, str(tmp_path))))
    retrieval.index(spark, str(tmp_path))
    assert len(scanned[0]) > 20 and scanned[0] == scanned[1] == rows(f(spark, str(tmp_path)))


@pytest.mark.parametrize("cells", [scoring.CELLS, 1])
def test_a_task_keeps_the_best_of_its_texts(spark, monkeypatch, cells):
    """F2: texts are scored where they lie; an id on two rows is one chunk, as in the joined postings."""
    monkeypatch.setattr(scoring, "CELLS", cells)
    monkeypatch.setattr(postings, "GATHERED", 7)
    rows = [*some_docs(80, 9), *((i, "s2", "alpha beta " * 3, "zeta", None) for i in range(3000, 3030))]
    docs, fields = spark.createDataFrame(rows, DOCS), {"text": 1.0, "title": 2.0}
    q = spark.createDataFrame([(1, "alpha zeta"), (2, "Beta unheard"), (3, None), (4, "")], "query_id int, text string")
    ways, real = [], scoring.index_top_k
    monkeypatch.setattr(scoring, "index_top_k", lambda *args, **named: (ways.append(1), real(*args, **named))[1])
    for k in (5, 1000):
        got = scoring.scanned_top_k(docs, q, k, fields).collect()
        for i, text in ((1, "alpha zeta"), (2, "beta")):
            want = sorted(plain_scores(rows, text, [(2, 1.0), (3, 2.0)]).items(), key=lambda x: (-x[1], x[0]))[:k]
            assert [(r["chunk_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == [(c, pytest.approx(v, abs=2e-6)) for c, v in want]
        assert {r["query_id"] for r in got} == {1, 2}
    assert not ways and scoring.scanned_top_k(docs.limit(0), q, 5, fields).count() == 0 == scoring.scanned_top_k(docs, q.limit(0), 5, fields).count()
    twice = docs.unionByName(docs.filter("chunk_id < 9"))
    scan = postings.Scanned(twice, lexical.query_terms(q), list(fields))
    assert near(found(scoring.scanned_top_k(twice, q.filter("query_id = 1"), 1000, fields)), found(lexical.index_top_k(scan, q.filter("query_id = 1"), 1000, fields=fields, prune_from=0)))
    assert ways


def test_a_scan_gathers_some_bytes_at_a_time(spark, monkeypatch):
    texts = [" ".join(f"w{(i * 7 + j) % 900}" for j in range(2000)) for i in range(600)] + [None, ""]
    docs = spark.createDataFrame([(1, "s", "")], "chunk_id long, source_id string, text string")
    kept = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, schema: kept.append(run))
    postings.tallied(docs, "text")
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(["s"] * len(texts)), pa.array(texts)], names=["chunk_id", "source_id", "text"])
    tracemalloc.start()
    seen = [(b.num_rows, b.column(4).to_numpy().sum()) for b in kept[0](iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for n, _ in seen) == 600 * 900 + 602 and sum(t for _, t in seen) == 600 * 2000 and peak < 40e6
