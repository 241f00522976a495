"""Expansion, collapse, reports, folds, plans, extents, audits, adjacency and folders against plain versions."""

import hashlib
import itertools
import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.functions import vector as V
from quillspark.operators import adjacency, audit, catalog, diversity, erasure, evidence, expansion, extents, folds, graph, ingest, packs, pairs, reports, research
from quillspark.plans import collections, ingestion, texts
from quillspark.segments import Segments
from quillspark.streaming import files

# expansion


def plain_expansion(seeds, edges, per_seed, total, hops, types, closed):
    """One query's seeds (rank, node, score), one after the other, breadth first."""
    neighbours = {}
    for a, b, t, o in sorted(edges, key=lambda e: (e[0], e[2], e[3], e[1])):
        if t in types and a not in closed and b not in closed and b not in neighbours.setdefault(a, []):
            neighbours[a].append(b)
    first = {}
    for rank, node, score in sorted(seeds):
        first.setdefault(node, (rank, score))
    seen, out = set(first), []
    for node, (_, score) in sorted(first.items(), key=lambda x: (x[1][0], x[0])):
        frontier, taken = [node], 0
        for hop in range(1, hops + 1):
            new = []
            for x in frontier:
                for y in neighbours.get(x, ()):
                    if y not in seen and taken < per_seed and len(out) < total:
                        seen.add(y)
                        new.append(y)
                        taken += 1
                        out.append((node, y, hop, round(score * 0.5**hop, 6), len(out) + 1))
            frontier = new
    return out


def test_expansion_equals_plain_steps(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(40), rng.randrange(40), rng.choice(["a", "b", "no"]), rng.randrange(3)) for _ in range(260)] + [(0, 100 + i, "a", i) for i in range(300)]
    closed = [3, 7]
    seeds = {q: [(r, rng.choice([0, *range(20)]), 1.0 / r) for r in range(1, rng.randint(1, 6))] for q in range(12)}
    s = spark.createDataFrame([(q, *x) for q, rows in seeds.items() for x in rows], "query_id long, rank int, node long, score double")
    e = spark.createDataFrame(edges, "from_node long, to_node long, edge_type string, ordinal int")
    c = spark.createDataFrame([(x,) for x in closed], "node long")
    for per_seed, total, hops in ((4, 9, 2), (6, 30, 3), (1, 2, 1)):
        got = {}
        for r in expansion.expanded(s, e, per_seed, total, hops, ["a", "b"], c).orderBy("query_id", "place").collect():
            got.setdefault(r["query_id"], []).append(tuple(r)[1:])
        assert got == {q: x for q, rows in seeds.items() if (x := plain_expansion(rows, edges, per_seed, total, hops, ["a", "b"], closed))}
    assert expansion.expanded(s.limit(0), e).count() == 0 == expansion.expanded(s, e.limit(0)).count()


# collapse


def plain_collapse(hits, ids, most):
    """hits: {hit: (rank, strength, protected)}, ids: (hit, kind, value) of one query."""
    ids = [(h, k, v) for h, k, v in ids if v and v.strip() and h in hits]
    merging = {(h, k, v) for h, k, v in ids if k in diversity.MERGING and not (k == "near_duplicate" and hits[h][2])}
    group = {h: {h} for h in hits}
    for (h, k, v), (i, k2, v2) in itertools.combinations(merging, 2):
        if (k, v) == (k2, v2) and group[h] is not group[i]:
            both = group[h] | group[i]
            for x in both:
                group[x] = both
    order = lambda h: (hits[h][1], hits[h][0], h)
    head = {h: min(group[h], key=order) for h in hits}
    reason = {}
    for h in hits:
        if head[h] != h:
            shared = [diversity.MERGING.index(k) for x, k, v in merging if x == h and any((y, k, v) in merging for y in hits if y != h)]
            reason[h] = diversity.MERGING[min(shared)]
    for kind in diversity.QUOTAS:
        value = {}
        for h, k, v in ids:
            if k == kind:
                value[h] = min(v, value.get(h, v))
        shown = {}
        for h in sorted((h for h in hits if h not in reason and h in value), key=order):
            shown.setdefault(value[h], []).append(h)
        for some in shown.values():
            for h in some[most[kind] :]:
                reason[h], head[h] = f"{kind}_quota", some[0]
    left = sorted((h for h in hits if h not in reason), key=lambda h: (hits[h][0], h))
    return {(h, hits[h][0], head[h], reason.get(h), left.index(h) + 1 if h in left else None) for h in hits}


def test_collapse_equals_plain_groups(spark):
    rng = random.Random(4)
    kinds, most = [*diversity.MERGING, *diversity.QUOTAS], {"thread": 3, "source": 2}
    queries, h, i = {}, [], []
    for q in range(15):
        hits = {x: (n + 1, rng.randrange(3), rng.random() < 0.3) for n, x in enumerate(rng.sample(range(100), rng.randint(1, 12)))}
        ids = [(rng.choice([*hits, 999]), k, rng.choice(["a", "b", "c", "d", "e", "f", "", " ", None])) for k in kinds for _ in range(3)]
        queries[q] = hits, ids
        h += [(q, x, *v) for x, v in hits.items()]
        i += [(q, *x) for x in ids]
    h = spark.createDataFrame(h, "query_id long, hit_id long, rank int, strength int, protected boolean")
    i = spark.createDataFrame(i, "query_id long, hit_id long, kind string, value string")
    got = {}
    for r in diversity.collapsed(h, i, most).collect():
        got.setdefault(r["query_id"], set()).add(tuple(r)[1:])
    assert got == {q: plain_collapse(*x, most) for q, x in queries.items()}
    assert diversity.collapsed(h.limit(0), i.limit(0), most).count() == 0


# reports


def test_claims_fall_with_what_they_cite(spark):
    claims = spark.createDataFrame([(1, "c1", "a"), (1, "c2", "b"), (1, "c3", "c"), (1, "c4", "d"), (1, "c5", "e"), (1, "late", "z"), (2, "c6", "a"), (2, "c7", None)], "community long, claim_id string, text string")
    spans = spark.createDataFrame([("c1", 0, "k1", 0), ("c2", 0, "k1", 0), ("c2", 1, "k2", 0), ("c3", 0, "gone", 0), ("c5", 0, "k4", 0), ("late", 0, "k1", 0), ("c6", 0, "k4", 0), ("c6", 1, "k3", 0)], "claim_id string, ordinal int, chunk_id string, source_id long")
    members = spark.createDataFrame([("k1", 1, 0, "e1"), ("k2", 1, 0, "lost"), ("k2", 1, 1, "e2"), ("k3", 1, 0, "e3"), ("k3", 1, 1, "e1"), ("k4", 2, 0, "e1")], "chunk_id string, source_id long, ordinal int, evidence_id string")
    stored = spark.createDataFrame([("e1", 1), ("e2", 1), ("e3", 1)], "evidence_id string, source_id long")
    kept, united = reports.report_evidence(claims, spans, members, stored, 5, 10)
    # c2 cites what is lost, c3 a chunk that is gone, c4 and c7 nothing, c5 and c6 evidence of another source than its chunk
    assert {tuple(r) for r in kept.collect()} == {(1, "c1", 1, 1)}
    assert {(r["community"], r["evidence_id"], r["turn"]) for r in united.collect()} == {(1, "e1", 1), (1, "e2", 2), (2, "e3", 1), (2, "e1", 2)}
    assert {r["claim_id"] for r in reports.report_evidence(claims, spans.filter("claim_id <> 'c2' OR ordinal = 0"), members, stored, 9, 1)[0].collect()} == {"c1", "c2", "late"}
    assert all(x.count() == 0 for x in reports.report_evidence(claims.limit(0), spans, members, stored, 5, 10))


# folds


@pytest.mark.parametrize(("block", "fan"), [(4, 2), (4, 512), (512, 512)])
def test_folds_equal_one_pass(spark, monkeypatch, block, fan):
    monkeypatch.setattr(folds, "BLOCK", block)
    monkeypatch.setattr(folds, "FAN", fan)
    rng = random.Random(block)
    table = {("s", "x"): "t", ("t", "y"): "s", ("t", "x"): "u", ("u", "z"): "s"}
    rows = [(i, seq, rng.choice(["x", "y", "z", "?", None])) for i, n in ((1, 90), (2, 3), (None, 5)) for seq in rng.sample(range(200), n)]
    got = folds.folded(spark.createDataFrame(rows, "id long, seq long, event string").filter("id IS NOT NULL"), table, "s")
    want = []
    for i in (1, 2):
        state = "s"
        for _, seq, e in sorted(r for r in rows if r[0] == i):
            after = table.get((state, e), state)
            want.append((i, seq, e, state, after, (state, e) in table))
            state = after
    assert sorted(map(tuple, got.collect())) == sorted(want)
    last = {r["id"]: (r["state"], r["events"], r["illegal"]) for r in folds.final_states(got).collect()}
    assert last[2][1] == 3 and last[1][2] == sum(not w[5] for w in want if w[0] == 1)
    assert folds.folded(spark.createDataFrame([], "id long, seq long, event string"), table, "s").count() == 0


def test_deletions_wait_for_holds(spark):
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    r = spark.createDataFrame([(1, day(1), None), (2, day(1), day(5)), (3, day(1), None), (4, day(1), None), (5, day(9), day(2))], "id long, requested timestamp_ntz, retained_until timestamp_ntz")
    h = spark.createDataFrame([(2, day(4), day(6)), (2, day(6), day(8)), (2, day(9), day(10)), (3, day(0), None), (4, day(2), day(3)), (5, day(9), day(9))], "id long, begins timestamp_ntz, ends timestamp_ntz")
    a = spark.createDataFrame([(1, "a", day(0), True), (1, "b", day(1), True), (1, "b", day(2), False), (2, "a", day(7), True), (2, "b", day(9), False)], "id long, product string, at timestamp_ntz, ok boolean")
    got = {(x["id"], x["product"]): (x["due"], x["outcome"]) for x in folds.deletion_outcomes(r, h, a, ["a", "b"], day(8)).collect()}
    assert got == {(1, "a"): (day(1), "pending"), (1, "b"): (day(1), "deleted"), (2, "a"): (day(8), "pending"), (2, "b"): (day(8), "failed"), (3, "a"): (None, "held"), (3, "b"): (None, "held"), (4, "a"): (day(1), "pending"), (4, "b"): (day(1), "pending"), (5, "a"): (day(9), "waiting"), (5, "b"): (day(9), "waiting")}


# plans


def test_levels_and_cycles(spark):
    q = [(1, x) for x in "abcd"] + [(2, x) for x in "abc"] + [(3, "a"), (3, "b")] + [(4, x) for x in "abc"]
    dep = [(1, "b", "a"), (1, "c", "a"), (1, "d", "b"), (1, "d", "a"), (2, "a", "b"), (2, "b", "a"), (2, "c", "a"), (3, "b", "zz"), (4, "a", "a"), (9, "a", "b")]
    got = research.levels(spark.createDataFrame(q + q[:2], "plan_id long, sub_id string"), spark.createDataFrame(dep, "plan_id long, sub_id string, depends_on string"))
    rows = {(r["plan_id"], r["sub_id"]): (r["level"], r["status"]) for r in got.collect()}
    assert rows == {(1, "a"): (0, "ok"), (1, "b"): (1, "ok"), (1, "c"): (1, "ok"), (1, "d"): (2, "ok"), (2, "a"): (None, "cycle"), (2, "b"): (None, "cycle"), (2, "c"): (None, "cycle"), (3, "a"): (0, "unknown_dependency"), (3, "b"): (0, "unknown_dependency"), (4, "a"): (None, "cycle"), (4, "b"): (0, "cycle"), (4, "c"): (0, "cycle")}
    found = spark.createDataFrame([(1, "d", 1, "e1", True), (1, "a", 2, "e2", False), (1, "a", 1, "e3", False), (1, "b", 1, "e2", True), (2, "a", 1, "e9", True)], "plan_id long, sub_id string, rank int, evidence_id string, direct boolean")
    assert [tuple(r) for r in research.merged_along(got, found).orderBy("place").collect()] == [(1, "e3", 1, ["a"], False), (1, "e2", 2, ["a", "b"], True), (1, "e1", 3, ["d"], True)]
    assert research.levels(spark.createDataFrame([], "plan_id long, sub_id string"), spark.createDataFrame([], "plan_id long, sub_id string, depends_on string")).count() == 0


# extents


@pytest.mark.parametrize(("block", "most"), [(8, 2), (8, 100), (1 << 20, 3)])
def test_extents_prune_and_keep_the_same_rows(spark, monkeypatch, block, most):
    monkeypatch.setattr(extents, "BLOCK", block)
    rng = random.Random(block + most)
    ids = sorted({x for a in rng.sample(range(-50, 400), 25) for x in range(a, a + rng.randint(1, 20))})
    scope = extents.extents(spark.createDataFrame([(i,) for i in [*ids, ids[0], None]], "id long"))
    runs = [(g[0], g[-1]) for _, k in itertools.groupby(enumerate(ids), lambda x: x[1] - x[0]) if (g := [v for _, v in k])]
    assert sorted(map(tuple, scope.collect())) == runs
    cover = extents.covering(scope, most)
    assert len(cover) <= most and all(any(a <= f and l <= b for a, b in cover) for f, l in runs) and cover[0][0] == ids[0] and cover[-1][1] == ids[-1]
    held = extents.sorted_by_id(spark.range(-100, 500).select(F.col("id").alias("k"), F.lit("x").alias("first")), "k")
    got = extents.in_extents(held, "k", scope, most)
    assert sorted(r["k"] for r in got.collect()) == ids and got.columns == held.columns
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or" in plan or "PushedFilters: [IsNotNull(k), Or" in plan or len(cover) == 1
    assert extents.shape(scope) == "sorted_run" and extents.shape(scope.limit(0)) == "empty" and extents.shape(scope.limit(1)) == "contiguous"
    assert extents.in_extents(held, "k", scope.limit(0)).count() == 0


# audits


def test_claims_tile_answers(spark):
    texts = ["Ünä [E1, E2]. Zwei? Drei!! vier", "", None, "...", "no end\n\nhere. [E9] then [E9, E3]", " . a"]
    answers = spark.createDataFrame(list(enumerate(texts)), "answer_id long, text string")
    c = audit.claims(answers)
    for i, t in enumerate(texts):
        assert "".join(r["text"] for r in c.filter(F.col("answer_id") == i).orderBy("claim").collect()) == (t or "")
    assert audit.tiling_faults(answers, c).count() == 0
    bound = {(r["answer_id"], r["claim"]): r["labels"] for r in audit.bound_citations(c, audit.citations(answers)).collect()}
    assert bound[0, 0] == ["E1", "E2"] and bound[0, 1] == [] and bound[4, 1] == ["E3", "E9"] and bound[4, 0] == [] and len(bound) == c.count()
    bad = spark.createDataFrame([(0, 0, 0, 5, "x"), (0, 1, 4, 4, ""), (0, 1, 9, 11, "zz")], "answer_id long, claim int, start int, end int, text string")
    got = {(r["answer_id"], r["claim"], r["fault"]) for r in audit.tiling_faults(answers, bad).collect()}
    assert got == {(0, 0, "text"), (0, 1, "overlap"), (0, 1, "empty"), (0, 1, "repeated"), (0, 1, "gap"), (0, 1, "text"), (0, None, "gap"), (3, None, "gap"), (4, None, "gap"), (5, None, "gap")}


def test_values_are_found_at_any_depth(spark):
    rows = ['{"a": {"b": ["x", {"c": "s1"}]}}', '{"s1": 1}', '{"a": "s1 not"}', '["s1"]', '{"n": [1, 22, true]}', '{"q": "a\\"s1\\""}', '{"q": "s\\u0031"}', "not json s1", None, '{"a": {"s1" : "b"}}']
    t = spark.createDataFrame(list(enumerate(rows)), "i long, p string")
    assert sorted(r["i"] for r in evidence.mentioning(t, "p", ["s1"]).collect()) == [0, 3, 6]
    assert sorted(r["i"] for r in evidence.mentioning(t, "p", ["22", "true"]).collect()) == [4]


# orders of large groups


def test_percentiles_and_positions_equal_sorted_lists(spark):
    rng = random.Random(11)
    rows = [(g, rng.choice([rng.randrange(20), None]) if g else 1, i) for i, g in enumerate(["a"] * 200 + ["b"] * 7 + [None] * 5 + ["c"])]
    t = spark.createDataFrame([(g, None if v is None else float(v), i) for g, v, i in rows], "g string, v double, i long").repartition(5)
    got = {(r["g"], r["share"]): r["value"] for r in catalog.percentiles(t, "g", "v", [0.0, 0.3, 0.95, 1.0]).collect()}
    for g in ("a", "b", None, "c"):
        values = sorted(v for h, v, _ in rows if h == g and v is not None)
        for share in (0.0, 0.3, 0.95, 1.0) if values else ():
            k = share * (len(values) - 1)
            a, b = values[int(k)], values[min(int(k) + (k > int(k)), len(values) - 1)]
            assert abs(got[g, share] - (a + (b - a) * (k - int(k)))) < 1e-9
    ahead = {r["i"]: r["ahead"] for r in catalog.queue_positions(t, "g", ["v", "i"]).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    assert ahead == {i: sum(key(o) < key((g, v, i)) for o in rows if o[0] == g) for g, v, i in rows}


# adjacency


def test_hops_do_not_move_edges(spark):
    rows = [(i, (i * 7 + k) % 50, "t", k, i % 4) for i in range(50) for k in range(3)]
    e = spark.createDataFrame(rows, "from_node long, to_node long, edge_type string, ordinal int, source_id int")
    held = adjacency.kept(e)
    seeds = spark.createDataFrame([(i, 1.0) for i in range(0, 50, 9)], "seed long, score double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        x = graph.hops(held.by("from_node"), seeds, 2)
        tree = x._jdf.queryExecution().executedPlan().toString()
        scans = tree.split("FileScan parquet")
        # from a scan of the edges up to the sort below its join there is no exchange
        assert len(scans) > 2 and all("Exchange" not in before[before.rfind("Sort [") :] for before in scans[:-1])
        assert sorted(map(tuple, x.collect())) == sorted(map(tuple, graph.hops(e, seeds, 2).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    now = held.upserted(spark.createDataFrame([(1, 2, "t", 0, 3), (1, 2, "t", 0, 3)], e.schema), spark.createDataFrame([(3,), (9,)], "source_id int"))
    want = {r for r in rows if r[4] != 3} | {(1, 2, "t", 0, 3)}
    assert {tuple(r) for r in now.by("to_node").select(e.columns).collect()} == want == {tuple(r) for r in now.by("from_node").select(e.columns).collect()}
    at = now.at(spark.createDataFrame([(2,)], "node long"))
    assert {(r["neighbour"], r["direction"]) for r in at.collect()} == {(b, "out") for a, b, *_ in want if a == 2} | {(a, "in") for a, b, *_ in want if b == 2}
    held.drop()
    now.drop()


# folders


def test_walks_are_bounded(spark, tmp_path):
    deep = tmp_path / "a" / "b" / "c"
    deep.mkdir(parents=True)
    (tmp_path / "skip").mkdir()
    for p in ("x.txt", "a/y.txt", "a/b/c/z.txt", "skip/no.txt", "a/b/n.tmp"):
        (tmp_path / p).write_text(p)
    os.symlink(tmp_path / "a", deep / "loop")
    os.symlink(tmp_path / "x.txt", tmp_path / "a" / "link.txt")
    found, faults = files.walk(spark, [str(tmp_path)], ["skip/", "*.tmp"])
    assert {r["logical"] for r in found.collect()} == {"x.txt", "a/y.txt", "a/link.txt", "a/b/c/z.txt"}
    assert [(r["path"].endswith("a/b/c/loop"), r["fault"]) for r in faults.collect()] == [(True, "loop")]
    found, faults = files.walk(spark, [str(tmp_path)], most_depth=2)
    assert "a/b/c/z.txt" not in {r["logical"] for r in found.collect()} and {r["fault"] for r in faults.collect()} == {"too_deep"}
    assert files.walk(spark, [str(tmp_path / "none")])[0].count() == 0


def test_folders_are_kept_in_step(spark, tmp_path):
    folder, store = tmp_path / "in", Segments(spark, str(tmp_path / "store"))
    (folder / "sub").mkdir(parents=True)
    texts = lambda: sorted((os.path.basename(r["source_id"]), r["text"]) for r in store.read("units").collect())
    (folder / "a.txt").write_text("one\ntwo")
    (folder / "sub" / "b.txt").write_text("three")
    (folder / "c.txt").write_text("")
    assert files.synced(spark, str(folder), store) == {"put": 3, "deleted": 0} and files.synced(spark, str(folder), store) == {"put": 0, "deleted": 0}
    assert texts() == [("a.txt", "one"), ("a.txt", "two"), ("b.txt", "three")]
    (folder / "a.txt").write_text("one\nchanged")
    os.rename(folder / "sub" / "b.txt", folder / "sub" / "renamed.txt")
    os.remove(folder / "c.txt")
    assert files.synced(spark, str(folder), store) == {"put": 2, "deleted": 2}
    assert texts() == [("a.txt", "changed"), ("a.txt", "one"), ("renamed.txt", "three")]
    for i in range(5):
        (folder / f"n{i}.txt").write_text(f"n{i}")
    os.remove(folder / "a.txt")
    steps = [files.synced(spark, str(folder), store, most_files=3) for _ in range(3)]
    assert steps == [{"put": 2, "deleted": 1}, {"put": 3, "deleted": 0}, {"put": 0, "deleted": 0}]
    assert texts() == [(f"n{i}.txt", f"n{i}") for i in range(5)] + [("renamed.txt", "three")]
    (folder / "n0.txt").write_text("by stream")
    q = files.start_sync(spark, str(folder), store, str(tmp_path / "cp"), every="1 second")
    for _ in range(40):  # ticks never end, so what is waited for is the change
        q.awaitTermination(1)
        if ("n0.txt", "by stream") in texts():
            break
    q.stop()
    assert ("n0.txt", "by stream") in texts()


# provenance, support, erasure, moved sources


def test_spans_name_their_first_fault(spark):
    chunks = spark.createDataFrame([(1, "héllo", "x"), (2, None, "x")], "chunk_id long, text string, c string")
    evidence = spark.createDataFrame([(1, "xhéllo", "p1", None), (2, "héllo", None, 7), (3, None, None, None)], "evidence_id long, text string, locator string, derived_from long")
    h = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in ((1, "xhéllo"), (2, "héllo"))}
    rows = [
        (1, 1, 0, 6, 1, 7, h[1], "p1", "direct", None), (1, 2, 0, 6, 0, 6, h[2], None, "derived", None),  # these hold
        (9, 1, 0, 6, 1, 7, h[1], "p1", "direct", "missing_chunk"), (1, 9, 0, 6, 1, 7, h[1], "p1", "direct", "missing_evidence"),
        (1, 1, 0, 5, 1, 7, h[1], "p1", "direct", "bytes"), (1, 1, 0, 7, 0, 7, h[1], "p1", "direct", "bytes"), (1, 1, -1, 6, 1, 7, h[1], "p1", "direct", "bytes"),
        (1, 1, None, 6, 1, 7, h[1], "p1", "direct", "bytes"), (2, 3, 0, 0, 0, 0, None, None, "direct", "bytes"), (None, 1, 0, 6, 1, 7, h[1], "p1", "direct", "missing_chunk"),
        (1, 1, 0, 6, 1, 7, h[2], "p1", "direct", "hash"), (1, 1, 0, 6, 1, 7, None, "p1", "direct", "hash"), (1, 1, 0, 6, 1, 7, h[1], None, "direct", "locator"),
        (1, 1, 0, 6, 1, 7, h[1], "p1", "derived", "trust"), (1, 2, 0, 6, 0, 6, h[2], None, None, "trust"), (1, 1, 3, 3, 2, 2, h[1], "p1", "direct", None),
    ]
    schema = "chunk_id long, evidence_id long, chunk_start int, chunk_end int, evidence_start int, evidence_end int, evidence_text_hash string, locator string, trust string, e string"
    spans = spark.createDataFrame(rows, schema)
    got = sorted((tuple(r) for r in ingest.span_faults(spans, chunks, evidence).collect()), key=str)
    assert got == sorted(((r[0], r[1], r[-1]) for r in rows if r[-1]), key=str)
    assert ingest.span_faults(spans.limit(0), chunks, evidence).count() == 0 and ingest.span_faults(spans, chunks.limit(0), evidence).count() == len(rows)


def test_support_of_claims(spark):
    evidence = spark.createDataFrame([(1, "The sky is Blue"), (2, "Grass is green")], "evidence_id long, text string")
    bindings = [
        (1, 1, "sky is Blue", "for"), (1, 2, None, "for"), (2, 1, "sky  is blue", "for"), (3, 1, "no", "for"), (3, 9, "", "for"), (4, 2, "green", None), (4, 1, "no", "for"),
        (5, 2, "green", "for"), (5, 1, "Blue", "against"), (6, 2, "green", "for"), (7, 2, "green", "for"), (8, 2, "green", "for"), (10, 1, "", "for"), (10, 1, "no", "against"), (11, 2, "green", "for"),
    ]
    claims = [(1, 1, "a", "x", True), (2, 1, "b", "x", None), (3, 1, "a", "z", True), (4, 1, "c", "x", True), (5, 1, "d", "x", True), (6, 1, "e", "x", True), (7, 1, "e", "y", True), (8, 1, "e", "y", False), (9, 1, None, None, True), (10, 2, "e", "q", True), (11, 1, None, "y", True)]
    c = spark.createDataFrame(claims, "claim_id long, pack_id long, subject string, value string, factual boolean")
    b = spark.createDataFrame([(*r, "clash") for r in bindings], "claim_id long, evidence_id long, quote string, stance string, text string")
    got = {r["claim_id"]: (r["support"], r["bindings"], r["holding"], r["publishable"]) for r in evidence_support(c, b, evidence)}
    assert got == {
        1: ("supported", 2, 2, True), 2: ("partial", 1, 0, False), 3: ("unsupported", 2, 0, False), 4: ("partial", 2, 1, False), 5: ("conflict", 1, 1, False), 6: ("conflict", 1, 1, False),
        7: ("conflict", 1, 1, False), 8: ("non_factual", 1, 1, False), 9: ("unsupported", 0, 0, False), 10: ("supported", 1, 1, True), 11: ("supported", 1, 1, True),
    }
    assert {r["support"] for r in evidence_support(c, b.limit(0), evidence)} == {"unsupported", "non_factual"} and not evidence_support(c.limit(0), b, evidence)


def evidence_support(*tables):
    return evidence.claim_support(*tables).collect()


def test_erasure_is_proved_or_its_faults_are_named(spark):
    places = list(erasure.TARGETS)
    scope = [(p, s) for p in range(1, 8) for s in ("a", "b", "b")] + [(8, None), (None, "a")]
    acks = [(p, s, t, erasure.TARGETS[t]) for p in range(1, 8) for s in "ab" for t in places]
    gone = lambda p, s, t: acks.remove((p, s, t, erasure.TARGETS[t]))
    gone(2, "a", "replica")  # told by a letter
    gone(3, "a", "graph")
    gone(4, "b", "replica")  # not told
    acks += [(5, "c", "catalog", 0), (5, "a", "moon", 0), (5, "a", "catalog", 0), (6, "a", "files", -1)]
    letters = [(2, "a", "replica"), (7, "a", "files"), (7, "a", "replica")]
    s = spark.createDataFrame(scope, "plan_id long, source_id string")
    a = spark.createDataFrame(acks, "plan_id long, source_id string, target string, at long")
    m = spark.createDataFrame(letters, "plan_id long, source_id string, target string")
    faults = sorted(tuple(r) for r in erasure.erasure_faults(s, a, m).collect())
    assert faults == [(3, "coverage", 1), (4, "mismatch", 1), (5, "out_of_scope", 2), (6, "order", 1), (7, "local_letter", 1), (7, "mismatch", 1)]
    proofs = erasure.erasure_proofs(s, a, m).collect()
    assert {(r["plan_id"], r["target"]) for r in proofs} == {(p, t) for p in (1, 2) for t in places} and {r["sources"] for r in proofs} == {2}
    assert [(r["plan_id"], r["target"], r["pending"]) for r in proofs if r["outcome"] != "confirmed"] == [(2, "replica", 1)]
    assert len({r["commitment"] for r in proofs}) == 1 and not {"a", "b"} & {r["commitment"] for r in proofs}
    assert erasure.erasure_proofs(s.limit(0), a.limit(0), m.limit(0)).count() == 0
    digest = lambda rows: {r["plan_id"]: r["commitment"] for r in erasure.commitments(spark.createDataFrame(rows, "plan_id long, source_id string"), 1).collect()}
    ids = [(1, f"s{i}") for i in range(100)]
    assert digest(ids) == digest(ids[::-1] + ids) != digest(ids[1:]) and digest([(1, "ab"), (1, "c")]) != digest([(1, "a"), (1, "bc")])


def test_moved_sources_find_their_files(spark):
    rng = random.Random(5)
    for _ in range(3):
        content = lambda: rng.choice(["h1", "h2", "h3", "h4", "h5", "h6", None])
        files = [(rng.choice(["a", "b", "c.d/x"]) + f"{i}" + rng.choice([".md", ".MD", ".pdf", ""]), content()) for i in range(8)] + [(None, "h1")]
        sources = [(i, rng.choice([f"old{i}.md", files[i][0], None]) if i < 8 else f"old{i}.md", content(), rng.choice(["markdown", "markdown", "other", None])) for i in range(9)]
        files += files[:2]
        have, taken, fits = {p for p, _ in files if p}, {s[1] for s in sources}, {}
        gone = [s for s in sources if s[1] and s[1] not in have]
        free = {(p, h) for p, h in files if p and h and p not in taken}
        for i, _, h, parser in gone:
            fits[i] = sorted(p for p, x in free if x == h and parser == "markdown" and p.lower().endswith(".md"))
        want = []
        for i, _, h, _ in gone:
            rivals = sum(len(f) == 1 and f == fits[i] for f in fits.values())
            outcome = ("relocated" if rivals == 1 else "contested") if len(fits[i]) == 1 else "ambiguous" if fits[i] else "unsupported" if any(x == h for _, x in free) else "no_target"
            want.append((i, outcome, fits[i][0] if outcome == "relocated" else None))
        s = spark.createDataFrame(sources, "source_id long, path string, hash string, parser string")
        f = spark.createDataFrame(files, "path string, hash string")
        assert sorted(map(tuple, catalog.relocations(s, f, {"markdown": ["md"]}).collect())) == sorted(want)
    assert catalog.relocations(s, f.limit(0), {"markdown": ["md"]}).filter("outcome <> 'no_target'").count() == 0


def plain_packs(results, evidence, selected, start, end):
    """Both packs of one query, result by result."""
    final, shown, seen, display = [], set(), set(), []
    place = 0

    def add(r, e):
        if e[1] not in shown:
            shown.add(e[1])
            display.append((f"E{len(display) + 1}", r[0], r[1], e[1]))

    for r in sorted(results):
        units = sorted(evidence.get(r[1], []))
        chosen = selected.get(r[1])
        for e in units:
            if (chosen is None or e[1] == chosen) and e[1] not in {x[3] for x in final}:
                final.append((f"E{len(final) + 1}", r[0], r[1], e[1]))
        one = len(units) > 1 and all(e[2] for e in units)
        for e in units[:1] if one else units:
            if e[1] in seen:
                continue
            seen.add(e[1])
            picks = [x for x in units if x[1] == chosen] if one and start <= place < end else []
            place += 1
            add(r, picks[0] if picks else e)
    return final, display


def test_packs_equal_plain_ones(spark):
    rng = random.Random(11)
    evidence = {c: [(o, rng.randint(0, 25), rng.choice([True, True, True, False, None])) for o in range(rng.randint(0, 4))] for c in range(20)}
    evidence = {c: [e for i, e in enumerate(v) if e[1] not in {x[1] for x in v[:i]}] for c, v in evidence.items()}
    results = {q: [(rank + 1, rng.randint(0, 22)) for rank in range(rng.randint(0, 12))] for q in range(12)}
    selected = {q: {c: rng.randint(0, 25) if rng.random() < 0.3 else rng.choice(evidence[c])[1] for c in range(20) if evidence[c] and rng.random() < 0.6} for q in range(12)}
    r = spark.createDataFrame([(q, c, k, 0.5, "search", "x") for q, v in results.items() for k, c in v], "query_id long, chunk_id long, rank int, score double, origin string, kind string")
    e = spark.createDataFrame([(c, o, i, "text", None, b, 9) for c, v in evidence.items() for o, i, b in v], "chunk_id long, ordinal int, evidence_id long, kind string, derived_from long, canonical boolean, rank int")
    s = spark.createDataFrame([(q, c, i) for q, v in selected.items() for c, i in v.items()], "query_id long, chunk_id long, evidence_id long")
    want = {q: plain_packs(v, evidence, selected[q], 1, 4) for q, v in results.items()}
    columns = ["query_id", "label", "rank", "chunk_id", "evidence_id"]
    for at, got in enumerate((packs.final_pack(r, e, s), packs.display_pack(r, e, s, 1, 4))):
        assert sorted(map(tuple, got.select(columns).collect())) == sorted((q, *x) for q, both in want.items() for x in both[at])
        assert set(row["role"] for row in got.collect()) == {"original_text"}
    assert packs.display_pack(r.limit(0), e, s, 0, 9).count() == packs.final_pack(r, e.limit(0), s).count() == 0


def test_results_rest_on_source_text(spark):
    e = spark.createDataFrame([(1, "Text"), (1, "Image"), (2, "Text"), (2, "Generated"), (3, None), (4, "Image"), (None, "Text")], "chunk_id long, kind string")
    r = spark.createDataFrame([(1, 2, 1, None), (1, 1, 2, None), (1, 4, 3, 2), (1, 1, 4, 4), (1, 3, 5, None), (1, 9, 6, None), (2, 4, 1, 9), (2, None, 2, None)], "query_id long, chunk_id long, rank int, seed_chunk_id long")
    got = sorted((x["query_id"], x["chunk_id"], x["rank"]) for x in packs.bounded_results(r, e).collect())
    assert got == [(1, 1, 1), (1, 1, 2)] and packs.bounded_results(r, e.limit(0)).count() == 0


def test_claim_support_finds_quotations_of_other_case_with_a_sharp_s(spark, tmp_path):
    import duckdb

    from quillspark.plans import catalog as plans

    texts = ["Das ieß ieschein cherge, weiß", "Fußball und Spaß ﬁndet er", "ŉa ǰb straße ß"]
    rows = [(i, texts[i % 3], "src1", "de") for i in range(1, 60)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    wanted = con.execute(plans.oracle_sql()["claim_support"]).fetchall()
    assert sorted(map(tuple, plans.queries()["claim_support"](spark, str(tmp_path)).collect())) == sorted(wanted)


def test_canonical_chunks_stream_over_sorted_units(spark):
    """The fold takes units in batches of any size and holds the open chunk, not a book; books are dealt once."""
    rows = [(s, i, f"verse {i} " + "word " * (i % 37), None if i % 29 == 0 else f"b{i // 50}", i // 8) for s in (1, 2) for i in range(200)]
    units = spark.createDataFrame(rows, "source_id long, position long, text string, book string, chapter long").repartition(3)
    out = ingest.canonical_children(units)
    one = sorted(map(tuple, out.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert sorted(map(tuple, ingest.canonical_children(units).collect())) == one
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(s, u) for s, _, _, _, a, b, _ in one for u in range(a, b + 1)} == {(s, i) for s in (1, 2) for i in range(200)}
    assert "InPandas" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_a_section_are_dealt_evenly(spark):
    """One section holds nearly all members, in one file: no task makes most of the pairs."""
    members = spark.createDataFrame([("big" if i % 50 else f"s{i % 3}", i) for i in range(6000)] + [(None, 7000)], "section string, chunk_id long").coalesce(1)
    seeds = members.filter("chunk_id % 100 = 1").select(F.col("chunk_id").alias("seed"))
    out = graph.siblings(members, seeds)
    held = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(held) <= 0.7 * sum(held)
    rows = members.filter("section IS NOT NULL").collect()
    want = {(s["section"], s["chunk_id"], m["chunk_id"]) for s in rows if s["chunk_id"] % 100 == 1 for m in rows if m["section"] == s["section"] and m["chunk_id"] != s["chunk_id"]}
    got = [tuple(r) for r in out.select("section", "seed", "chunk_id").collect()]
    assert len(got) == len(want) and set(got) == want


def test_exact_kernels_deal_a_label_evenly_and_keep_odd_vectors(spark, tmp_path, monkeypatch):
    """Nearly all vectors have one label and lie in one file; lengths, nulls and zeros give the values they always gave."""
    monkeypatch.setattr(pairs, "BLOCK", 100)
    rng = random.Random(8)
    odd = [[], [0.0] * 4, None, [1.0, None, 0.0, 0.0], [float("nan")] * 4, [1.0, 2.0], [1.0, 0.0, 0.0, 0.0]]
    rows = [(i, odd[i // 100] if i % 100 == 0 and i // 100 < len(odd) else [rng.uniform(-1, 1) for _ in range(4)], 1 if i % 40 else None) for i in range(1, 3001)]
    rows = [(i, v, 1 if i % 100 == 0 else label) for i, v, label in rows] + [(3100 + i, v, 1) for i, v in enumerate(odd)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = texts.exact_kernels(spark, str(tmp_path))
    held = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(held) <= 0.8 * sum(held)
    e = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"), "label")
    a, b = F.col("q"), F.col("embedding")
    want = q.join(e, "label").filter("vec_id <> q_id").select("q_id", "vec_id", F.round(V.dot(a, b), 6).alias("dot"), F.round(V.cosine(a, b), 6).alias("cosine"), F.round(V.l2_score(a, b), 6).alias("l2_score"), V.is_unit(b).alias("is_unit"))
    assert out.count() == want.count() > 0 == out.exceptAll(want).count()


def test_expansion_deals_only_what_a_step_asks(spark, monkeypatch):
    """Of a large graph a step deals the neighbours of its frontier, and a frontier without room asks nothing more."""
    edges = [(i, (i * 7 + j) % 5000, "a", j) for i in range(5000) for j in range(3)]
    seeds = {q: [(r, 100 * q + r, 1.0) for r in range(1, 4)] for q in range(3)}
    s = spark.createDataFrame([(q, *x) for q, rows in seeds.items() for x in rows], "query_id long, rank int, node long, score double")
    e = spark.createDataFrame(edges, "from_node long, to_node long, edge_type string, ordinal int")
    dealt, real = [], expansion.likely
    monkeypatch.setattr(expansion, "likely", lambda *args: (out := real(*args), dealt.append(out[0].filter("likely").count()))[0])
    got = {}
    for r in expansion.expanded(s, e, 2, 5, 2, ["a"]).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append(tuple(r)[1:])
    assert got == {q: plain_expansion(rows, edges, 2, 5, 2, ["a"], []) for q, rows in seeds.items()}
    # two of three neighbours fill a seed's room, so the second hop is left out but for the last seed's
    assert len(dealt) <= 4 and max(dealt) <= 20


def test_every_order_is_expanded(spark, tmp_path, monkeypatch):
    """orders of any number ask, those that the first hops of their parts settle without steps of their own."""
    rng = random.Random(4)
    # few orders are of parts that stand nowhere else
    lines = [(o, n, rng.randint(1, 30) if o % 9 else 100 + 4 * o + n, o % 3 + 1) for o in range(1, 90) for n in range(1, 5)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    at = {(o, n): p for o, n, p, _ in lines}
    edges = [(a, b, t, o) for (o, n), p in at.items() if (o, n + 1) in at for a, b, t in ((p, at[o, n + 1], "next"), (at[o, n + 1], p, "previous"))]
    stepped, real = [], expansion._stepped
    monkeypatch.setattr(expansion, "_stepped", lambda s, *args: (stepped.extend(r[0] for r in s.select("query_id").distinct().collect()), real(s, *args))[1])
    got = {}
    for r in collections.budgeted_expansion(spark, str(tmp_path)).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append((r["seed"], r["node"], r["hop"], r["place"]))
        assert r["score"] == pytest.approx(0.5 ** r["hop"] / (60 + min(n for o, n, p, _ in lines if (o, p) == (r["query_id"], r["seed"]))), abs=1e-6)
    seeds = {}
    for o, n, p, _ in lines:
        seeds.setdefault(o, []).append((n, p))
    plain = {o: plain_expansion([(n, p, 1.0) for n, p in rows], edges, 6, 30, 2, ["next", "previous"], []) for o, rows in seeds.items()}
    want = {o: [(*x[:3], x[4]) for x in rows] for o, rows in plain.items() if rows}
    assert got == want and 0 < len(stepped) < len(got)


def test_gaps_between_paragraphs_cost_a_text_once(spark, tmp_path):
    """A long last line is read once: from each of its places it took minutes."""
    texts_ = ["a\nb\nc\nd\n\ne\nf\ng\nh", "", "\n\n\n\n", "x\ny", "one\ntwo\nthree\n" + "z" * 400_000]
    spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    start = time.monotonic()
    got = sorted((r["source_id"], r["position"], r["first_line"], r["last_line"], r["text"]) for r in ingestion.paragraph_units(spark, str(tmp_path)).collect())
    assert time.monotonic() - start < 30
    assert got == [(0, 0, 1, 3, "a b c"), (0, 1, 5, 5, "d"), (0, 2, 7, 7, "e"), (0, 3, 9, 11, "f g h"), (3, 0, 1, 2, "x y"), (4, 0, 1, 3, "one two three"), (4, 1, 5, 5, "z" * 400_000)]
