"""Operators of the corpus subpackage against brute force on small fixtures, with nulls, ties, copies and odd columns."""

import collections
import hashlib
import itertools
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import langid, licenses, mixing, neardup, packing, quality, repeats, topk, toxicity, warc
from quillspark.llm.common import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, target string"
LONG = "the quick brown fox jumps over the lazy dog again and again near a river bank " * 3000


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), 7, "x") for i, t, lang, source in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns whose names clash."""
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, LONG, "en", "a"), (4, "a b c d e f g", None, None), (4, "a b c d e f g", None, None), (None, "one two three", "de", "b"), (None, None, None, None), (5, " \t\n", "fr", ""), (6, "é" * 500, "fr", "b"), (7, "é" * 500, "fr", "b")]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# languages


def test_viterbi_equals_brute_force(monkeypatch):
    monkeypatch.setattr(langid, "SEGMENT", 3)
    rng = np.random.default_rng(0)
    for _ in range(60):
        sizes = rng.integers(1, 8, 4)
        scores, doc = rng.normal(size=(sizes.sum(), 3)) * 2, np.repeat(np.arange(4), sizes)
        value = lambda s, p: sum(s[i, x] for i, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
        path = langid.viterbi(scores, doc, 1.5)
        for d in range(4):
            s = scores[doc == d]
            assert math.isclose(value(s, path[doc == d]), max(value(s, p) for p in itertools.product(range(3), repeat=len(s))))


def words_of(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_languages_and_spans(spark, odd, empty):
    rng = random.Random(1)
    rows = [(i, words_of(rng, a, 60), x, "s") for i, (a, x) in enumerate([("abcde", "xx"), ("fghij", "yy"), ("абвгд", "zz")] * 40)]
    docs = frame(spark, rows)
    model = langid.fit(docs)
    assert model[0] == ["xx", "yy", "zz"]
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == x and 0 <= got[i]["score"] <= 1 for i, _, x, _ in rows)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    mixed = frame(spark, [(1, words_of(rng, "abcde", 30) + " " + words_of(rng, "fghij", 20), None, None)])
    spans = langid.identify(mixed, model).first()["spans"]
    assert [(s["from"], s["to"], s["lang"]) for s in spans] == [(0, 30, "xx"), (30, 50, "yy")]
    out = langid.identify(odd, model).collect()
    assert len(out) == 10 and {r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 5)} == {"und"}
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.fit(empty)).collect()} == {"und"}


def test_two_scripts_and_many_languages(monkeypatch):
    rng = np.random.default_rng(16)
    names = [f"l{i}" for i in range(8)] + ["ru"]
    logs = rng.normal(-9, 0.1, (langid.BUCKETS, 9)).astype(np.float32)
    logs[:, 0] += 1
    scripts = np.zeros((langid.SCRIPTS, 9), bool)
    scripts[0, :8] = scripts[2, 8] = True
    text = " ".join(["word"] * 90 + ["слово"] * 10)
    want = ("l0", 360 / 410, [(0, 90, "l0"), (90, 100, "ru")])
    labeller = langid.Labeller((names, logs, scripts), 12.0)
    assert labeller.label([text, "", "слово " * 5, text]) == [want, ("und", 0.0, []), ("ru", 1.0, [(0, 5, "ru")]), want]
    monkeypatch.setattr(langid, "CELLS", 1)
    assert labeller.label([text, text]) == [want, want]


# quality


def brute_stats(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = collections.Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines, seen, dups = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dups += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(inside)


def test_quality_statistics(spark, odd, empty):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n\té#|\x1c ") for _ in range(rng.randint(0, 300))) for _ in range(200)] + [None, "", LONG]
    for t in texts:
        assert quality.text_stats(t)[:5] == brute_stats(t)
    out = quality.judge(odd, []).collect()
    assert len(out) == 10 and all(not r["kept"] for r in out if r["n_words"] < 50)
    assert quality.judge(empty, []).count() == 0
    assert quality.fit_rules(odd, labels(spark, [])) == []


def test_decision_list_finds_planted_rule(spark):
    rng = np.random.default_rng(5)
    x = rng.random((2000, 3))
    bad = (x[:, 0] > 0.8) & (x[:, 1] <= 0.5) | (x[:, 2] > 0.95)
    rules = quality.learn_list(x, bad, ["a", "b", "c"])
    found = np.zeros(2000, bool)
    for r in rules:
        found |= quality.covers(x, ["a", "b", "c"], r)
    assert (found == bad).mean() > 0.97
    assert quality.learn_list(x, np.zeros(2000, bool), ["a", "b", "c"]) == []


# mixing


def test_mixing(spark, odd, empty):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([0, 1, 5, 30, 200]), None, rng.choice(["a", "b", "c", "d", None])) for i in range(300)] + [(1000, "w " * 5000, None, "e")]
    out = mixing.mix(frame(spark, rows)).toPandas()
    total = out["size"].sum()
    by = out.groupby(out["source"].fillna("~"))[["size", "taken"]].sum()
    target = out.groupby(out["source"].fillna("~"))["target"].first()
    assert math.isclose(target.sum(), total) and (abs(by["taken"] - target) <= 0.5).all()
    assert (target <= 3 * by["size"] + 1e-6).all() and (out["taken"] <= 3 * out["size"]).all()
    again = mixing.mix(frame(spark, rows).repartition(7)).toPandas()
    assert again.sort_values("doc_id").reset_index(drop=True).equals(out.sort_values("doc_id").reset_index(drop=True))
    # weights 5, 2, 1, 5, 2, 1 in code-point order, null last; unsaturated sources share one level
    weight = dict(zip(["a", "b", "c", "d", "e", "~"], [5, 2, 1, 5, 2, 1]))
    level = {k: target[k] / weight[k] for k in weight if target[k] < 3 * by["size"][k] - 1e-6}
    assert max(level.values()) - min(level.values()) < 1e-6
    assert mixing.mix(odd).count() == 10 and mixing.mix(empty).count() == 0


def test_mixed_rows_follow_the_plan(spark, odd):
    rows = [(i, " ".join(f"{i}w{j}" for j in range(10)), "en", s) for i, s in enumerate("aaab")]
    docs = frame(spark, rows)
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    got = collections.Counter()
    for r in mixing.mixed(docs).collect():
        got[r["doc_id"]] += len(r["text"].split())
    assert got == {k: v for k, v in plan.items() if v}
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(odd).count() > 0


# packing


def test_packing_covers_every_id_once(spark, odd, empty):
    pd = packing.pack(odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).toPandas()
    encode = packing.tokenizer()
    texts = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"]}
    for i, rows in pd.groupby("doc_id"):
        ids = np.array([*encode(texts[i] or ""), 0], "<u4")
        rows = rows.sort_values("start")
        assert (rows["doc_tokens"] == len(ids)).all() and rows["length"].sum() == len(ids)
        assert [0, *rows["length"].cumsum()][:-1] == rows["start"].tolist()
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(rows["start"], rows["length"])] == rows["ids_crc32"].tolist()
    for _, rows in pd.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows["length"].sum() <= 1024 and [0, *rows["length"].cumsum()][:-1] == rows["offset"].tolist()
    assert packing.pack(odd).select("doc_id").distinct().count() == 8 and packing.pack(empty).count() == 0


def test_tokenizer_gives_the_ids_of_the_other_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.tokenizer()
    for x in ["hi <|endoftext|> there", "<|endoftext|><|endoftext|>a", "a<|endoftext|> \n b <|endoftext", " <|endoftext|>", "", "Hello  world\n\n12345 élève", "naïve 漢字 🙂 don't", "a" * 500, "\t\r\n x", LONG[:5000]]:
        assert t.encode(x, add_special_tokens=False).ids == encode(x)


def test_differencing_balances():
    rng = random.Random(6)
    sizes = [rng.randint(1, 128) for _ in range(300)]
    windows = packing.differencing(sizes, 8)
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(300)) and max(sums) - min(sums) <= 16
    assert all(sum(w) <= 10 for w in ([[6, 6, 6][i] for i in w] for w in packing.balanced([6, 6, 6], 10)))


# archives


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1) for i, u, h in rows], "page_id long, url string, html string, digest int")


def test_archives_round_trip(spark):
    same, short = "<p>" + "x" * 200, "tiny"
    rows = [(9, "u9", same), (3, "u3", same), (5, None, same), (1, "u1", short), (2, "u\n2", short), (4, "u4", None), (None, "n", same), (8, "u8", "é" * 90), (8, "u8", "é" * 90), (10, "z", "é" * 90)]
    root = new_path(spark, "t")
    out = warc.archive(pages(spark, rows), root, roll_bytes=600)
    got = sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out.collect())
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = min((j for j, _, k in rows if k == h and j is not None), default=None)
        again = len(b) >= 100 and i is not None and first != i
        want.append((i or -1, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(r["html"] is None for r in out.filter("record_type = 'revisit'").collect())
    sums = lambda r: sorted(x["sha256"] for x in spark.read.parquet(f"{r}/_manifest").collect())
    other = new_path(spark, "t")
    warc.write_archives(pages(spark, rows), other, roll_bytes=600)
    assert sums(root) == sums(other) and len(sums(root)) > 1
    assert warc.archive(pages(spark, []), new_path(spark, "t")).count() == 0


def test_archives_do_not_depend_on_partitions(spark):
    """More pages than range sampling keeps, one id with many payloads, two settings of partitions: equal files."""
    n = F.col("id")
    many = spark.range(9000).select(F.when(n % 100 < 30, F.lit(7)).when(n % 100 == 30, F.lit(None)).otherwise(n * 977 - 4_000_000).cast("long").alias("page_id"), F.concat(F.lit("u"), n % 5).alias("url"), F.repeat(F.md5((n % 6000).cast("string")), 8).alias("html"))
    manifests = []
    for order, partitions in (("id", 4), ("html", 13), ("url", 2)):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        root = new_path(spark, "t")
        mixed = many.repartition(partitions, F.col(order) if order != "id" else F.col("page_id"))
        got = warc.write_archives(mixed, root, roll_bytes=20_000, shard_bytes=100_000).collect()
        manifests.append(sorted((r["file"].rpartition("/")[2], r["records"], r["bytes"], r["sha256"], r["first_page"], r["last_page"]) for r in got))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert manifests[0] == manifests[1] == manifests[2] and sum(r[1] for r in manifests[0]) == 9000
    # the id with a third of the rows is cut too, and files follow the order of the ids
    assert sum(r[4] == r[5] == 7 for r in manifests[0]) > 5 and max(r[2] for r in manifests[0]) < 40_000
    firsts = [r[4] for r in manifests[0] if r[4] is not None]
    assert firsts == sorted(firsts) and len({r[0] for r in manifests[0]}) == len(manifests[0])
    keys = warc.shard_keys(warc.payloads(many), 1, most=7)
    assert len(keys) <= 7


# licences


def brute_scan(text, templates, t):
    words = licenses.normalised(text)
    best = {}
    for name, x in templates.items():
        w = licenses.normalised(x)
        m = set(zip(w, w[1:]))
        for a in range(len(words)):
            for b in range(a + 2, len(words) + 1):
                s = set(zip(words[a:b], words[a + 1 : b]))
                d = 2 * len(s & m) / (len(s) + len(m))
                if d >= t - 1e-12 and (name not in best or (-d, a, b - a) < best[name]):
                    best[name] = (-d, a, b - a)
    return best


def test_license_scan(spark, odd, empty):
    rng = random.Random(7)
    some = {k: v for k, v in licenses.TEMPLATES.items() if len(v) < 90}
    scanner = licenses.Scanner(some, 0.6)
    for _ in range(60):
        words = " ".join(rng.choice(list(some.values())) for _ in range(2)).split()
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = rng.choice(["the", "License", "foo"])
        want = brute_scan(" ".join(words), some, 0.6)
        got = scanner.scan_all(" ".join(words))
        assert bool(got) == bool(want) and (not want or max(x[1] for x in got) == -min(want.values())[0])
    docs = frame(spark, [(1, f"foo bar\n{licenses.TEMPLATES['MIT']} baz", None, None), (2, "nothing here", None, None)])
    assert [(r["doc_id"], r["license"], r["dice"], r["first_word"]) for r in licenses.scan_licenses(docs).collect()] == [(1, "MIT", 1.0, 2)]
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(empty).count() == 0


def brute_scan_all(text, templates, t):
    words = licenses.normalised(text)
    windows, taken = [], []
    for name, x in templates.items():
        w = licenses.normalised(x)
        m = set(zip(w, w[1:]))
        for a in range(len(words)):
            for b in range(a + 2, len(words) + 1):
                g = list(zip(words[a:b], words[a + 1 : b]))
                d = 2 * len(set(g) & m) / (len(set(g)) + len(m))
                if d >= t - 1e-12 and g[0] in m and g[-1] in m:
                    windows.append((name, d, a, b - a))
    while windows:
        best = {}
        for name, d, a, n in windows:
            best[name] = min(best.get(name, (1,)), (-d, a, n))
        d, n, a, name = min((d, -n, a, name) for name, (d, a, n) in best.items())
        taken.append((name, -d, a, -n))
        windows = [x for x in windows if x[2] + x[3] <= a or a - n <= x[2]]
    return sorted(taken, key=lambda x: x[2])


def test_license_scan_finds_every_occurrence(spark):
    rng = random.Random(15)
    some = {k: v for k, v in licenses.TEMPLATES.items() if len(v) < 90}
    scanner, more = licenses.Scanner(some, 0.6), 0
    for _ in range(40):
        words = " ".join(rng.choice(list(some.values())) for _ in range(3)).split()
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = rng.choice(["the", "License", "foo"])
        got = scanner.scan_all(" ".join(words))
        assert got == brute_scan_all(" ".join(words), some, 0.6)
        more += len(got) > len({name for name, *_ in got})
    assert more
    t = licenses.TEMPLATES
    texts = [f"{t['MIT']} foo {t['MIT']}", f"{t['Apache-2.0-header']} foo bar {t['Apache-2.0']}", f"{t['GPL-3.0']} foo bar This work is licenced under the GNU General Public License, version 2."]
    got = licenses.scan_licenses(frame(spark, [(i, x, None, None) for i, x in enumerate(texts)])).orderBy("doc_id", "first_word").collect()
    assert [(r["doc_id"], r["license"]) for r in got] == [(0, "MIT"), (0, "MIT"), (1, "Apache-2.0-header"), (1, "Apache-2.0"), (2, "GPL-3.0"), (2, "GPL-2.0")]


def test_license_scan_of_repetitive_words_is_fast():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    for phrase, n in (("all rights reserved ", 6667), ("permission is hereby granted ", 5000), ("the software ", 10_000)):
        began = time.process_time()
        scanner.scan_all(phrase * n)
        assert time.process_time() - began < 2
    for name, text in licenses.TEMPLATES.items():
        assert [(x[0], x[1]) for x in scanner.scan_all(f"some words before {text} and after")] == [(name, 1.0)]


# top k


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = np.random.default_rng(8)
    vectors = [(i, [float(x) for x in rng.choice([-0.5, -0.1, 0.0, 0.26, 0.5], 5)]) for i in range(200)]
    bad = [(200, None), (220, [1.0, None, 0.0, 0.0, 0.0]), (240, [float("nan")] * 5), (260, [float("inf")] * 5), (None, [0.1] * 5), (280, []), (300, [0.5] * 3)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors + bad], "vec_id long, embedding array<double>, score int, rank int")
    q = {i: [math.floor(64 * x) for x in v] for i, v in vectors}
    want = []
    for i in q:
        if i % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)[:20]
            want += [(i, r + 1, j, -d) for r, (d, j) in enumerate(s)]
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == sorted(want)
    few = topk.top_k(df.filter("vec_id < 4 OR vec_id IS NULL")).collect()
    assert len(few) == 3
    assert topk.top_k(df.limit(0)).count() == 0


# repeats


def brute_repeats(rows, n):
    count = collections.Counter(b[i : i + n] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - n + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("v", repeats.COVERS)
def test_covers_give_every_difference(v):
    assert {(a - b) % v for a in repeats.COVERS[v] for b in repeats.COVERS[v]} == set(range(v))


@pytest.mark.parametrize("length,block", [(24, 4 << 20), (24, 500), (40, 500), (60, 2000)])
def test_repeats_equal_brute_force(spark, monkeypatch, length, block):
    monkeypatch.setattr(repeats, "BLOCK", block)
    rng = random.Random(9)
    piece = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    base = [piece(60) for _ in range(5)]
    rows = [(i, "".join(rng.choice([rng.choice(base), piece(rng.randint(0, 30)), "ab" * rng.randint(0, 40)]) for _ in range(rng.randint(0, 5)))) for i in range(120)]
    rows += [(500, None), (501, ""), (None, rows[3][1]), (7, rows[7][1]), (None, None)]
    docs = frame(spark, [(i, t, None, None) for i, t in rows])
    assert sorted(map(tuple, repeats.remove_repeats(docs, length).collect()), key=str) == brute_repeats(rows, length)
    left = repeats.remove_repeats(docs, length, text=True)
    assert left.columns == docs.columns and left.count() == len(rows)


@pytest.mark.parametrize("words", [5, 8])
def test_repeated_words_equal_brute_force(spark, words):
    rng = random.Random(13)
    piece = lambda n: [rng.choice(["a", "b", "é", "ab", "c" * 9]) for _ in range(n)]
    base = [piece(14) for _ in range(5)]
    rows = [(i, [w for _ in range(rng.randint(0, 5)) for w in rng.choice([rng.choice(base), piece(rng.randint(0, 8)), ["a", "b"] * rng.randint(0, 6)])]) for i in range(120)]
    rows += [(500, []), (None, rows[3][1]), (7, rows[7][1])]
    docs = frame(spark, [(i, "".join(w + rng.choice([" ", "\n", "  "]) for w in ws), None, None) for i, ws in rows] + [(501, None, None, None)])
    count = collections.Counter(tuple(ws[i : i + words]) for _, ws in rows for i in range(len(ws) - words + 1))
    want = []
    for d, ws in rows:
        gone = {i + j for i in range(len(ws) - words + 1) if count[tuple(ws[i : i + words])] > 1 for j in range(words)}
        want.append((d, [w for i, w in enumerate(ws) if i not in gone]))
    got = [(r["doc_id"], (r["text"] or "").split()) for r in repeats.remove_repeats(docs, text=True, words=words).collect()]
    assert sorted(got, key=str) == sorted([*want, (501, [])], key=str) and 0 < sum(len(ws) for _, ws in want) < sum(len(ws) for _, ws in rows)


def test_repeats_odd_tables(spark, odd, empty):
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in repeats.remove_repeats(odd).collect()}
    assert got[3, len(LONG)] == len(LONG) and got[6, 1000] == 1000 and got[2, 0] == 0
    assert repeats.remove_repeats(empty).count() == 0


# toxicity


def test_grammar_scores_clauses():
    s = toxicity.Scorer({"idiot": 2.0})
    total = lambda t: s.features(t)[1]
    assert total("nothing to see") == 0 and total("") == 0
    assert total("you are an idiot") > total("an idiot walked by") > total("he said she is an idiot") > 0
    assert total("you are not an idiot") < total("an idiot walked by")
    assert total("i will kill you. fine") < total("you idiot, i will kill you")
    assert total("you. idiot") == total("idiot")
    assert total("idiot, you") == total("you idiot") > total("idiot")
    assert total("we will kill him") > total("the frost will kill roses") > total("frost kills roses") > 0
    assert total("such an idiot") == total("idiot") < total("very idiot") and total("i will not kill you") < total("i will kill you")


def test_composition_equals_rewriting_in_turn():
    """The composed automaton writes what its transducers write one after the other over the whole sequence."""
    rng = random.Random(17)
    kinds = ["word", "slur", "intensifier", "actor", "modal", "violence", "target", "negation", "report", "quote"]
    chain = [toxicity.insults(), toxicity.threats(), toxicity.negation(), toxicity.reported(), toxicity.targets()]
    for _ in range(300):
        symbols = [rng.choice(kinds) for _ in range(rng.randint(0, 14))]
        whole, state, got = toxicity.grammar(), toxicity.grammar().start, []
        for x in symbols:
            state, y = whole.step(state, x)
            got.append(y)
        want = symbols
        for t in chain:
            at, out = t.start, []
            for x in want:
                at, y = t.arcs.get((at, x), (at, x))
                out.append(y)
            want = out
        assert got == want


def test_toxicity_learns(spark, odd, empty):
    rng = random.Random(10)
    clean = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam".split()
    rows, marks = [], []
    for i in range(300):
        words = [rng.choice(clean) for _ in range(30)]
        if i % 3 == 0:
            words.insert(rng.randrange(30), rng.choice(["grobniks", "grobnika", "zworfel"]))
        rows.append((i, " ".join(words), "en", "s"))
        marks.append((i, 1, int(i % 3 == 0)))
    docs, lab = frame(spark, rows), labels(spark, marks + [(None, None, None), (5, None, None)])
    model = toxicity.fit(docs, lab)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i]["predicted"] == y and 0 <= got[i]["score"] <= 1 for i, _, y in marks)
    assert sorted(r["doc_id"] for r in toxicity.keep_clean(docs, model).collect()) == [i for i, _, y in marks if not y]
    assert toxicity.score(odd, model).filter("predicted = 0").count() == 10 and toxicity.score(empty, model).count() == 0
    assert toxicity.score(odd, toxicity.fit(docs, labels(spark, []))).filter("predicted = 0").count() == 10


# near duplicates


def brute_near(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def test_blocks_by_size_miss_no_link_around_a_centre(spark, monkeypatch):
    """Many sets share half their words with one centre, so bands meet there; links lie between the others, of all sizes."""
    monkeypatch.setattr(neardup, "CHUNK_SHINGLES", 150)
    rng = random.Random(12)
    core = [f"c{i}" for i in range(30)]
    texts = [" ".join(core)]
    for g in range(25):
        own = [f"g{g}_{i}" for i in range(rng.randint(5, 60))]
        for _ in range(3):
            more = [f"x{rng.random()}" for _ in range(rng.choice([0, 1, 2, 5, 9]))]
            texts.append(" ".join(core + own + more))
    for percent, few in ((85, 16), (60, 1000), (100, 16), (85, 0), (60, 3)):
        monkeypatch.setattr(neardup, "FEW", few)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        # one row a band: nearly every pair with something in common meets
        got = neardup.near_duplicates(docs, 3, percent, 60, 1).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_near(list(enumerate(texts)), 3, percent)


def test_common_shingles_make_no_rows_around_a_centre(spark, monkeypatch):
    """All nodes hold the same 60 shingles: rows are made of prefixes alone, and sets that are alike share a key."""
    rng = np.random.default_rng(5)
    common, sets = np.arange(60, dtype=np.uint64), []
    for g in range(40):
        own = rng.integers(1000, 1 << 60, 40).astype(np.uint64)
        sets += [np.sort(np.r_[common, own]), np.sort(np.r_[common, own[:37], rng.integers(1000, 1 << 60, 2).astype(np.uint64)])]
    names = [b"%04d" % i for i in range(len(sets))]
    m = spark.createDataFrame([(b"c", names[i], len(s), 1, names[i], True) for i, s in enumerate(sets)], "a binary, node binary, n long, cls long, root binary, apart boolean")
    held = spark.createDataFrame([(names[i], s.tobytes()) for i, s in enumerate(sets)], "node binary, shingles binary")
    sizes, write = [], neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, name: (out := write(df, name), sizes.append(out[0].count()))[0])
    rows = neardup._rare(m, held, 85)[0].collect()
    assert max(sizes) <= sum(len(s) - -(-len(s) * 85 // 100) + 1 for s in sets)
    keys = {n: {r["a"] for r in rows if r["node"] == n} for n in names}
    assert all(keys[names[i]] & keys[names[i + 1]] for i in range(0, len(names), 2))
    assert not keys[names[0]] & keys[names[3]]


def test_counts_of_slots_are_few_rows_whatever_a_task_reads(spark, monkeypatch):
    """A task's counts are a row for each range of slots at most, and add up to those of all rows."""
    rng = np.random.default_rng(6)
    sets = [rng.integers(0, 1 << 60, 400).astype(np.uint64) for _ in range(60)]
    rows = [(b"c%d" % (i % 3), np.sort(np.r_[s, sets[0][:50]]).tobytes()) for i, s in enumerate(sets)]
    around = spark.createDataFrame(rows, "a binary, shingles binary").repartition(4)
    made, real = [], type(around).mapInArrow
    monkeypatch.setattr(type(around), "mapInArrow", lambda self, *args: (out := real(self, *args), made.append(out.count()))[0])
    got = neardup._frequencies(around)
    want = np.zeros(neardup.SLOTS, np.int64)
    for a, x in rows:
        np.add.at(want, neardup._slots(a, np.frombuffer(x, np.uint64)), 1)
    assert (got == want).all() and want.max() > 1
    assert max(made) <= 4 * 64 < (want > 0).sum()


def test_near_duplicates_equal_brute_force(spark, odd, empty):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 40, 120]))]
        for _ in range(rng.choice([1, 3, 25])):
            words = list(rng.choice([base, rows[-1][1].split()]) if rows and g and len(rows[-1][1].split()) > 3 else base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((1000 - len(rows), " ".join(words).upper() if rng.random() < 0.3 else " ".join(words)))
    rows += [(1, ""), (2, None), (3, "x"), (4, "X"), (5, "x y"), (6, " ")]
    docs = frame(spark, [(i, t, None, None) for i, t in rows])
    for k, percent, bands, size in ((3, 85, 25, 5), (5, 80, 31, 4)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, k, percent, bands, size).collect()}
        assert got == brute_near(rows, k, percent)
    out = neardup.near_duplicates(odd).collect()
    assert len(out) == 10 and all(r["kept"] for r in out if r["doc_id"] is None) and sum(r["doc_id"] == 7 and not r["kept"] for r in out) == 1
    assert neardup.near_duplicates(empty).count() == 0


# the pipeline


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(100))
    rows = [(i, " ".join(word() for _ in range(80)), "en", f"s{i % 2}") for i in range(60)]
    rows += [(100, rows[0][1] + " extra", "en", "s0"), (101, passage + " " + " ".join(word() for _ in range(40)), "en", "s0"), (102, " ".join(word() for _ in range(40)) + " " + passage, "en", "s1"), (103, None, None, None), (104, "", None, None)]
    bad = [(200 + i, f"{word()} {word()} zworfel {word()}", "en", "s0") for i in range(60)]
    docs = spark.createDataFrame([(i, t, x, s, len(t or "")) for i, t, x, s in rows + bad], "doc_id long, text string, lang string, source string, n_chars long")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    labels(spark, [(i, 1, int(i >= 200)) for i, *_ in rows + bad]).write.parquet(f"{d}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    clean = stage["toxicity"](spark, docs, d)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, *_ in rows}
    near = stage["near_dedup"](spark, clean, d)
    assert {r["doc_id"] for r in near.collect()} == {i for i, *_ in rows} - {100}
    left = stage["repeat_removal"](spark, near, d)
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert passage not in texts[101] and passage not in texts[102] and texts[5] == rows[5][1] and left.columns == docs.columns
    mixed = stage["mixing"](spark, left, d)
    assert mixed.columns == docs.columns and abs(sum(len(r["text"].split()) for r in mixed.collect()) - sum(len((t or "").split()) for t in texts.values())) <= 3
    assert corpus_pipeline.run(spark, d).groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0


def test_pipeline_removes_rows_not_ids(spark):
    import corpus_pipeline

    rng = random.Random(16)
    a, b = (" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(60)) for _ in range(2))
    docs = frame(spark, [(3, a, "en", "s"), (5, b, "en", "s"), (5, a, "en", "s"), (None, a, "en", "s"), (9, None, None, None)])
    near = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    assert near.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in near.collect()), key=str) == sorted([(3, a), (5, b), (None, a), (9, None)], key=str)


def test_clashing_columns(spark):
    names = ["_own", "_starts", "_digest", "_taken", "_size", "_plan", "_id", "_gone", "row", "digest", "whole", "spans", "passages", "node", "key"]
    docs = frame(spark, [(i, f"w{i} " * 60, "en", "s") for i in range(4)])
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    assert repeats.remove_repeats(docs, text=True, words=51).columns == docs.columns
    assert {r["_digest"] for r in mixing.mixed(docs).collect()} == {"_digest"} and mixing.mixed(docs).columns == docs.columns
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(4)], "doc_id long, quality int, toxic int")
    assert toxicity.keep_clean(docs, toxicity.fit(docs, marks)).columns == docs.columns
    assert quality.judge(docs, quality.fit_rules(docs, marks)).count() == 4
    assert neardup.near_duplicates(docs).count() == 4 and packing.pack(docs).count() >= 4


def test_pipeline_removes_passages_of_51_short_words(spark):
    import corpus_pipeline

    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))
    own = lambda: " ".join(word() for _ in range(40))
    passages = [" ".join(word() for _ in range(n)) for n in (50, *range(51, 61))]
    assert all(len(p) < 400 for p in passages)
    rows = [(10 * k + j, f"{own()} {p} {own()}") for k, p in enumerate(passages) for j in range(2)]
    docs = frame(spark, [(i, t, "en", "s") for i, t in rows])
    left = {r["doc_id"]: r for r in dict(corpus_pipeline.STAGES)["repeat_removal"](spark, docs, "").collect()}
    for i, t in rows:
        p = passages[i // 10]
        assert left[i]["text"] == (t if i < 10 else t.replace(p, "")) and left[i]["n_chars"] == len(left[i]["text"])


def test_only_likely_rows_are_dealt(spark):
    """Marks never miss a key, and leave nearly all else out; null keys count as equal here, the join decides."""
    from quillspark.llm.common import likely

    keys = spark.range(0, 2000, 7).select(F.col("id").alias("k"), F.lit(b"x").alias("b"))
    x, _ = likely(spark.range(2000).select(F.col("id").alias("k"), F.lit(b"x").alias("b")), keys, ["k", "b"])
    found = {r["k"] for r in x.filter("likely").collect()}
    assert x.count() == 2000 and found >= set(range(0, 2000, 7)) and len(found) < 290
    assert likely(keys, keys.limit(0), ["k"])[0].filter("likely").count() == 0


def test_a_small_centre_sends_each_set_once(spark, monkeypatch):
    """Nodes of many classes of sizes around one centre, all apart: each went to its own class's block and to both neighbours'."""
    monkeypatch.setattr(neardup, "_compare_blocks", lambda percent: lambda block: block[["node", "node"]].set_axis(["a", "b"], axis=1))
    m = spark.createDataFrame([(b"a", bytes([i]), n, n // 10, bytes([i]), i > 0) for i, n in enumerate((30, 33, 40, 44, 50))], "a binary, node binary, n long, cls long, root binary, apart boolean")
    sets = m.select("node", F.lit(b"\0" * 8).alias("shingles"))
    near, _ = neardup._near(m)
    sent = [r["a"] for r in neardup._across(m, near, sets, 80).collect()]
    assert len(sent) == len(set(sent)) == 5
