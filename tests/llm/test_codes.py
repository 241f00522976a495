"""Vector codes, byte-level BPE and periodic runs against plain versions and the library they must agree with."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, codes, queries, runs

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, ids string, decoded long, x string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 3, None) for i, t in rows], DOCS)


# vector codes


def plain_codes(rows, parts, entries, rounds, scale):
    """The contract in Python's integers: rows (vec_id, vector, label)."""
    kept = [(i, [int(np.floor(scale * float(c))) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    d = width // parts
    cut = lambda v, p: v[p * d : (p + 1) * d]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def near(v, p):
        far = [sum((a - b) ** 2 for a, b in zip(cut(v, p), c)) for c in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        groups = {}
        for _, v, _ in kept:
            for p in range(parts):
                groups.setdefault((p, near(v, p)[0]), []).append(cut(v, p))
        for (p, e), some in groups.items():
            books[p][e] = [sum(x) // len(some) for x in zip(*some)]
    out = [(i, "".join(f"{near(v, p)[0]:02x}" for p in range(parts)), sum(near(v, p)[1] for p in range(parts)), label) for i, v, label in kept]
    by_label = {}
    for _, _, e, label in out:
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    return [(i, code, min(e, 2**63 - 1), min(by_label[label], 2**63 - 1), digest) for i, code, e, label in out]


def coded(df):
    return [(r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect()]


KEY = lambda r: (r[0] is None, *(str(x) for x in r))


@pytest.mark.parametrize("scale_up", [1.0, 3e6])
def test_codes_equal_plain_integers(spark, scale_up):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(c) * scale_up for c in rng.normal(size=8).round(2)], int(i) % 3 or None) for i in rng.permutation(150)]
    rows += [rows[0], (None, rows[1][1], 1), (200, None, 1), (201, [1.0, None] + [0.0] * 6, 1), (202, [float("nan")] * 8, 2), (203, [float("inf")] * 8, 2), (204, [0.0] * 8, None), (205, [0.0] * 8, None)]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, x long").repartition(5)
    got = coded(codes.compress(table, parts=4, entries=16))
    assert sorted(got, key=KEY) == sorted(plain_codes(rows, 4, 16, 2, 256), key=KEY)


def test_codes_of_few_and_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert coded(codes.compress(spark.createDataFrame([], schema))) == []
    one = coded(codes.compress(spark.createDataFrame([(7, [0.5] * 16, "a")], schema)))
    assert [r[:4] for r in one] == [(7, "00" * 16, 0, 0)]
    odd = coded(codes.compress(spark.createDataFrame([(1, [0.5] * 16, "a"), (2, [0.5] * 15, "a"), (3, [], None)], schema)))
    assert sorted(r[:4] for r in odd) == [(1, "00" * 16, 0, 0), (2, None, None, 0), (3, None, None, None)]
    assert {r[1] for r in coded(codes.compress(spark.createDataFrame([(1, [0.5] * 15, "a")], schema)))} == {None}


def test_nearest_takes_the_first_of_equals():
    x, entries = np.array([[[2], [5]]]), np.array([[[1], [3], [3], [7]]])
    assert codes.nearest(x, entries)[0].tolist() == [[0, 1]] and codes.nearest(x, entries)[1].tolist() == [[1, 4]]
    big = codes.nearest(x * 10**12, entries * 10**12)
    assert big[0].tolist() == [[0, 1]] and big[1].tolist() == [[10**24, 4 * 10**24]]


# byte-level BPE


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return tiktoken.Encoding("oracle", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


ODD_TEXTS = ["", " ", "\n\n \t", "a" * 3000, "<|endoftext|> x", "naïve 日本語テスト 👩‍👩‍👧 ​", "it's we'LL 12345  x\r\n\x1c\x85 ", "é" * 900, "ab " * 40_000, " ퟿", "��"]


def random_texts(seed, n, tokens):
    rng = random.Random(seed)
    return ["".join(rng.choice(tokens) if rng.random() < 0.7 else chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0xD7FF), rng.randrange(0x10000, 0x11000)])) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_ids_and_bytes_are_those_of_the_other_library(library):
    path, pattern = bpe._files("byte_bpe_multi_50k")
    encoder, decoder = bpe.Encoder(path, pattern), bpe.Decoder(path)
    tokens = [t.decode("utf-8", "ignore") for t in bpe.read_ranks(path)]
    texts = ODD_TEXTS + random_texts(1, 2000, tokens)
    for text, (ids, _) in zip(texts, encoder.encode(texts)):
        ids = np.frombuffer(ids, "<u4")
        assert ids.tolist() == library.encode_ordinary(text)
        assert decoder.bytes_of(ids) == text.encode() and "".join(decoder.texts_of(ids)) == text


def test_offsets_and_split_characters(library, monkeypatch):
    path, pattern = bpe._files("byte_bpe_multi_50k")
    texts = ODD_TEXTS + random_texts(2, 200, ["word ", "日", "👩", "\U0001f9ff", "\n"])
    encoder, decoder = bpe.Encoder(path, pattern, offsets=True), bpe.Decoder(path)
    whole = encoder.encode(texts)
    for text, (ids, spans) in zip(texts, whole):
        place, last = 0, 0
        for i, (lo, hi) in zip(np.frombuffer(ids, "<u4").tolist(), spans.tolist()):
            token = decoder.token[i]
            end = place + len(token)
            # the span is the least run of characters whose bytes hold the token's
            assert len(text[:lo].encode()) <= place < len(text[: lo + 1].encode()) and len(text[: hi - 1].encode()) < end <= len(text[:hi].encode())
            place, last = end, hi
        assert last == len(text)
    monkeypatch.setattr(bpe, "CHUNK", 50)
    monkeypatch.setattr(bpe, "PIECES", 7)
    monkeypatch.setattr(bpe, "KEPT", 5)
    small = bpe.Encoder(path, pattern, offsets=True)
    for text, (ids, spans) in zip(texts, whole):
        ((a, b),) = small.encode([text])
        assert a == ids and np.array_equal(b, spans)
    assert len(small.known) <= 5


def test_bpe_over_tables(spark, library):
    texts = ODD_TEXTS + [None]
    docs = docs_of(spark, [(None if k == 3 else k // 2, t) for k, t in enumerate(texts)])
    got = bpe.digests(bpe.decode(bpe.encode(docs))).collect()
    want = []
    for k, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        want.append((None if k == 3 else k // 2, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    rows = bpe.encode(docs, offsets=True).collect()
    assert all(len(r["starts"]) == len(r["ends"]) == len(r["ids"]) // 4 for r in rows)
    assert bpe.encode(docs_of(spark, [])).count() == 0 == bpe.decode(bpe.encode(docs_of(spark, []))).count()


# periodic runs


def plain_runs(t):
    """(start, end, smallest period) by trying every period at every place."""
    found = {}
    for q in range(1, len(t) // 4 + 1):
        i = 0
        while i + q < len(t):
            j = i
            while j + q < len(t) and t[j] == t[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in found.items())


def repetitive(rng):
    t = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 4)):
        t += [rng.randrange(4) for _ in range(rng.randint(1, 6))] * rng.randint(1, 9)
        if rng.random() < 0.5:
            t += t[rng.randrange(len(t)) :][:60]
    return t


def test_runs_equal_plain_ones():
    rng = random.Random(5)
    for _ in range(500):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 6))]
        got = runs.all_runs([np.array(t, np.int64) for t in texts])
        assert [sorted(g) for g in got] == [plain_runs(t) for t in texts]


def test_previous_factors_and_common_letters():
    rng = random.Random(6)
    for _ in range(100):
        t = repetitive(rng) + [99]
        names = runs.Names(np.array(t, np.int64))
        assert names.order.tolist() == sorted(range(len(t)), key=lambda i: [(x) for x in t[i:]])
        factor, source = runs.previous_factors(names)
        same = lambda i, j: next((k for k in range(len(t)) if max(i, j) + k >= len(t) or t[i + k] != t[j + k]), 0)
        for i in range(len(t)):
            assert factor[i] == max((same(i, j) for j in range(i)), default=0)
            assert source[i] < 0 or (source[i] < i and same(i, source[i]) == factor[i])


def plain_row(doc_id, text, plant):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if plant and doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = [(s, e - s, q) for s, e, q in plain_runs(words)]
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in found).encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


@pytest.mark.parametrize("most", [50, 200_000])
def test_runs_over_tables(spark, monkeypatch, most):
    monkeypatch.setattr(runs, "WORDS", most)
    rng = random.Random(8)
    texts = [" ".join(f"w{x}" for x in repetitive(rng)) for _ in range(150)] + [None, "", " \t\n", "a " * 9, "a b c " * 20, " x\x0b\x0c" * 7, "one two three"]
    rows = [(None if k % 50 == 7 else k % 140, t) for k, t in enumerate(texts)]
    docs = docs_of(spark, rows).repartition(3)
    for plant in (True, False):
        got = [tuple(r) for r in runs.periodic_runs(docs, plant).collect()]
        assert sorted(got, key=str) == sorted((plain_row(i, t, plant) for i, t in rows), key=str)
    assert runs.periodic_runs(docs_of(spark, [])).count() == 0


def test_runs_of_a_long_text_are_found_in_time():
    rng = random.Random(9)
    tail = [rng.randrange(1000) for _ in range(9000)]
    t = [rng.randrange(1000) for _ in range(20_000)] + tail * 5 + [7] * 30_000 + [7, 8] * 20_000
    got = runs.all_runs([np.array(t, np.int64)])[0]
    assert (20_000, 65_000, 9000) in got and any(q == 1 and e - s >= 30_000 for s, e, q in got) and any(q == 2 for _, _, q in got)


# queries over whole tables


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_codes_query_equals_its_sql(spark, sf):
    got = coded(queries.op11_codes(spark, sf))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    want = duck.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({queries.oracle_sql()['op11_codes']})").fetchall()
    assert sorted(got) == sorted(want) and len(want) > 0


def test_bpe_query_over_the_whole_table(spark, library):
    got = {r["doc_id"]: r for r in queries.op12_bpe(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]]["n_tokens"] == len(ids) and got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_runs_query_over_the_whole_table(spark):
    got = sorted((tuple(r) for r in queries.op13_runs(spark, SF).collect()), key=str)
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("text")).collect()
    assert got == sorted((plain_row(r["doc_id"], r["text"], True) for r in rows), key=str)
    assert sum(r[1] for r in got) > 0
