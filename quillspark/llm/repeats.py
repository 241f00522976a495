"""Removal of long repeated strings by a distributed difference-cover algorithm.

The places of a text whose residue modulo v is in a difference cover are its sample: any two places have a common
distance below v to sampled places, so two equal strings of `length` units hold equal sampled suffixes. The steps:

1. sampled suffixes are named by their first v units; names are sorted, and those that stand alone are done;
2. the recursion is on names: three neighbouring ones of a residue, none of them alone, name 3 v units, which every
   repeated string of `length` >= 4 v - 1 units holds; these names are sorted too;
3. the suffixes that remain, all starts within v before a sampled suffix that is not alone, are merged: named by their
   first `length` units (128 bits), in slices of the range of names;
4. adjacent ones are compared: a start whose neighbour has the same prefix repeats.

Texts lie in blocks, one row each. A block sends each distinct name once to the bucket of its range, with a mark if it
has it twice, so copies and common passages make no bucket hot, and gets one bit for each name back. What steps 3 and 4
read is cut out of the blocks after step 1 and again after step 2.

Units are bytes, or words (as hashes of 8 bytes); the same steps serve both."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import new_path, release, remove, written

#: Bytes and words of a string whose repetition counts.
LENGTH, PASSAGE = 400, 51
#: Difference covers: the residues' differences give every residue modulo the first number.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52), 91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)}
#: Bytes of text in a block, bytes of names in a bucket, slices of the range of names, places named at once.
BLOCK, BUCKET, SLICES, STEP = 4 << 20, 4 << 20, 3, 1 << 13
#: Words are what ASCII space separates, as in common.WORD.
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
PIECES = "key binary, n long, digests binary, twice binary, base binary, sizes binary, at binary, data binary"
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
_U = np.uint64


def cover(length: int) -> tuple[int, np.ndarray]:
    """The largest modulus whose triples of names fit into every string, and its residues."""
    v = max(v for v in COVERS if 4 * v <= length + 1)
    return v, np.array(COVERS[v])


def _mixed(a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
    x = a * MULTIPLIERS[lane]
    x += b
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    return x


def _finished(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> _U(32))) * _U(0x94D049BB133111EB)


def names_at(units: np.ndarray, at: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """64-bit names of the strings of `length` units at ascending places: halves are named first, then joined."""
    out = np.empty(len(at), _U)
    cut = np.searchsorted(at, np.arange(0, len(units) + STEP, STEP))
    for k in np.flatnonzero(np.diff(cut)):
        c, some = k * STEP, at[cut[k] : cut[k + 1]] - k * STEP
        part = units[c : c + STEP + length - 1]
        if part.dtype == np.uint8 and length >= 8:
            h, w = np.ndarray(len(part) - 7, "<u8", buffer=np.ascontiguousarray(part), strides=(1,)), 8
        else:
            h, w = part.astype(_U), 1
        h = _mixed(h, _U(w), lane)
        while 2 * w <= length:
            h, w = _mixed(h[:-w], h[w:], lane), 2 * w
        out[cut[k] : cut[k + 1]] = _finished(h[some] if w == length else _mixed(h[some], h[some + length - w], lane))
    return out


def sampled(sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Sampled places of joined texts where v units follow, the text of each, and its number among the text's."""
    v, residues = cover(length)
    sizes = np.where(np.diff(np.r_[0, np.cumsum(sizes)]) >= length, sizes, 0)
    places = (np.arange(0, max([0, *sizes]) + v, v)[:, None] + residues).ravel()
    count = np.searchsorted(places, sizes - v, side="right") * (sizes > 0)
    text = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return places[number], text, number


def ranked(lanes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of names, and which of them in that order differ from the one before."""
    order = np.argsort(lanes[0])
    x = [lane[order] for lane in lanes]
    if len(x) == 2 and ((x[0][1:] == x[0][:-1]) & (x[1][1:] != x[1][:-1])).any():  # the second lane decides
        order = np.lexsort(lanes[::-1])
        x = [lane[order] for lane in lanes]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([lane[1:] != lane[:-1] for lane in x])
    return order, new


class Pieces:
    """A row of PIECES: texts, or pieces of them, joined. base: where a piece begins in its text; at: places to name."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        get = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)
        self.key, self.data = batch.column("key")[i].as_py(), batch.column("data")[i].as_buffer()
        self.digests, self.twice = get("digests", "V16"), get("twice", bool)
        self.base, self.sizes, self.at = (get(x, np.int64) for x in ("base", "sizes", "at"))

    def units(self, coded: bool, cut: bool) -> np.ndarray:
        """Bytes, or hashes of words; texts that are not cut yet are split into words first."""
        if not coded:
            return np.frombuffer(self.data, np.uint8)
        if cut:
            return np.frombuffer(self.data, _U)
        b, ends, hashes, sizes = self.data.to_pybytes(), np.cumsum(self.sizes), [], []
        for lo, hi in zip(ends - self.sizes, ends):
            words = b[lo:hi].split()
            sizes.append(len(words))
            hashes += map(xxhash.xxh3_64_intdigest, words)
        self.sizes = np.array(sizes, np.int64)
        return np.array(hashes, _U)

    def around(self, units: np.ndarray, hits: np.ndarray, text: np.ndarray, length: int) -> list | None:
        """The pieces that hold the starts within v before a hit, as a row of PIECES; `at` keeps the hits."""
        v, _ = cover(length)
        ends = np.cumsum(self.sizes)
        starts = ends - self.sizes
        lo, hi = np.maximum(hits - v + 1, starts[text]), np.minimum(hits, ends[text] - length)
        good = hi >= lo
        if not good.any():
            return None
        lo, hi, hits, text = lo[good], hi[good], hits[good], text[good]
        first = np.r_[True, lo[1:] > hi[:-1] + 1]
        a, z, text = lo[first], hi[np.r_[first[1:], True]], text[first]
        size = z - a + length
        at = hits - (a - (np.cumsum(size) - size))[np.cumsum(first) - 1]
        data = np.concatenate([units[p:q] for p, q in zip(a, a + size)])
        base = self.base[text] + a - starts[text]
        return [self.key, len(data), self.digests[text].tobytes(), self.twice[text].tobytes(), base.tobytes(), size.tobytes(), at.tobytes(), data.tobytes()]


def _rows(rows: list[list]) -> Iterator[pa.RecordBatch]:
    if rows:
        kinds = [pa.int64() if x.endswith(" long") else pa.binary() for x in PIECES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in PIECES.split(", ")])


def _packed(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A table of PIECES in the shared folder."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def blocks(docs: DataFrame, least: int) -> DataFrame:
    """Distinct texts of at least so many bytes, joined to rows of about BLOCK bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def row() -> list:
            sizes = np.array([len(t) for _, _, t in held], np.int64)
            data = b"".join(t for _, _, t in held)
            return [held[0][0], len(data), b"".join(d for d, _, _ in held), np.array([n > 1 for _, n, _ in held]).tobytes(), np.zeros(len(held), np.int64).tobytes(), sizes.tobytes(), b"", data]

        for batch in batches:
            for digest, n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                held.append((digest, n, text.as_buffer().to_pybytes()))
                size += len(held[-1][2])
                if size >= BLOCK:
                    yield from _rows([row()])
                    held, size = [], 0
        if held:
            yield from _rows([row()])

    x = docs.select("text").filter(F.octet_length("text") >= least).groupBy(F.unhex(F.md5("text")).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text"))
    return x.select("digest", "n", "text").mapInArrow(run, PIECES)


def shared(table: DataFrame, names: Callable[[Pieces], list[np.ndarray]], buckets: int, part: range | None = None) -> DataFrame:
    """key, bucket, n and flags: for the n distinct names of a row in a bucket, in order, whether each occurs elsewhere.

    names: one or two lanes of 64 bits for each named place. part: the buckets that are asked for."""
    part = part or range(buckets)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = Pieces(batch, i)
                lanes = names(row)
                if len(part) < buckets:
                    bucket = ((lanes[0] >> _U(32)) * _U(buckets)) >> _U(32)
                    some = (bucket >= part.start) & (bucket < part.stop)
                    lanes = [x[some] for x in lanes]
                if not len(lanes[0]):
                    continue
                order, new = ranked(lanes)
                first = np.flatnonzero(new)
                twice = np.diff(np.r_[first, len(order)]) > 1
                lanes = [x[order[first]] for x in lanes]
                bucket = ((lanes[0] >> _U(32)) * _U(buckets)) >> _U(32)
                own, cut = np.unique(bucket, return_index=True)
                out = [(int(b), row.key, p, n, twice[p : p + n]) for b, p, n in zip(own, cut, np.diff(np.r_[cut, len(bucket)]))]
                yield pa.RecordBatch.from_arrays([
                    pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[3] for x in out], pa.int32()),
                    pa.array([b"".join(lane[p : p + n].tobytes() for lane in lanes) for _, _, p, n, _ in out], pa.binary()), pa.array([np.packbits(x[4]).tobytes() for x in out], pa.binary()),
                ], names=["bucket", "key", "n", "names", "twice"])

    def compare(x: pa.Table) -> pa.Table:
        n = x.column("n").to_numpy()
        sent = [np.frombuffer(v.as_buffer(), _U).reshape(-1, k) for v, k in zip(x.column("names"), n)]
        lanes = [np.concatenate([s[lane] for s in sent]) for lane in range(len(sent[0]))]
        order, new = ranked(lanes)
        flag = np.empty(len(order), bool)
        flag[order] = ~new | np.r_[~new[1:], False]
        flag |= np.concatenate([np.unpackbits(np.frombuffer(v.as_buffer(), np.uint8), count=k) for v, k in zip(x.column("twice"), n)]).astype(bool)
        return pa.table({"key": x.column("key"), "bucket": x.column("bucket"), "n": x.column("n"), "flags": pa.array([np.packbits(f).tobytes() for f in np.split(flag, np.cumsum(n)[:-1])], pa.binary())})

    dealt = table.mapInArrow(deal, "bucket int, key binary, n int, names binary, twice binary")
    return dealt.groupBy("bucket").applyInArrow(compare, "key binary, bucket int, n int, flags binary")


def _told(table: DataFrame, flags: DataFrame) -> DataFrame:
    """Rows of PIECES with the flags of their names, in order."""
    return table.join(flags.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "flags"))).alias("told")), "key").select(*(x.split()[0] for x in PIECES.split(", ")), "told")


def _flags(told, lanes: list[np.ndarray]) -> np.ndarray:
    """For each named place, whether its name occurs elsewhere."""
    order, new = ranked(lanes)
    got = [np.unpackbits(np.frombuffer(x["flags"], np.uint8), count=x["n"]) for x in told.as_py()]
    out = np.empty(len(order), bool)
    out[order] = np.concatenate(got)[np.cumsum(new) - 1].astype(bool)
    return out


def repeated(texts: DataFrame, length: int, coded: bool) -> DataFrame:
    """(digest, spans): what repeated strings of `length` units cover in each text of `texts` (blocks) that holds some.

    spans: int64 pairs (from, to) of units."""
    spark = texts.sparkSession
    v, residues = cover(length)
    q = len(residues)
    total = texts.agg(F.sum("n")).first()[0] or 0
    buckets = lambda names: max(8, -(-8 * int(names) // BUCKET))  # noqa: E731  rows sent are at most blocks x buckets, and at most names

    def first(row: Pieces):
        units = row.units(coded, False)
        places, text, number = sampled(row.sizes, length)
        return units, places + (np.cumsum(row.sizes) - row.sizes)[text], text, number

    def first_names(row: Pieces) -> list[np.ndarray]:
        units, at, _, _ = first(row)
        return [names_at(units, at, v)]

    def triple_names(row: Pieces) -> list[np.ndarray]:
        units = row.units(coded, True)
        x = [names_at(units, row.at + k * v, v) for k in range(3)]
        return [_finished(_mixed(_mixed(x[0], x[1], 0), x[2], 0))]

    def starts(row: Pieces) -> tuple[np.ndarray, np.ndarray]:
        count = row.sizes - length + 1
        text = np.repeat(np.arange(len(count)), count)
        return np.arange(len(text)) + (length - 1) * text, text

    def start_names(row: Pieces) -> list[np.ndarray]:
        units, at = row.units(coded, True), starts(row)[0]
        return [names_at(units, at, length, lane) for lane in (0, 1)]

    def step(told_rows: DataFrame, make: Callable, name: str) -> tuple[DataFrame, str]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = make(Pieces(batch, i), batch.column("told")[i])
                    yield from _rows([row] if row else [])

        return _packed(told_rows.mapInArrow(run, PIECES), name)

    def triples(row: Pieces, told) -> list | None:
        """Places where three neighbouring names are not alone, and the pieces around them."""
        units, at, text, number = first(row)
        flag = _flags(told, [names_at(units, at, v)])
        some = np.flatnonzero(flag[: max(0, len(flag) - 2 * q)])
        some = some[flag[some + q] & flag[some + 2 * q] & (text[some] == text[some + 2 * q])]
        return row.around(units, at[some], text[some], length)

    def remaining(row: Pieces, told) -> list | None:
        flag = _flags(told, triple_names(row))
        ends = np.cumsum(row.sizes)
        return row.around(row.units(coded, True), row.at[flag], np.searchsorted(ends, row.at[flag], side="right"), length)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = Pieces(batch, i)
                at, text = starts(row)
                flag = _flags(batch.column("told")[i], start_names(row))
                at, text = at[flag], text[flag]
                if not len(at):
                    continue
                place = at - (np.cumsum(row.sizes) - row.sizes)[text] + row.base[text]
                other = row.digests[text[1:]] != row.digests[text[:-1]]
                new = np.r_[True, other | (place[1:] > place[:-1] + length)]
                pairs = np.c_[place[new], place[np.r_[new[1:], True]] + length]
                begins = np.flatnonzero(np.r_[True, row.digests[text[new]][1:] != row.digests[text[new]][:-1]])
                yield pa.RecordBatch.from_arrays([pa.array([row.digests[text[new]][k].tobytes() for k in begins], pa.binary()), pa.array([x.tobytes() for x in np.split(pairs, begins[1:])], pa.binary())], names=["digest", "spans"])

    flags, flags_path = written(shared(texts, first_names, buckets(total * q / v)), "names")
    release(spark)
    cut, cut_path = step(_told(texts, flags), triples, "triples")
    release(spark)
    total = cut.agg(F.sum("n")).first()[0] or 0
    flags, path = written(shared(cut, triple_names, buckets(total * q / v)), "names")
    rest, rest_path = step(_told(cut, flags), remaining, "rest")
    release(spark)
    remove(spark, flags_path, path, cut_path)
    total = SLICES * buckets((rest.agg(F.sum("n")).first()[0] or 0) * 2 / SLICES)
    merged, paths = None, []
    for k in range(SLICES):
        some, path = written(shared(rest, start_names, total, range(total // SLICES * k, total // SLICES * (k + 1))), "merged")
        merged = some if merged is None else merged.union(some)
        paths.append(path)
        release(spark)
    out, _ = written(_told(rest, merged).mapInArrow(spans, "digest binary, spans binary"), "spans")
    remove(spark, rest_path, *paths)
    release(spark)
    return out


def marks(docs: DataFrame, length: int, words: int) -> DataFrame:
    """digest, whole, spans and passages of every text with something repeated; whole: the text occurs twice."""
    spark = docs.sparkSession
    texts, path = _packed(blocks(docs, min(length, 2 * words - 1) if words else length), "blocks")
    release(spark)

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, t in zip(batch.column(0), batch.column(1)):
                some = np.frombuffer(d.as_buffer(), "V16")[np.frombuffer(t.as_buffer(), bool)]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in some], pa.binary())], names=["digest"])

    none = F.lit(None).cast("binary")
    out = texts.select("digests", "twice").mapInArrow(copied, "digest binary").select("digest", F.lit(True).alias("whole"), none.alias("spans"), none.alias("passages"))
    out = out.union(repeated(texts, length, False).select("digest", F.lit(False), "spans", none))
    if words:
        out = out.union(repeated(texts, words, True).select("digest", F.lit(False), none, F.col("spans")))
    out, _ = written(out.groupBy("digest").agg(F.max("whole").alias("whole"), F.first("spans", True).alias("spans"), F.first("passages", True).alias("passages")), "marks")
    remove(spark, path)
    return out


def _pairs(x: pa.Scalar) -> list[tuple[int, int]]:
    return list(map(tuple, np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2).tolist())) if x.is_valid else []


def covered(b: bytes, whole: bool, spans: pa.Scalar, passages: pa.Scalar, length: int, words: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Maximal runs (from, to) of bytes that repeated strings of bytes cover, and that repeated strings of words do."""
    by_bytes = ([(0, len(b))] if len(b) >= length else []) if whole else _pairs(spans)
    if not words or not (whole or passages.is_valid):
        return by_bytes, []
    at = [m.span() for m in WORDS.finditer(b)]
    by_words = ([(0, len(at))] if len(at) >= words else []) if whole else _pairs(passages)
    return by_bytes, [(at[lo][0], at[hi - 1][1]) for lo, hi in by_words]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: bool = False, words: int = 0) -> DataFrame:
    """doc_id and RESULT of each document after removal of every byte that a repeated string of `length` bytes covers.

    Strings are judged on the input, over UTF-8 bytes, inside documents; a string repeats if it starts at another
    place of any document, its own included. With `words`, repeated strings of so many words are found as well,
    whatever space is between the words: n_passage_bytes has the bytes that they cover, from first word to last, and
    with text=True they are removed too. With text=True the result has the columns of docs instead, text being what is
    left, without characters that lost bytes.

    A null text counts as empty (and stays null with text=True); texts under `length` bytes and `words` words stay
    whole; copies of a long text, repeated rows among them, lose everything. Null and equal ids do no harm: texts are
    matched by digest. An empty table gives no rows; other columns, of any name, are ignored, or kept with text=True.
    Raises ValueError for strings under 3 units."""
    if length < 3 or 0 < words < 3:
        raise ValueError("strings have at least 3 units")
    found = marks(docs, length, words)
    kind, names = dict(docs.dtypes)["doc_id"], docs.columns

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("row").flatten()
            out = []
            for x, whole, spans, passages in zip(texts, batch.column("whole").to_pylist(), batch.column("spans"), batch.column("passages")):
                b = (x.as_py() or "").encode()
                by_bytes, by_words = covered(b, bool(whole), spans, passages, length, words)
                at, kept = 0, hashlib.sha256()
                for lo, hi in by_bytes:
                    kept.update(b[at:lo])
                    at = hi
                kept.update(b[at:])
                out.append((len(b), sum(hi - lo for lo, hi in by_bytes), len(by_bytes), kept.hexdigest(), sum(hi - lo for lo, hi in _merged(by_words))))
            columns = list(zip(*out))[: 4 + (words > 0)] if out else [()] * (4 + (words > 0))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["doc_id", *(x.split()[0] for x in RESULT.split(", ")), "n_passage_bytes"][: len(columns) + 1])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, out = batch.column("row").flatten(), []
            place = names.index("text")
            for x, whole, spans, passages in zip(columns[place], batch.column("whole").to_pylist(), batch.column("spans"), batch.column("passages")):
                if (t := x.as_py()) is not None and whole is not None:
                    b, at, parts = t.encode(), 0, []
                    by_bytes, by_words = covered(b, whole, spans, passages, length, words)
                    for lo, hi in _merged(by_bytes + by_words):
                        parts.append(b[at:lo].decode(errors="ignore"))
                        at = hi
                    t = "".join([*parts, b[at:].decode(errors="ignore")])
                out.append(t)
            columns[place] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    x = docs.select(F.struct(*(names if text else ["doc_id", "text"])).alias("row"))
    x = x.withColumn("digest", F.unhex(F.md5("row.text"))).join(found, "digest", "left").select("row", "whole", "spans", "passages")
    if text:
        return x.mapInArrow(rewrite, docs.schema)
    return x.mapInArrow(shape, f"doc_id {kind}, {RESULT}" + ", n_passage_bytes long" * (words > 0))
