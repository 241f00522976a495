"""Near-duplicate documents: circulant MinHash bands propose, exact Jaccard similarity of whole sets decides."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import likely, release, remove, written
from quillspark.llm.shingles import circulant_signature, mix64, shingle_sets
from quillspark.operators.components import components

#: Characters of text whose shingles are made at once; shingles of one chunk of a group in the second comparison.
CHUNK, CHUNK_SHINGLES = 2_000_000, 64_000
#: Chunks around one centre up to which all its blocks are compared; beyond, only nodes that share a rare shingle are.
FEW = 4
#: Slots in which shingles around centres are counted, and the ranges of slots, each a row of what a task has counted.
SLOTS, RANGES = 1 << 20, 64


def _chunks(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, list[str]]]:
    begin, some, size = 0, [], 0
    for i, x in enumerate(batch.column(at)):
        some.append(x.as_py() or "")
        size += len(some[-1])
        if size >= CHUNK:
            yield begin, some
            begin, some, size = i + 1, [], 0
    if some:
        yield begin, some


def _name(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def text_digest(text: str) -> Column:
    return F.unhex(F.md5(text)).alias("digest")


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, digest (MD5 of the text), n_shingles, node (128 bits of hash of the whole set; null if empty) and the set's band values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in _chunks(batch, 1):
                h, bounds = shingle_sets(texts, k)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                values = np.zeros((len(texts), bands), np.int64)
                if len(full):
                    sig = circulant_signature(h, np.r_[bounds[full], len(h)], bands * rows).astype(np.uint64).reshape(len(full), bands, rows)
                    v = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(full), bands))
                    for j in range(rows):
                        v = mix64(v ^ (sig[:, :, j] + np.uint64(0x9E3779B97F4A7C15)))
                    values[full] = v.view(np.int64)
                nodes = [_name(h[bounds[i] : bounds[i + 1]]) if n[i] else None for i in range(len(texts))]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * bands, pa.int32()), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), batch.column(2).slice(begin, len(texts)), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), flat], names=["doc_id", "digest", "n_shingles", "node", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text", text_digest("text")).mapInArrow(run, "doc_id long, digest binary, n_shingles long, node binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> tuple[DataFrame, str]:
    """node and its sorted shingles (8 bytes each), for the documents `wanted` (node, rep) names. Texts are not dealt: what
    may be wanted is known by marks, and only its sets are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _chunks(batch, 0):
                h, bounds = shingle_sets(texts, k)
                sets = [h[i:j] for i, j in zip(bounds, bounds[1:]) if i < j]
                yield pa.RecordBatch.from_arrays([pa.array(map(_name, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    x, marks = likely(docs.select(F.col("doc_id").cast("long").alias("rep"), "text"), wanted, ["rep"])
    x = x.filter("likely").select("text").mapInArrow(run, "node binary, shingles binary")
    # an id may stand on several rows; only the row with the wanted set counts
    out = written(x.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    remove(docs.sparkSession, marks)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(p, q)
                both = int((p[np.minimum(at, len(p) - 1)] == q).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    x = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("q")), "b")
    x = x.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("p")), "a")
    return x.select("a", "b", "p", "q").mapInArrow(run, "a binary, b binary")


def _compare_blocks(percent: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        """Links between different roots, found over an index from shingles to the block's rows."""
        sets = [np.frombuffer(x, np.uint64) for x in block["shingles"]]
        root = block["root"].to_numpy()
        one, two = np.flatnonzero(block["one"]), np.flatnonzero(block["two"])
        out: list[tuple[int, int]] = []
        if len(two) and len(np.unique(root)) > 1:
            n = np.array([len(s) for s in sets])
            tokens = np.concatenate([sets[i] for i in two])
            owner = np.repeat(np.arange(len(two)), n[two])
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            for i in one:
                lo, hi = np.searchsorted(tokens, sets[i], "left"), np.searchsorted(tokens, sets[i], "right")
                length = hi - lo
                at = np.repeat(hi - np.cumsum(length), length) + np.arange(length.sum())
                both = np.bincount(owner[at], minlength=len(two))
                good = (100 * both >= percent * (n[i] + n[two] - both)) & (root[two] != root[i])
                out += [(block["node"].iloc[i], block["node"].iloc[two[m]]) for m in np.flatnonzero(good)]
        return pd.DataFrame(out, columns=["a", "b"], dtype=object)

    return run


def _block_pairs() -> Column:
    """The blocks (low class, whether its two sides are of two classes, chunks i and j, which sides it is on) of a node
    of class `cls` in chunk `chunk`. Chunks below n_apart hold nodes outside the centre's component; each block has one."""

    def pairs(upto: Column, start: Column, make) -> Column:
        return F.when(upto > start, F.transform(F.sequence(start, upto - 1), make)).otherwise(F.array().cast("array<struct<low:bigint,cross:boolean,i:int,j:int,one:boolean,two:boolean>>"))

    def block(low: Column, cross: bool, i: Column, j: Column, one: Column, two: Column) -> Column:
        return F.struct(low.alias("low"), F.lit(cross).alias("cross"), i.alias("i"), j.alias("j"), one.alias("one"), two.alias("two"))

    cls, chunk, yes, no, zero = F.col("cls"), F.col("chunk"), F.lit(True), F.lit(False), F.lit(0)
    partners = lambda x: F.col(f"{x}_apart") + F.when(F.col("apart"), F.col(f"{x}_own")).otherwise(0)
    return F.concat(
        pairs(F.least(chunk + 1, F.col("n_apart")), zero, lambda i: block(cls, False, i, chunk, i == chunk, yes)),
        pairs(F.when(F.col("apart"), F.col("n_apart") + F.col("n_own")).otherwise(0), chunk + 1, lambda j: block(cls, False, chunk, j, yes, no)),
        pairs(partners("up"), zero, lambda j: block(cls, True, chunk, j, yes, no)),
        pairs(partners("down"), zero, lambda i: block(cls - 1, True, i, chunk, no, yes)),
    )


def _slots(a: bytes, shingles: np.ndarray) -> np.ndarray:
    """The slot among SLOTS of each shingle around the centre a."""
    return (mix64(shingles ^ np.uint64(xxhash.xxh3_64_intdigest(a))) % np.uint64(SLOTS)).astype(np.int64)


def _frequencies(around: DataFrame) -> np.ndarray:
    """For each slot, how many rows of `around` (a, shingles) hold its shingles: of one shingle around one centre, at least
    as many as hold it. A task sends at most a row for each range of slots, whatever it has read; ranges are added up
    where they meet, and SLOTS bounds what comes to the driver."""
    width, kind = SLOTS // RANGES, "part int, slots array<int>, n array<long>"

    def rows(parts: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """The counts other than 0 of each of the parts; n is one array of `width` for each."""
        which, at = np.nonzero(n)
        bounds = pa.array(np.searchsorted(which, np.arange(len(parts) + 1)), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.ListArray.from_arrays(bounds, pa.array(at, pa.int32())), pa.ListArray.from_arrays(bounds, pa.array(n[which, at]))], names=["part", "slots", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for a, x in zip(batch.column(0), batch.column(1)):
                np.add.at(n, _slots(a.as_py(), np.frombuffer(x.as_buffer(), np.uint64)), 1)
        n = n.reshape(RANGES, width)
        parts = np.flatnonzero(n.any(axis=1))
        yield rows(parts, n[parts])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, slots, more in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                n.setdefault(part, np.zeros(width, np.int64))[slots.values.to_numpy()] += more.values.to_numpy()
        if n:
            yield rows(np.array(list(n)), np.stack(list(n.values())))

    found = around.select("a", "shingles").mapInArrow(count, kind).repartition("part").mapInArrow(add, kind).toArrow()
    out = np.zeros((RANGES, width), np.int64)
    for part, slots, n in zip(found["part"].to_pylist(), found["slots"], found["n"]):
        out[part, slots.values.to_numpy()] = n.values.to_numpy()
    return np.minimum(out.ravel(), np.iinfo(np.int32).max).astype(np.int32)


def _rare(m: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, list[str]]:
    """The rows of m, dealt anew: one for each shingle of the node's prefix that another component around the centre has
    in a prefix too; `a` then names centre and shingle. With a set's shingles in any one order around the centre, two sets
    alike to percent % share one of the first n - ceil(n * percent / 100) + 1 of each. The order is by how many nodes hold a
    shingle, counted by slots, so no shingle that is in no prefix is a row."""
    whole, whole_path = written(m.join(sets, "node").select("a", "shingles", "node", "n", "cls", "root", "apart"), "around")
    counts = m.sparkSession.sparkContext.broadcast(_frequencies(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for i, (a, x, n) in enumerate(zip(batch.column(0), batch.column(1), batch.column(3).to_pylist())):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                c = counts.value[_slots(a.as_py(), s)]
                # what only one node holds comes first in its prefix and pairs it with none
                held = c > 1
                left = max(n - -(-n * percent // 100) + 1 - int((~held).sum()), 0)
                s, c = s[held], c[held]
                s = s[np.lexsort((s, c))[:left]]
                name = np.frombuffer(xxhash.xxh3_128_digest(a.as_py()), np.uint64)
                rows += [i] * len(s)
                keys.append(np.column_stack([mix64(s ^ name[0]), mix64(s ^ name[1])]).ravel())
            key = np.concatenate(keys).tobytes() if keys else b""
            at = pa.array(rows, pa.int32())
            named = pa.Array.from_buffers(pa.binary(16), len(rows), [None, pa.py_buffer(key)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([named, *(batch.column(j).take(at) for j in range(2, 7))], names=["a", "node", "n", "cls", "root", "apart"])

    prefix, prefix_path = written(whole.mapInArrow(run, "a binary, node binary, n long, cls long, root binary, apart boolean"), "prefixes")
    mixed = prefix.groupBy("a").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("apart").alias("some")).filter("some AND lo <> hi").select("a")
    counts.unpersist()
    remove(m.sparkSession, whole_path)
    return prefix.join(mixed, "a"), [prefix_path]


def _near(m: DataFrame) -> tuple[DataFrame, str]:
    """Per a and class of sizes: how many chunks it and the classes next to it have apart from the centre's component and
    inside it, and whether all around a fits one chunk; only where there is something to compare."""
    size = m.groupBy("a", "cls").agg(*(F.ceil(F.sum(F.when(c, F.col("n")).otherwise(0)) / CHUNK_SHINGLES).cast("int").alias(x) for x, c in (("n_apart", F.col("apart")), ("n_own", ~F.col("apart")))), F.sum("n").alias("all"))
    size = size.withColumn("whole", F.sum("all").over(Window.partitionBy("a")) <= CHUNK_SHINGLES).drop("all")
    size, size_path = written(size, "size")
    near = size
    for x, step in (("up", 1), ("down", -1)):
        other = size.select("a", (F.col("cls") - step).alias("cls"), F.col("n_apart").alias(f"{x}_apart"), F.col("n_own").alias(f"{x}_own"))
        near = near.join(other, ["a", "cls"], "left").fillna(0, [f"{x}_apart", f"{x}_own"])
    near, near_path = written(near.filter("n_apart + up_apart + down_apart > 0"), "near")
    remove(m.sparkSession, size_path)
    return near, near_path


def _across(m: DataFrame, near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components around the same a, compared in blocks."""
    m = m.join(near, ["a", "cls"])
    deal = F.xxhash64(F.lit(3), "node")
    m = m.withColumn("chunk", F.when(F.col("apart"), F.pmod(deal, "n_apart")).otherwise(F.col("n_apart") + F.pmod(deal, "n_own")).cast("int"))
    # a set goes once to the one block of a small centre
    one_block = F.array(F.struct(F.lit(-1).cast("long").alias("low"), F.lit(False).alias("cross"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("apart").alias("one"), F.lit(True).alias("two")))
    m = m.withColumn("pairs", F.when(F.col("whole"), one_block).otherwise(_block_pairs())).filter(F.size("pairs") > 0).join(sets, "node")
    blocks = m.select("a", "node", "root", "shingles", F.explode("pairs").alias("p")).select("a", "p.*", "node", "root", "shingles")
    return blocks.groupBy("a", "low", "cross", "i", "j").applyInPandas(_compare_blocks(percent), "a binary, b binary")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 31, rows: int = 4, digests: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document (with `digests`, its text's MD5 too); links are sets with Jaccard similarity >= percent %.

    Takes doc_id and text. Circulant signatures of bands * rows coordinates propose: a pair at the threshold s meets in
    no band with probability (1 - s^rows)^bands, under 1e-6 for the arguments used. Equal sets are one node from the
    start. Around each band value, nodes are compared with its centre, the node that shares most band values; this
    joins most members of large groups with one comparison each. Where the nodes around one centre still form
    several components, whatever lies outside the centre's component is compared with all nodes around that centre,
    in blocks of bounded size, between neighbouring classes of set sizes and only across components, so no link that the
    bands propose is missed and no pair inside a component is made. Around a centre of many nodes, these comparisons are
    made for each shingle that nodes share among their rarest (prefixes that alike sets cannot fail to share), so nodes
    that have only what all have meet in no block. Components then take the smallest doc_id.

    Null and empty texts, and texts of white space, have the empty set and link with nothing. A null doc_id gets a
    null component_id and is kept. Repeated rows share a component; those with its id are all kept. An empty table
    gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    sig, sig_path = written(signatures(docs, k, bands, rows), "signatures")
    nodes, nodes_path = written(sig.filter("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands")), "nodes")
    values = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = values.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members, members_path = written(values.join(shared, "band"), "members")
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    centre = members.join(weight, "node").groupBy("band").agg(F.max(F.struct("weight", "node", "n")).alias("c"))
    around = members.join(centre, "band").select(F.col("c.node").alias("a"), F.col("c.n").alias("n_a"), F.col("node").alias("b"), F.col("n").alias("n_b")).distinct()
    around, around_path = written(around, "around")
    wanted = around.select(F.col("b").alias("node")).distinct().join(nodes.select("node", "rep"), "node")
    sets, sets_path = _sets(docs, wanted, k)
    release(spark)
    fit = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (F.col("a") != F.col("b"))
    links, links_path = written(_verified(around.filter(fit).select("a", "b"), sets, percent), "stars")
    release(spark)
    roots = components(links)
    # what the stars have left apart
    r = roots.select("node", "root")
    m = around.join(r.withColumnRenamed("node", "b"), "b", "left").select("a", F.col("b").alias("node"), F.col("n_b").alias("n"), F.coalesce("root", "b").alias("root"))
    own = around.filter("a = b").join(r.withColumnRenamed("node", "a"), "a", "left").select("a", F.coalesce("root", "a").alias("own"))
    # a large group has one centre: the join ends in a table, so that Spark can split its skewed partition
    m, m_path = written(m.join(own, "a").withColumn("apart", F.col("root") != F.col("own")), "rooted")
    # sets alike to percent % lie in one class of sizes or in neighbours; the last factor keeps rounding on the safe side
    m = m.withColumn("cls", F.floor(F.ln("n") / (math.log(100 / min(max(percent, 1), 99)) * (1 + 1e-9))))
    near, near_path = _near(m)
    big, big_path = written(near.groupBy("a").agg(F.sum(F.col("n_apart") + F.col("n_own")).alias("chunks")).filter(F.col("chunks") > FEW).select("a"), "big")
    spare = [big_path, near_path]
    some = big.limit(1).count() > 0
    more, more_path = written(_across(m, near.join(big, "a", "left_anti") if some else near, sets, percent), "more")
    spare.append(more_path)
    if some:
        release(spark)
        rare, paths = _rare(m.join(near.join(big, "a").select("a", "cls"), ["a", "cls"]).select("a", "node", "n", "cls", "root", "apart"), sets, percent)
        near, near_path = _near(rare)
        rest, rest_path = written(_across(rare, near, sets, percent), "more")
        more = more.union(rest)
        spare += [near_path, rest_path, *paths]
    release(spark)
    if more.limit(1).count():
        roots = components(links.union(more))
    groups = nodes.select("node", "rep", "copies").join(roots, "node", "left").filter("root IS NOT NULL OR copies > 1").withColumn("root", F.coalesce("root", "node"))
    least = groups.groupBy("root").agg(F.min("rep").alias("component"))
    named, _ = written(groups.join(least, "root").select("node", "component"), "named")
    remove(spark, *spare, members_path, around_path, m_path, sets_path, links_path, nodes_path)
    out = sig.select("doc_id", *["digest"] * digests, "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(named, "node", "left")
    out = out.select("doc_id", *["digest"] * digests, "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
