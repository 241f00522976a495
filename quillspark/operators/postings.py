"""A kept inverted index: positional postings by term, in segments that are written once and replaced source by source."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import normalize_key, terms
from quillspark.operators import catalog
from quillspark.segments import Segments
from quillspark.storage import remove, written

#: Raised when the terms of a text or the columns of a segment change: an index of another version is rebuilt.
VERSION = 2
#: Texts whose terms are gathered at once.
GATHERED = 500
#: Bytes of texts whose terms a scan gathers at once.
GATHERED_BYTES = 1 << 20
#: Terms up to which a search names them in its scan; more are joined.
MOST_TERMS = 4096


def counted(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(field, chunk_id, source_id, length, term, tf, positions) of each term of each text column in `fields`.

    Takes chunk_id, source_id and the fields. Positions count a text's terms from 0, length is their number. The terms
    are cut by Spark and gathered by Arrow batch; no token is a row and nothing is shuffled. Null and empty texts have
    no terms; equal rows are counted each."""
    kinds = dict(docs.dtypes)
    one = [docs.select(F.lit(f).alias("field"), "chunk_id", "source_id", terms(F.col(f)).alias("terms")) for f in fields]
    whole = one[0]
    for other in one[1:]:
        whole = whole.unionByName(other)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, GATHERED) for whole in batches for i in range(0, whole.num_rows, GATHERED)):
            lists = batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            sizes[~lists.is_valid().to_numpy(zero_copy_only=False)] = 0
            words = lists.flatten().dictionary_encode()
            if not len(words):
                continue
            term, row = words.indices.to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            order = np.lexsort((place, term, row))
            term, row, place = term[order], row[order], place[order]
            first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (row[1:] != row[:-1])])
            bounds, at = np.r_[first, len(term)], pa.array(row[first])
            columns = [batch.column(i).take(at) for i in range(3)]
            columns += [pa.array(sizes[row[first]], pa.int32()), words.dictionary.take(pa.array(term[first])), pa.array(np.diff(bounds), pa.int32())]
            columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(place, pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["field", "chunk_id", "source_id", "length", "term", "tf", "positions"])

    return whole.mapInArrow(gather, f"field string, chunk_id {kinds['chunk_id']}, source_id {kinds['source_id']}, length int, term string, tf int, positions array<int>")


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows whose sizes sum up to `most`; a larger row is a run of its own."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def tallied(docs: DataFrame, name: str, named: list[str] | None = None, positions: bool = False) -> DataFrame:
    """(chunk_id, source_id, length, term, tf) of each term of the text column `name`, and a row with no term and tf 0 for
    each text; of the terms in `named` alone where it is given, and with their `positions`, as `counted` has them. Each text is
    cut once for all. A task gathers GATHERED_BYTES of texts, or one that is longer, so its memory depends neither on the
    table nor on Spark's batches."""
    kinds = dict(docs.dtypes)
    names = ["chunk_id", "source_id", "length", "term", "tf", "positions"][: 6 if positions else 5]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if named is None else pa.array(named, pa.string())
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in _runs(sizes, GATHERED_BYTES):
                part = batch.slice(lo, hi - lo)
                text = pc.fill_null(part.column(2), "")
                words, none = pc.split_pattern(text, " "), pc.equal(text, "").to_numpy(zero_copy_only=False)
                n = np.diff(words.offsets.to_numpy())
                words, n = words.flatten().filter(pa.array(np.repeat(~none, n))), np.where(none, 0, n)
                row = np.arange(len(n))
                of, place = np.repeat(row, n), np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
                if known is None:
                    coded = words.dictionary_encode()
                    held, code = coded.dictionary, coded.indices.to_numpy()
                else:
                    held, code = known, pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()
                    asked = np.flatnonzero(code >= 0)
                    of, place, code = of[asked], place[asked], code[asked]
                # a key for each text, then one for each term of a text
                width = len(held) + 1
                every = of * width + code + 1
                key, tf = np.unique(every, return_counts=True)
                ends = np.cumsum(tf)
                key, tf = np.r_[row * width, key], np.r_[np.zeros(len(row), np.int64), tf]
                at, term = np.divmod(key, width)
                columns = [part.column(i).take(pa.array(at)) for i in range(2)]
                columns += [pa.array(n[at], pa.int32()), held.take(pa.array(term - 1, mask=term == 0)), pa.array(tf, pa.int32())]
                if positions:
                    # a text's terms come in order
                    places = place[np.argsort(every, kind="stable")]
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[np.zeros(len(row) + 1, np.int64), ends], pa.int32()), pa.array(places, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    # the terms of a text, joined by single spaces
    x = docs.select("chunk_id", "source_id", normalize_key(F.col(name)).alias("text"))
    schema = f"chunk_id {kinds['chunk_id']}, source_id {kinds['source_id']}, length int, term string, tf int"
    return x.mapInArrow(gather, schema + (", positions array<int>" if positions else ""))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def block_of(tf: Column, length: Column) -> Column:
    """Postings of a term with like tf and like length of text, and so of like weight, are a block."""
    return (F.floor(F.log2(tf)) * 64 + F.floor(2 * F.log2(length))).cast("int")


@dataclass
class Index:
    """Postings of chunks, in the segments of `store`.

    A segment holds `postings` (by field and bucket of the term; sorted by term, block and chunk), `blocks` (number of
    postings, largest tf and least length of each block of a term), `docs` (chunk_id, source_id, lengths and the columns in
    `keep`) and whatever else its writer puts there. `docs` given to the methods have chunk_id,
    source_id, the fields and `keep`; a chunk_id stands on one row."""

    store: Segments
    fields: list[str] = field(default_factory=lambda: ["text"])
    keep: list[str] = field(default_factory=list)
    buckets: int = 16

    # writing

    def write(self, docs: DataFrame, segment: str) -> None:
        """The tables of docs into a segment."""
        lengths = [F.coalesce(F.size(terms(F.col(f))), F.lit(0)).alias(f"length_{f}") for f in self.fields]
        self.store.write(segment, "docs", docs.select("chunk_id", "source_id", *lengths, *self.keep, F.lit(VERSION).alias("version"), F.lit(self.buckets).alias("buckets")))
        # ranges are sampled before they are dealt: from a table, not by cutting the texts again
        found, path = written(counted(docs, self.fields), "counted")
        self._write_postings(found, segment)
        remove(docs.sparkSession, path)

    def _write_postings(self, postings: DataFrame, segment: str) -> None:
        x = postings.withColumn("bucket", bucket_of(F.col("term"), self.buckets)).withColumn("block", block_of(F.col("tf"), F.col("length")))
        # ranges end inside a term that very many chunks hold
        by = ["field", "bucket", "term", "block", "chunk_id"]
        self.store.write(segment, "postings", x.repartitionByRange(*by).sortWithinPartitions(*by), by=by[:2])
        blocks = x.groupBy(*by[:4]).agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("tf"), F.min("length").alias("length"))
        self.store.write(segment, "blocks", blocks.repartitionByRange(*by[:3]).sortWithinPartitions(*by[:4]), by=by[:2])

    def build(self, docs: DataFrame) -> int:
        """All of docs as one segment of a new generation; its number."""
        return self.store.rewrite(lambda segment: self.write(docs, segment), docs.select("source_id"))

    def replace(self, docs: DataFrame, sources: DataFrame) -> int:
        """A new generation in which the sources (source_id) have the chunks that docs has of them, and no others. Only
        those chunks are cut into terms and written."""
        some = docs.join(sources.select("source_id").distinct(), "source_id", "left_semi")
        return self.store.replace(lambda segment: self.write(some, segment), some.select("source_id"), sources)

    def merge(self) -> int:
        """All that lives as one segment of a new generation, from the postings themselves: no text is read."""

        def write(segment: str) -> None:
            self.store.write(segment, "docs", docs.drop("segment"))
            self._write_postings(self.postings().drop("segment", "bucket", "block"), segment)

        docs = self.docs()
        return self.store.rewrite(write, docs.select("source_id"))

    # reading

    def docs(self) -> DataFrame:
        """chunk_id, source_id, length_<field> of each field, kept columns and segment of every living chunk."""
        return self.store.read("docs")

    def lengths(self, name: str) -> DataFrame:
        """length of the field `name`, a row for every living chunk."""
        return self.docs().select(F.col(f"length_{name}").alias("length"))

    def _cut(self, wanted: DataFrame | None, fields: list[str] | None) -> list:
        cut = [lambda x: x.filter(F.col("field").isin(*(fields or self.fields)))]
        if wanted is not None:
            wanted = wanted.select("term").filter("term IS NOT NULL").distinct().withColumn("bucket", bucket_of(F.col("term"), self.buckets))
            some = wanted.limit(MOST_TERMS + 1).collect()
            if len(some) <= MOST_TERMS:
                named = F.col("bucket").isin(sorted({r["bucket"] for r in some})) & F.col("term").isin(sorted(r["term"] for r in some))
                cut.append(lambda x: x.filter(named))
            else:
                cut.append(lambda x: x.join(wanted, ["bucket", "term"], "left_semi"))
        return cut

    def postings(self, wanted: DataFrame | None = None, fields: list[str] | None = None) -> DataFrame:
        """Living postings: field, bucket, term, block, chunk_id, source_id, length, tf, positions, segment.

        With `wanted` (term) only those of these terms: up to MOST_TERMS of them stand in the scan as buckets, which are
        folders, and terms, which are sorted; more are joined on bucket and term."""
        return self.store.read("postings", cut=self._cut(wanted, fields))

    def blocks(self, wanted: DataFrame | None = None, fields: list[str] | None = None) -> DataFrame:
        """(field, term, block, df, tf, length): in how many living chunks the term is, repeated on each of its blocks, and
        the largest tf and the least length in a block, which sources that were replaced since may have held.

        Counts are kept; only postings of replaced sources are read, to take them off."""
        cut = self._cut(wanted, fields)
        out = self.store.read("blocks", cut=cut, living=False).groupBy("field", "term", "block").agg(F.max("tf").alias("tf"), F.min("length").alias("length"))
        return out.join(self._frequencies(cut), ["field", "term"])

    def frequencies(self, wanted: DataFrame | None = None, fields: list[str] | None = None) -> DataFrame:
        """(field, term, df): in how many living chunks each term is, from the counts of its blocks."""
        return self._frequencies(self._cut(wanted, fields))

    def _frequencies(self, cut: list) -> DataFrame:
        df = self.store.read("blocks", cut=cut, living=False).groupBy("field", "term").agg(F.sum("n").alias("df"))
        if len(self.store.segments()) > 1:
            gone = self.store.read("postings", cut=cut, living=False).join(self.store.removed(), ["segment", "source_id"], "left_semi")
            gone = gone.groupBy("field", "term").agg((-F.count(F.lit(1))).alias("df"))
            df = df.unionByName(gone).groupBy("field", "term").agg(F.sum("df").alias("df")).filter("df > 0")
        return df

    # maintenance

    def faults(self, docs: DataFrame) -> DataFrame:
        """(chunk_id, fault): chunks of docs that the index lacks (missing), and indexed ones that docs lacks (orphan)."""
        return catalog.index_faults(docs.select("chunk_id"), self.docs().select("chunk_id"), "chunk_id")

    def maintain(self, docs: DataFrame) -> dict:
        """Bring the index to docs with the least work: build it where there is none or one of another version or number of
        buckets, write the sources anew that have missing or orphan chunks, and else leave it. What was done, why, and counts."""
        if not self.store.generation():
            self.build(docs)
            return {"status": "built", "reason": "no_index", "missing": 0, "orphan": 0}
        made = self.docs().select("version", "buckets").distinct().limit(2).collect()
        if any(tuple(r) != (VERSION, self.buckets) for r in made):
            self.build(docs)
            return {"status": "rebuilt", "reason": "version_mismatch", "missing": 0, "orphan": 0}
        found = self.faults(docs)
        n = {r["fault"]: r["n"] for r in found.groupBy("fault").agg(F.count(F.lit(1)).alias("n")).collect()}
        counts = {k: n.get(k, 0) for k in ("missing", "orphan")}
        if not n:
            return {"status": "skipped", "reason": "current", **counts}
        both = docs.select("chunk_id", "source_id").unionByName(self.docs().select("chunk_id", "source_id"))
        self.replace(docs, both.join(found.select("chunk_id"), "chunk_id", "left_semi").select("source_id"))
        return {"status": "repaired", "reason": "missing_rows" if counts["missing"] else "orphan_rows", **counts}


class Scanned:
    """What a search asks of an index, of texts that no index holds and for the terms (term) of its queries alone.

    The text columns `fields` of docs (chunk_id, source_id and these) are scanned once. Only postings of these terms are kept,
    unsorted, and with positions only where `positions` is set: for one table of queries that is a small part of what an
    index has to write. Up to MOST_TERMS terms are told apart where texts are cut; more are joined."""

    def __init__(self, docs: DataFrame, wanted: DataFrame, fields: list[str] | None = None, positions: bool = False):
        self.fields, self._positions, paths = fields or ["text"], positions, []
        wanted = wanted.select("term").filter("term IS NOT NULL").distinct()
        some = [r["term"] for r in wanted.limit(MOST_TERMS + 1).collect()]
        named = sorted(some) if len(some) <= MOST_TERMS else None
        rows = None
        for f in self.fields:
            one = tallied(docs.select("chunk_id", "source_id", f), f, named, positions).withColumn("field", F.lit(f))
            rows = one if rows is None else rows.unionByName(one)
        if named is None:
            # written, so that Spark sees how small it is and does not deal the postings
            asked, path = written(wanted.withColumn("asked", F.lit(True)), "wanted")
            paths.append(path)
            rows = rows.join(asked, "term", "left").filter("asked OR term IS NULL").drop("asked")
        self._rows, self.path = written(rows, "tallied")
        remove(docs.sparkSession, *paths)

    def docs(self) -> DataFrame:
        x = self._rows.filter("term IS NULL")
        if len(self.fields) == 1:
            return x.select("chunk_id", "source_id", F.col("length").alias(f"length_{self.fields[0]}"))
        return x.groupBy("chunk_id", "source_id").agg(*(F.max(F.when(F.col("field") == f, F.col("length"))).alias(f"length_{f}") for f in self.fields))

    def lengths(self, name: str) -> DataFrame:
        return self._rows.filter("term IS NULL").filter(F.col("field") == name).select("length")

    def postings(self, wanted: DataFrame, fields: list[str] | None = None) -> DataFrame:
        """field, term, block, chunk_id, source_id, length, tf and, if kept, positions of the wanted terms (term)."""
        x = self._rows.filter("term IS NOT NULL").filter(F.col("field").isin(*(fields or self.fields))).join(wanted.select("term").distinct(), "term", "left_semi")
        return x.select("field", "term", block_of(F.col("tf"), F.col("length")).alias("block"), "chunk_id", "source_id", "length", "tf", *["positions"] * self._positions)

    def frequencies(self, wanted: DataFrame, fields: list[str] | None = None) -> DataFrame:
        """(field, term, df): in how many chunks each of the wanted terms is."""
        return self.postings(wanted, fields).groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))

    def blocks(self, wanted: DataFrame, fields: list[str] | None = None) -> DataFrame:
        """(field, term, block, df, tf, length), as an index has them."""
        x = self.postings(wanted, fields).groupBy("field", "term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("tf"), F.min("length").alias("length"))
        df = F.sum("n").over(Window.partitionBy("field", "term"))
        return x.select("field", "term", "block", df.alias("df"), "tf", "length")
