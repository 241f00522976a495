"""The engine's API: ingest folders or tables, retrieve, read evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import storage
from quillspark.operators import dense, filters, fusion, ingest, lexical
from quillspark.operators.postings import Index
from quillspark.segments import Segments
from quillspark.sources import markdown, readers, scripture


class Engine:
    """Units, chunks and postings of one collection under `root`, in segments and generations that are published whole."""

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[DataFrame, str], DataFrame] | None = None):
        self.spark, self.embed, self.store = spark, embed, Segments(spark, root)
        self.index = Index(self.store)

    def generation(self) -> int:
        return self.store.generation()

    def table(self, name: str, generation: int | None = None) -> DataFrame:
        return self.store.read(name, generation).drop("segment")

    def _write(self, texts: DataFrame, segment: str) -> None:
        units = ingest.paragraphs(texts, lines_are_units=True).withColumn("boundary", F.lit(0))
        self.store.write(segment, "units", units)
        self.store.write(segment, "chunks", ingest.children(units))
        self.store.write(segment, "hashes", texts.select("source_id", F.sha2("text", 256).alias("hash")))
        self.index.write(self.store.table(segment, "chunks"), segment)

    def ingest(self, texts: DataFrame) -> int:
        """Texts (source_id long, text) as a new generation of units, child chunks and postings."""
        return self.store.rewrite(lambda segment: self._write(texts, segment), texts)

    def replace(self, texts: DataFrame) -> int:
        """A new generation in which the units and chunks of the sources in texts are new, and all others are kept.

        A source with a null text has nothing left. Rows of other sources stay in the segments that hold them."""
        some = texts.filter("text IS NOT NULL")
        return self.store.replace(lambda segment: self._write(some, segment), some, texts)

    def sync(self, texts: DataFrame, force: bool = False, whole: bool = True) -> dict[str, int]:
        """Take texts (source_id, text) in by the hash of their text; how many sources were added, changed, removed, same.

        Only what is new or other than stored is cut and written; with `force` all of texts is. If texts are the `whole`
        collection, a source that is not among them is removed; else only one with a null text. Without a difference there
        is no new generation."""
        if not self.generation():
            self.ingest(texts.filter("text IS NOT NULL"))
            return {"added": texts.filter("text IS NOT NULL").count(), "changed": 0, "removed": 0, "same": 0}
        now = texts.select("source_id", F.sha2("text", 256).alias("now"), F.lit(True).alias("given"))
        x = now.join(self.table("hashes"), "source_id", "full")
        gone = F.col("now").isNull() & (F.lit(whole) | F.coalesce("given", F.lit(False)))
        what = F.when(F.col("hash").isNull() & F.col("now").isNotNull(), "added").when(F.col("hash").isNotNull() & gone, "removed").when(F.col("now").isNotNull() & (F.lit(force) | (F.col("now") != F.col("hash"))), "changed").otherwise("same")
        x, path = storage.written(x.select("source_id", what.alias("what")), "sync")
        counts = {k: 0 for k in ("added", "changed", "removed", "same")} | {r["what"]: r["n"] for r in x.groupBy("what").agg(F.count(F.lit(1)).alias("n")).collect()}
        if counts["added"] + counts["changed"] + counts["removed"]:
            other = x.filter("what <> 'same'").select("source_id")
            some = texts.filter("text IS NOT NULL").join(other, "source_id", "left_semi")
            self.store.replace(lambda segment: self._write(some, segment), some, other)
        storage.remove(self.spark, path)
        return counts

    def _vectors(self, profile: str) -> Segments:
        return Segments(self.spark, f"{self.store.root}/vectors/{profile}")

    def vectors(self, profile: str) -> DataFrame:
        """source_id, chunk_id, input_hash and embedding of a profile's vectors."""
        return self._vectors(profile).read("vectors").drop("segment")

    def build_vectors(self, profile: str) -> dict[str, int]:
        """Bring a profile's vectors to the chunks: sources, inputs that were embedded, and those that were known.

        Only sources whose chunks and vectors differ are written. `embed` gets each input (input_hash, text) once that no
        vector of the profile has yet, and returns input_hash and embedding."""
        store = self._vectors(profile)
        chunks = self.table("chunks").select("source_id", "chunk_id", "text", F.sha2(F.concat_ws("\n", F.lit(profile), "text"), 256).alias("input_hash"))
        if store.generation():
            held = self.vectors(profile)
            pairs = lambda t: t.select("source_id", "chunk_id")
            other = pairs(chunks).join(pairs(held), ["source_id", "chunk_id"], "left_anti").unionByName(pairs(held).join(pairs(chunks), ["source_id", "chunk_id"], "left_anti")).select("source_id").distinct()
            known = held.select("input_hash", "embedding").dropDuplicates(["input_hash"])
        else:
            other, known = chunks.select("source_id").distinct(), None
        other, other_path = storage.written(other, "sources")
        some = chunks.join(other, "source_id", "left_semi")
        wanted = some.select("input_hash", "text").dropDuplicates(["input_hash"])
        missing = wanted if known is None else wanted.join(known, "input_hash", "left_anti")
        made, made_path = storage.written(self.embed(missing, profile).select("input_hash", F.col("embedding").cast("array<double>").alias("embedding")), "embedded")
        counts = {"sources": other.count(), "embedded": made.count(), "known": wanted.count()}
        counts["known"] -= counts["embedded"]
        if counts["sources"]:
            every = made if known is None else made.unionByName(known)
            rows = some.join(every, "input_hash").select("source_id", "chunk_id", "input_hash", "embedding")
            store.replace(lambda segment: store.write(segment, "vectors", rows), rows.select("source_id"), other)
        storage.remove(self.spark, other_path, made_path)
        return counts

    def ingest_folder(self, folder: str, ignore: list[str] | None = None) -> DataFrame:
        """Units of all files that a parser reads, by path: plaintext, Markdown, JSON and scripture."""
        files = readers.discover(self.spark, folder, ignore).filter("parser IS NOT NULL")
        texts = files.select(F.col("path").alias("source_id"), "parser", F.decode("content", "UTF-8").alias("text"))
        plain = ingest.paragraphs(texts.filter("parser = 'plaintext'")).select("source_id", F.col("position").cast("long"), F.lit("paragraph").alias("kind"), "text")
        marked = markdown.parse(texts.filter("parser = 'markdown'")).select("source_id", "position", "kind", "text")
        data = readers.flattened_json(texts.filter("parser = 'json'"), "source_id", "text").select("source_id", "position", F.lit("scalar").alias("kind"), F.concat_ws(": ", "path", "value").alias("text"))
        verses = scripture.parse(texts).select("source_id", "position", "kind", "text")
        return plain.unionByName(marked).unionByName(data).unionByName(verses)

    def retrieve(self, questions: DataFrame, limit: int = 12, scope: DataFrame | None = None, vectors: DataFrame | None = None, question_vectors: DataFrame | None = None) -> DataFrame:
        """Ranked chunks for questions (query_id, text): BM25, fused with dense neighbours where vectors (chunk_id,
        embedding) are given. A scope (source_id) holds before anything is ranked."""
        chunks = self.table("chunks").select("chunk_id", "source_id", "text")
        if scope is not None:
            chunks = filters.in_scope(chunks, scope, "source_id")
        lists = lexical.index_top_k(self.index, questions, 50, within=chunks if scope is not None else None).select("query_id", "chunk_id", "rank")
        if vectors is not None:
            near = dense.dense_top_k(vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi"), question_vectors, 80)
            lists = lists.unionByName(near.select("query_id", "chunk_id", "rank"))
        return fusion.rrf(lists, limit).join(chunks, "chunk_id")

    def search(self, queries: DataFrame, limit: int = 12) -> DataFrame:
        """Ranked chunks for queries (query_id, text) with phrases and + and - before words (`lexical.clauses`)."""
        return lexical.boolean_top_k(self.index, queries, limit).join(self.table("chunks").select("chunk_id", "source_id", "text"), "chunk_id")

    def evidence(self, hits: DataFrame) -> DataFrame:
        """The units behind hits (query_id, rank, chunk_id), by the spans of the chunks, each once a query; units whose
        text a chunk carries over from the one before are among them."""
        spans = self.table("chunks").select("chunk_id", "source_id", F.explode("spans.unit").alias("position"))
        x = hits.select("query_id", "rank", "chunk_id").join(spans, "chunk_id")
        first = x.groupBy("query_id", "source_id", "position").agg(F.min("rank").alias("rank"))
        return first.join(self.table("units").select("source_id", F.col("position").cast("long").alias("position"), "text", "text_hash"), ["source_id", "position"])
