"""What an answer shows of its results: results that rest on source text alone, and packs of labelled evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.citations import evidence_role
from quillspark.operators.filters import source_bounded

#: Results (query_id, chunk_id, rank, score, origin), one a query, chunk and rank; evidence of chunks (chunk_id, ordinal, evidence_id, kind, derived_from,
#: canonical: whether its place is a canonical one), an evidence once a chunk; selected (query_id, chunk_id, evidence_id), one
#: a query and chunk.
_RESULT = ("query_id", "chunk_id", "rank", "score", "origin")
_EVIDENCE = ("chunk_id", "ordinal", "evidence_id", "kind", "derived_from", "canonical")


def bounded_results(results: DataFrame, evidence: DataFrame) -> DataFrame:
    """Results whose chunk, and whose seed_chunk_id if they have one, have evidence and all of it of the allowed kinds;
    ranks are numbered anew."""
    good = source_bounded(evidence.select("chunk_id").dropna().distinct(), evidence)
    x = results.join(good, "chunk_id", "left_semi")
    x = x.join(good.withColumnRenamed("chunk_id", "seed_chunk_id").withColumn("_seed", F.lit(True)), "seed_chunk_id", "left").filter("seed_chunk_id IS NULL OR _seed").drop("_seed")
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id")))


def _first(rows: DataFrame, key: str) -> DataFrame:
    """Of a query's rows with one key, the first by rank and ordinal."""
    x = rows.groupBy("query_id", F.col(key).alias("_key")).agg(F.min(F.struct("rank", "chunk_id", "ordinal", *(c for c in rows.columns if c not in ("query_id", "rank", "chunk_id", "ordinal")))).alias("x"))
    return x.select("query_id", "x.*")


def _labelled(entries: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id", "ordinal"))
    x = entries.withColumn("label", F.concat(F.lit("E"), n)).withColumn("role", evidence_role(F.col("origin"), F.lower("kind"), F.col("derived_from")))
    return x.select("query_id", "label", "rank", "chunk_id", "score", "evidence_id", "role", "kind")


def _rows(results: DataFrame, evidence: DataFrame, selected: DataFrame) -> DataFrame:
    chosen = selected.select("query_id", "chunk_id", F.col("evidence_id").alias("chosen"))
    return results.select(*_RESULT).join(evidence.select(*_EVIDENCE), "chunk_id").join(chosen, ["query_id", "chunk_id"], "left")


def final_pack(results: DataFrame, evidence: DataFrame, selected: DataFrame) -> DataFrame:
    """Each query's evidence in order of results, once where it comes first, labelled E1, E2, ...; of a chunk with a
    selection that one alone, and none if the chunk does not have it."""
    x = _rows(results, evidence, selected).filter("chosen IS NULL OR chosen = evidence_id").drop("chosen", "canonical")
    return _labelled(_first(x, "evidence_id"))


def display_pack(results: DataFrame, evidence: DataFrame, selected: DataFrame, start: int, end: int) -> DataFrame:
    """What a page shows: as `final_pack`, but a result of several evidences that all have canonical places is one place on
    the page, under its first evidence. There it shows its selection, or the first, if the page (places from start to before
    end) has it; off the page it shows the first. Other results show all that was not shown before."""
    x = _rows(results, evidence, selected)
    w = Window.partitionBy("query_id", "chunk_id", "rank")
    whole = w.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct("ordinal", "evidence_id", "kind", "derived_from")
    x = x.withColumn("one", (F.count(F.lit(1)).over(w) > 1) & F.bool_and(F.coalesce("canonical", F.lit(False))).over(w)).withColumn("head", F.first("evidence_id").over(whole))
    x = x.withColumn("pick", F.max(F.when(F.col("chosen") == F.col("evidence_id"), own)).over(w))
    x = x.filter("NOT one OR evidence_id = head").drop("chosen", "canonical")
    x = _first(x, "evidence_id").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id", "ordinal")) - 1)
    shown = F.when(F.col("one") & (F.col("place") >= start) & (F.col("place") < end) & F.col("pick").isNotNull(), F.col("pick")).otherwise(own)
    entries = x.select("query_id", "rank", "chunk_id", "ordinal", "score", "origin", shown["evidence_id"].alias("evidence_id"), shown["kind"].alias("kind"), shown["derived_from"].alias("derived_from"))
    return _labelled(_first(entries, "evidence_id"))
