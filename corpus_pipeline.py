"""A pipeline over documents: each stage's result is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import table, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar, learned from `labels`, does not predict to be toxic."""
    from quillspark.llm.toxicity import fit, keep_clean

    return keep_clean(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar to 0.8 or more.

    Rows go by id and text, so a row that only shares its id with a copy stays; rows without an id stay."""
    from quillspark.llm.common import likely
    from quillspark.llm.neardup import near_duplicates, text_digest

    gone, _ = written(near_duplicates(docs, digests=True).filter("NOT kept").select("doc_id", "digest").distinct(), "gone")
    x = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long"), text_digest("text"))
    # only what may be gone is dealt
    x, _ = likely(x, gone, ["doc_id", "digest"])
    rest = x.filter("likely").join(gone, ["doc_id", "digest"], "left_anti")
    return x.filter("NOT likely").unionByName(rest.select(*x.columns)).select("row.*")


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without what a string of 51 words, or of 400 bytes where words are longer, found twice covers."""
    from quillspark.llm.repeats import remove_repeats

    out = remove_repeats(docs, text=True, words=51)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and at the edge of a source's target as far, as the mix takes them."""
    from quillspark.llm.mixing import mixed

    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenized documents in sequences of at most 1024 tokens."""
    from quillspark.llm.packing import pack

    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("repeat_removal", repeat_removal), ("mixing", mixing), ("packing", packing)]

#: Learned scores, string matching over all positions and tokenizing have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = written(docs, name)
    return docs
