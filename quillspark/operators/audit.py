"""Answers cut into claims that tile them, and citations bound to the claims that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A claim ends with its marks and the white space after them, or with the answer; citations stand in brackets.
CLAIM, CITATION = r"(?s)[^.!?]+[.!?]*[ \t\r\n]*|[.!?]+[ \t\r\n]*", r"\[E[0-9]+(?:, *E[0-9]+)*\]"


def claims(answers: DataFrame) -> DataFrame:
    """(answer_id, claim, start, end, text) of answers (answer_id, text): consecutive byte ranges, numbered from 0, whose
    texts make the answer. A null or empty answer has none."""
    x = answers.select("answer_id", F.posexplode(F.regexp_extract_all("text", F.lit(CLAIM), F.lit(0))).alias("claim", "text")).withColumn("size", F.octet_length("text"))
    end = F.sum("size").over(Window.partitionBy("answer_id").orderBy("claim"))
    return x.withColumn("end", end).select("answer_id", "claim", (F.col("end") - F.col("size")).alias("start"), "end", "text")


def citations(answers: DataFrame) -> DataFrame:
    """(answer_id, start, label) of each label in each bracket of an answer, at the byte where its bracket begins."""
    between = F.transform(F.split("text", CITATION), lambda x: F.octet_length(x))
    x = answers.select("answer_id", between.alias("between"), F.posexplode(F.regexp_extract_all("text", F.lit(CITATION), F.lit(0))).alias("i", "raw"))
    x = x.withColumn("own", F.octet_length("raw"))
    w = Window.partitionBy("answer_id").orderBy("i")
    start = F.sum(F.col("between")[F.col("i")]).over(w) + F.sum("own").over(w) - F.col("own")
    # starts are summed before brackets become a row for each label
    return x.withColumn("start", start).select("answer_id", "start", F.explode(F.array_distinct(F.regexp_extract_all("raw", F.lit("E[0-9]+"), F.lit(0)))).alias("label"))


def bound_citations(claims: DataFrame, cited: DataFrame) -> DataFrame:
    """(answer_id, claim, labels) of every claim: the labels that begin inside it, sorted; one pass over an answer's claims
    and citations in order, not a pair of them each."""
    c = claims.select("answer_id", "start", F.lit(0).alias("kind"), "claim", F.lit(None).cast("string").alias("label"))
    x = c.unionByName(cited.select("answer_id", "start", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("claim"), "label"))
    w = Window.partitionBy("answer_id").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("claim", F.last("claim", ignorenulls=True).over(w)).filter("claim IS NOT NULL")
    return x.groupBy("answer_id", "claim").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def tiling_faults(answers: DataFrame, claims: DataFrame) -> DataFrame:
    """(answer_id, claim, fault) of claims (answer_id, claim, start, end, text) that do not tile their answer: gap or overlap
    before a claim, empty, text (its bytes are others), repeated (its number), or a gap at the end (claim null)."""
    w = Window.partitionBy("answer_id").orderBy("start", "end", "claim")
    reached = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    again = F.count(F.lit(1)).over(Window.partitionBy("answer_id", "claim")) > 1
    x = claims.select("answer_id", "claim", "start", "end", "text", reached.alias("reached"), again.alias("again"))
    x = x.join(answers.select("answer_id", F.encode("text", "UTF-8").alias("whole")), "answer_id")
    part = F.substring("whole", F.col("start") + 1, F.col("end") - F.col("start"))
    faults = F.array(
        F.when(F.col("start") > F.col("reached"), "gap").when(F.col("start") < F.col("reached"), "overlap"), F.when(F.col("start") >= F.col("end"), "empty"),
        F.when(part != F.encode("text", "UTF-8"), "text"), F.when(F.col("again"), "repeated"),
    )
    one = x.select("answer_id", "claim", F.explode(F.array_compact(faults)).alias("fault"))
    ends = claims.groupBy("answer_id").agg(F.max("end").alias("end"))
    tail = answers.filter("octet_length(text) > 0").join(ends, "answer_id", "left").filter("coalesce(end, 0) < octet_length(text)")
    return one.unionByName(tail.select("answer_id", F.lit(None).cast("int").alias("claim"), F.lit("gap").alias("fault")))
