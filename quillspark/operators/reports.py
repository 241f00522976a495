"""Community reports whose claims stand on evidence that is all there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def report_evidence(claims: DataFrame, spans: DataFrame, members: DataFrame, evidence: DataFrame, most_claims: int, most_evidence: int) -> tuple[DataFrame, DataFrame]:
    """Surviving claims (community, claim_id, place, n_evidence) and each community's evidence (community, evidence_id,
    chunk_id, turn).

    Takes claims (community, claim_id, text), spans (claim_id, ordinal, chunk_id, source_id), members (chunk_id, source_id,
    ordinal, evidence_id) and evidence (evidence_id, source_id). A community takes its first claims by text and id. What
    they cite is united in the order of claims, spans and the chunk's units, each evidence once, up to most_evidence. A
    claim survives if it cites something and all that it cites is among that: an evidence that is lost, has another
    source than its chunk, or did not fit, takes its claims along; so does a chunk that is not there.

    Firsts are taken by ranks with a limit, which Spark applies before it shuffles, and unions by sums over (community,
    evidence), so that a giant community is dealt over tasks. Null keys match nothing; empty tables give no rows."""
    first = F.row_number().over(Window.partitionBy("community").orderBy("text", "claim_id"))
    kept = claims.withColumn("place", first).filter(F.col("place") <= most_claims).select("community", "claim_id", "place")
    m = members.select("chunk_id", F.col("source_id").alias("chunk_source"), F.col("ordinal").alias("unit"), "evidence_id")
    cited = kept.join(spans.select("claim_id", "ordinal", "chunk_id"), "claim_id").join(m, "chunk_id", "left")
    stored = evidence.select("evidence_id", F.col("source_id").alias("evidence_source")).dropDuplicates(["evidence_id"])
    cited = cited.join(stored, "evidence_id", "left").withColumn("there", F.coalesce(F.col("evidence_source") == F.col("chunk_source"), F.lit(False)))
    at = F.struct("place", "ordinal", "chunk_id", "unit")
    # evidence that disagrees in one place is still there in another, but not for the claim that cites it here
    united = cited.filter("there").groupBy("community", "evidence_id").agg(F.min(at).alias("at"))
    turn = F.row_number().over(Window.partitionBy("community").orderBy("at", "evidence_id"))
    united = united.withColumn("turn", turn).filter(F.col("turn") <= most_evidence)
    x = cited.join(united.select("community", "evidence_id", F.lit(True).alias("united")), ["community", "evidence_id"], "left")
    whole = F.bool_and(F.col("there") & F.coalesce("united", F.lit(False)))
    claims = x.groupBy("community", "claim_id", "place").agg(whole.alias("whole"), F.countDistinct("evidence_id").alias("n_evidence")).filter("whole")
    return claims.select("community", "claim_id", "place", "n_evidence"), united.select("community", "evidence_id", F.col("at.chunk_id").alias("chunk_id"), "turn")
