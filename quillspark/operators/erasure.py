"""Erasure of sources at every place that holds them: what the acknowledgements leave open, in which order they came, and a
proof that names no source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Places in the order in which they are erased, with their phase; those of the last phase are remote, and may
#: be pending as long as a dead letter says so.
TARGETS = {"catalog": 0, "lexical": 1, "vectors": 1, "graph": 1, "files": 1, "caches": 2, "replica": 3}
REMOTE = max(TARGETS.values())


def _phase(target: str):
    return F.create_map(*(F.lit(x) for pair in TARGETS.items() for x in pair))[F.col(target)]


def pending(scopes: DataFrame, acks: DataFrame) -> DataFrame:
    """(plan_id, source_id, target) that no acknowledgement (plan_id, source_id, target) covers. Each source of a scope
    (plan_id, source_id) counts once; null ids stand for no source."""
    every = scopes.select("plan_id", "source_id").dropna().distinct().withColumn("target", F.explode(F.array(*map(F.lit, TARGETS))))
    return every.join(acks.select("plan_id", "source_id", "target"), ["plan_id", "source_id", "target"], "left_anti")


def erasure_faults(scopes: DataFrame, acks: DataFrame, letters: DataFrame) -> DataFrame:
    """(plan_id, fault, n) of plans whose acknowledgements (plan_id, source_id, target, at) and dead letters (plan_id,
    source_id, target) prove nothing.

    out_of_scope: an acknowledgement of a source or place that the plan has not; coverage: a local place without one; order:
    a place acknowledged before the last of an earlier phase; local_letter: a dead letter about a local place; mismatch:
    pending remote places and dead letters are not the same. n counts sources at places, for order phases."""
    key = ["plan_id", "source_id", "target"]
    one = lambda x, fault: x.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n")).select("plan_id", F.lit(fault).alias("fault"), "n")
    scope = scopes.select("plan_id", "source_id").dropna().distinct()
    known = acks.filter(F.col("target").isin(*TARGETS)).join(scope, ["plan_id", "source_id"], "left_semi")
    strange = acks.select(*key).distinct().join(known.select(*key).distinct(), key, "left_anti")
    left = pending(scope, acks).withColumn("remote", _phase("target") == REMOTE)
    told = letters.select(*key).distinct().withColumn("remote", F.coalesce(_phase("target") == REMOTE, F.lit(False)))
    late = left.filter("remote").join(told, key, "left_anti").select(*key)
    void = told.filter("remote").join(left, key, "left_anti").select(*key)
    # one row for each plan and phase
    phases = known.groupBy("plan_id", _phase("target").alias("phase")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    before = F.max("last").over(Window.partitionBy("plan_id").orderBy("phase").rowsBetween(Window.unboundedPreceding, -1))
    found = [
        one(strange, "out_of_scope"), one(left.filter("NOT remote"), "coverage"), one(phases.withColumn("before", before).filter("first < before"), "order"),
        one(told.filter("NOT remote"), "local_letter"), one(late.unionByName(void), "mismatch"),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def commitments(scopes: DataFrame, digits: int = 3) -> DataFrame:
    """(plan_id, sources, commitment): a digest of each plan's sorted source ids that does not name them.

    Ids go to 16^digits parts of a plan by their own digest; parts are hashed, then their digests, so that no task holds
    the ids of a large plan."""
    x = scopes.select("plan_id", F.col("source_id").cast("string").alias("id")).dropna().distinct()
    x = x.withColumn("part", F.substring(F.sha2("id", 256), 1, digits)).groupBy("plan_id", "part").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))
    framed = F.array_join(F.transform("ids", lambda i: F.concat(F.octet_length(i), F.lit(":"), i)), "")
    x = x.select("plan_id", "n", F.concat("part", F.sha2(framed, 256)).alias("digest"))
    return x.groupBy("plan_id").agg(F.sum("n").alias("sources"), F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ""), 256).alias("commitment"))


def erasure_proofs(scopes: DataFrame, acks: DataFrame, letters: DataFrame) -> DataFrame:
    """(plan_id, target, outcome, pending, sources, commitment) of the plans without faults: each place is confirmed, or
    pending_remote with the number of sources that wait there."""
    good = commitments(scopes).join(erasure_faults(scopes, acks, letters), "plan_id", "left_anti")
    every = good.withColumn("target", F.explode(F.array(*map(F.lit, TARGETS))))
    waits = pending(scopes, acks).groupBy("plan_id", "target").agg(F.count(F.lit(1)).alias("pending"))
    x = every.join(waits, ["plan_id", "target"], "left").withColumn("pending", F.coalesce("pending", F.lit(0)))
    return x.withColumn("outcome", F.when(F.col("pending") > 0, "pending_remote").otherwise("confirmed"))
