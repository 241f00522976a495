"""Plans of questions that depend on each other: levels, cycles, and evidence merged along the levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.storage import remove, written


def levels(questions: DataFrame, depends: DataFrame) -> DataFrame:
    """plan_id, sub_id, level and status of every question, over all plans at once.

    Takes questions (plan_id, sub_id) and depends (plan_id, sub_id, depends_on). A question without dependencies has level
    0, another one more than the highest it depends on. Status is its plan's: unknown_dependency before cycle before ok;
    questions in a cycle or behind one have no level. Dependencies on what is not there do not count for levels.

    Each round takes away the questions that wait for nothing more and what waited for them; rounds are as many as the
    longest chain, and only whether something is left reaches the driver."""
    spark = questions.sparkSession
    nodes, nodes_path = written(questions.select("plan_id", "sub_id").distinct(), "questions")
    known = nodes.select("plan_id", F.col("sub_id").alias("depends_on"))
    edges = depends.select("plan_id", "sub_id", "depends_on").distinct().join(nodes, ["plan_id", "sub_id"], "left_semi")
    unknown = edges.join(known, ["plan_id", "depends_on"], "left_anti").select("plan_id").distinct()
    open_, open_path = written(edges.join(known, ["plan_id", "depends_on"], "left_semi"), "depends")
    pending, found, level, paths, spare = nodes, None, 0, [nodes_path], open_path
    while True:
        new = pending.join(open_.select("plan_id", "sub_id").distinct(), ["plan_id", "sub_id"], "left_anti").withColumn("level", F.lit(level))
        new, path = written(new, "level")
        paths.append(path)
        if not new.limit(1).count():
            break
        found = new if found is None else found.unionByName(new)
        left, pending_path = written(pending.join(new.select("plan_id", "sub_id"), ["plan_id", "sub_id"], "left_anti"), "pending")
        still, still_path = written(open_.join(new.select("plan_id", F.col("sub_id").alias("depends_on")), ["plan_id", "depends_on"], "left_anti"), "depends")
        remove(spark, spare)
        paths.append(pending_path)
        pending, open_, spare, level = left, still, still_path, level + 1
    rest = pending.withColumn("level", F.lit(None).cast("int"))
    all_ = rest if found is None else found.unionByName(rest)
    status = all_.groupBy("plan_id").agg(F.max(F.col("level").isNull()).alias("cyclic")).join(unknown.withColumn("unknown", F.lit(True)), "plan_id", "left")
    status = status.select("plan_id", F.when(F.col("unknown"), "unknown_dependency").when(F.col("cyclic"), "cycle").otherwise("ok").alias("status"))
    out, _ = written(all_.join(status, "plan_id"), "levels")
    remove(spark, spare, *paths)
    return out


def merged_along(levelled: DataFrame, found: DataFrame) -> DataFrame:
    """plan_id, evidence_id, place, subs and direct: what the questions of plans without faults found (plan_id, sub_id, rank,
    evidence_id, direct), each evidence once where it comes first by level, question and rank, with all its questions."""
    x = levelled.filter("status = 'ok'").select("plan_id", "sub_id", "level").join(found, ["plan_id", "sub_id"])
    x = x.groupBy("plan_id", "evidence_id").agg(F.min(F.struct("level", "sub_id", "rank")).alias("first"), F.array_sort(F.collect_set("sub_id")).alias("subs"), F.bool_or("direct").alias("direct"))
    place = F.row_number().over(Window.partitionBy("plan_id").orderBy("first", "evidence_id"))
    return x.select("plan_id", "evidence_id", place.alias("place"), "subs", "direct")
