"""Collapse of ranked hits that share an identity, with the strongest as representative and a reason for each collapse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.components import components

#: Identities that merge hits, in the order in which they give a reason; and those of which a quota shows some.
MERGING = ("exact_duplicate", "near_duplicate", "overlap", "parent_child", "mirror", "version")
QUOTAS = ("thread", "source")
#: The identity that rests on similarity alone.
SIMILARITY = "near_duplicate"


def collapsed(hits: DataFrame, identities: DataFrame, most: dict[str, int]) -> DataFrame:
    """query_id, hit_id, rank, representative, reason and place of every hit.

    Takes hits (query_id, hit_id, rank, strength: 0 is strongest, protected) and identities (query_id, hit_id, kind,
    value). Hits of one query that share a value of a merging kind, also over others, are one group. A protected hit (a
    version or translation that differs in meaning) joins no group over similarity alone. A group shows its strongest
    hit, of equals the one with the least rank; every other one is collapsed onto it and keeps as its reason the first
    kind of MERGING that it shares with another hit. Of what is shown, each thread and then each source keeps the
    strongest `most` hits; what exceeds them is collapsed onto the strongest, for the quota. `place` numbers what is left
    by rank. Null and blank values identify nothing, a hit with several values of a quota counts for the least; an
    empty table gives no rows.

    Groups are components of the graph between hits and values, so a value that very many hits share costs a row a hit."""
    ids = identities.filter(F.trim(F.coalesce("value", F.lit(""))) != "").join(hits.select("query_id", "hit_id", "protected"), ["query_id", "hit_id"])
    merging = ids.filter(F.col("kind").isin(*MERGING) & ~((F.col("kind") == SIMILARITY) & F.coalesce("protected", F.lit(False))))
    merging = merging.select("query_id", "hit_id", "kind", "value").distinct()
    hit_node = F.to_json(F.array(F.col("query_id").cast("string"), F.col("hit_id").cast("string")))
    value_node = F.to_json(F.array(F.col("query_id").cast("string"), F.col("kind"), F.col("value")))
    roots = components(merging.select(hit_node.alias("a"), value_node.alias("b")))
    h = hits.withColumn("node", hit_node).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    shared = merging.groupBy("query_id", "kind", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    order = F.array_position(F.array(*map(F.lit, MERGING)), F.col("kind"))
    reasons = merging.join(shared, ["query_id", "kind", "value"]).groupBy("query_id", "hit_id").agg(F.min_by("kind", order).alias("shared_kind"))
    best = F.min(F.struct("strength", "rank", "hit_id"))
    heads = h.groupBy("query_id", "root").agg(best.alias("best")).select("query_id", "root", F.col("best.hit_id").alias("representative"))
    x = h.join(heads, ["query_id", "root"]).join(reasons, ["query_id", "hit_id"], "left")
    x = x.select("query_id", "hit_id", "rank", "strength", "representative", F.when(F.col("hit_id") != F.col("representative"), F.col("shared_kind")).alias("reason"))
    for kind in QUOTAS:
        value = ids.filter(F.col("kind") == kind).groupBy("query_id", "hit_id").agg(F.min("value").alias("value"))
        shown = x.filter("reason IS NULL").join(value, ["query_id", "hit_id"])
        w = Window.partitionBy("query_id", "value").orderBy("strength", "rank", "hit_id")
        over = shown.select("query_id", "hit_id", F.row_number().over(w).alias("turn"), F.first("hit_id").over(w).alias("head")).filter(F.col("turn") > most[kind])
        x = x.join(over.drop("turn"), ["query_id", "hit_id"], "left")
        x = x.withColumns({"reason": F.when(F.col("head").isNotNull(), f"{kind}_quota").otherwise(F.col("reason")), "representative": F.coalesce("head", "representative")}).drop("head")
    place = F.row_number().over(Window.partitionBy("query_id", F.col("reason").isNull()).orderBy("rank", "hit_id"))
    return x.select("query_id", "hit_id", "rank", "representative", "reason", F.when(F.col("reason").isNull(), place).alias("place"))
