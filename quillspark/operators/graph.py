"""Structural graphs over units and chunks: edges, expansion of seeds, communities and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import lookup_key, token_set
from quillspark.functions.vector import hop_score
from quillspark.operators.components import components
from quillspark.operators.pairs import paired

#: Weight of a whole query found in a report, and of each of its claims.
EXACT_BONUS, CLAIM_WEIGHT = 2.0, 0.001


def sequence_edges(rows: DataFrame, group: str, order: list[str], node: str) -> DataFrame:
    """next and previous edges between neighbours in each group's order."""
    x = rows.withColumn("_to", F.lead(node).over(Window.partitionBy(group).orderBy(*order))).filter("_to IS NOT NULL")
    edge = lambda kind, a, b: F.struct(F.lit(kind).alias("edge_type"), F.col(a).alias("from_node"), F.col(b).alias("to_node"))
    return x.select(F.explode(F.array(edge("next", node, "_to"), edge("previous", "_to", node))).alias("e")).select("e.*")


def hierarchy_edges(rows: DataFrame, child: str, parent: Column) -> DataFrame:
    """parent and child edges to the first parent key that is not null (page, else section, else source)."""
    x = rows.select(F.col(child).cast("string").alias("c"), parent.cast("string").alias("p")).filter("p IS NOT NULL")
    edge = lambda kind, a, b: F.struct(F.lit(kind).alias("edge_type"), F.col(a).alias("from_node"), F.col(b).alias("to_node"))
    return x.select(F.explode(F.array(edge("parent", "c", "p"), edge("child", "p", "c"))).alias("e")).select("e.*").distinct()


def structural_edges(units: DataFrame, group: str, order: list[str], unit: str, levels: list[str]) -> DataFrame:
    """All structural edges of units: next and previous in each group's order, and parent and child between each unit and
    its first level, and each level and the one above (columns of node names, from the nearest up)."""
    out = sequence_edges(units, group, order, unit)
    for low, high in zip([unit, *levels], levels):
        out = out.unionByName(hierarchy_edges(units, low, F.col(high)))
    return out


def section_nodes(units: DataFrame) -> DataFrame:
    """One node for every prefix of a heading path (source_id, heading_path array), with its depth and units below it."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size("heading_path")), lambda i: F.slice("heading_path", F.lit(1), i))
    x = units.filter(F.size("heading_path") > 0).select("source_id", F.explode(prefixes).alias("path"))
    return x.groupBy("source_id", F.array_join("path", " / ").alias("section"), F.size("path").alias("depth")).agg(F.count(F.lit(1)).alias("units"))


def siblings(members: DataFrame, seeds: DataFrame) -> DataFrame:
    """For each seed, the other chunks of its sections: section, seed, chunk_id. Takes members (section, chunk_id)."""
    own = seeds.join(members.withColumnRenamed("chunk_id", "seed"), "seed").select("section", "seed").distinct()
    return paired(own, members, "section", "chunk_id").filter("seed <> chunk_id")


def hops(edges: DataFrame, seeds: DataFrame, most: int, closed: DataFrame | None = None) -> DataFrame:
    """Nodes within `most` hops of each seed (seed, node, score), with the least hop and the score it leaves.

    Nodes of `closed` are reached but not passed through. Each hop joins the frontier with the edges; a node already
    reached from that seed is dropped before the next."""
    # over an adjacency in buckets of from_node this needs no shuffle, and the joins below none of the edges
    e = edges.select(F.col("from_node").alias("node"), F.col("to_node").alias("next")).distinct()
    reached = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"), "score")
    frontier = reached
    for hop in range(1, most + 1):
        if closed is not None and hop > 1:
            frontier = frontier.join(closed.select("node"), "node", "left_anti")
        new = frontier.join(e, "node").select("seed", F.col("next").alias("node"), F.lit(hop).alias("hop"), "score").distinct()
        frontier = new.join(reached.select("seed", "node"), ["seed", "node"], "left_anti")
        reached = reached.unionByName(frontier)
    return reached.filter("hop > 0").select("seed", "node", "hop", F.round(hop_score(F.col("score"), F.col("hop")), 6).alias("score"))


def canonical_entities(nodes: DataFrame) -> DataFrame:
    """Entities by type and label key: labels, nodes and sources of each."""
    return nodes.groupBy("entity_type", lookup_key(F.col("label")).alias("key")).agg(
        F.array_sort(F.collect_set("label")).alias("labels"), F.countDistinct("node").alias("n_nodes"), F.countDistinct("source").alias("n_sources"))


def communities(links: DataFrame) -> DataFrame:
    """(node, community): the smallest node of each connected component of links (a, b)."""
    roots = components(links)
    least = roots.groupBy("root").agg(F.min("node").alias("community"))
    return roots.join(least, "root").select("node", "community")


def reports(claims: DataFrame, most_claims: int, most_labels: int = 3) -> DataFrame:
    """Per community: its first claims by text and node, and a title of its first labels."""
    w = Window.partitionBy("community").orderBy("claim", "node")
    kept = claims.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most_claims)
    body = kept.groupBy("community").agg(F.count(F.lit(1)).alias("n_claims"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "claim"))), lambda x: x["claim"]), " ").alias("summary"))
    first = F.row_number().over(Window.partitionBy("community").orderBy("label"))
    labels = claims.select("community", "label").distinct().withColumn("n", first).filter(F.col("n") <= most_labels)
    title = labels.groupBy("community").agg(F.array_join(F.array_sort(F.collect_list("label")), " / ").alias("title"))
    return body.join(title, "community")


def report_scores(reports: DataFrame, query: str) -> DataFrame:
    """Reports by overlap with the query's terms, a bonus where they hold it whole, and their claims; without overlap
    they are left out unless the query is blank."""
    blank = not query.strip()
    q, t = token_set(F.lit(query)), token_set(F.concat_ws(" ", "title", "summary"))
    overlap = F.size(F.array_intersect(q, t))
    whole = F.when(F.lit(not blank) & F.contains(F.lower(F.concat_ws(" ", "title", "summary")), F.lit(query.strip().lower())), EXACT_BONUS).otherwise(0.0)
    x = reports.withColumn("score", F.round(overlap + whole + F.col("n_claims") * CLAIM_WEIGHT, 6))
    return x if blank else x.filter(overlap + whole > 0)
