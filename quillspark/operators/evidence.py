"""Hits, caches, tasks, pages and reports: joins that keep what still holds and drop the rest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Which fields of a cache key an event kind compares; each field-equality is a join of its own.
INVALIDATES = {kind: ("principal", "source_generation") for kind in ("edit", "delete", "snapshot", "lifecycle")} | {
    "acl": ("principal", "acl_scope"), "model": ("model_fingerprint",), "profile": ("query_plan_hash",), "graph": ("source_generation",), "retention": ("policy_version",),
}


def valid_hits(hits: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The first k hits (query_id, chunk_id, position, generation) of each query whose chunk (chunk_id, generation) is
    there and of that generation, each chunk once; with their new rank. Scope filters apply to chunks before."""
    x = hits.join(chunks.select("chunk_id", "generation"), ["chunk_id", "generation"]).groupBy("query_id", "chunk_id").agg(F.min("position").alias("position"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("position", "chunk_id"))
    return x.withColumn("rank", rank).filter(F.col("rank") <= k)


def identity_filtered(lists: DataFrame, allowed: DataFrame) -> DataFrame:
    """Ranked lists (list, query_id, chunk_id, rank) cut to the allowed chunks, ranks numbered anew in each list."""
    x = lists.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("list", "query_id").orderBy("rank", "chunk_id")))


def invalidated(keys: DataFrame, events: DataFrame) -> DataFrame:
    """Ids of cache keys that an event (kind and the fields of its kind) invalidates: one equi-join for each set of fields."""
    parts = []
    for fields in sorted(set(INVALIDATES.values())):
        kinds = [k for k, v in INVALIDATES.items() if v == fields]
        parts.append(keys.join(events.filter(F.col("kind").isin(*kinds)).select(*fields).distinct(), list(fields), "left_semi").select("key_id"))
    return reduce(DataFrame.union, parts).distinct()


def startable(tasks: DataFrame) -> DataFrame:
    """Queued tasks (task_id, kind, status) of kinds of which none runs."""
    running = tasks.filter("status = 'running'").select("kind").distinct()
    return tasks.filter("status = 'queued'").join(running, "kind", "left_anti")


def mentioning(payloads: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows whose JSON payload has one of the values anywhere: in objects and arrays at any depth, never as a key.

    A payload's tokens are its texts, with a colon behind them if they are keys, and its bare numbers and words. What is
    no JSON has no values."""
    tokens = F.regexp_extract_all(F.col(column), F.lit(r'("(?:[^"\\]|\\.)*"\s*:?|[^\s,:\[\]{}"]+)'), F.lit(1))
    plain = lambda t: F.get_json_object(F.concat(F.lit("["), t, F.lit("]")), "$[0]")
    good = F.get_json_object(F.col(column), "$").isNotNull()
    return payloads.filter(good & F.coalesce(F.exists(tokens, lambda t: ~t.endswith(":") & plain(t).isin(*values)), F.lit(False)))


def near_text(images: DataFrame, units: DataFrame) -> DataFrame:
    """(image_id, unit_id) of images (source_id, page, image_id, nearby) and text units of their page that hold the nearby text."""
    x = images.filter("nearby IS NOT NULL AND trim(nearby) <> ''").join(units, ["source_id", "page"])
    return x.filter(F.contains("text", F.trim("nearby"))).select("image_id", "unit_id").distinct()


def page_graph(units: DataFrame) -> DataFrame:
    """Edges between each page of a source and its units (source_id, page, unit_id), both ways, and between the page and its source."""
    page = F.concat(F.lit("page:"), F.col("source_id").cast("string"), F.lit(":"), F.col("page").cast("string"))
    x = units.select("source_id", page.alias("page_node"), F.col("unit_id").cast("string").alias("unit")).distinct()
    same = x.select(F.lit("same_page").alias("edge_type"), F.col("page_node").alias("from_node"), F.col("unit").alias("to_node"))
    back = x.select(F.lit("same_page").alias("edge_type"), F.col("unit").alias("from_node"), F.col("page_node").alias("to_node"))
    top = x.select(F.lit("child").alias("edge_type"), F.concat(F.lit("source:"), F.col("source_id").cast("string")).alias("from_node"), F.col("page_node").alias("to_node")).distinct()
    return same.union(back).union(top)


def relation_edges(relations: DataFrame, units: DataFrame) -> DataFrame:
    """Relations (from_unit, to_unit) whose ends are both among the units (unit_id)."""
    u = units.select("unit_id").distinct()
    x = relations.join(u.withColumnRenamed("unit_id", "from_unit"), "from_unit", "left_semi")
    return x.join(u.withColumnRenamed("unit_id", "to_unit"), "to_unit", "left_semi").select("from_unit", "to_unit").distinct()


def nodes_of_chunks(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each chunk the generated entities and claims (node_id, kind, chunk_ids of their spans) that cite it, sorted."""
    x = nodes.filter(F.col("kind").isin("entity", "claim")).select("node_id", F.explode(F.array_distinct("chunk_ids")).alias("chunk_id"))
    return x.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("chunk_id").agg(F.array_sort(F.collect_set("node_id")).alias("nodes"))


def backing_evidence(hits: DataFrame, backing: DataFrame, chunks: DataFrame, evidence: DataFrame, members: DataFrame, most: int) -> DataFrame:
    """Evidence rows behind global hits (query_id, report_id, score), best hit first, each evidence once, `most` a query.

    backing: report_id, ordinal, chunk_id, evidence_id. A row counts only if chunk and evidence are there, have one
    source, and the chunk holds the evidence (members: chunk_id, evidence_id)."""
    x = hits.join(backing, "report_id").join(chunks.select("chunk_id", F.col("source_id").alias("chunk_source")), "chunk_id").join(evidence.select("evidence_id", "source_id"), "evidence_id")
    x = x.filter(F.col("chunk_source") == F.col("source_id")).join(members.select("chunk_id", "evidence_id").distinct(), ["chunk_id", "evidence_id"], "left_semi")
    first = F.min(F.struct((-F.col("score")).alias("worse"), "report_id", "ordinal", "chunk_id")).alias("first")
    x = x.groupBy("query_id", "evidence_id").agg(first).select("query_id", "evidence_id", "first.*")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("worse", "report_id", "ordinal", "evidence_id"))
    return x.withColumn("rank", rank).filter(F.col("rank") <= most).select("query_id", "evidence_id", "chunk_id", "report_id", (-F.col("worse")).alias("score"), "rank")


def ordered_edges(edges: DataFrame) -> DataFrame:
    """Each node's edges (from_node, edge_type, ordinal, edge_id) numbered by type, ordinal (nulls first) and id."""
    w = Window.partitionBy("from_node").orderBy("edge_type", F.col("ordinal").asc_nulls_first(), "edge_id")
    return edges.withColumn("place", F.row_number().over(w))


def vector_payload_classes(rows: DataFrame) -> DataFrame:
    """How many rows (json_length, blob_length) may drop their JSON, have none, have no blob, or a malformed one."""
    j, b = F.coalesce("json_length", F.lit(0)), F.coalesce("blob_length", F.lit(0))
    kind = F.when((b > 0) & (b % 4 == 0) & (j > 0), "eligible").when((b > 0) & (b % 4 == 0), "already_clean").when(b > 0, "malformed_blob").when(j > 0, "json_only").otherwise("missing_blob")
    return rows.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def reconciliation_batch(pending: DataFrame, most: int) -> DataFrame:
    """The next `most` sources to reconcile: fewest attempts first, then the oldest request, then the id."""
    return pending.orderBy("attempts", "requested_at", "source_id").limit(most)


def erasure_plan(sources: DataFrame, targets: list[str], done: DataFrame) -> DataFrame:
    """(source_id, target) still to be erased: every source at each of a fixed list of targets, less what is done."""
    every = sources.select("source_id", F.explode(F.array(*map(F.lit, targets))).alias("target"))
    return every.join(done.select("source_id", "target"), ["source_id", "target"], "left_anti")


def _quotation(bindings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Bindings (evidence_id, quote) with the status of their quotation in `evidence` (evidence_id, text)."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    x = bindings.drop("text", "status").join(evidence.select("evidence_id", "text"), "evidence_id", "left")
    status = (
        F.when(F.col("text").isNull(), "unknown_evidence").when(F.coalesce("quote", F.lit("")) == "", "not_provided")
        .when(F.contains("text", "quote"), "match").when(F.contains(plain(F.col("text")), plain(F.col("quote"))), "approximate").otherwise("missing")
    )
    return x.withColumn("status", status).drop("text")


def quotation_status(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each claim (claim_id, evidence_id, quote) as match, approximate (equal but for case and spacing), missing,
    not_provided or unknown_evidence, and whether it is publishable."""
    return _quotation(claims, evidence).select("claim_id", "status", (F.col("status") == "match").alias("publishable"))


def claim_support(claims: DataFrame, bindings: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, support, bindings, holding, publishable) of claims (claim_id, pack_id, subject, value, factual), whose
    bindings (claim_id, evidence_id, quote, stance) are quotations of evidence, or bare ids, for or against them.

    A binding for a claim holds if its quotation is found, or if it has none and its evidence is there. non_factual: not a
    statement; conflict: a quotation against it is found, or its pack has a holding claim of another value on its subject;
    supported: all bindings for it hold, and there are some; partial: some hold, or are found but for case and spacing;
    else unsupported. Only supported claims are publishable. Subjects are compared by their least and greatest value, never
    claim by claim; a null subject or value contradicts nothing, a null `factual` counts as true."""
    x = _quotation(bindings, evidence)
    against = F.coalesce(F.col("stance") == "against", F.lit(False))
    n = x.groupBy("claim_id").agg(
        F.count_if(~against).alias("bindings"), F.count_if(~against & F.col("status").isin("match", "not_provided")).alias("holding"),
        F.count_if(~against & (F.col("status") == "approximate")).alias("close"), F.count_if(against & (F.col("status") == "match")).alias("denied"))
    c = claims.select("claim_id", "pack_id", "subject", "value", F.coalesce("factual", F.lit(True)).alias("factual")).join(n, "claim_id", "left").na.fill(0, ["bindings", "holding", "close", "denied"])
    held = c.filter("factual AND holding > 0").groupBy("pack_id", "subject").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    c = c.join(held, ["pack_id", "subject"], "left")
    other = (F.col("denied") > 0) | F.coalesce((F.col("holding") > 0) & (F.col("least") != F.col("most")), F.lit(False))
    support = (
        F.when(~F.col("factual"), "non_factual").when(other, "conflict").when((F.col("bindings") > 0) & (F.col("holding") == F.col("bindings")), "supported")
        .when(F.col("holding") + F.col("close") > 0, "partial").otherwise("unsupported")
    )
    return c.select("claim_id", support.alias("support"), "bindings", "holding", (support == "supported").alias("publishable"))


def growth_steps(points: DataFrame) -> DataFrame:
    """Growth of bytes per unit between neighbouring points (series, x, bytes); x is positive, series have two points or more."""
    w = Window.partitionBy("series").orderBy("x")
    x = points.filter("x > 0").withColumn("step", (F.col("bytes") - F.lag("bytes").over(w)) / (F.col("x") - F.lag("x").over(w)))
    return x.filter("step IS NOT NULL")
