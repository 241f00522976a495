"""Catalog maintenance: membership, staleness, upserts, generations, metadata precedence, task analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.storage import written

#: Trust of a metadata value's origin, highest first.
ORIGINS = ("manual", "canonical_package", "embedded", "filename", "model_derived")


def membership_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """source_id with added, removed or unchanged."""
    a, b = old.select("source_id", F.lit(1).alias("_old")).distinct(), new.select("source_id", F.lit(1).alias("_new")).distinct()
    return a.join(b, "source_id", "full").select("source_id", F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("unchanged").alias("status"))


def stale(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Sources whose current hash differs from the stored one."""
    return stored.select("source_id", F.col("hash").alias("stored_hash")).join(current.select("source_id", F.col("hash").alias("current_hash")), "source_id").filter(~F.col("stored_hash").eqNullSafe(F.col("current_hash")))


def freshness(children: DataFrame, vectors: DataFrame, status: DataFrame) -> DataFrame:
    """Per source: children, vectors, and whether the vectors are stale."""
    c, v = children.groupBy("source").agg(F.count(F.lit(1)).alias("n_children")), vectors.groupBy("source").agg(F.count(F.lit(1)).alias("n_vectors"))
    x = status.join(c, "source", "left").join(v, "source", "left").fillna(0, ["n_children", "n_vectors"])
    return x.select("source", "n_children", "n_vectors", ((F.col("status") != "Embedded") | (F.col("recorded") != F.col("n_children")) | (F.col("n_vectors") != F.col("n_children"))).alias("stale"))


def index_faults(expected: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """Rows that the index lacks (missing) or has too many of (orphan)."""
    a, b = expected.select(key).distinct(), indexed.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("fault", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("fault", F.lit("orphan")))


def unreferenced(cache: DataFrame, used: DataFrame, key: str) -> DataFrame:
    return cache.join(used.select(key).distinct(), key, "left_anti")


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the order: an upsert of what is new over what is old."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def precedence(values: DataFrame, protected: list[str]) -> DataFrame:
    """For each source and field the winning value, and how many it supersedes.

    Values rank by origin and then by version; a protected field takes no model_derived value over another."""
    rank = F.array_position(F.array(*map(F.lit, ORIGINS)), F.col("origin"))
    barred = F.col("field").isin(*protected) & (F.col("origin") == "model_derived")
    w = Window.partitionBy("source_id", "field").orderBy(F.when(barred, 1).otherwise(0), rank, F.desc("version"), "value")
    n = F.count(F.lit(1)).over(Window.partitionBy("source_id", "field"))
    return values.withColumn("_n", F.row_number().over(w)).withColumn("superseded", n - 1).filter("_n = 1").drop("_n")


def collectable(generations: DataFrame, keep: int) -> DataFrame:
    """Generations (profile, generation, current) to delete: older than the current one and not among the `keep` newest
    of those. Newer ones are never deleted."""
    older = generations.filter(F.col("generation") < F.col("current"))
    return older.withColumn("age", F.dense_rank().over(Window.partitionBy("profile").orderBy(F.desc("generation")))).filter(F.col("age") > keep)


def turnover(events: DataFrame, limit: int) -> DataFrame:
    """Counts by event type within the last `limit` ids, with the users behind them and how many values are over 1.

    The newest id is one row, which is broadcast."""
    newest = events.agg(F.max("event_id").alias("newest"))
    x = events.crossJoin(F.broadcast(newest)).filter(F.col("event_id") > F.col("newest") - limit)
    return x.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"), F.count_if(F.col("value") > 1).alias("n_over_one"))


def buckets(rows: DataFrame, column: str, default: str, n: int) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(default)).alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(n)


def sums_before(rows: DataFrame, group: str, order: list[str], amount: str, name: str) -> DataFrame:
    """rows with `name`: the sum of `amount` over the rows of the group that precede in the order.

    Rows are dealt to ranges of group and order; ranges are summed, one row each and group, and rows only within their
    range, so a group of any size is shared out."""
    x, _ = written(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_range", F.spark_partition_id()), "ordered")
    sums = x.groupBy(group, "_range").agg(F.sum(amount).alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col(group).alias("_group"), F.col("_range").alias("_of"), F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    within = F.sum(amount).over(Window.partitionBy("_range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_within", F.coalesce(within, F.lit(0))).join(sums, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    return x.withColumn(name, F.col("_earlier") + F.col("_within")).drop("_range", "_within", "_earlier", "_group", "_of")


def queue_positions(rows: DataFrame, kind: str, order: list[str]) -> DataFrame:
    """How many rows of its kind precede each row."""
    return sums_before(rows.withColumn("_one", F.lit(1)), kind, order, "_one", "ahead").drop("_one")


def percentiles(rows: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """(group, share, value): exact percentiles of each group's values, between two values in proportion. Nulls do not count.

    The values at the ranks are picked by sums over distinct values before them; no group's values are in one buffer."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    x = sums_before(counts, group, [value], "n", "start")
    total = x.groupBy(F.col(group).alias("_g")).agg(F.sum("n").alias("total"))
    rank = F.col("share") * (F.col("total") - 1)
    x = x.join(total, F.col(group).eqNullSafe(F.col("_g"))).withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("rank", rank)
    held = lambda r: (F.col("start") <= r) & (r < F.col("start") + F.col("n"))
    low, high = F.floor("rank"), F.ceil("rank")
    x = x.filter(held(low) | held(high)).groupBy(group, "share", "rank").agg(F.max(F.when(held(low), F.col(value))).alias("a"), F.max(F.when(held(high), F.col(value))).alias("b"))
    return x.select(group, "share", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank"))).alias("value"))


def mutation_faults(batch: DataFrame, committed: DataFrame) -> DataFrame:
    """Mutations (id, version) that repeat an id in their batch, or do not raise the committed version."""
    once = batch.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("version").alias("version"))
    x = once.join(committed.select("id", F.col("version").alias("was")), "id", "left")
    return x.withColumn("fault", F.when(F.col("n") > 1, "repeated").when(F.col("version") <= F.col("was"), "not_newer")).filter("fault IS NOT NULL").select("id", "fault")


def first_page(tasks: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n tasks in the order, each with the number of all."""
    total = tasks.agg(F.count(F.lit(1)).alias("total"))
    return tasks.orderBy(*order).limit(n).crossJoin(F.broadcast(total))  # total is one row


def reclaimable(generations: DataFrame, leases: DataFrame, now) -> DataFrame:
    """Generations (profile, generation) that no live lease (profile, generation, expires) holds."""
    live = leases.filter(F.col("expires") > now).select("profile", "generation").distinct()
    return generations.join(live, ["profile", "generation"], "left_anti")


def reconciled(store: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """What store and index (key, version) disagree on: missing, orphan, behind or ahead in the index."""
    s, i = store.select(key, F.col("version").alias("stored")), index.select(key, F.col("version").alias("indexed"))
    finding = F.when(F.col("indexed").isNull(), "missing").when(F.col("stored").isNull(), "orphan").when(F.col("indexed") < F.col("stored"), "behind").when(F.col("indexed") > F.col("stored"), "ahead")
    return s.join(i, key, "full").withColumn("finding", finding).filter("finding IS NOT NULL")


def relocations(sources: DataFrame, files: DataFrame, supported: dict[str, list[str]]) -> DataFrame:
    """(source_id, outcome, new_path) of the sources (source_id, path, hash, parser) whose path is gone from files (path,
    hash): relocated to the one file of equal content that no source has and whose extension the source's parser takes.

    ambiguous: there are several; contested: several sources would go to it; unsupported: content is found under other
    extensions alone; no_target: nowhere. Equal files are counted by content and extension, never paired with sources, so a
    content that a third of all files share costs no square. Null hashes and paths match nothing."""
    free = files.select("path", "hash").dropna().distinct().join(sources.select("path").dropna(), "path", "left_anti")
    free = free.groupBy("hash", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("extension")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("target"))
    gone = sources.filter("path IS NOT NULL").join(files.select("path").dropna(), "path", "left_anti").select("source_id", "hash", "parser")
    takes = F.create_map(*(x for p, e in supported.items() for x in (F.lit(p), F.array(*map(F.lit, e)))))
    wants = gone.select("source_id", "hash", F.explode(F.coalesce(takes[F.col("parser")], F.array().cast("array<string>"))).alias("extension"))
    fits = wants.join(free, ["hash", "extension"]).groupBy("source_id").agg(F.sum("n").alias("n"), F.min("target").alias("target"))
    rivals = fits.filter("n = 1").groupBy("target").agg(F.count(F.lit(1)).alias("rivals"))
    x = gone.join(fits, "source_id", "left").join(rivals, "target", "left").join(free.select("hash", F.lit(True).alias("known")).distinct(), "hash", "left")
    outcome = F.when((F.col("n") == 1) & (F.col("rivals") == 1), "relocated").when(F.col("n") == 1, "contested").when(F.col("n") > 1, "ambiguous").when(F.col("known"), "unsupported").otherwise("no_target")
    return x.select("source_id", outcome.alias("outcome"), F.when(outcome == "relocated", F.col("target")).alias("new_path"))
