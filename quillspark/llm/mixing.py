"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, written

#: Lowest quality weight of a document; the highest is 1.
LEAST_WEIGHT = 0.25


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """LEAST_WEIGHT to 1: the share of characters that are not symbols of markup or tables."""
    plain = F.length(F.regexp_replace(text, "[#*$%&|<>]", "")).cast("double")
    return LEAST_WEIGHT + (1 - LEAST_WEIGHT) * F.coalesce(plain / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def sampling_key(doc_id: Column, weight: Column) -> Column:
    """Exponential key -ln(u) / weight, with u in (0, 1) from 48 bits of a digest of the id: reruns agree."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 12), 16, 10).cast("double")
    return -F.ln((bits + 1.0) / float((1 << 48) + 1)) / weight


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    """sizes (source, source_size; one row each) with `target`: share of all words dealt by weight, at most `most` times a source's size.

    Water filling: what saturated sources cannot take is reshared among the others by weight until none is above its
    limit. Every round is an aggregate of one row over the table of sources; only those sums reach the driver."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked, _ = written(sizes.withColumn("weight", weight), "sources")
    limit = F.col("source_size") * most
    level = None
    while True:
        full = F.lit(False) if level is None else limit < F.col("weight") * level
        row = ranked.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, limit)).alias("full"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
        ).first()
        total = (row["all"] or 0) * share
        left = total - (row["full"] or 0)
        new = left / row["open"] if row["open"] else None
        if new is None or new == level:
            break
        level = new
    target = F.when(F.col("weight") * F.lit(level or 0.0) > limit, limit.cast("double")).otherwise(F.col("weight") * F.lit(level or 0.0))
    return ranked.withColumn("target", target).drop("weight")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: int = 3, rows_a_bucket: int = 4096) -> DataFrame:
    """Words that the mix takes from each document.

    Takes columns doc_id, text, source; returns doc_id, size, source_size, target, taken, source and digest (of the text). Sources in code-point order,
    null last, weigh `weights` in turn. A source's target first covers complete epochs (all its documents, whole);
    the rest is taken in the order of the Efraimidis-Spirakis keys, the document at the budget's edge in part, so
    that each source's taken words are its target rounded to a word.

    The order within a source is prefix-summed in two steps, so that no task holds a whole source: keys fall into
    buckets that follow the order, buckets of a source are summed and prefix-summed as one row each, and rows only
    within their bucket. Nulls: a null text has size 0, null sources form one source, null ids share a key. Equal ids
    are told apart by size and a digest of the text; rows equal in all of these are interchangeable. Empty texts
    take 0. An empty table gives no rows. Other columns are ignored."""
    d = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), sampling_key(F.col("doc_id"), quality_weight(F.col("text"))).alias("key"), F.coalesce(F.md5(F.col("text")), F.lit("")).alias("digest"))
    # a null source is a source too: keys of joins and windows are never null
    d, _ = written(d.withColumn("s", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))), "mix")
    sizes, _ = written(d.groupBy("s", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sizes")
    largest = sizes.agg(F.max("n")).first()[0] or 0
    buckets = max(512, largest // rows_a_bucket)
    targets = source_targets(sizes, weights, share, most)
    # exp(-key * LEAST_WEIGHT) is uniform for the lowest weight and at most 1 / LEAST_WEIGHT times as dense for others
    d = d.withColumn("bucket", F.floor((1 - F.exp(-F.col("key") * LEAST_WEIGHT)) * buckets))
    sums = d.groupBy("s", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = F.sum("bucket_size").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("s", "bucket", F.coalesce(before, F.lit(0)).alias("before")).join(targets.select("s", "source_size", "target"), "s")
    within = F.sum("size").over(Window.partitionBy("s", "bucket").orderBy("key", F.col("doc_id").asc_nulls_first(), "size", "digest").rowsBetween(Window.unboundedPreceding, -1))
    x = d.withColumn("within", F.coalesce(within, F.lit(0))).join(sums, ["s", "bucket"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.round("target").cast("long") - F.col("epochs") * F.col("source_size")
    x = x.withColumn("epochs", epochs)
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left - F.col("before") - F.col("within")))
    return x.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"), "source", "digest")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows that the mix takes, with all columns of docs: whole documents as often as they are taken, and of the one
    at a source's edge the first words. Rows equal in id and text (null ids and texts are equal) are taken together; n_chars, if there,
    follows the text. Null and empty texts are never taken, and an empty table gives no rows; other columns keep their values."""
    plan = mix(docs, **how).filter("taken > 0").groupBy("doc_id", "digest").agg(F.sum("taken").alias("taken"), F.max("size").alias("size"))
    plan = plan.withColumnsRenamed({"doc_id": "plan_id", "digest": "plan_digest"})
    names = docs.columns
    one = docs.select(F.struct(*names).alias("row"), F.col("doc_id"), F.coalesce(F.md5("text"), F.lit("")).alias("digest")).dropDuplicates(["doc_id", "digest"])
    x = one.join(plan, F.col("doc_id").eqNullSafe(F.col("plan_id")) & (F.col("digest") == F.col("plan_digest"))).select("row", "taken", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(WORD)
        for batch in batches:
            columns, place = batch.column("row").flatten(), names.index("text")
            texts, taken, size = columns[place].to_pylist(), batch.column("taken").to_pylist(), batch.column("size").to_pylist()
            rows, out = [], []
            for i, t in enumerate(texts):
                whole, part = divmod(taken[i], size[i])
                rows += [i] * whole
                out += [t] * whole
                if part:
                    rows.append(i)
                    out.append(t[: next(islice(word.finditer(t), part - 1, None)).end()])
            rows = pa.array(rows, pa.int64())
            columns = [pa.array(out, pa.string()) if k == place else c.take(rows) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = x.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in names else out


#: The same in DuckDB, for the default arguments.
MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 1.0) / 281474976710657.0)
      / (0.25 + 0.75 * coalesce(length(regexp_replace(text, '[#*$%&|<>]', '', 'g'))::DOUBLE / nullif(length(text), 0), 0.0)) AS key,
    coalesce(md5(text), '') AS digest
  FROM {documents}),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 3 * source_size / w AS r, sum(source_size) OVER ()::BIGINT AS total,
    coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_before,
    sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM s),
l AS (SELECT coalesce(max((total - full_before) / open_w) FILTER (WHERE (total - full_before) / open_w <= r), max(r)) AS level FROM o),
t AS (
  SELECT source, source_size, CASE WHEN w * level > 3 * source_size THEN (3 * source_size)::DOUBLE ELSE w * level END AS target
  FROM s, l),
x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.source,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size, d.digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, round(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken, source
FROM x
"""
