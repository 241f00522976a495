"""From texts to evidence units, child chunks and parents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import stable_id, token_estimate, token_quarters

#: Tokens of a child chunk, the slack before it is flushed, tokens carried over; children of one parent.
TARGET, SLACK, OVERLAP, PARENT_CHILDREN = 300, 5, 80, 5

SPANS = "array<struct<unit:long,chunk_start:long,chunk_end:long,evidence_start:long,evidence_end:long>>"


def paragraphs(texts: DataFrame, lines_are_units: bool = False) -> DataFrame:
    """Units (source_id, position, first_line, last_line, text, text_hash) of texts (source_id, text).

    Runs of non-blank lines, trimmed and joined by spaces; with lines_are_units each non-blank line is one. Lines are
    numbered in their text, so no sort is needed before the run of a line is known."""
    lines = texts.select("source_id", F.posexplode(F.split("text", "\r?\n")).alias("line", "raw")).withColumn("raw", F.trim("raw"))
    w = Window.partitionBy("source_id").orderBy("line")
    if lines_are_units:
        units = lines.filter("raw <> ''").select("source_id", F.col("line").alias("first_line"), F.col("line").alias("last_line"), F.col("raw").alias("text"))
    else:
        run = F.sum((F.col("raw") == "").cast("int")).over(w)
        units = lines.withColumn("run", run).filter("raw <> ''").groupBy("source_id", "run").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.array_sort(F.collect_list(F.struct("line", "raw"))).alias("parts"))
        units = units.select("source_id", "first_line", "last_line", F.array_join(F.col("parts.raw"), " ").alias("text"))
    position = F.row_number().over(Window.partitionBy("source_id").orderBy("first_line")) - 1
    return units.select("source_id", position.alias("position"), (F.col("first_line") + 1).alias("first_line"), (F.col("last_line") + 1).alias("last_line"), "text", F.sha2("text", 256).alias("text_hash"))


def islands(units: DataFrame, key: str) -> DataFrame:
    """Adds `boundary`: consecutive units of a source with equal (also null) keys share a number from 0."""
    w = Window.partitionBy("source_id").orderBy("position")
    change = ~F.col(key).eqNullSafe(F.lag(key).over(w)) & (F.row_number().over(w) > 1)
    return units.withColumn("boundary", F.sum(change.cast("int")).over(w))


def quarter_tokens(text: str) -> int:
    """token_quarters of one text, for what a fold carries over."""
    quarters = run = 0
    for c in text:
        run = run + 1 if c.isascii() and c.isalnum() else 0
        quarters += 1 if 0 < run <= 24 else 4
    return quarters


def estimate(text: str) -> int:
    """token_estimate of one text."""
    return -(-quarter_tokens(text) // 4)


def overlap_start(text: str, budget: int) -> int:
    """Start of the longest suffix that costs at most budget tokens, counted from the end."""
    quarters = run = 0
    for i in range(len(text) - 1, -1, -1):
        run = run + 1 if text[i].isascii() and text[i].isalnum() else 0
        quarters += 1 if 0 < run <= 24 else 4
        if quarters > 4 * budget:
            return i + 1
    return 0


def cut_spans(spans: list[dict], start: int, end: int) -> list[dict]:
    """The parts of spans inside bytes start to end of their chunk, counted from start."""
    out = []
    for s in spans:
        lo, hi = max(s["chunk_start"], start), min(s["chunk_end"], end)
        if lo < hi:
            shift = s["evidence_start"] - s["chunk_start"]
            out.append({"unit": s["unit"], "chunk_start": lo - start, "chunk_end": hi - start, "evidence_start": lo + shift, "evidence_end": hi + shift})
    return out


def children(units: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Child chunks (source_id, boundary, child, text, first_unit, last_unit, spans, tokens) of units (source_id, boundary, position, text).

    Units are packed greedily within a boundary: a chunk is flushed before the unit that would take it over the
    target and a fifth, and the next one starts with its last `overlap` tokens. A unit is never split. Units' costs are
    summed as quarter tokens, which Spark counts, since a space ends every run; the fold runs over units sorted by place
    and holds the open chunk alone, so a boundary of any length streams through its task.

    `spans` says which bytes of the chunk are which bytes of which unit (by its position), in the chunk's order; what a
    chunk carries over keeps the units that it came from."""
    limit = 4 * (target + target // SLACK)
    names = ["source_id", "boundary", "child", "text", "first_unit", "last_unit", "spans"]
    span = pa.struct([("unit", pa.int64()), *((x, pa.int64()) for x in ("chunk_start", "chunk_end", "evidence_start", "evidence_end"))])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(span)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, child, text, cost, first, last, size, spans = None, 0, "", 0, None, None, 0, []
        for batch in batches:
            out = []
            for source, boundary, position, unit, quarters in zip(*(c.to_pylist() for c in batch.columns)):
                if (source, boundary) != key:
                    if text:
                        out.append((*key, child, text, first, last, spans))
                    key, child, text, cost, first, size, spans = (source, boundary), 0, "", 0, None, 0, []
                if text and cost + 4 + quarters > limit:
                    out.append((*key, child, text, first, last, spans))
                    tail = text[overlap_start(text, overlap) :]
                    carried = tail.strip()
                    lead = size - len(tail.encode()) + len(tail[: len(tail) - len(tail.lstrip())].encode())
                    size = len(carried.encode())
                    spans = cut_spans(spans, lead, lead + size)
                    child, text, cost, first = child + 1, carried, quarter_tokens(carried), None
                begin, n = (size + 1 if text else 0), len(unit.encode())
                spans.append({"unit": position, "chunk_start": begin, "chunk_end": begin + n, "evidence_start": 0, "evidence_end": n})
                text, cost, size = (f"{text} {unit}", cost + 4 + quarters, begin + n) if text else (unit, quarters, n)
                first, last = position if first is None else first, position
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 7, kinds)], names=names)
        if text:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*key, child, text, first, last, spans), kinds)], names=names)

    x = units.select(F.col("source_id").cast("long"), F.col("boundary").cast("long"), F.col("position").cast("long"), "text", token_quarters(F.col("text")).alias("quarters"))
    x = x.repartition("source_id", "boundary").sortWithinPartitions("source_id", "boundary", "position")
    out = x.mapInArrow(fold, f"source_id long, boundary long, child long, text string, first_unit long, last_unit long, spans {SPANS}")
    return out.withColumn("tokens", token_estimate(F.col("text"))).withColumn("chunk_id", stable_id("chunk", F.col("source_id"), F.col("boundary"), F.col("child"), F.sha2("text", 256)))


def parent_spans(chunks: DataFrame, size: int = PARENT_CHILDREN) -> DataFrame:
    """Spans of parents (source_id, boundary, parent, unit, byte ranges): those of their children, moved by the bytes of
    the children before and a space each."""
    x = chunks.withColumn("parent", F.floor(F.col("child") / size)).withColumn("n_bytes", F.octet_length("text") + 1)
    before = F.coalesce(F.sum("n_bytes").over(Window.partitionBy("source_id", "boundary", "parent").orderBy("child").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("before", before).select("source_id", "boundary", "parent", "before", F.explode("spans").alias("s"))
    return x.select("source_id", "boundary", "parent", F.col("s.unit").alias("unit"), *((F.col(f"s.chunk_{e}") + F.col("before")).alias(f"chunk_{e}") for e in ("start", "end")), "s.evidence_start", "s.evidence_end")


def mixed_children(units: DataFrame) -> DataFrame:
    """Child chunks of units (source_id, position, text, boundary, canonical, book, chapter), each unit by its locator:
    canonical ones go to `canonical_children`, all others (null too) to `children`; with `strategy` and `place`.

    `place` merges both lists of a source by their chunks' first unit. Where two begin alike, the strategy of the
    source's first unit comes first, then the child's number."""
    canonical = F.coalesce(F.col("canonical"), F.lit(False))
    columns = ["source_id", "boundary", "child", "text", "first_unit", "last_unit"]
    names = {True: "canonical", False: "generic"}
    one = canonical_children(units.filter(canonical)).select(*columns, F.lit(names[True]).alias("strategy"), F.col("first_unit").alias("least"))
    two = children(units.filter(~canonical)).select(*columns, F.lit(names[False]).alias("strategy"), F.coalesce(F.array_min(F.col("spans.unit")), F.col("first_unit")).alias("least"))
    leads = units.groupBy(F.col("source_id").cast("long").alias("source_id")).agg(F.min_by(F.when(canonical, names[True]).otherwise(names[False]), "position").alias("leads"))
    x = one.unionByName(two).join(leads, "source_id")
    w = Window.partitionBy("source_id").orderBy("least", (F.col("strategy") != F.col("leads")).cast("int"), "boundary", "child")
    chunk_id = stable_id("chunk", F.col("strategy"), F.col("source_id"), F.col("boundary"), F.col("child"), F.sha2("text", 256))
    return x.withColumn("place", F.row_number().over(w) - 1).withColumn("chunk_id", chunk_id).drop("leads")


def parents(chunks: DataFrame, size: int = PARENT_CHILDREN) -> DataFrame:
    """Parents of every `size` children of a boundary: their texts joined by spaces, their number and first and last units."""
    parts = F.array_sort(F.collect_list(F.struct("child", "text")))
    out = chunks.withColumn("parent", F.floor(F.col("child") / size)).groupBy("source_id", "boundary", "parent")
    return out.agg(F.array_join(parts["text"], " ").alias("text"), F.count(F.lit(1)).alias("n_children"), F.min("first_unit").alias("first_unit"), F.max("last_unit").alias("last_unit"))


def span_faults(spans: DataFrame, chunks: DataFrame, evidence: DataFrame) -> DataFrame:
    """Spans (chunk_id, evidence_id, chunk and evidence byte ranges, evidence_text_hash) that do not hold, with the first
    reason: missing_chunk, missing_evidence, bytes that differ or are out of range, hash (the evidence text has changed).

    Where spans and evidence have a locator it must be the same; where spans have a trust and evidence derived_from, it must
    be derived for evidence that was derived and else direct. Null texts and bounds resolve to nothing, and so are bytes."""
    c = chunks.select("chunk_id", F.encode("text", "UTF-8").alias("c"), F.lit(True).alias("has_chunk"))
    e = evidence.select("evidence_id", F.encode("text", "UTF-8").alias("e"), F.sha2("text", 256).alias("now"), F.lit(True).alias("has_evidence"), *(F.col(x).alias(f"e_{x}") for x in ("locator", "derived_from") if x in evidence.columns))
    known = ("chunk_id", "evidence_id", "chunk_start", "chunk_end", "evidence_start", "evidence_end", "evidence_text_hash", "locator", "trust")
    x = spans.select(*(k for k in known if k in spans.columns)).join(c, "chunk_id", "left").join(e, "evidence_id", "left")
    cut = lambda b, lo, hi: F.when((F.col(lo) >= 0) & (F.col(lo) <= F.col(hi)) & (F.col(hi) <= F.octet_length(b)), F.substring(F.col(b), F.col(lo) + 1, F.col(hi) - F.col(lo)))
    equal = F.coalesce(cut("c", "chunk_start", "chunk_end") == cut("e", "evidence_start", "evidence_end"), F.lit(False))
    reason = F.when(F.col("has_chunk").isNull(), "missing_chunk").when(F.col("has_evidence").isNull(), "missing_evidence").when(~equal, "bytes").when(~F.col("now").eqNullSafe(F.col("evidence_text_hash")), "hash")
    if "locator" in spans.columns and "e_locator" in x.columns:
        reason = reason.when(~F.col("locator").eqNullSafe(F.col("e_locator")), "locator")
    if "trust" in spans.columns and "e_derived_from" in x.columns:
        reason = reason.when(~F.col("trust").eqNullSafe(F.when(F.col("e_derived_from").isNull(), "direct").otherwise("derived")), "trust")
    return x.withColumn("reason", reason).filter("reason IS NOT NULL").select("chunk_id", "evidence_id", "reason")


def cache_plan(inputs: DataFrame, cache: DataFrame) -> DataFrame:
    """Embedding work: each input hash once, with whether the cache (input_hash) has it and how many inputs share it."""
    once = inputs.groupBy("input_hash").agg(F.count(F.lit(1)).alias("inputs"))
    return once.join(cache.select("input_hash", F.lit(True).alias("hit")).distinct(), "input_hash", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def is_noop(prepared: DataFrame, stored: DataFrame) -> DataFrame:
    """Per source: whether nothing has to be written, as hash and parser are as stored and all vectors are there."""
    s = stored.select("source_id", F.col("hash").alias("_hash"), F.col("parser").alias("_parser"), "n_children", "n_vectors")
    same = F.col("hash").eqNullSafe(F.col("_hash")) & F.col("parser").eqNullSafe(F.col("_parser")) & F.coalesce(F.col("n_children") == F.col("n_vectors"), F.lit(False))
    return prepared.join(s, "source_id", "left").select("source_id", same.alias("noop"))


def canonical_children(units: DataFrame, target: int = TARGET, overlap: int = 2, most: int = 20) -> DataFrame:
    """Child chunks (source_id, boundary, child, text, first_unit, last_unit, n_units) of whole canonical units
    (source_id, position, book, chapter, text).

    No chunk crosses a book, and a unit without one stands alone. Units of a chapter are packed up to the target and
    a fifth, or `most` units, and the next chunk repeats the last `overlap`. Nothing is repeated across a chapter, nor
    where a run of units has `most` of them or twice the target. Costs are summed as quarter tokens, and the fold
    holds the open chunk alone, as in `children`; the window that finds the books has dealt and sorted the units already."""
    w = Window.partitionBy("source_id").orderBy("position")
    limit = 4 * (target + target // SLACK)
    book = F.col("book").isNull() | ~F.col("book").eqNullSafe(F.lag("book").over(w))
    x = units.withColumns({c: F.col(c).cast("long") for c in ("source_id", "position")}).withColumn("boundary", F.sum(book.cast("int")).over(w).cast("long"))
    x = x.select("source_id", "boundary", "position", F.col("chapter").cast("string"), "text", token_quarters(F.col("text")).alias("quarters"))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = ["source_id", "boundary", "child", "text", "first_unit", "last_unit", "n_units"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, before, child, now, run, spent = None, None, 0, [], 0, 0  # now: (position, text, quarters) of the open chunk

        def flushed() -> tuple:
            return (*key, child, " ".join(t for _, t, _ in now if t), now[0][0], now[-1][0], len(now))

        def over(unit: tuple) -> bool:
            costs = [q for _, t, q in (*now, unit) if t]
            return sum(costs) + 4 * max(0, len(costs) - 1) > limit

        for batch in batches:
            out = []
            for source, boundary, position, chapter, text, quarters in zip(*(c.to_pylist() for c in batch.columns)):
                unit, cost = (position, text, quarters), -(-quarters // 4)
                if (source, boundary) != key:
                    if now:
                        out.append(flushed())
                    key, before, child, now, run, spent = (source, boundary), None, 0, [], 0, 0
                if run and ((before is not None and chapter != before) or run >= most or spent + cost > 2 * target):
                    out.append(flushed())
                    child, now, run, spent = child + 1, [], 0, 0
                elif now and (len(now) >= most or over(unit)):
                    out.append(flushed())
                    child, now = child + 1, now[max(1, len(now) - overlap) :] if overlap else []
                now = [*now, unit]
                before, run, spent = chapter, run + 1, spent + cost
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 7, kinds)], names=names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(flushed(), kinds)], names=names)

    x = x.sortWithinPartitions("source_id", "boundary", "position")
    return x.mapInArrow(fold, "source_id long, boundary long, child long, text string, first_unit long, last_unit long, n_units long")
