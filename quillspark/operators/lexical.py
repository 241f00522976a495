"""BM25 top-k of many queries at once, and clauses of phrases, required, excluded and field terms, over postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import terms
from quillspark.storage import remove, written

K1, B = 1.2, 0.75
#: A query's best terms are scored first, until they have so many postings for each row that is asked for.
FIRST = 8
#: Up to so many postings of all questions together, each is scored: that is less than what pruning costs in jobs.
PRUNE_FROM = 100_000_000
#: What rounding to six places and the order of sums may add to a score.
SLACK = 2e-6


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term), each once, of queries (query_id, text)."""
    return queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))


def _idf(n: Column, df: Column) -> Column:
    return F.greatest(F.ln((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))


def _saturated(tf: Column, length: Column, mean_length: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


def weighted_terms(postings: DataFrame, lengths: DataFrame, q: DataFrame, scope: list[str] | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, chunk_id, term, weight) of postings (chunk_id, length, term, tf and the scope columns) of the terms q
    (query_id, term). Numbers of chunks and mean lengths are taken over `lengths` (length and the scope columns), one row
    a chunk, or within each value of scope.

    What is known of a term is a table with a row for each term, scope and query, so that Spark sees how small it is and
    need not deal postings by scope or term, of which few may hold them all."""
    scope = scope or []
    stats = lengths.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length"))
    df = postings.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))
    asked = df.join(stats, scope) if scope else df.crossJoin(F.broadcast(stats))  # stats is one row
    asked, _ = written(asked.join(q, "term").select(*scope, "term", "query_id", _idf(F.col("n"), F.col("df")).alias("idf"), "mean_length"), "asked")
    weight = F.col("idf") * _saturated(F.col("tf"), F.col("length"), F.col("mean_length"), k1, b)
    return postings.join(asked, [*scope, "term"]).select("query_id", "chunk_id", "term", weight.alias("weight"))


def _by_chunk(postings: DataFrame) -> DataFrame:
    """Postings dealt by chunk: after joins with small tables, sums by query and chunk need no other shuffle, so a posting
    is dealt once and not for each query that asks its term."""
    return postings.repartition("chunk_id")


def ranked(scores: DataFrame, k: int, score: Column | str = "score") -> DataFrame:
    """The k best rows of each query by score rounded to six places, ties to smaller chunk ids, with their rank."""
    x = scores.withColumn("score", F.round(F.col(score) if isinstance(score, str) else score, 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return x.withColumn("rank", rank).filter(F.col("rank") <= k)


def _summed(weights: DataFrame, k: int) -> DataFrame:
    return ranked(weights.groupBy("query_id", "chunk_id").agg(F.sum("weight").alias("score")), k)


def _scan(docs: DataFrame, name: str, wanted: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """Postings of the wanted terms and lengths of a text column, without an index: texts are cut into terms once, and
    rows are made of distinct terms, not of tokens."""
    from quillspark.operators.postings import counted

    keys = F.struct(*(scope or ["chunk_id"]))
    p = counted(docs.select("chunk_id", keys.alias("source_id"), F.col(name).alias("text")), ["text"]).join(wanted, "term", "left_semi")
    lengths = docs.select(*scope, F.coalesce(F.size(terms(F.col(name))), F.lit(0)).alias("length"))
    return p.select("chunk_id", *(F.col(f"source_id.{s}").alias(s) for s in scope), "length", "term", "tf"), lengths


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int, scope: list[str] | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, chunk_id, score and rank over docs (chunk_id, text and the scope columns) that no index holds. For a scope
    filter, filter docs before."""
    q = query_terms(queries)
    p, lengths = _scan(docs, "text", q.select("term").distinct(), scope or [])
    return _summed(weighted_terms(p, lengths, q, scope, k1, b), k)


def _held(index, wanted: DataFrame, name: str, scope: list[str], within: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    p, docs = _by_chunk(index.postings(wanted, [name]).select("chunk_id", "source_id", "length", "term", "tf")), index.docs()
    if within is not None:
        p, docs = (x.join(within.select("chunk_id"), "chunk_id", "left_semi") for x in (p, docs))
    if scope and scope != ["source_id"]:
        p = p.join(docs.select("chunk_id", *scope), "chunk_id")
    return p.select("chunk_id", *scope, "length", "term", "tf"), docs.select(*scope, F.col(f"length_{name}").alias("length"))


def index_top_k(index, queries: DataFrame, k: int, scope: list[str] | None = None, within: DataFrame | None = None, fields: dict[str, float] | None = None, k1: float = K1, b: float = B, prune_from: int = PRUNE_FROM) -> DataFrame:
    """query_id, chunk_id, score and rank from an index's postings of the queries' terms alone.

    `within` (chunk_id) holds before anything is counted; `scope` names kept columns within whose values chunks are
    counted; `fields` are summed by their weights, which are not negative. Without within and scope, postings that cannot
    change the result are left out (`pruned_top_k`)."""
    fields = fields or {"text": 1.0}
    if within is None and not scope:
        return pruned_top_k(index, queries, k, fields, k1, b, prune_from)
    q, parts = query_terms(queries), None
    wanted = q.select("term").distinct()
    for name, boost in fields.items():
        p, lengths = _held(index, wanted, name, scope or [], within)
        one = weighted_terms(p, lengths, q, scope, k1, b).select("query_id", "chunk_id", (F.col("weight") * boost).alias("weight"))
        parts = one if parts is None else parts.unionByName(one)
    return _summed(parts, k)


def _field_stats(index, fields) -> DataFrame:
    out = None
    for name in fields:
        one = index.lengths(name).agg(F.lit(name).alias("field"), F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length"))
        out = one if out is None else out.unionByName(one)
    return out


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, least): the k-th best score of each query that has so many; scores are (query_id, chunk_id, score)."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))


def pruned_top_k(index, queries: DataFrame, k: int, fields: dict[str, float], k1: float = K1, b: float = B, prune_from: int = PRUNE_FROM) -> DataFrame:
    """`index_top_k` over all chunks, with the same rows and scores, without a row for each posting of each query.

    The most that a term can add is known from its blocks. A query's terms are ranked by it; the first ones are scored and
    give a score that k chunks reach. Only terms that are not in the tail whose sum stays below it find candidates, and only
    in blocks that could reach it with all other terms; the tail, where the frequent words are, is scored for the candidates
    that can still reach the k-th best of them. So a word that every chunk holds costs rows for candidates, not for all
    chunks times all queries that ask it. Queries that fewer than k chunks answer take every posting, and so do all where there are
    no more than `prune_from`."""
    session = queries.sparkSession
    boosts = F.create_map(*(F.lit(x) for pair in fields.items() for x in pair))
    q = query_terms(queries).select("query_id", "term", F.explode(boosts).alias("field", "boost"))
    blocks, b_path = written(index.blocks(q, list(fields)).join(F.broadcast(_field_stats(index, fields)), "field").withColumn("idf", _idf(F.col("n"), F.col("df"))), "blocks")
    most = F.col("idf") * _saturated(F.col("tf"), F.col("length"), F.col("mean_length"), k1, b)
    blocks = blocks.select("field", "term", "block", "df", "idf", "mean_length", most.alias("most"))
    best = blocks.groupBy("field", "term").agg(F.first("df").alias("df"), F.first("idf").alias("idf"), F.first("mean_length").alias("mean_length"), F.max("most").alias("most"))
    x = q.join(best, ["field", "term"]).withColumn("idf", F.col("idf") * F.col("boost")).withColumn("most", F.col("most") * F.col("boost"))
    w = Window.partitionBy("query_id").orderBy(F.desc("most"), "field", "term")
    x = x.withColumn("before", F.coalesce(F.sum("df").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("tail", F.sum("most").over(w.rowsBetween(0, Window.unboundedFollowing))).withColumn("whole", F.sum("most").over(Window.partitionBy("query_id")))
    x, x_path = written(x, "asked")  # one row for each term of each query

    def weights(asked: DataFrame, on: list[str]) -> DataFrame:
        p = _by_chunk(index.postings(asked, list(fields)).select("field", "term", "block", "chunk_id", "length", "tf"))
        return p.join(asked, on).select("query_id", "chunk_id", (F.col("idf") * _saturated(F.col("tf"), F.col("length"), F.col("mean_length"), k1, b)).alias("weight"))

    def sums(rows: DataFrame) -> DataFrame:
        return rows.groupBy("query_id", "chunk_id").agg(F.sum("weight").alias("score"))

    if (x.agg(F.sum("df")).first()[0] or 0) <= prune_from:
        out, _ = written(ranked(sums(weights(x.select("query_id", "field", "term", "idf", "mean_length"), ["field", "term"])), k), "best")
        remove(session, b_path, x_path)
        return out
    first = x.filter(F.col("before") < FIRST * k)
    least, l_path = written(_kth(sums(weights(first, ["field", "term"])), k), "least")
    x = x.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - SLACK)
    finding = x.filter("tail >= least")
    reach = finding.join(blocks.select("field", "term", "block", F.col("most").alias("in_block")), ["field", "term"])
    reach = reach.filter("whole - most + in_block * boost >= least").select("query_id", "field", "term", "block", "idf", "mean_length")
    found, f_path = written(sums(weights(reach, ["field", "term", "block"])), "found")
    ends = x.groupBy("query_id").agg(F.max("least").alias("least"), F.coalesce(F.sum(F.when(F.col("tail") < F.col("least"), F.col("most"))), F.lit(0.0)).alias("rest"))
    ends = ends.join(_kth(found, k).withColumnRenamed("least", "later"), "query_id", "left").withColumn("least", F.greatest("least", F.col("later") - SLACK))
    held, h_path = written(found.join(ends, "query_id").filter("score + rest >= least").select("query_id", "chunk_id", "score"), "held")
    tail = x.filter("tail < least").select("query_id", "field", "term", "idf", "mean_length")
    p = index.postings(tail, list(fields)).select("field", "term", "chunk_id", "length", "tf")
    more = p.join(held.select("query_id", "chunk_id"), "chunk_id").join(tail, ["query_id", "field", "term"])
    more = more.select("query_id", "chunk_id", (F.col("idf") * _saturated(F.col("tf"), F.col("length"), F.col("mean_length"), k1, b)).alias("weight"))
    out, _ = written(ranked(sums(held.withColumnRenamed("score", "weight").unionByName(more)), k), "best")
    remove(session, b_path, x_path, l_path, f_path, h_path)
    return out


def clauses(queries: DataFrame, fields: list[str]) -> DataFrame:
    """(query_id, clause, sign, field, terms) of queries (query_id, text) in the usual syntax: words and "phrases", before
    them + (required) or - (excluded), and a field's name and a colon; without a field, a clause is one for each.

    The clause is its place in the query. A word with marks inside is a phrase of its parts; clauses without letters or
    digits are none."""
    pattern = r'([+-]?)(?:(\w+):)?("[^"]*"|[^\s"]+)'
    found = queries.select("query_id", F.posexplode(F.regexp_extract_all("text", F.lit(r'[+-]?(?:\w+:)?(?:"[^"]*"|[^\s"]+)'), F.lit(0))).alias("clause", "raw"))
    part = lambda i: F.regexp_extract("raw", pattern, i)
    known = part(2).isin(*fields)
    # a word before a colon that names no field belongs to the clause
    body = F.when(known | (part(2) == ""), part(3)).otherwise(F.concat_ws(" ", part(2), part(3)))
    x = found.select("query_id", "clause", part(1).alias("sign"), F.when(known, F.array(part(2))).otherwise(F.array(*map(F.lit, fields))).alias("f"), terms(body).alias("terms"))
    return x.filter(F.size("terms") > 0).select("query_id", "clause", "sign", F.explode("f").alias("field"), "terms")


def boolean_top_k(index, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, chunk_id, score and rank of queries in the syntax of `clauses`.

    A phrase holds where its terms stand side by side in one field, as often as they do; its idf is the sum of its
    terms'. A chunk must hold every required clause and no excluded one in any of the clause's fields, and some clause
    that is not excluded; these are summed."""
    c = clauses(queries, index.fields).withColumn("phrase", F.concat_ws(" ", "terms"))
    words = c.select("query_id", "clause", "sign", "field", "phrase", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("offset", "term"))
    # the number of partitions is set, as each posting meets all queries that ask it and Spark would deal by the postings' size
    partitions = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = index.postings(words.select("term"), index.fields).select("field", "term", "chunk_id", "length", "positions").repartition(partitions, "chunk_id")
    needed = c.filter("sign = '+'").groupBy("query_id").agg(F.countDistinct("clause").alias("needed"))
    known = words.join(index.frequencies(words.select("term"), index.fields), ["field", "term"]).join(_field_stats(index, index.fields), "field")
    known, known_path = written(known.withColumn("idf", _idf(F.col("n"), F.col("df"))), "known")
    # what each query asks: small tables, so that Spark sees how small they are
    asked = known.groupBy("query_id", "clause", "sign", "field", "phrase").agg(F.sum("idf").alias("idf"), F.first("mean_length").alias("mean_length"), F.count(F.lit(1)).alias("held"), F.first("n_terms").alias("n_terms"))
    asked = asked.filter("held = n_terms").join(needed, "query_id", "left")
    asked, _ = written(asked.select("query_id", "clause", (F.col("sign") == "+").alias("required"), (F.col("sign") == "-").alias("excluded"), F.coalesce("needed", F.lit(0)).alias("needed"), "field", "phrase", "idf", "mean_length"), "asked")
    units, _ = written(known.select("field", "phrase", "n_terms", "offset", "term").distinct(), "units")
    remove(queries.sparkSession, known_path)
    # a word or phrase is looked for once, however many queries ask it; a word's places are not gathered
    one = p.join(units.filter("n_terms = 1").drop("n_terms", "offset"), ["field", "term"]).select("field", "phrase", "chunk_id", "length", F.size("positions").alias("tf"))
    starts = F.transform("positions", lambda x: x - F.col("offset"))
    more = p.join(units.filter("n_terms > 1"), ["field", "term"]).select("field", "phrase", "chunk_id", "n_terms", "length", starts.alias("starts"))
    more = more.groupBy("field", "phrase", "chunk_id").agg(F.first("n_terms").alias("n_terms"), F.first("length").alias("length"), F.collect_list("starts").alias("starts")).filter(F.size("starts") == F.col("n_terms"))
    more = more.withColumn("tf", F.size(F.aggregate(F.slice("starts", 2, F.size("starts")), F.col("starts")[0], F.array_intersect))).filter("tf > 0")
    x = one.unionByName(more.select(*one.columns)).join(asked, ["field", "phrase"])
    x = x.select("query_id", "clause", "required", "excluded", "needed", "chunk_id", (F.col("idf") * _saturated(F.col("tf"), F.col("length"), F.col("mean_length"), k1, b)).alias("weight"))
    held = x.groupBy("query_id", "clause", "chunk_id").agg(F.max("required").alias("required"), F.max("excluded").alias("excluded"), F.max("needed").alias("needed"), F.sum("weight").alias("weight"))
    sums = held.groupBy("query_id", "chunk_id").agg(
        F.sum(F.when(~F.col("excluded"), F.col("weight"))).alias("score"), F.count_if("required").alias("held"), F.max("excluded").alias("excluded"), F.max("needed").alias("needed"))
    sums = sums.filter("NOT excluded AND score IS NOT NULL AND held = needed")
    return ranked(sums.select("query_id", "chunk_id", "score"), k)
