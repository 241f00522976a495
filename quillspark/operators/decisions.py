"""Decisions as columns: overfetch, compaction, recovery, claims, request keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Growth and bounds of overfetch; thresholds of compaction signals.
OVERFETCH_FACTOR, OVERFETCH_MOST, OVERFETCH_ATTEMPTS = 2, 256, 9
COMPACTION = {"tombstone_ratio": 0.2, "delta_rows": 100_000, "segments": 32, "age_hours": 24.0}
#: Which completeness claims a kind of retriever may make.
CLAIMS = {"top_k": ("TopK", "Approximate"), "approximate": ("Approximate",), "exhaustive": ("TopK", "Approximate", "All", "Only", "None", "Every")}


def overfetch(k: Column, attempt: Column, corpus: Column) -> Column:
    """Candidates to ask for at an attempt (from 0): doubled each time, bounded, at most the corpus; null when it must give up."""
    want = F.least(k * F.pow(F.lit(OVERFETCH_FACTOR), attempt).cast("long"), F.greatest(k, F.lit(OVERFETCH_MOST)), corpus)
    return F.when(attempt < OVERFETCH_ATTEMPTS, want)


def compaction_due(**signals: Column) -> Column:
    """Whether any of the signals reaches its threshold; a null signal does not."""
    due = F.lit(False)
    for name, value in signals.items():
        due = due | F.coalesce(value >= COMPACTION[name], F.lit(False))
    return due


def recovery(staged: Column, validated: Column, published: Column) -> Column:
    """What to do with a generation that a crash interrupted."""
    return F.when(published, "keep").when(validated, "publish").when(staged, "discard").otherwise("nothing")


def may_claim(retriever: Column, claim: Column) -> Column:
    out = F.lit(False)
    for kind, claims in CLAIMS.items():
        out = out | ((retriever == kind) & claim.isin(*claims))
    return F.coalesce(out, F.lit(False))


def request_states(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Requests (request_id, key, fingerprint) as fresh, replay, in_progress or conflict; known: key, fingerprint, finished, once a key."""
    k = known.select("key", F.col("fingerprint").alias("seen"), "finished")
    state = F.when(F.col("seen").isNull(), "fresh").when(F.col("seen") != F.col("fingerprint"), "conflict").when(F.col("finished"), "replay").otherwise("in_progress")
    return requests.join(k, "key", "left").select("request_id", state.alias("state"))


#: Clauses of one plan over named vector spaces; the operation that takes many vectors a query.
MOST_CLAUSES, LATE = 64, "late_interaction_max_sim"


def plan_faults(clauses: DataFrame, spaces: DataFrame) -> DataFrame:
    """plan_id, n_clauses and fault of each plan of clauses (plan_id, position, space, operation, dimension, late) over
    spaces (space, dimension, operations).

    A plan with a space asked twice, or with too many clauses, is an invalid query plan; else the first clause that
    does not fit its space gives the fault, which is null where all fit."""
    s = spaces.select("space", F.col("dimension").alias("native"), F.col("operations").alias("offered"))
    shape = F.col("dimension").eqNullSafe(F.col("native")) & F.col("late").eqNullSafe(F.col("operation") == LATE)
    fault = F.when(F.col("offered").isNull(), "missing_vector_space").when(~F.coalesce(F.array_contains("offered", F.col("operation")), F.lit(False)), "unsupported_query_operation").when(~shape, "incompatible_query_shape")
    x = clauses.join(s, "space", "left").withColumn("fault", fault)
    n, first = F.count(F.lit(1)), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("position")))
    x = x.groupBy("plan_id").agg(n.alias("n_clauses"), F.count_distinct("space").alias("n_spaces"), first.alias("fault"))
    broken = (F.col("n_clauses") > MOST_CLAUSES) | (F.col("n_spaces") < F.col("n_clauses"))
    return x.select("plan_id", "n_clauses", F.when(broken, "invalid_query_plan").otherwise(F.col("fault")).alias("fault"))


#: The dimensions of the query matrix.
MATRIX = {
    "query_class": ("semantic", "lexical", "exact_identifier_reference", "phrase", "multilingual", "mixed_language", "multi_hop"),
    "selectivity": ("full_100", "ten_percent", "one_percent", "point_one_percent", "point_zero_one_percent", "single_source_document", "zero_authorized"),
    "concurrency": ("one", "eight", "thirty_two", "saturation"),
    "cache_state": ("cold", "warm", "cache_churn"),
    "update_state": ("read_only", "mixed_updates", "source_replacement", "delete_heavy", "compaction"),
}


def matrix_coverage(runs: DataFrame) -> DataFrame:
    """Every cell of the query matrix with its number of runs (0 where none), and whether a suite must have measured it."""
    cells = runs.sparkSession.range(1).select()
    for name, values in MATRIX.items():
        cells = cells.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    n = runs.groupBy(*MATRIX).agg(F.count(F.lit(1)).alias("runs"))
    return cells.join(n, list(MATRIX), "left").withColumn("runs", F.coalesce("runs", F.lit(0))).withColumn("required", F.col("cache_state").isin("cold", "warm"))
