"""Filters that hold before ranking: scopes, typed predicates, tombstones, evidence kinds."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Authorized rows up to which an exact scan, and a planner's choice, are made.
EXACT_LIMIT, PLANNER_LIMIT = 1024, 8192
MOST_PREDICATES = 16
#: Evidence kinds that an answer may rest on.
SOURCE_KINDS = ("Text", "Image")


def in_scope(rows: DataFrame, scope: DataFrame, key: str = "source") -> DataFrame:
    """Rows whose key the scope names; an empty scope leaves none."""
    return rows.join(scope.select(key).distinct(), key, "left_semi")


def collection_scope(members: DataFrame, collections: list[str], explicit: DataFrame | None = None, default: list[str] | None = None) -> DataFrame:
    """Sources of the named collections; the defaults only where nothing is named explicitly."""
    if explicit is not None:
        return explicit
    return members.filter(F.col("collection").isin(*(collections or default or []))).select("source").distinct()


def source_bounded(chunks: DataFrame, evidence: DataFrame, kinds: tuple[str, ...] = SOURCE_KINDS) -> DataFrame:
    """Chunks with evidence, all of it of the allowed kinds; a missing evidence row counts as not allowed."""
    good = evidence.groupBy("chunk_id").agg(F.bool_and(F.coalesce(F.col("kind").isin(*kinds), F.lit(False))).alias("good")).filter("good")
    return chunks.join(good.select("chunk_id"), "chunk_id", "left_semi")


def without_tombstones(rows: DataFrame, tombstones: DataFrame, generation: int) -> DataFrame:
    """Rows (id, version) that no tombstone up to the generation, of their version or later, marks."""
    t = tombstones.filter(F.col("generation") <= generation).groupBy("id").agg(F.max("version").alias("_version"))
    return rows.join(t, (rows["id"] == t["id"]) & (t["_version"] >= rows["version"]), "left_anti")


def selectivity(count: Column, exact: int = EXACT_LIMIT, planner: int = PLANNER_LIMIT) -> Column:
    """The candidate path for so many authorized rows."""
    return F.when(count == 0, "zero").when(count <= exact, "exact_scan").when(count <= planner, "planner_selected").otherwise("predicate_aware_ann")


@dataclass(frozen=True)
class Predicate:
    """One of: source, collection, tenant, lifecycle (any of values), acl_allow, acl_deny, dates (inclusive), metadata equality."""

    kind: str
    values: tuple = ()
    key: str = ""

    def column(self) -> Column:
        if self.kind in ("source", "collection", "tenant", "lifecycle", "language"):
            return F.col(self.kind).isin(*self.values) if self.values else F.lit(False)
        if self.kind == "acl_allow":
            return F.arrays_overlap("acl", F.array(*map(F.lit, self.values)))
        if self.kind == "acl_deny":
            return ~F.coalesce(F.arrays_overlap("acl", F.array(*map(F.lit, self.values))), F.lit(False))
        if self.kind == "dates":
            low, high = self.values
            if not isinstance(low, date) or low > high:
                raise ValueError("dates need a first day that is not after the last")
            return F.to_date("date").between(F.lit(low), F.lit(high))
        if self.kind == "metadata":
            return F.col("metadata").getItem(self.key) == F.lit(self.values[0])
        raise ValueError(f"unknown predicate {self.kind}")


def compiled(predicates: list[Predicate]) -> Column:
    """All predicates at once, 1 to MOST_PREDICATES; what is null does not pass."""
    if not 1 <= len(predicates) <= MOST_PREDICATES:
        raise ValueError(f"1 to {MOST_PREDICATES} predicates")
    return F.coalesce(reduce(lambda a, b: a & b, (p.column() for p in predicates)), F.lit(False))
