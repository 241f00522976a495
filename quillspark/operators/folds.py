"""States folded from event logs by composing transitions, and deletions under retention and holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Events of one block, and blocks of one group; both are scanned as arrays.
BLOCK, FAN = 512, 512


def _scanned(items: Column, start: Column, step) -> Column:
    """The state before each item, and the state after all."""
    first = F.struct(start.cast("int").alias("state"), F.array().cast("array<int>").alias("before"))
    return F.aggregate(items, first, lambda a, x: F.struct(step(a["state"], x).cast("int").alias("state"), F.concat(a["before"], F.array(a["state"])).alias("before")))


def _before(maps: DataFrame, start: int) -> DataFrame:
    """(id, block, state) of maps (id, block, map): the state in which each block of an id begins."""
    ordered = F.array_sort(F.collect_list(F.struct("block", "map")))
    most = maps.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= FAN:
        groups = maps.groupBy("id").agg(ordered.alias("items")).withColumn("state", F.lit(start))
    else:
        x = maps.withColumn("group", F.floor(F.col("block") / FAN).cast("long")).groupBy("id", "group").agg(ordered.alias("items"))
        whole = F.aggregate(F.slice("items", 2, F.size("items")), F.col("items")[0]["map"], lambda a, x: F.transform(a, lambda s: x["map"][s]))
        above = _before(x.select("id", F.col("group").alias("block"), whole.alias("map")), start)
        groups = x.join(above.withColumnRenamed("block", "group"), ["id", "group"])
    scanned = groups.select("id", "items", _scanned(F.col("items"), F.col("state"), lambda s, x: x["map"][s])["before"].alias("before"))
    return scanned.select("id", F.explode(F.arrays_zip(F.col("items.block").alias("block"), F.col("before").alias("state"))).alias("x")).select("id", "x.block", "x.state")


def folded(events: DataFrame, transitions: dict[tuple[str, str], str], start: str) -> DataFrame:
    """id, seq, event, before, after and legal of every event of events (id, seq, event).

    Each id begins in the state `start` and takes its events in the order of seq, which is unique to an id and not
    negative. An event that the table has no transition for, or that is null, is illegal: it is named and changes nothing.

    A block of BLOCK numbers of seq is a map from states to states, and maps compose: first each block on its own, then
    blocks in groups of FAN, then groups, until an id has few; the states in which blocks begin come back the
    same way. So no task holds all events of an id."""
    states = [start, *sorted({s for s, _ in transitions} | set(transitions.values()) - {start})]
    states = list(dict.fromkeys(states))
    kinds = sorted({e for _, e in transitions})
    nexts = F.array(*[F.array(*[F.lit(states.index(transitions.get((s, e), s))) for s in states]) for e in kinds])
    legal = F.array(*[F.array(*[F.lit((s, e) in transitions) for s in states]) for e in kinds])
    number = F.array_position(F.array(*map(F.lit, kinds)), F.col("event")).cast("int") - 1
    step = lambda s, e: F.when(e >= 0, nexts[e][s]).otherwise(s)
    x = events.select("id", F.col("seq").cast("long"), "event", F.coalesce(number, F.lit(-1)).alias("e"))
    x = x.groupBy("id", F.floor(F.col("seq") / BLOCK).cast("long").alias("block")).agg(F.array_sort(F.collect_list(F.struct("seq", "e", "event"))).alias("items"))
    each = F.aggregate("items", F.array(*map(F.lit, range(len(states)))), lambda a, x: F.transform(a, lambda s: step(s, x["e"])))
    x = x.join(_before(x.select("id", "block", each.alias("map")), 0), ["id", "block"])
    x = x.select("id", "items", _scanned(F.col("items"), F.col("state"), lambda s, x: step(s, x["e"]))["before"].alias("before"))
    x = x.select("id", F.explode(F.arrays_zip("items", "before")).alias("x")).select("id", "x.items.seq", "x.items.event", "x.items.e", F.col("x.before").alias("s"))
    names = F.array(*map(F.lit, states))
    return x.select("id", "seq", "event", names[F.col("s")].alias("before"), names[step(F.col("s"), F.col("e"))].alias("after"), F.when(F.col("e") >= 0, legal[F.col("e")][F.col("s")]).otherwise(False).alias("legal"))


def final_states(steps: DataFrame) -> DataFrame:
    """id, state, events and illegal, after all folded events."""
    return steps.groupBy("id").agg(F.max_by("after", "seq").alias("state"), F.count(F.lit(1)).alias("events"), F.count_if(~F.col("legal")).alias("illegal"))


def merged_holds(holds: DataFrame) -> DataFrame:
    """Holds (id, begins, ends; null ends never) as disjoint intervals that do not touch. Empty ones are left out."""
    never = F.coalesce("ends", F.lit("9999-12-31 00:00:00").cast("timestamp_ntz"))
    h = holds.select("id", "begins", never.alias("ends")).filter("begins < ends")
    w = Window.partitionBy("id").orderBy("begins", "ends")
    before = F.max("ends").over(w.rowsBetween(Window.unboundedPreceding, -1))
    h = h.withColumn("new", F.coalesce(F.col("begins") > before, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(w))
    return h.groupBy("id", "island").agg(F.min("begins").alias("begins"), F.max("ends").alias("ends")).drop("island")


def deletion_outcomes(requests: DataFrame, holds: DataFrame, attempts: DataFrame, products: list[str], now) -> DataFrame:
    """id, product, due and outcome for each request at each product.

    Takes requests (id, requested, retained_until; null: not retained), holds, and attempts (id, product, at, ok). A
    deletion is due once it is requested, no longer retained, and under no hold: a hold that is on then moves it to the
    hold's end, and one that never ends leaves it without a date. Outcomes: held (no date), waiting (the date is after
    `now`), deleted (an attempt from then on was right), failed (there were others), pending."""
    due = F.greatest("requested", F.coalesce("retained_until", "requested"))
    r = requests.select("id", due.alias("due"))
    h = merged_holds(holds).withColumnRenamed("id", "held")
    r = r.join(h, (F.col("id") == F.col("held")) & (F.col("begins") <= F.col("due")) & (F.col("due") < F.col("ends")), "left")
    forever = F.col("ends") >= F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    r = r.select("id", F.when(forever, F.lit(None)).otherwise(F.coalesce("ends", "due")).alias("due"))
    x = r.withColumn("product", F.explode(F.array(*map(F.lit, products))))
    tried = x.join(attempts, ["id", "product"]).filter("at >= due").groupBy("id", "product").agg(F.bool_or("ok").alias("right"))
    x = x.join(tried, ["id", "product"], "left")
    outcome = F.when(F.col("due").isNull(), "held").when(F.col("due") > F.lit(now), "waiting").when(F.col("right"), "deleted").when(~F.col("right"), "failed").otherwise("pending")
    return x.select("id", "product", "due", outcome.alias("outcome"))
