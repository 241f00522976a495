"""Expansion of the ranked hits of many queries over a graph, under budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.marks import likely
from quillspark.storage import remove, written


def _open_edges(edges: DataFrame, types: list[str] | None, closed: DataFrame | None, most: int) -> DataFrame:
    """(node, nexts): the first `most` different neighbours of each node, in order of edge type, ordinal and id."""
    e = edges.filter(F.col("edge_type").isin(*types)) if types is not None else edges
    if closed is not None:
        for end in ("from_node", "to_node"):
            e = e.join(closed.select(F.col("node").alias(end)), end, "left_anti")
    e = e.groupBy(F.col("from_node").alias("node"), F.col("to_node").alias("next")).agg(F.min(F.struct("edge_type", "ordinal")).alias("first"))
    # the limit is known to Spark before the shuffle, so a hub sends `most` rows a task
    turn = F.row_number().over(Window.partitionBy("node").orderBy("first", "next"))
    first = e.withColumn("turn", turn).filter(F.col("turn") <= most)
    return first.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "next"))), lambda x: x["next"]).alias("nexts"))


def _first_hops(s: DataFrame, e: DataFrame, per_seed: int, total: int, most_hops: int) -> tuple[DataFrame, str]:
    """(query_id, found, whole) of ranked seeds s (query_id, rank, node, score, n_seeds): what a query's seeds add in order by
    their first hop (seed, node, score), and whether they add no more. Also the path of the marks.

    So many first seeds are tried as fill the total. It is whole where each filled its room or added nothing, and the total is
    reached or no seed is left. The seed of a rank sees n_seeds nodes and less than rank * per_seed others, so its
    neighbours are cut at that before they are dealt by query."""
    tried = F.col("rank") <= -(-total // max(per_seed, 1))
    kinds = dict(s.dtypes) | dict(e.dtypes)
    nodes, none = kinds["nexts"], F.array().cast(kinds["nexts"])
    near, marks = likely(e, s.filter(tried), ["node"])
    near = near.filter("likely").select(F.col("node").alias("at"), "nexts")
    most = F.least(F.col("rank") * max(per_seed, 0), F.lit(max(total, 0))) + F.col("n_seeds")
    x = s.join(near, (F.col("node") == F.col("at")) & tried, "left").withColumn("nexts", F.coalesce(F.slice("nexts", F.lit(1), most.cast("int")), none))
    x = x.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "node", "score", tried.alias("tried"), "nexts"))).alias("seeds"))
    start = F.struct(F.transform("seeds", lambda y: y["node"]).cast(nodes).alias("seen"), F.array().cast(f"array<struct<seed:{kinds['node']},node:{nodes[6:-1]},score:{kinds['score']}>>").alias("found"), F.lit(False).alias("more"))

    def step(a, y):
        room = F.greatest(F.least(F.lit(per_seed), total - F.size(a["found"])), F.lit(0))
        # an array of one row, so that what is new is looked for once
        new = F.array(F.struct(F.slice(F.array_except(y["nexts"], a["seen"]), F.lit(1), room).alias("new"), room.alias("room")))
        rows = lambda z: F.transform(z["new"], lambda n: F.struct(y["node"].alias("seed"), n.alias("node"), y["score"].alias("score")))
        more = lambda z: a["more"] | (F.lit(most_hops > 1) & F.size(z["new"]).between(1, z["room"] - 1))
        return F.transform(new, lambda z: F.struct(F.concat(a["seen"], z["new"]).alias("seen"), F.concat(a["found"], rows(z)).alias("found"), more(z).alias("more")))[0]

    x = x.select("query_id", "seeds", F.aggregate(F.filter("seeds", lambda y: y["tried"]), start, step).alias("x"))
    whole = ~F.col("x.more") & ((F.size("x.found") >= total) | F.forall("seeds", lambda y: y["tried"]))
    return x.select("query_id", "x.found", whole.alias("whole")), marks


def expanded(seeds: DataFrame, edges: DataFrame, per_seed: int = 6, total: int = 30, most_hops: int = 2, types: list[str] | None = None, closed: DataFrame | None = None) -> DataFrame:
    """query_id, seed, node, hop, score and place of the nodes that each query's seeds reach.

    Takes seeds (query_id, rank, node, score) and edges (from_node, to_node, edge_type, ordinal). A query's seeds go in the
    order of their ranks, each breadth first: its frontier in order, each node's edges by type, ordinal and id. A query
    has one set of seen nodes, its seeds among them; only new nodes count, `per_seed` for a seed and `total` for the
    query. Edges of other types and those that touch a closed node are not followed. A score is halved each hop.

    Where the first hops of a query's seeds fill its budgets they are all there is: one join with the seeds' neighbours and a
    fold over each query's seeds (`_first_hops`). The other queries take one step after the other together (`_stepped`).
    As a frontier node adds no more than the budget and all that is skipped has been seen, its
    first per_seed + total + seeds neighbours suffice. Seeds that repeat a node count once, by their least rank; an
    empty table gives no rows."""
    spark = seeds.sparkSession
    s = seeds.groupBy("query_id", "node").agg(F.min(F.struct("rank", "score")).alias("x"))
    by_query = Window.partitionBy("query_id")
    s = s.select("query_id", "node", "x.score", F.row_number().over(by_query.orderBy("x.rank", "node")).alias("rank"), F.count(F.lit(1)).over(by_query).alias("n_seeds"))
    s, s_path = written(s, "seeds")
    most = s.agg(F.max("rank")).first()[0] or 0
    paths = [s_path]
    if closed is not None:
        # a table, of which Spark knows how small it is
        closed, c_path = written(closed.select("node").distinct(), "closed")
        paths.append(c_path)
    e, e_path = written(_open_edges(edges, types, closed, per_seed + total + most), "edges")
    direct, marks = _first_hops(s, e, per_seed, total, most_hops)
    direct, _ = written(direct.filter(F.lit(most_hops > 0)), "direct")
    paths += [e_path, marks]
    out = direct.filter("whole").select("query_id", F.posexplode("found").alias("place", "x"))
    out = out.select("query_id", "x.seed", "x.node", F.lit(1).alias("hop"), F.round(F.col("x.score") * 0.5, 6).alias("score"), (F.col("place") + 1).alias("place"))
    rest = direct.filter("NOT whole").select("query_id")
    if rest.limit(1).count():
        s, rest_path = written(s.join(rest, "query_id", "left_semi").drop("n_seeds"), "rest")
        paths.append(rest_path)
        out = out.unionByName(_stepped(s, e, per_seed, total, most_hops))
    remove(spark, *paths)
    return out


def _stepped(s: DataFrame, e: DataFrame, per_seed: int, total: int, most_hops: int) -> DataFrame:
    """`expanded` of ranked seeds s (query_id, rank, node, score) over the neighbours e, step by step.

    A step is a join of the frontier with the neighbours of its nodes, and one ranked window over
    each query's new nodes, which are few. Neighbours of other nodes are not dealt, and a frontier without room takes no step."""
    seen, found, paths = s.select("query_id", "node"), None, []
    most = s.agg(F.max("rank")).first()[0]
    for rank in range(1, most + 1):
        frontier = s.filter(F.col("rank") == rank).select("query_id", F.col("node").alias("seed"), "score", "node", F.lit(1).alias("turn_of"))
        if found is None:
            frontier = frontier.withColumn("room", F.lit(min(per_seed, total)))
        else:
            spent = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("spent"))
            room = F.least(F.lit(per_seed), total - F.coalesce("spent", F.lit(0)))
            frontier = frontier.join(spent, "query_id", "left").withColumn("room", room).drop("spent")
        for hop in range(1, most_hops + 1):
            asked = frontier.filter("room > 0")
            near, marks = likely(e, asked, ["node"])
            x = asked.join(near.filter("likely").drop("likely"), "node").select("query_id", "seed", "score", "room", "turn_of", F.posexplode("nexts").alias("turn", "next"))
            x = x.groupBy("query_id", F.col("next").alias("node")).agg(F.min(F.struct("turn_of", "turn")).alias("first"), *(F.first(c).alias(c) for c in ("seed", "score", "room")))
            x = x.join(seen, ["query_id", "node"], "left_anti")
            x = x.withColumn("turn_of", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "node"))).filter("turn_of <= room")
            new, path = written(x.withColumn("hop", F.lit(hop)).withColumn("rank", F.lit(rank)).drop("first"), "expanded")
            paths += [path, marks]
            found = new if found is None else found.unionByName(new)
            seen = seen.unionByName(new.select("query_id", "node"))
            frontier = new.withColumn("room", F.col("room") - F.count(F.lit(1)).over(Window.partitionBy("query_id")))
            if hop < most_hops and not frontier.filter("room > 0").limit(1).count():
                break
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "hop", "turn_of"))
    score = F.round(F.col("score") * F.power(F.lit(0.5), F.col("hop").cast("double")), 6)
    out, _ = written(found.select("query_id", "seed", "node", "hop", score.alias("score"), place.alias("place")), "expansion")
    remove(s.sparkSession, *paths)
    return out
