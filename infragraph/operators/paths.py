"""Shortest paths by a search from both ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infragraph.operators.relational import both_ways
from infragraph.plans.lineage import bucketed, cut, discard, packed, release

PAIR = ["from_id", "to_id"]


def _meetings(arcs: DataFrame, want: DataFrame, max_depth: int | None) -> tuple[DataFrame, DataFrame]:
    """(rows (side, root, node_id, depth, pointer) of all that was seen, meeting nodes (from_id, to_id, node_id)).

    Side 0 starts at each ``from_id`` and side 1 at each ``to_id``, once for all pairs of that end. In a round one side moves,
    the one that more open pairs would rather move as its frontier is smaller; a pair is done in the round in which its
    sides meet. Pointers lead back to the side's start. On side 0 they keep the smallest trail: nodes of a level are
    numbered in the order of their trails, and a node points to the first that reaches it. On side 1 the smallest next node
    does the same.
    """
    open_ = packed(want.where("from_id <> to_id"))
    start = open_.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("from_id").alias("root")), F.struct(F.lit(1).alias("side"), F.col("to_id").alias("root")))).alias("e")).distinct()
    seen = packed(start.select("e.side", "e.root", F.col("e.root").alias("node_id"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("pointer"), F.lit(0).cast("long").alias("place")))
    fronts, met, rounds = [seen.where("side = 0"), seen.where("side = 1")], None, 0
    while True:
        sizes = [f.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("r")) for f in fronts]
        both = open_.join(sizes[0].select(F.col("root").alias("from_id"), F.col("n").alias("n0"), F.col("r").alias("r0")), "from_id").join(sizes[1].select(F.col("root").alias("to_id"), F.col("n").alias("n1"), F.col("r").alias("r1")), "to_id")
        both = both if max_depth is None else both.where(F.col("r0") + F.col("r1") < max_depth)
        open_ = packed(both.select(*PAIR, F.when(F.col("n0") <= F.col("n1"), 0).otherwise(1).alias("side")))  # those with a frontier on either side
        votes = {r["side"]: r["count"] for r in open_.groupBy("side").count().collect()}
        if not votes:
            break
        rounds += 1
        side = 0 if votes.get(0, 0) >= votes.get(1, 0) else 1
        own, far = (PAIR[side], PAIR[1 - side])
        # only who has an open pair stays; of those the roots that a pair would rather move do
        alive = [f.join(open_.select(F.col(PAIR[s]).alias("root")).distinct(), "root", "left_semi") for s, f in enumerate(fronts)]
        movers = open_.where(F.col("side") == side).select(F.col(own).alias("root")).distinct()
        step = alive[side].join(movers, "root", "left_semi").select("root", F.col("node_id").alias("via"), "depth", "place").join(arcs, F.col("via") == F.col("a"))
        first = step.groupBy("root", F.col("b").alias("node_id")).agg(F.min(F.struct("place", "via")).alias("m"), (F.min("depth") + 1).alias("depth"))
        first = first.join(seen.where(F.col("side") == side).select("root", "node_id"), ["root", "node_id"], "left_anti")
        first = first.select(F.lit(side).alias("side"), "root", "node_id", "depth", F.col("m.via").alias("pointer"), F.col("m.place").alias("before"))
        if side == 0:
            order = ["before", "node_id"]
            first = first.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
        else:
            first = first.withColumn("place", F.lit(0).cast("long"))
        fresh = packed(first.drop("before"))
        there = seen.where(F.col("side") == 1 - side).select(F.col("root").alias(far), "node_id", F.col("depth").alias("depth_"), F.col("place").alias("place_"))
        here = fresh.select(F.col("root").alias(own), "node_id", "depth", "place").join(open_.select(*PAIR), own)
        trail = F.col("place" if side == 0 else "place_")
        found = packed(here.join(there, [far, "node_id"]).groupBy(*PAIR).agg(F.min_by("node_id", F.struct(trail, F.col("node_id"))).alias("node_id"), F.min(F.col("depth") + F.col("depth_")).alias("length")))
        met = found if met is None else met.unionByName(found)
        open_ = open_.select(*PAIR).join(found, PAIR, "left_anti")
        stay = alive[side].join(movers, "root", "left_anti")
        fronts[side] = stay.unionByName(fresh)
        seen = seen.unionByName(fresh)
        if rounds % 8 == 0:  # what was seen is written together, and frontiers are
            seen, fronts = packed(seen), [packed(f) for f in fronts]
        release(want.sparkSession)
    if met is None:
        return seen, want.limit(0).select(*PAIR, F.col("from_id").alias("node_id"))
    if max_depth is not None:
        met = met.where(F.col("length") <= max_depth)
    return seen, met.select(*PAIR, "node_id")


def shortest_path(edges: DataFrame, pairs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(from_id, to_id, found, step, node_id, edge_id) along an undirected shortest path of each pair.

    Equal ends give one step. Without a path there is one row with found = false. Ties go to the smallest
    trail of node ids. A step's edge is the one that points forward, if there is one, with the smallest id.
    The search goes from both ends, so it sees the nodes within half of the way; the path is then followed from where the
    ends met, a step a round on either side.
    """
    want = cut(pairs.select(*PAIR).distinct())
    every = both_ways(edges).select("a", "b", F.when(F.col("forward"), 0).otherwise(1).alias("back"), "edge_id")
    arcs = bucketed(every.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a"), "a", "path_arcs")
    seen, met = _meetings(arcs.select("a", "b"), want, max_depth)
    at = cut(met.select(*PAIR, F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), "node_id"))
    rows = want.where("from_id = to_id").select(*PAIR, F.lit(0).alias("side"), F.col("from_id").alias("node_id"), F.lit(0).alias("depth"))
    way = seen.select("side", "root", "node_id", "pointer", "depth")
    while not at.isEmpty():
        own = at.withColumn("root", F.when(F.col("side") == 0, F.col("from_id")).otherwise(F.col("to_id")))
        here = cut(own.join(way, ["side", "root", "node_id"]))
        rows = rows.unionByName(here.select(*PAIR, "side", "node_id", "depth"))
        at = here.where("pointer is not null").select(*PAIR, "side", F.col("pointer").alias("node_id"))
    # the meeting node lies on both sides; the steps of side 1 count from the end
    rows = cut(rows)
    length = rows.groupBy(*PAIR).agg(F.max(F.when(F.col("side") == 0, F.col("depth"))).alias("i"), F.coalesce(F.max(F.when(F.col("side") == 1, F.col("depth"))), F.lit(0)).alias("j"))
    steps = rows.join(length, PAIR).select(*PAIR, F.when(F.col("side") == 0, F.col("depth")).otherwise(F.col("i") + F.col("j") - F.col("depth")).cast("int").alias("step"), "node_id").distinct()
    before = steps.select(*PAIR, (F.col("step") + 1).alias("step"), F.col("node_id").alias("a"))
    named = cut(steps.join(before, [*PAIR, "step"], "left"))
    ends = named.select("a", "node_id").where("a is not null").distinct()
    taken = arcs.withColumnRenamed("b", "node_id").join(ends, ["a", "node_id"]).groupBy("a", "node_id").agg(F.min(F.struct("back", "edge_id")).alias("e")).select("a", "node_id", "e.edge_id")
    named = named.join(taken, ["a", "node_id"], "left")
    out = named.select(*PAIR, F.lit(True).alias("found"), "step", "node_id", "edge_id")
    none = want.join(steps.select(*PAIR), PAIR, "left_anti").selectExpr("from_id", "to_id", "false as found", "cast(null as int) as step", "cast(null as string) as node_id", "cast(null as string) as edge_id")
    result = cut(out.unionByName(none))
    discard(arcs)
    return result
