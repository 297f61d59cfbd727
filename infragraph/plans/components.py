"""Connected components by alternating star contraction (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infragraph.plans.lineage import cut, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction step over rows (u, v) with v < u; rows may repeat, also in the result.

    The minimum of a neighbourhood is a combinable aggregate and returns by an equi-join, so that a hub is
    never gathered in one task; adaptive execution splits the join of a hub's rows. Rows are turned and replaced
    one by one, without unions, as a union runs all tasks of both its sides.
    """
    near = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v") if large else edges
    low = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u_"), F.least("u", "m").alias("m"))
    joined = near.join(low, near["u"] == low["u_"])
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    # the row of the smallest neighbour itself links the node to it, the others link theirs
    return joined.select(F.expr("if(v = m, u, v)").alias("u"), F.col("m").alias("v")).where("u > v")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node with a link to another one; component is the smallest node.

    ``edges`` may hold repeats, self-links and either direction; rows with a null end are ignored. Each
    round is one large and one small star step; it ends when every node has one edge to a node that has none.
    Work per round is linear in the edges, and the number of rounds is logarithmic in practice; each round is
    checkpointed.
    """
    # the cut before the loop keeps the caller's plan from being run again in each round
    cur = cut(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    for _ in range(max_rounds):
        cur = cut(_star(_star(cur, large=True), large=False).distinct())
        release(edges.sparkSession)
        ends = cur.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("node")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component"))
    )
