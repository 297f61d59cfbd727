"""Components of a graph that grows: a stored table of parents, to which new links are added.

The table has a row (node, parent) for each node with a link. Following parents ends at the smallest node of the component,
which is its own parent. A batch of links looks up the roots of its ends, finds components among these roots alone,
and writes the rows of the roots that moved and of its own ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from infragraph.plans.components import connected_components
from infragraph.plans.lineage import cut
from infragraph.sources.delta_store import KeyedTable, View

PARENTS = KeyedTable(T.StructType([T.StructField("node", T.StringType()), T.StructField("parent", T.StringType())]), ("node",), ("node",))


def find_roots(view: View, nodes: DataFrame, table: str = "parents") -> DataFrame:
    """Rows (node, root) of rows (node); a node that is not stored is its own root. A round a step upward."""
    at = cut(nodes.select("node", F.col("node").alias("at")))
    done = at.limit(0)
    while True:
        up = view.lookup(table, at.select(F.col("at").alias("node"), F.col("node").alias("of")))
        step = cut(up.select(F.col("of").alias("node"), F.coalesce(F.col("stored")["parent"], F.col("node")).alias("next"), F.col("node").alias("at")))
        done = done.unionByName(step.where("next = at").select("node", "at"))
        at = step.where("next <> at").select("node", F.col("next").alias("at"))
        if at.isEmpty():
            return done.withColumnRenamed("at", "root")


def merge_links(view: View, links: DataFrame, table: str = "parents") -> View:
    """``view`` with the links (a, b) staged; links inside a component change nothing."""
    links = cut(links.select("a", "b").where("a <> b").distinct())
    roots = cut(find_roots(view, links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), table))
    root = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
    met = connected_components(links.join(root("a"), "a").join(root("b"), "b").where("ra <> rb"), "ra", "rb")
    top = met.select(F.col("node").alias("root"), "component")
    own = roots.join(top, "root", "left").select("node", F.coalesce("component", "root").alias("parent"))
    rows = own.unionByName(met.select("node", F.col("component").alias("parent"))).distinct()
    return view.stage(table, rows)


def stored_components(view: View, table: str = "parents") -> DataFrame:
    """Rows (node, component) of all stored nodes; ways upward double each round."""
    at = cut(view.read(table))
    while True:
        above = at.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        at = cut(at.join(above, "parent", "left").select("node", F.coalesce("next", "parent").alias("parent"), (F.col("next") != F.col("parent")).alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("node", F.col("parent").alias("component"))
        at = at.drop("moved")
