"""Storage and exports of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from infragraph.functions.schema import EDGE_SCHEMA, NODE_SCHEMA
from infragraph.operators.relational import edge_counts, expiring_within, latest_scans, node_counts

#: Fill colours by type.
COLOURS = {
    "vm": "#AED6F1", "node": "#AED6F1", "pod": "#A3E4D7", "container": "#A3E4D7", "service": "#F9E79F", "ingress": "#F5CBA7",
    "load_balancer": "#F5CBA7", "database": "#D7BDE2", "certificate": "#F1948A", "secret": "#E74C3C", "network": "#85C1E9",
    "subnet": "#85C1E9", "dns_record": "#82E0AA", "firewall_rule": "#F0B27A", "function": "#F5B041", "api_gateway": "#F9E79F",
    "nosql_database": "#D7BDE2",
}
OTHER_COLOUR = "#D5D8DC"


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Parquet; nodes by source, so that one scan rewrites one partition."""
    nodes.write.mode("overwrite").partitionBy("source").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; order them only at an output (nodes by type, name, id; edges by type, from_id, id: D13)."""
    return spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes").select(*NODE_SCHEMA.names), spark.read.schema(EDGE_SCHEMA).parquet(f"{path}/edges")


def store_drift(drift: DataFrame, path: str) -> None:
    """One partition for each scan_id, replaced on repeat."""
    drift.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").parquet(path)


def get_drift(spark: SparkSession, path: str, scan_id: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("scan_id") == scan_id)


def export_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json), one line for each node and edge."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("*")).alias("json"))
    return n.unionAll(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct("*")).alias("json")))


def _quoted(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit('"'), F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _sections(*parts: tuple[int, DataFrame]) -> DataFrame:
    """Lines in the order of their sections, then by sort key."""
    out = None
    for place, df in parts:
        own = df.select(F.lit(place).alias("section"), "sort", "line")
        out = own if out is None else out.unionAll(own)
    return out.orderBy("section", "sort").select("line")


def _text(spark: SparkSession, *lines: str) -> DataFrame:
    return spark.createDataFrame([(f"{i:03d}", x) for i, x in enumerate(lines)], "sort string, line string")


def export_dot(nodes: DataFrame, edges: DataFrame, name: str = "assets") -> DataFrame:
    """Lines of a Graphviz digraph."""
    spark = nodes.sparkSession
    colour = F.coalesce(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])[F.col("type")], F.lit(OTHER_COLOUR))
    label = F.concat("name", F.lit("\\n("), "type", F.lit(")"))
    n = nodes.select(F.concat_ws("\u0001", "type", "name", "id").alias("sort"), F.concat(F.lit("  "), _quoted("id"), F.lit(" [label="), _quoted(label), F.lit(", fillcolor="), _quoted(colour), F.lit("];")).alias("line"))
    e = edges.select(F.concat_ws("\u0001", "type", "from_id", "id").alias("sort"), F.concat(F.lit("  "), _quoted("from_id"), F.lit(" -> "), _quoted("to_id"), F.lit(" [label="), _quoted("type"), F.lit("];")).alias("line"))
    return _sections((0, _text(spark, f"digraph {name} {{", "  rankdir=LR;", "  node [shape=box, style=filled];", "")), (1, n), (2, _text(spark, "")), (3, e), (4, _text(spark, "}")))


def export_mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a Mermaid graph."""
    safe = lambda c: F.translate(c, ":.-/", "____")
    n = nodes.select(F.concat_ws("\u0001", "type", "name", "id").alias("sort"), F.concat(F.lit("  "), safe("id"), F.lit('["'), "name", F.lit(" ("), "type", F.lit(')"]')).alias("line"))
    e = edges.select(F.concat_ws("\u0001", "type", "from_id", "id").alias("sort"), F.concat(F.lit("  "), safe("from_id"), F.lit(" -->|"), "type", F.lit("| "), safe("to_id")).alias("line"))
    return _sections((0, _text(nodes.sparkSession, "graph LR")), (1, n), (2, e))


def metrics_lines(nodes: DataFrame, edges: DataFrame, scans: DataFrame, as_of: Column, prefix: str = "infragraph") -> DataFrame:
    """(metric, line): gauges of totals, types, certificates expiring in 30 days, and the last 1000 scans."""

    def gauge(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.agg(value.alias("v")).select(F.lit(name).alias("metric"), F.format_string(f"{prefix}_{name} %d", "v").alias("line"))

    def by_type(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("metric"), F.format_string(f'{prefix}_{name}{{type="%s"}} %d', "type", "n").alias("line"))

    last = latest_scans(scans, 1000)
    out = gauge(nodes, "nodes_total", F.count(F.lit(1))).unionAll(gauge(edges, "edges_total", F.count(F.lit(1))))
    out = out.unionAll(by_type(node_counts(nodes), "nodes_by_type")).unionAll(by_type(edge_counts(edges), "edges_by_type"))
    out = out.unionAll(gauge(expiring_within(nodes, 30, as_of), "certs_expiring_total", F.count(F.lit(1))))
    for status in ("completed", "failed"):
        out = out.unionAll(gauge(last, f"scans_{status}_total", F.count_if(F.col("status") == status)))
    return out
