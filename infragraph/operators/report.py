"""The report and its baseline difference (B1, B2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from infragraph.functions.schema import EDGE_SCHEMA, FINDING_SCHEMA, NODE_SCHEMA
from infragraph.operators.audit import audit
from infragraph.operators.correlate import correlated_groups
from infragraph.operators.relational import audit_summary, edge_counts, latest_scans, node_counts, sample_nodes
from infragraph.operators.state import report_diff


def report(nodes: DataFrame, edges: DataFrame, scans: DataFrame, sample: int = 20, made: DataFrame | None = None) -> dict[str, DataFrame]:
    """B1: the report's tables by name; ``made`` are counts of links that the groups hold besides ``edges``."""
    findings = audit(nodes, edges)
    return {
        "nodes_by_type": node_counts(nodes), "nodes_by_source": node_counts(nodes, "source"), "edges_by_type": edge_counts(edges),
        "scans": latest_scans(scans, 10), "findings": findings, "summary": audit_summary(findings), "groups": correlated_groups(nodes, edges, made),
        "nodes": nodes.orderBy("id"), "edges": edges.orderBy("id"), "sample": sample_nodes(nodes, sample),
    }


def baseline_tables(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The tables of the report that B2 compares, without their order."""
    return {"nodes": nodes, "edges": edges, "findings": audit(nodes, edges)}


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of compressed JSON lines for each table."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")


def report_with_baseline(tables: dict[str, DataFrame], spark: SparkSession, path: str) -> DataFrame:
    """B2: the difference to a report written earlier."""
    schemas = {"nodes": NODE_SCHEMA, "edges": EDGE_SCHEMA, "findings": FINDING_SCHEMA}
    base = {k: spark.read.schema(s).json(f"{path}/{k}") for k, s in schemas.items()}
    return report_diff({k: tables[k].select(*s.names) for k, s in schemas.items()}, base)


def report_row(tables: dict[str, DataFrame]) -> DataFrame:
    """The report's counts as one JSON text; only bounded tables are folded into the row."""
    t = tables["nodes_by_type"].agg(F.sum("n").alias("nodes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("nodes_by_type"))
    s = tables["nodes_by_source"].agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("nodes_by_source"))
    e = tables["edges_by_type"].agg(F.sum("n").alias("edges"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("edges_by_type"))
    return t.crossJoin(s).crossJoin(e).crossJoin(tables["summary"]).select(F.to_json(F.struct("*")).alias("report"))  # one row each
