"""The graph as a store of deltas, kept current by scans whose cost follows the batch (R1, U1, U2, DR1, DR3, C2, P2).

Nodes, edges, correlation keys, components and scans are keyed tables of a ``DeltaStore``. A scan looks up what it touches
and writes that; all its deltas become visible with one manifest, which also notes the scan's name, so that a scan
that is tried again after its commit does nothing, and one that broke before it leaves nothing behind.

Edges carry the sources of their two ends as these were when the edge was written, as drift compares the edges
whose ends are both of one source (DR3). A node that another source takes over makes these notes stale (D9): from then on
drift reads the nodes, until ``settle`` has written the notes anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from infragraph.functions.schema import EDGE_COLUMNS, EDGE_SCHEMA, NODE_COLUMNS, NODE_SCHEMA, SCAN_SCHEMA
from infragraph.operators.correlate import KEYS, correlate_changes
from infragraph.operators.state import changed_fields, edge_drift
from infragraph.plans.lineage import cut
from infragraph.plans.union_find import PARENTS, merge_links, stored_components
from infragraph.sources.delta_store import DeltaStore, KeyedTable, View, co_partitioned
from infragraph.sources.store import store_drift

Parser = Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]]
ENDS = ("from_source", "to_source")
TRIPLE = ["from_id", "to_id", "type"]
TABLES = {
    "nodes": KeyedTable(NODE_SCHEMA, ("id",), ("id",)),
    "edges": KeyedTable(T.StructType([*EDGE_SCHEMA.fields, *(T.StructField(c, T.StringType()) for c in ENDS)]), tuple(TRIPLE), tuple(TRIPLE)),
    "keys": KEYS,
    "parents": PARENTS,
    "scans": KeyedTable(SCAN_SCHEMA, ("id",), ("id",)),
}


def graph_store(spark: SparkSession, path: str, buckets: int | None = None) -> DeltaStore:
    return DeltaStore(spark, path, TABLES, buckets)


def read_graph(store: DeltaStore, version: int | None = None) -> dict[str, DataFrame]:
    """All tables of a version, the newest if none is named: nodes, edges, scans, and components (node, component) of correlated nodes."""
    view = store.view(version)
    out = {t: view.read(t) for t in ("nodes", "edges", "scans")}
    return out | {"edges": out["edges"].select(*EDGE_COLUMNS), "components": stored_components(view)}


def _one(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A row for each key: the last by the other columns, maps as sorted entries."""
    rest = [c for c in columns if c not in keys]
    order = F.struct(*[F.to_json(F.array_sort(F.map_entries(c))) if c == "metadata" else F.col(c) for c in rest])
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in columns])


def _node_changes(view: View, batch: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(rows (id, new, stored) of the batch, drift as ``state.node_drift`` has it)."""
    met = cut(view.lookup("nodes", batch.select("id", F.struct(*NODE_COLUMNS).alias("new"))))
    own = F.coalesce(F.col("stored")["source"] == source, F.lit(False))
    fields = F.when(own, changed_fields("stored", "new")).otherwise(F.array().cast("array<string>"))
    change = F.when(~own, "added").when(F.size(fields) > 0, "modified")
    here = met.select(change.alias("change"), "id", F.col("new")["name"].alias("name"), F.col("new")["type"].alias("type"), fields.alias("changes"))
    gone = view.unmatched("nodes", batch, F.col("source") == source)
    removed = gone.select(F.lit("removed").alias("change"), "id", "name", "type", F.array().cast("array<string>").alias("changes"))
    return met, here.where("change is not null").unionByName(removed)


def _edge_changes(view: View, batch: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(rows (from_id, to_id, type, new, stored) of the batch, drift as ``state.edge_drift`` has it)."""
    met = cut(view.lookup("edges", batch.select(*TRIPLE, F.struct(*EDGE_COLUMNS).alias("new"))))
    if view.state["notes"].get("flipped"):
        return met, edge_drift(view.read("nodes"), view.read("edges").select(*EDGE_COLUMNS), batch, source)
    own = " and ".join(f"{c} = '{source}'" for c in ENDS)
    stored = F.coalesce(F.expr(own.replace("from_", "stored.from_").replace("to_", "stored.to_")), F.lit(False))
    added = met.where(~stored).select(F.lit("added").alias("change"), "new.id", "from_id", "to_id", "type")
    removed = view.unmatched("edges", batch, own).select(F.lit("removed").alias("change"), "id", "from_id", "to_id", "type")
    return met, added.unionByName(removed)


def _ends(view: View, batch: DataFrame, nodes: DataFrame) -> DataFrame:
    """``batch`` with the sources of its ends, null where an end is neither stored nor in ``nodes``."""
    ends = batch.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    met = view.lookup("nodes", ends).join(nodes.select("id", F.col("source").alias("now")), "id", "left")
    known = cut(met.select("id", F.coalesce("now", F.col("stored")["source"]).alias("source"), (F.col("now").isNotNull() | F.col("stored").isNotNull()).alias("known")))
    for side in ("from", "to"):
        own = known.select(F.col("id").alias(f"{side}_id"), F.col("source").alias(f"{side}_source"), F.col("known").alias(f"{side}_known"))
        batch = batch.join(own, f"{side}_id")
    return batch


def apply_scan(store: DeltaStore, docs: DataFrame, parse: Parser, source: str, name: str, writer: str | None = None) -> dict[str, DataFrame] | None:
    """One scan: parse, drift, upsert, correlate, record; returns drift, rejected edges and warnings, or None if it is done.

    ``name`` tells a scan that is tried again; only the last one of each ``writer`` is remembered, which is enough for
    a stream. The drift of a scan is a partition of ``<path>/drift``; the first scan of a source has none.
    """
    spark, before = store.spark, store.view()
    notes, writer = before.state["notes"], writer or name
    if notes.get("done", {}).get(writer) == name:
        return None
    now = before.state["version"] + 1
    began = spark.range(1).select(F.current_timestamp()).first()[0]
    found_nodes, found_edges, warnings = parse(docs)
    found_nodes, found_edges = cut(found_nodes), cut(found_edges)
    nodes, edges = cut(_one(found_nodes, ["id"], NODE_COLUMNS)), cut(_one(found_edges, TRIPLE, EDGE_COLUMNS))
    with co_partitioned(spark):
        met, drift = _node_changes(before, nodes, source)
        met_edges, drifted = _edge_changes(before, edges, source)
        ended = cut(_ends(before, met_edges, nodes))
        good = F.col("from_known") & F.col("to_known")
        kept = ended.where(good).select(F.coalesce(F.col("stored")["id"], F.col("new")["id"]).alias("id"), *TRIPLE, F.col("new")["metadata"].alias("metadata"), *ENDS)
        view = before.stage("nodes", met.select(*[F.coalesce(F.col("stored")[c], F.col("new")[c]).alias(c) if c == "first_seen" else F.col("new")[c].alias(c) for c in NODE_COLUMNS]))
        view, links = correlate_changes(view, met.where("stored is not null").select("stored.*"), met.select("new.*"))
        fresh = before.lookup("edges", links).where("stored is null").drop("stored")
        fresh = cut(_ends(before, fresh, nodes).select(*EDGE_COLUMNS, *ENDS))
        view = view.stage("edges", kept.unionByName(fresh))
        view = merge_links(view, fresh.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")))
        known = before.state["notes"].get("sources", [])
        if source in known:
            all_drift = drift.select(F.lit("node").alias("kind"), "change", "id", "type").unionByName(drifted.select(F.lit("edge").alias("kind"), "change", "id", "type"))
            store_drift(all_drift.withColumn("scan_id", F.lit(now).cast("long")), f"{store.path}/drift")
        scan = spark.createDataFrame([(now, source, name, began, None, found_nodes.count(), found_edges.count(), "completed")], SCAN_SCHEMA)
        view = view.stage("scans", scan.withColumn("finished_at", F.current_timestamp()))
        flipped = notes.get("flipped", False) or not met.where("stored.source <> new.source").isEmpty()
        sources = sorted({*known, *(r[0] for r in nodes.select("source").distinct().collect() if r[0] is not None)})  # a handful: one for each kind of document
        view = view.noted(done=notes.get("done", {}) | {writer: name}, flipped=flipped, sources=sources).compacted()
    store.commit(view)
    rejected = ended.where(~good).select("new.*").select(*EDGE_COLUMNS)
    return {"node_drift": drift, "edge_drift": drifted, "rejected": rejected, "warnings": warnings}


def settle(store: DeltaStore) -> View:
    """Writes the sources of all edges' ends anew, after nodes have changed their source, and merges all deltas."""
    view = store.view()
    with co_partitioned(store.spark):
        nodes, edges = view.read("nodes").select("id", "source"), view.read("edges").select(*EDGE_COLUMNS)
        for side in ("from", "to"):
            edges = edges.join(nodes.select(F.col("id").alias(f"{side}_id"), F.col("source").alias(f"{side}_source")), f"{side}_id", "left")
        return store.commit(view.stage("edges", edges).noted(flipped=False).compacted(share=0.0))
