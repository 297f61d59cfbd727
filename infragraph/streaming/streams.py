"""The graph kept current by streams."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from infragraph.operators.certs import cert_alerts, list_certs
from infragraph.operators.correlate import correlate
from infragraph.operators.relational import dangling_edges
from infragraph.operators.state import edge_drift, node_drift, upsert_edges, upsert_nodes
from infragraph.plans.lineage import stored
from infragraph.streaming.graph_store import Parser, apply_scan, graph_store

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest_rows(events: DataFrame, key: str = "id", ts: str = "ts") -> DataFrame:
    """R2: for each key the latest row with first_seen and last_seen; on batches and on streams (update mode)."""
    rest = [c for c in events.columns if c not in (key, ts)]
    kept = events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(ts, *rest)).alias("r"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))
    return kept.select(key, *[F.col(f"r.{c}").alias(c) for c in rest], "first_seen", "last_seen")


def ingest_batch(docs: DataFrame, parse: Parser, nodes: DataFrame, edges: DataFrame, source: str) -> dict[str, DataFrame]:
    """One scan over whole tables: parse, drift against the graph, upsert, correlate. Returns the new tables, the drift and the scan's own rows.

    ``graph_store.apply_scan`` does the same on a stored graph, at the cost of the batch.
    """
    new_nodes, new_edges, warnings = parse(docs)
    new_nodes, new_edges = stored(new_nodes, "scan-nodes"), stored(new_edges, "scan-edges")
    drift = node_drift(nodes, new_nodes, source)
    drifted = edge_drift(nodes, edges, new_edges, source)
    all_nodes = upsert_nodes(nodes, new_nodes)
    good, bad = dangling_edges(all_nodes, new_edges)
    all_edges = upsert_edges(edges, good)
    linked = all_edges.unionByName(correlate(all_nodes, all_edges).select(*all_edges.columns))
    return {"nodes": all_nodes, "edges": linked, "node_drift": drift, "edge_drift": drifted, "rejected": bad, "warnings": warnings, "new_nodes": new_nodes, "new_edges": new_edges}


def stream_ingest(docs_stream: DataFrame, graph_path: str, parse: Parser, source: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of documents is a scan of the graph store below ``graph_path``.

    A batch writes what it changes; ``read_graph(graph_store(spark, graph_path))`` reads the graph. A stored graph is
    continued also under a new checkpoint, and a batch that is tried again after it was committed does nothing.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        apply_scan(graph_store(batch.sparkSession, graph_path), batch, parse, source, f"{checkpoint}#{batch_id}", checkpoint)

    return docs_stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, off the heap, and save its changes only."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_latest(events: DataFrame, path: str, checkpoint: str, key: str = "id", ts: str = "ts") -> StreamingQuery:
    """R2: the changed rows of each micro-batch as ``<path>/v<batch id>``; the state holds one row for each key, in RocksDB."""

    def one(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    with keyed_state(events.sparkSession):
        return latest_rows(events, key, ts).writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_cert_alerts(certs: DataFrame, as_of: Column, path: str, checkpoint: str) -> StreamingQuery:
    """Alert events of certificate rows as JSON files."""
    return cert_alerts(list_certs(certs, as_of), as_of).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
