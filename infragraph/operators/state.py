"""Keeping the graph current: upserts, pruning, scan records, drift and report differences (U, P, DR)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from infragraph.functions.schema import EDGE_COLUMNS, NODE_COLUMNS
from infragraph.functions.scalar import edge_id
from infragraph.operators.relational import last_wins


def _upsert(current: DataFrame, batch: DataFrame, keys: list[str], columns: list[str], keep: list[str]) -> DataFrame:
    """Full outer join on the keys; the batch wins except for the stored values of ``keep``."""
    c = current.select(*[F.col(k).alias(f"c_{k}") for k in columns])
    b = batch.select(*[F.col(k).alias(f"b_{k}") for k in columns])
    on = [F.col(f"c_{k}") == F.col(f"b_{k}") for k in keys]
    hit = F.col(f"b_{keys[0]}").isNotNull()
    out = []
    for k in columns:
        own = F.coalesce(f"c_{k}", f"b_{k}") if k in keep else F.when(hit, F.col(f"b_{k}")).otherwise(F.col(f"c_{k}"))
        out.append(own.alias(k))
    return c.join(b, on, "full_outer").select(*out)


def upsert_nodes(current: DataFrame, batch: DataFrame, order: str | None = None) -> DataFrame:
    """By id; the batch replaces all but ``first_seen``. Repeats in the batch: the last by ``order`` stays."""
    if order:
        batch = last_wins(batch.select(*NODE_COLUMNS, order), ["id"], [order])
    return _upsert(current, batch, ["id"], NODE_COLUMNS, ["id", "first_seen"])


def upsert_edges(current: DataFrame, batch: DataFrame) -> DataFrame:
    """By (from, to, type); only metadata is replaced and a stored id stays."""
    batch = batch.groupBy("from_id", "to_id", "type").agg(F.min("id").alias("id"), F.max_by("metadata", "id").alias("metadata")).select(*EDGE_COLUMNS)
    return _upsert(current, batch, ["from_id", "to_id", "type"], EDGE_COLUMNS, ["id", "from_id", "to_id", "type"])


def prune(nodes: DataFrame, edges: DataFrame, stale_days: int = 0, source: str | None = None, as_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Without the nodes that are stale and / or of a source, and without their edges."""
    from infragraph.operators.relational import list_nodes

    if stale_days <= 0 and not source:
        raise ValueError("prune by age, by source, or both")
    gone = list_nodes(nodes, source=source, stale_days=stale_days, as_of=as_of).select(F.col("id").alias("gone_id"))
    left = nodes.join(gone, F.col("id") == F.col("gone_id"), "left_anti")
    return left, edges.join(gone, F.col("from_id") == F.col("gone_id"), "left_anti").join(gone, F.col("to_id") == F.col("gone_id"), "left_anti")


def record_scan(scans: DataFrame, scan: DataFrame) -> DataFrame:
    """One more row for a finished scan (completed or failed, with counts and times)."""
    return scans.unionByName(scan)


def changed_fields(old: str, new: str) -> Column:
    """DR2: of two node structs: name, type, then the sorted ``metadata.<key>`` that differ."""
    a, b = F.col(old), F.col(new)
    empty = F.create_map().cast("map<string,string>")
    ma, mb = F.coalesce(a["metadata"], empty), F.coalesce(b["metadata"], empty)
    keys = F.filter(F.array_sort(F.array_union(F.map_keys(ma), F.map_keys(mb))), lambda k: ~ma[k].eqNullSafe(mb[k]))
    named = F.array(*[F.when(~a[c].eqNullSafe(b[c]), F.lit(c)) for c in ("name", "type")])
    return F.concat(F.array_compact(named), F.transform(keys, lambda k: F.concat(F.lit("metadata."), k)))


def _signature(prefix: str) -> Column:
    """128 bits of what ``changed_fields`` compares."""
    parts = ("name", "type", F.array_sort(F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>")))))
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("again"), *parts).alias("b")).alias(f"{prefix}_sig")


def node_drift(current: DataFrame, batch: DataFrame, source: str) -> DataFrame:
    """DR1: (change, id, name, type, changes): added, removed and modified nodes of one source.

    The caller names the source (D9). Repeated ids in the batch count once (D7). Removed nodes stay stored
    until pruned and so come back with every scan (D8). In two phases: all nodes meet by id with a signature of their
    fields; metadata are only fetched for those that differ.
    """
    stored_rows = current.where(F.col("source") == source)
    last = F.max_by(F.struct("name", "type", "metadata"), F.struct("name", "type", F.to_json(F.array_sort(F.map_entries("metadata")))))
    new_rows = batch.groupBy("id").agg(last.alias("r")).select("id", "r.*")
    old = stored_rows.select(F.col("id").alias("old_id"), F.col("name").alias("old_name"), F.col("type").alias("old_type"), _signature("old"))
    both = old.join(new_rows.select("id", "name", "type", _signature("new")), F.col("old_id") == F.col("id"), "full_outer")
    change = F.when(F.col("old_id").isNull(), "added").when(F.col("id").isNull(), "removed").when(F.col("old_sig") != F.col("new_sig"), "modified")
    met = both.select(change.alias("change"), F.coalesce("id", "old_id").alias("id"), F.coalesce("name", "old_name").alias("name"), F.coalesce("type", "old_type").alias("type")).where("change is not null")
    differ = met.where("change = 'modified'").select("id")
    a = stored_rows.join(differ, "id", "left_semi").select("id", F.struct("id", "name", "type", "metadata").alias("old"))
    b = new_rows.join(differ, "id", "left_semi").select("id", F.struct("id", "name", "type", "metadata").alias("new"))
    fields = a.join(b, "id").select("id", changed_fields("old", "new").alias("changes"))
    return met.join(fields, "id", "left").select("change", "id", "name", "type", F.coalesce("changes", F.array().cast("array<string>")).alias("changes"))


def edge_drift(current_nodes: DataFrame, current_edges: DataFrame, batch_edges: DataFrame, source: str) -> DataFrame:
    """DR3: (change, id, from_id, to_id, type): edges are compared by id; stored ones count if both ends are of the source."""
    own = current_nodes.where(F.col("source") == source).select(F.col("id").alias("n"))
    old = current_edges.join(own, F.col("from_id") == F.col("n"), "left_semi").join(own, F.col("to_id") == F.col("n"), "left_semi").select("id", "from_id", "to_id", "type")
    new = batch_edges.select("id", "from_id", "to_id", "type").dropDuplicates(["id"])
    gone = old.join(new.select("id"), "id", "left_anti").withColumn("change", F.lit("removed"))
    return new.join(old.select("id"), "id", "left_anti").withColumn("change", F.lit("added")).unionByName(gone).select("change", "id", "from_id", "to_id", "type")


def is_initial(current: DataFrame, source: str) -> bool:
    """DR4: nothing of this source is stored yet."""
    return current.where(F.col("source") == source).isEmpty()


def initial_sources(current: DataFrame, sources: DataFrame) -> DataFrame:
    """DR4 for many sources in one job: rows (source, initial) for rows (source)."""
    known = current.select("source").distinct().withColumn("known", F.lit(True))
    return sources.select("source").distinct().join(known, "source", "left").select("source", F.col("known").isNull().alias("initial"))


def fingerprint(df: DataFrame, skip: tuple[str, ...] = ()) -> Column:
    """128 bits of SHA-256 over all columns; maps as sorted entries."""
    parts = [F.array_sort(F.map_entries(f.name)).alias(f.name) if f.dataType.typeName() == "map" else F.col(f.name) for f in df.schema if f.name not in skip]
    return F.substring(F.unhex(F.sha2(F.to_json(F.struct(*parts)), 256)), 1, 16)


def _changes(cur: DataFrame, base: DataFrame, kind: str) -> DataFrame:
    a = cur.select(F.col("id").alias("a_id"), fingerprint(cur).alias("fa"))
    b = base.select(F.col("id").alias("b_id"), fingerprint(base).alias("fb"))
    change = F.when(F.col("b_id").isNull(), "added").when(F.col("a_id").isNull(), "removed").when(F.col("fa") != F.col("fb"), "changed")
    return a.join(b, F.col("a_id") == F.col("b_id"), "full_outer").select(F.lit(kind).alias("kind"), change.alias("change"), F.coalesce("a_id", "b_id").alias("id")).where("change is not null")


def report_diff(cur: dict[str, DataFrame], base: dict[str, DataFrame]) -> DataFrame:
    """DR5: (kind, change, id) between reports given as nodes, edges and findings.

    Assets by id and edges by id, or by their ends and type where blank: added, removed, changed in any
    column. Findings by (severity, rule, resource): added or resolved.
    """
    out = _changes(cur["nodes"], base["nodes"], "assets")
    named = F.when(F.coalesce(F.col("id"), F.lit("")) == "", edge_id("from_id", "type", "to_id")).otherwise(F.col("id"))
    out = out.unionAll(_changes(cur["edges"].withColumn("id", named), base["edges"].withColumn("id", named), "edges"))
    key = F.concat_ws("|", "severity", "rule", "resource_id").alias("id")
    a, b = cur["findings"].select(key).distinct(), base["findings"].select(key).distinct()
    more = a.join(b, "id", "left_anti").select(F.lit("findings").alias("kind"), F.lit("added").alias("change"), "id")
    less = b.join(a, "id", "left_anti").select(F.lit("findings").alias("kind"), F.lit("resolved").alias("change"), "id")
    return out.unionAll(more).unionAll(less)


def report_diff_summary(diff: DataFrame) -> DataFrame:
    """DR5: one row with the eight counts."""
    kinds = [("assets", c) for c in ("added", "removed", "changed")] + [("edges", c) for c in ("added", "removed", "changed")] + [("findings", c) for c in ("added", "resolved")]
    return diff.agg(*[F.count_if((F.col("kind") == k) & (F.col("change") == c)).alias(f"{k}_{c}") for k, c in kinds])
