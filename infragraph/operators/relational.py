"""Filters, lookups, joins, counts, windows and top rows over nodes and edges (F, J, G, W, O)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from infragraph.functions.scalar import after_last, connection_like, edge_id

SENSITIVE = ("secret", "certificate", "kms_key")


def _equal(df: DataFrame, **wanted: str | None) -> DataFrame:
    for name, value in wanted.items():
        if value:
            df = df.where(F.col(name) == value)
    return df


def list_nodes(nodes: DataFrame, type: str | None = None, source: str | None = None, provider: str | None = None, stale_days: int = 0, as_of: Column | None = None) -> DataFrame:
    """nodes that meet all given filters; stale: last seen more than ``stale_days`` before ``as_of``."""
    out = _equal(nodes, type=type, source=source, provider=provider)
    return out.where(F.col("last_seen") < as_of - F.make_interval(days=F.lit(stale_days))) if stale_days > 0 else out


def list_edges(edges: DataFrame, type: str | None = None, from_id: str | None = None, to_id: str | None = None) -> DataFrame:
    """F2."""
    return _equal(edges, type=type, from_id=from_id, to_id=to_id)


def get_nodes(nodes: DataFrame, ids: DataFrame | list[str]) -> DataFrame:
    """by a short list, or by a DataFrame with a column ``id``."""
    return nodes.where(F.col("id").isin(ids)) if isinstance(ids, list) else nodes.join(ids.select("id"), "id", "left_semi")


def resolve_hostname(nodes: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, id): the first node by (type, name, id) whose name or last id segment is the host."""
    n = nodes.select("id", "name", "type", F.explode(F.array_distinct(F.array(F.col("name"), after_last("id", ":")))).alias("host"))
    best = n.join(hosts.select("host").distinct(), "host").groupBy("host").agg(F.min(F.struct("type", "name", "id")).alias("m"))
    return best.select("host", F.col("m.id").alias("id"))


def search_nodes(nodes: DataFrame, query: str = "", type: str | None = None, source: str | None = None) -> DataFrame:
    """case-insensitive part of id or name."""
    q = query.lower()
    return _equal(nodes, type=type, source=source).where(F.lower("id").contains(q) | F.lower("name").contains(q))


def source_group(source: Column | str) -> Column:
    """F6."""
    s = F.col(source) if isinstance(source, str) else source
    return F.when(s.isin("kubernetes", "kubernetes-live"), "k8s").when(s.isNull() | (s == ""), "unknown").otherwise(s)


def connection_strings(nodes: DataFrame) -> DataFrame:
    """(id, key, value) of metadata that tells how to connect."""
    return nodes.select("id", F.explode("metadata").alias("key", "value")).where((F.col("value") != "") & connection_like("key", "value"))


def mask_sensitive(nodes: DataFrame) -> DataFrame:
    """F8: names of secrets, certificates and keys as up to eight stars and an ellipsis."""
    stars = F.concat(F.expr("repeat('*', least(length(name), 8))"), F.lit("…"))
    return nodes.withColumn("name", F.when(F.col("type").isin(*SENSITIVE), stars).otherwise(F.col("name")))


def both_ways(edges: DataFrame) -> DataFrame:
    """Rows (a, b, type, edge_id, forward) for each edge from either end."""
    there = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), "type", F.col("id").alias("edge_id"), F.lit(True).alias("forward"))
    back = edges.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"), "type", F.col("id").alias("edge_id"), F.lit(False).alias("forward"))
    return there.unionAll(back)


def neighbors(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(root_id, node columns): distinct nodes one hop from each root, either way."""
    roots = ids.select(F.col("id").alias("root_id")).distinct()
    pairs = both_ways(edges).select("a", "b").join(roots, F.col("a") == F.col("root_id")).select("root_id", F.col("b").alias("id")).distinct()
    return pairs.join(nodes, "id")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at no edge's end."""
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id"))
    return nodes.join(ends, "id", "left_anti")


def marked_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` with ``valid``, whether both ends are nodes, in one pass; ids that follow X1 are not shuffled but made again."""
    own = edge_id("from_id", "type", "to_id")
    ids = lambda end: nodes.select(F.col("id").alias(end)).where(F.col(end).isNotNull()).distinct().withColumn(f"has_{end}", F.lit(True))
    short = edges.withColumn("id", F.struct(F.when(~F.col("id").eqNullSafe(own), F.col("id")).alias("other"), F.col("id").isNull().alias("none")))
    marked = short.join(ids("from_id"), "from_id", "left").join(ids("to_id"), "to_id", "left")
    whole = F.when(F.col("id.none"), None).otherwise(F.coalesce("id.other", own))
    valid = F.coalesce(F.col("has_from_id") & F.col("has_to_id"), F.lit(False))
    return marked.select(*[whole.alias("id") if c == "id" else F.col(c) for c in edges.columns], valid.alias("valid"))


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose two ends are nodes, and the others (D6: set apart instead of failing the scan)."""
    marked = marked_edges(nodes, edges)
    return marked.where("valid").drop("valid"), marked.where("not valid").drop("valid")


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in a set of ids."""
    some = ids.select(F.col("id").alias("n")).distinct()
    return edges.join(some, F.col("from_id") == F.col("n"), "left_semi").join(some, F.col("to_id") == F.col("n"), "left_semi")


def connection_evidence(nodes: DataFrame, edges: DataFrame, ids: DataFrame, only_connects_to: bool = False) -> DataFrame:
    """(id, edge_type, direction, peer_id, peer_name, evidence): edges with metadata around each id."""
    some = edges.where(F.col("type") == "connects_to") if only_connects_to else edges
    full = F.filter(F.array_sort(F.map_entries("metadata")), lambda e: F.trim(e["value"]) != "")
    text = F.array_join(F.transform(full, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    e = some.withColumn("evidence", text).where(F.col("evidence") != "")
    out = e.select(F.col("from_id").alias("id"), F.col("type").alias("edge_type"), F.lit("out").alias("direction"), F.col("to_id").alias("peer_id"), "evidence")
    back = e.select(F.col("to_id").alias("id"), F.col("type").alias("edge_type"), F.lit("in").alias("direction"), F.col("from_id").alias("peer_id"), "evidence")
    peers = nodes.select(F.col("id").alias("peer_id"), F.col("name").alias("peer_name"))
    return out.unionAll(back).join(ids.select("id").distinct(), "id").join(peers, "peer_id", "left").select("id", "edge_type", "direction", "peer_id", "peer_name", "evidence")


def visible_edges(nodes: DataFrame, edges: DataFrame, node_filter: Column, off_types: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Edges between nodes that pass the filter, of types not switched off; and (visible, total)."""
    ids = nodes.where(node_filter).select("id")
    seen = induced_edges(edges.where(~F.col("type").isin(*off_types)) if off_types else edges, ids)
    return seen, seen.agg(F.count(F.lit(1)).alias("visible")).crossJoin(edges.agg(F.count(F.lit(1)).alias("total")))  # one row each


def node_counts(nodes: DataFrame, by: str = "type") -> DataFrame:
    """G1: counts by type, source, or namespace (metadata, ``default`` without)."""
    key = F.coalesce(F.nullif(F.col("metadata")["namespace"], F.lit("")), F.lit("default")) if by == "namespace" else F.col(by)
    return nodes.groupBy(key.alias(by)).agg(F.count(F.lit(1)).alias("n"))


def edge_counts(edges: DataFrame) -> DataFrame:
    """G2."""
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def _as_map(counts: DataFrame, key: str, name: str) -> DataFrame:
    """One row with the counts as a map; the keys are the few types of the vocabulary."""
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name), F.coalesce(F.sum("n"), F.lit(0)).alias(f"{name}_total"))


def stats(nodes: DataFrame, edges: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """One row: totals, both maps, certificates that expire within ``days``."""
    certs = expiring_within(nodes, days, as_of).agg(F.count(F.lit(1)).alias("expiring_certs"))
    out = _as_map(node_counts(nodes), "type", "nodes_by_type").crossJoin(_as_map(edge_counts(edges), "type", "edges_by_type")).crossJoin(certs)  # one row each
    return out.withColumnsRenamed({"nodes_by_type_total": "nodes_total", "edges_by_type_total": "edges_total"})


def expiring_within(nodes: DataFrame, days: int, as_of: Column) -> DataFrame:
    """Certificates with ``as_of <= expires_at <= as_of + days``."""
    return nodes.where((F.col("type") == "certificate") & F.col("expires_at").between(as_of, as_of + F.make_interval(days=F.lit(days))))


def scan_status_counts(scans: DataFrame, limit: int = 1000) -> DataFrame:
    """(status, n) over the latest ``limit`` scans."""
    return latest_scans(scans, limit).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def audit_summary(findings: DataFrame) -> DataFrame:
    """G5."""
    return findings.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")])


def worst_severity(findings: DataFrame) -> DataFrame:
    """For each resource its worst severity and the rules that fired, sorted."""
    rank = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "warning", 2).otherwise(1)
    return findings.groupBy("resource_id").agg(F.max_by("severity", rank).alias("severity"), F.sort_array(F.collect_list("rule")).alias("rules"))


def parallel_edges(edges: DataFrame) -> DataFrame:
    """Edges for each unordered pair of nodes."""
    return edges.groupBy(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the last by ``order``; a combinable aggregate, so hot keys do not gather."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in df.columns])


def top_key(votes: DataFrame, group: str, key: str, count: Column | None = None) -> DataFrame:
    """For each group the key with most rows (or most of ``count``), ties to the smallest key."""
    n = votes.groupBy(group, key).agg((F.count(F.lit(1)) if count is None else count).alias("n"))
    return n.groupBy(group).agg(F.min(F.struct(-F.col("n"), F.col(key).alias("k"))).alias("m")).select(group, F.col("m.k").alias(key))


def latest_scans(scans: DataFrame, n: int = 10) -> DataFrame:
    """O1."""
    return scans.orderBy(F.desc("id")).limit(n)


def sample_nodes(nodes: DataFrame, n: int = 20) -> DataFrame:
    """O2: the first ``n`` by id, all if negative."""
    return nodes.orderBy("id").limit(n) if n >= 0 else nodes.orderBy("id")


def diff_preview(ids: DataFrame, group: str, n: int = 10) -> DataFrame:
    """O3: for each list its first ``n`` ids and how many are left over."""
    ranked = ids.selectExpr("*", f"row_number() over (partition by {group} order by id) as place")
    top = ranked.where(F.col("place") <= n).groupBy(group).agg(F.array_sort(F.collect_list("id")).alias("first"))
    return top.join(ids.groupBy(group).agg((F.greatest(F.count(F.lit(1)) - n, F.lit(0))).alias("more")), group)
