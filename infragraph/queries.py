"""Registered queries over the driver's tables as an asset graph, with the same questions in DuckDB SQL.

Each entry of ``CASES`` is one or more operators of the library on whole tables; arrays and maps are
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from infragraph.functions.scalar import days_until, edge_id, image_uses_latest, normalize_cycle, potential_hosts
from infragraph.operators import audit as A
from infragraph.operators import certs as E
from infragraph.operators import correlate as C
from infragraph.operators import relational as R
from infragraph.operators import state as S
from infragraph.operators import traverse as T
from infragraph.plans.table_graph import SQL, TRADE_SQL, as_of, graph_edges, graph_nodes, table, trade_edges
from infragraph.sources import store


class Case(NamedTuple):
    query: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CASES: dict[str, Case] = {}
AT = "TIMESTAMP '1998-01-01'"


def case(sql: str | None, base: str = SQL) -> Callable[[Callable[[DataFrame, DataFrame], DataFrame]], Callable[[DataFrame, DataFrame], DataFrame]]:
    """Registers a function of (nodes, edges); ``sql`` follows the graph's common table expressions."""

    def add(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, DataFrame], DataFrame]:
        CASES[f.__name__] = Case(lambda spark, d, f=f: f(graph_nodes(spark, d), graph_edges(spark, d)), None if sql is None else base + sql)
        return f

    return add


def direct(sql: str | None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    """Registers a function of (spark, sf_dir)."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        CASES[f.__name__] = Case(f, sql)
        return f

    return add


def joined(c: Column | str) -> Column:
    return F.array_join(F.array_sort(F.col(c) if isinstance(c, str) else c), ",")


def map_text(c: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


def regions(nodes: DataFrame) -> DataFrame:
    return nodes.where("type = 'network'").select("id")


# ---- filters, lookups, joins, counts


@case(f"SELECT id, name, type, source FROM nodes WHERE source = 'compose' AND last_seen < {AT} - INTERVAL 90 DAY")
def f1_list_nodes(nodes, edges):
    return R.list_nodes(nodes, source="compose", stale_days=90, as_of=as_of()).select("id", "name", "type", "source")


@case("SELECT id, from_id, to_id FROM edges WHERE type = 'mounts_secret'")
def f2_list_edges(nodes, edges):
    return R.list_edges(edges, type="mounts_secret").select("id", "from_id", "to_id")


@case("SELECT id, name FROM nodes WHERE id IN (SELECT to_id FROM edges WHERE type = 'routes_to')")
def f3_get_nodes(nodes, edges):
    return R.get_nodes(nodes, R.list_edges(edges, type="routes_to").select(F.col("to_id").alias("id"))).select("id", "name")


@case(""", hosts AS (SELECT n_name AS host FROM nation UNION SELECT c_name FROM customer),
cand AS (SELECT DISTINCT id, name, type, h AS host FROM (SELECT id, name, type, unnest([name, split_part(id, ':', -1)]) AS h FROM nodes))
SELECT host, id FROM cand JOIN hosts USING (host) QUALIFY row_number() OVER (PARTITION BY host ORDER BY type, name, id) = 1""")
def f4_resolve_hostname(nodes, edges):
    hosts = nodes.where("type in ('subnet', 'vm')").select(F.col("name").alias("host"))
    return R.resolve_hostname(nodes, hosts)


@case("SELECT id, name FROM nodes WHERE (contains(lower(id), 'ring') OR contains(lower(name), 'ring')) AND source = 'pulumi'")
def f5_search_nodes(nodes, edges):
    return R.search_nodes(nodes, "RING", source="pulumi").select("id", "name")


@case("SELECT CASE WHEN source IN ('kubernetes', 'kubernetes-live') THEN 'k8s' WHEN source IS NULL OR source = '' THEN 'unknown' ELSE source END AS source_group, count(*) AS n FROM nodes GROUP BY 1")
def f6_source_group(nodes, edges):
    return nodes.groupBy(R.source_group("source").alias("source_group")).agg(F.count(F.lit(1)).alias("n"))


@case("SELECT id, 'api_url' AS key, md['api_url'] AS value FROM nodes WHERE md['api_url'] IS NOT NULL")
def f7_connection_strings(nodes, edges):
    return R.connection_strings(nodes)


@case("SELECT id, CASE WHEN type IN ('secret', 'certificate', 'kms_key') THEN repeat('*', least(length(name), 8)) || '…' ELSE name END AS name FROM nodes")
def f8_mask_sensitive(nodes, edges):
    return R.mask_sensitive(nodes).select("id", "name")


@case(", u AS (SELECT from_id AS a, to_id AS b FROM edges UNION SELECT to_id, from_id FROM edges) SELECT a AS root_id, b AS id, name, type FROM u JOIN nodes ON b = id WHERE a LIKE 'tf:subnet:%'")
def j1_neighbors(nodes, edges):
    return R.neighbors(nodes, edges, nodes.where("type = 'subnet'").select("id")).select("root_id", "id", "name", "type")


@case("SELECT id, type FROM nodes WHERE id NOT IN (SELECT from_id FROM edges) AND id NOT IN (SELECT to_id FROM edges)")
def j2_orphans(nodes, edges):
    return R.orphans(nodes, edges).select("id", "type")


@case(", picked AS (SELECT id FROM nodes WHERE type <> 'database') SELECT e.id, e.from_id IN (SELECT id FROM picked) AND e.to_id IN (SELECT id FROM picked) AS valid FROM edges e")
def j3_dangling_edges(nodes, edges):
    return R.marked_edges(nodes.where("type <> 'database'"), edges).select("id", "valid")


@case(", picked AS (SELECT id FROM nodes WHERE type IN ('vm', 'subnet', 'network')) SELECT id, type FROM edges WHERE from_id IN (SELECT id FROM picked) AND to_id IN (SELECT id FROM picked)")
def j4_induced_edges(nodes, edges):
    return R.induced_edges(edges, nodes.where("type in ('vm', 'subnet', 'network')").select("id")).select("id", "type")


@case(", x AS (SELECT from_id AS id, type, 'out' AS direction, to_id AS peer_id FROM edges UNION ALL SELECT to_id, type, 'in', from_id FROM edges) SELECT x.id, x.type AS edge_type, direction, peer_id, p.name AS peer_name, 'via=tables' AS evidence FROM x JOIN nodes p ON p.id = peer_id WHERE x.id LIKE 'k8s:service:%' AND x.type = 'connects_to'")
def j5_connection_evidence(nodes, edges):
    return R.connection_evidence(nodes, edges, nodes.where("type = 'service'").select("id"), only_connects_to=True)


@case(", picked AS (SELECT id FROM nodes WHERE source <> 'compose') SELECT (SELECT count(*) FROM edges WHERE type <> 'member_of' AND from_id IN (SELECT id FROM picked) AND to_id IN (SELECT id FROM picked)) AS visible, (SELECT count(*) FROM edges) AS total")
def j6_visible_edges(nodes, edges):
    return R.visible_edges(nodes, edges, F.col("source") != "compose", ("member_of",))[1]


@case("""SELECT 'type' AS by, type AS value, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM nodes GROUP BY 2
UNION ALL SELECT 'namespace', coalesce(nullif(md['namespace'], ''), 'default'), count(*) FROM nodes GROUP BY 2""")
def g1_node_counts(nodes, edges):
    parts = [R.node_counts(nodes, by).select(F.lit(by).alias("by"), F.col(by).alias("value"), "n") for by in ("type", "source", "namespace")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@case("SELECT type, count(*) AS n FROM edges GROUP BY 1")
def g2_edge_counts(nodes, edges):
    return R.edge_counts(edges)


@case(f""", a AS (SELECT type, count(*) AS n FROM nodes GROUP BY 1), b AS (SELECT type, count(*) AS n FROM edges GROUP BY 1)
SELECT (SELECT CAST(sum(n) AS BIGINT) FROM a) AS nodes_total, (SELECT string_agg(type || '=' || n, ',' ORDER BY type) FROM a) AS nodes_by_type,
(SELECT CAST(sum(n) AS BIGINT) FROM b) AS edges_total, (SELECT string_agg(type || '=' || n, ',' ORDER BY type) FROM b) AS edges_by_type,
(SELECT count(*) FROM nodes WHERE type = 'certificate' AND expires_at BETWEEN {AT} AND {AT} + INTERVAL 30 DAY) AS expiring_certs""")
def g3_stats(nodes, edges):
    return R.stats(nodes, edges, as_of()).select("nodes_total", map_text("nodes_by_type").alias("nodes_by_type"), "edges_total", map_text("edges_by_type").alias("edges_by_type"), "expiring_certs")


@case("SELECT least(from_id, to_id) AS a, greatest(from_id, to_id) AS b, count(*) AS n FROM edges GROUP BY 1, 2")
def g7_parallel_edges(nodes, edges):
    return R.parallel_edges(edges)


def scans_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scans: errors are failed runs, purchases completed ones, others are running."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("running")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("user-"), "user_id").alias("source"), F.lit("/").alias("source_path"), F.col("ts").alias("started_at"), F.col("ts").alias("finished_at"), F.lit(1).cast("long").alias("nodes_found"), F.lit(0).cast("long").alias("edges_found"), status.alias("status"))


STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'running' END"


@direct(f"SELECT status, count(*) AS n FROM (SELECT {STATUS} AS status FROM events ORDER BY event_id DESC LIMIT 1000) GROUP BY 1")
def g4_scan_status_counts(spark, sf_dir):
    return R.scan_status_counts(scans_of(spark, sf_dir), 1000)


@direct(f"SELECT event_id AS id, {STATUS} AS status FROM events ORDER BY event_id DESC LIMIT 10")
def o1_latest_scans(spark, sf_dir):
    return R.latest_scans(scans_of(spark, sf_dir), 10).select("id", "status")


@case("SELECT id, type FROM nodes ORDER BY id LIMIT 20")
def o2_sample_nodes(nodes, edges):
    return R.sample_nodes(nodes, 20).select("id", "type")


@case(", r AS (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY id) AS p FROM nodes) SELECT type, string_agg(id, ',' ORDER BY id) FILTER (p <= 10) AS first, greatest(count(*) - 10, 0) AS more FROM r GROUP BY 1")
def o3_diff_preview(nodes, edges):
    return R.diff_preview(nodes.select("type", "id"), "type").select("type", joined("first").alias("first"), "more")


@direct("SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def w1_last_wins(spark, sf_dir):
    return R.last_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@direct("SELECT user_id, event_type FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def w3_top_key(spark, sf_dir):
    return R.top_key(table(spark, sf_dir, "events"), "user_id", "event_type")


# ---- traversal

BLAST = ", up AS (SELECT id AS root_id, id AS node_id, 0 AS depth FROM nodes WHERE type = 'network' UNION SELECT root_id, from_id, depth + 1 FROM up JOIN edges ON to_id = node_id)"


@case(BLAST + " SELECT root_id, node_id, min(depth) AS depth FROM up WHERE node_id <> root_id GROUP BY 1, 2")
def t1_blast_radius(nodes, edges):
    return T.blast_radius(nodes, edges, regions(nodes), paths=False).select("root_id", "node_id", "depth")


@case(BLAST + """, d AS (SELECT DISTINCT root_id, node_id FROM up WHERE node_id <> root_id), k AS (SELECT root_id, type, count(*) AS n FROM d JOIN nodes ON id = node_id GROUP BY 1, 2)
SELECT root_id, CAST(sum(n) AS BIGINT) AS affected, string_agg(type || '=' || n, ',' ORDER BY type) AS by_type FROM k GROUP BY 1""")
def t2_blast_summary(nodes, edges):
    roots = regions(nodes)
    return T.blast_summary(T.blast_radius(nodes, edges, roots, paths=False), nodes, roots).select("root_id", "affected", map_text("by_type").alias("by_type"))


@case(BLAST + ", f AS (SELECT root_id, node_id, min(depth) AS depth FROM up WHERE node_id <> root_id GROUP BY 1, 2) SELECT root_id, depth, count(*) AS n FROM f GROUP BY 1, 2")
def t3_impact_tree(nodes, edges):
    """Children of the impact tree, counted by their depth."""
    rows = T.blast_radius(nodes, edges, regions(nodes), paths=False, parents=True)
    depth = rows.select("root_id", F.col("node_id").alias("parent_id"), "depth").unionAll(regions(nodes).select(F.col("id").alias("root_id"), F.col("id").alias("parent_id"), F.lit(0).alias("depth")))
    return T.impact_tree(rows).join(depth, ["root_id", "parent_id"]).groupBy("root_id", (F.col("depth") + 1).alias("depth")).agg(F.sum("n_children").alias("n"))


@case("""SELECT n.id AS root_id, n.id AS node_id, CAST(trunc((epoch_us(expires_at) - epoch_us(TIMESTAMP '1998-01-01')) / 86400000000) AS INTEGER) AS days FROM nodes n
WHERE type = 'certificate' AND expires_at IS NOT NULL AND trunc((epoch_us(expires_at) - epoch_us(TIMESTAMP '1998-01-01')) / 86400000000) <= 30""")
def t4_impact_warnings(nodes, edges):
    roots = nodes.where("type = 'certificate'").select("id")
    return T.impact_warnings(T.blast_radius(nodes, edges, roots, paths=False), nodes, as_of(), roots)


@case(", down AS (SELECT id AS root_id, id AS node_id, 0 AS depth FROM nodes WHERE type = 'ingress' UNION SELECT root_id, to_id, depth + 1 FROM down JOIN edges ON from_id = node_id WHERE depth < 2) SELECT root_id, node_id, min(depth) AS depth FROM down WHERE node_id <> root_id GROUP BY 1, 2")
def t5_dependency_chain(nodes, edges):
    return T.dependency_chain(edges, nodes.where("type = 'ingress'").select("id"), 2).select("root_id", "node_id", "depth")


CLOSURE = ", c AS (SELECT to_id AS root_id, from_id AS node_id FROM edges UNION SELECT c.root_id, e.from_id FROM c JOIN edges e ON e.to_id = c.node_id)"


@case(CLOSURE + ", k AS (SELECT root_id AS id, type, count(*) AS n FROM c JOIN nodes ON id = node_id WHERE root_id <> node_id GROUP BY 1, 2) SELECT id, CAST(sum(n) AS BIGINT) AS affected, string_agg(type || '=' || n, ',' ORDER BY type) AS by_type FROM k GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def t6_spof(nodes, edges):
    return T.spof(nodes, edges).select("id", "affected", map_text("by_type").alias("by_type"))


@case(CLOSURE + ", k AS (SELECT root_id AS id, count(*) AS n FROM c WHERE root_id <> node_id GROUP BY 1) SELECT id, true AS near FROM k")
def t7_spof_approx(nodes, edges):
    """Every node of the exact ranking, and whether its sketched count is within a tenth of the exact one."""
    exact = T.reach_counts(nodes, edges).select("id", F.col("affected").alias("n"))
    found = T.spof_approx(nodes, edges, limit=0).join(exact, "id")
    return found.select("id", (F.abs(F.col("affected") - F.col("n")) <= F.greatest(F.lit(2), F.col("n") * 0.1)).alias("near"))


@case(""", u AS (SELECT from_id AS a, to_id AS b FROM edges UNION SELECT to_id, from_id FROM edges),
p AS (SELECT id AS from_id, id AS node_id, 0 AS depth FROM nodes WHERE type = 'network' UNION SELECT from_id, b, depth + 1 FROM p JOIN u ON a = node_id WHERE depth < 6)
SELECT x.id AS from_id, y.id AS to_id, CAST((SELECT min(depth) FROM p WHERE p.from_id = x.id AND p.node_id = y.id) AS INTEGER) AS hops FROM nodes x JOIN nodes y ON x.id < y.id WHERE x.type = 'network' AND y.type = 'network'""")
def t8_shortest_path(nodes, edges):
    r = regions(nodes)
    pairs = r.select(F.col("id").alias("from_id")).join(r.select(F.col("id").alias("to_id")), F.col("from_id") < F.col("to_id"))
    return T.shortest_path(edges, pairs).groupBy("from_id", "to_id").agg(F.max("step").alias("hops"))


@direct(TRADE_SQL + """, walk AS (SELECT from_id AS first_id, to_id AS cur, [from_id] AS path FROM trade UNION ALL SELECT first_id, to_id, list_append(path, cur) FROM walk JOIN trade ON from_id = cur WHERE cur <> first_id AND NOT list_contains(path, cur))
SELECT array_to_string(path, ',') AS cycle, CAST(len(path) AS INTEGER) AS length FROM walk WHERE cur = first_id AND first_id = list_min(path)""")
def t9_find_cycles(spark, sf_dir):
    return T.find_cycles(trade_edges(spark, sf_dir), limit=0).select(F.array_join("cycle", ",").alias("cycle"), "length")


@case("""SELECT 'tf:subnet:' || n_name AS root_id, count(*) AS n FROM nation, nodes WHERE type NOT IN ('firewall_rule', 'bucket', 'certificate') AND id <> 'tf:subnet:' || n_name
AND (type <> 'secret' OR id IN (SELECT to_id FROM edges)) AND (type <> 'ingress' OR id IN (SELECT from_id FROM edges)) AND (type <> 'database' OR id IN (SELECT to_id FROM edges)) GROUP BY 1""")
def t10_reachable_undirected(nodes, edges):
    """The graph is one component, apart from nodes without edges."""
    return T.reachable_undirected(edges, nodes.where("type = 'subnet'").select("id")).groupBy("root_id").agg(F.count(F.lit(1)).alias("n"))


@case("""SELECT 'tf:subnet:' || n_name AS root_id, n_nationkey IN (SELECT s_nationkey FROM supplier) AS exposed, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 'k8s:ingress:default/' || n_name END AS entry_id FROM nation""")
def t12_external_exposure(nodes, edges):
    return T.external_exposure(nodes, edges, nodes.where("type = 'subnet'").select("id")).select("root_id", "exposed", "entry_id")


@case("""SELECT root_id, node_id, 'up' AS way FROM (SELECT to_id AS root_id, from_id AS node_id FROM edges) WHERE root_id LIKE 'tf:subnet:%'
UNION ALL SELECT DISTINCT from_id, to_id, 'down' FROM edges WHERE from_id LIKE 'tf:subnet:%'""")
def t13_focus(nodes, edges):
    roots = nodes.where("type = 'subnet'").select("id")
    up = T.focus_upstream(nodes, edges, roots, 1).select("root_id", "node_id", F.lit("up").alias("way"))
    return up.unionAll(T.focus_downstream(edges, roots, 1).select("root_id", "node_id", F.lit("down").alias("way")))


@case(BLAST.replace("type = 'network'", "type = 'subnet'") + """, k AS (SELECT root_id, count(DISTINCT node_id) AS n FROM up WHERE node_id <> root_id GROUP BY 1)
SELECT 'tf:subnet:' || n_name AS id, CASE n_nationkey % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'update' ELSE 'delete' END AS action, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE coalesce(n, 0) END AS affected FROM nation LEFT JOIN k ON root_id = 'tf:subnet:' || n_name""")
def t14_plan_impact(nodes, edges):
    key = F.regexp_extract("name", r"(\d+)$", 1).cast("int") % 3
    planned = F.when(F.col("type") == "subnet", F.create_map(F.lit("plan_action"), F.when(key == 0, "create").when(key == 1, "update").otherwise("delete"))).otherwise(F.col("metadata"))
    n = nodes.withColumn("metadata", planned).withColumn("source", F.when(F.col("type") == "subnet", "terraform-plan").otherwise(F.col("source")))
    return T.plan_impact(n, edges).select("id", "action", "affected")


# ---- state, drift


def changed_nodes(nodes: DataFrame) -> DataFrame:
    """A later scan of Terraform: subnets gone, one kind of bucket changed, machines renamed in lower case."""
    n = nodes.where("source = 'terraform' and type <> 'subnet'")
    n = n.withColumn("name", F.when(F.col("type") == "vm", F.lower("name")).otherwise(F.col("name")))
    meta = F.when(F.col("type") == "bucket", F.create_map(F.lit("acl"), F.lit("private"))).otherwise(F.col("metadata"))
    return n.withColumn("metadata", meta).withColumn("last_seen", as_of() + F.expr("interval 1 day")).withColumn("first_seen", F.col("last_seen"))


@case(""", b AS (SELECT * REPLACE (CASE WHEN type = 'vm' THEN lower(name) ELSE name END AS name) FROM nodes WHERE source = 'terraform' AND type <> 'subnet')
SELECT n.id, coalesce(b.name, n.name) AS name, n.type, b.id IS NOT NULL AS touched FROM nodes n LEFT JOIN b USING (id)""")
def u1_upsert_nodes(nodes, edges):
    up = S.upsert_nodes(nodes, changed_nodes(nodes))
    return up.select("id", "name", "type", (F.col("first_seen") < F.col("last_seen")).alias("touched"))


@case("SELECT id, type, CASE WHEN type = 'member_of' THEN 'new' ELSE 'tables' END AS via FROM edges")
def u2_upsert_edges(nodes, edges):
    batch = edges.where("type = 'member_of'").withColumn("metadata", F.create_map(F.lit("via"), F.lit("new"))).withColumn("id", F.concat(F.lit("other-"), "id"))
    return S.upsert_edges(edges, batch).select("id", "type", F.col("metadata")["via"].alias("via"))


@case(", gone AS (SELECT id FROM nodes WHERE source = 'kubernetes') SELECT 'node' AS kind, id FROM nodes WHERE source <> 'kubernetes' UNION ALL SELECT 'edge', id FROM edges WHERE from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone)")
def p1_prune(nodes, edges):
    n, e = S.prune(nodes, edges, source="kubernetes")
    return n.select(F.lit("node").alias("kind"), "id").unionAll(e.select(F.lit("edge").alias("kind"), "id"))


@case("""SELECT CASE WHEN type = 'subnet' THEN 'removed' ELSE 'modified' END AS change, id, CASE WHEN type = 'vm' THEN lower(name) ELSE name END AS name, type,
CASE WHEN type = 'vm' THEN 'name' WHEN type = 'bucket' THEN 'metadata.acl' || CASE WHEN md['encrypted'] IS NOT NULL THEN ',metadata.encrypted' ELSE '' END ELSE '' END AS changes
FROM nodes WHERE source = 'terraform' AND type IN ('subnet', 'vm', 'bucket')""")
def dr1_node_drift(nodes, edges):
    """With DR2: the changed fields of each modified node."""
    return S.node_drift(nodes, changed_nodes(nodes), "terraform").select("change", "id", "name", "type", F.array_join("changes", ",").alias("changes"))


@case("""SELECT CASE WHEN type = 'depends_on' THEN 'removed' ELSE 'added' END AS change, CASE WHEN type = 'depends_on' THEN id ELSE replace(id, 'connects_to', 'routes_to') END AS id
FROM edges WHERE from_id LIKE 'tf:%' AND to_id LIKE 'tf:%' UNION ALL SELECT 'removed', id FROM edges WHERE from_id LIKE 'tf:subnet%'""")
def dr3_edge_drift(nodes, edges):
    batch = edges.where("from_id like 'tf:subnet%'").withColumn("id", F.replace("id", F.lit("connects_to"), F.lit("routes_to"))).withColumn("type", F.lit("routes_to"))
    some = nodes.where("id like 'tf:%'").withColumn("source", F.lit("terraform"))
    return S.edge_drift(some, edges, batch, "terraform").select("change", "id")


@case(""", f AS (SELECT count(*) FILTER (type = 'subnet') AS gone, count(*) FILTER (type IN ('vm', 'bucket', 'firewall_rule', 'network')) AS chg FROM nodes WHERE source = 'terraform')
SELECT CAST(0 AS BIGINT) AS assets_added, gone AS assets_removed, (SELECT count(*) FROM nodes WHERE source = 'terraform' AND type <> 'subnet') AS assets_changed, CAST(0 AS BIGINT) AS edges_added, (SELECT count(*) FROM edges WHERE type = 'member_of') AS edges_removed, CAST(0 AS BIGINT) AS edges_changed FROM f""")
def dr5_report_diff(nodes, edges):
    findings = nodes.sparkSession.createDataFrame([], "severity string, rule string, resource_id string")
    cur = {"nodes": nodes.where("source <> 'terraform'").unionByName(changed_nodes(nodes)), "edges": edges.where("type <> 'member_of'"), "findings": findings}
    d = S.report_diff_summary(S.report_diff(cur, {"nodes": nodes, "edges": edges, "findings": findings}))
    return d.select(*[F.col(f"{k}_{c}").cast("long").alias(f"{k}_{c}") for k in ("assets", "edges") for c in ("added", "removed", "changed")])


# ---- correlation

KEYS = """, v AS (SELECT id, source, unnest([name, split_part(name, '/', -1), split_part(name, '@', -1), split_part(name, ':', -1), coalesce(md['host'], ''), split_part(coalesce(md['host'], ''), '/', -1)]) AS x FROM nodes
  WHERE type IN ('vm', 'container', 'pod', 'service', 'ingress', 'load_balancer', 'database', 'bucket', 'dns_record', 'secret', 'ip_address', 'queue', 'nosql_database', 'function', 'api_gateway')),
keys AS (SELECT DISTINCT id AS node_id, source, trim(regexp_replace(lower(trim(x)), '[^\\p{L}\\p{Nd}]+', '-', 'g'), '-') AS key FROM v WHERE x <> ''),
ks AS (SELECT * FROM keys WHERE length(key) >= 2)"""


@case(KEYS + " SELECT node_id, source, key FROM ks")
def c1_correlation_keys(nodes, edges):
    return C.correlation_keys(nodes)


PAIRS = KEYS + """, g AS (SELECT key, count(*) AS n, count(DISTINCT source) AS s FROM ks GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT source) >= 2),
pr AS (SELECT a.node_id AS from_id, b.node_id AS to_id, min(a.key) AS key FROM ks a JOIN ks b ON a.key = b.key AND a.node_id < b.node_id AND a.source <> b.source GROUP BY 1, 2)"""


@case(PAIRS + " SELECT from_id || '->correlates_with->' || to_id AS id, key, CASE WHEN n >= 3 AND s >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM pr JOIN g USING (key)")
def c2_correlate(nodes, edges):
    made = C.correlate(nodes, edges)
    return made.select("id", F.col("metadata")["key"].alias("key"), F.col("metadata")["confidence"].alias("confidence"))


@case(PAIRS + """, m AS (SELECT DISTINCT key, node_id, source FROM ks WHERE key IN (SELECT key FROM pr))
SELECT key, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, string_agg(node_id, ',' ORDER BY node_id) AS node_ids, count(*) AS n FROM m GROUP BY 1""")
def c3_correlated_groups(nodes, edges):
    """On these tables every group has one key."""
    return C.correlated_groups(nodes, edges, C.link_counts(nodes, edges)).select("key", joined("sources").alias("sources"), joined("node_ids").alias("node_ids"), "n")


@case(PAIRS + " SELECT (SELECT count(DISTINCT key) FROM pr) AS groups, (SELECT count(*) FROM pr) AS edges_added")
def c4_correlation_summary(nodes, edges):
    made = C.link_counts(nodes, edges)
    return C.correlation_summary(made, C.correlated_groups(nodes, edges, made))


# ---- audit, certificates, report

FINDINGS = """, f AS (
SELECT 'critical' AS severity, 'public-database' AS rule, id AS resource_id FROM nodes WHERE type = 'database' AND md['publicly_accessible'] = 'true'
UNION ALL SELECT 'critical', 'unencrypted-storage', id FROM nodes WHERE type IN ('database', 'bucket', 'disk') AND coalesce(nullif(md['encrypted'], ''), nullif(md['storage_encrypted'], ''), md['StorageEncrypted']) = 'false'
UNION ALL SELECT 'critical', 'permissive-firewall', id FROM nodes WHERE type = 'firewall_rule' AND contains(md['ingress_cidrs'], '0.0.0.0/0')
UNION ALL SELECT 'warning', 'no-deletion-protection', id FROM nodes WHERE type = 'database' AND md['deletion_protection'] = 'false'
UNION ALL SELECT 'warning', 'single-az-database', id FROM nodes WHERE type = 'database' AND md['MultiAZ'] = 'false'
UNION ALL SELECT 'critical', 'public-bucket', id FROM nodes WHERE type = 'bucket' AND md['acl'] IN ('public-read', 'public-read-write', 'authenticated-read')
UNION ALL SELECT 'critical', 'privileged-container', id FROM nodes WHERE type = 'pod' AND md['security.app.privileged'] = 'true'
UNION ALL SELECT 'critical', 'host-namespace', id FROM nodes WHERE type = 'pod' AND md['security.host_network'] = 'true'
UNION ALL SELECT 'info', 'public-load-balancer', id FROM nodes WHERE type = 'service' AND md['service_type'] = 'LoadBalancer'
UNION ALL SELECT 'info', 'orphan-secret', id FROM nodes WHERE type = 'secret' AND id NOT IN (SELECT to_id FROM edges WHERE type = 'mounts_secret')
UNION ALL SELECT 'warning', 'public-instance', id FROM nodes WHERE type = 'vm' AND md['public_ip'] IS NOT NULL
UNION ALL SELECT 'warning', 'run-as-root', id FROM nodes WHERE type = 'pod' AND md['security.app.run_as_non_root'] = 'false'
UNION ALL SELECT 'warning', 'unencrypted-ingress', id FROM nodes WHERE type = 'ingress' AND md['tls'] IS NULL
UNION ALL SELECT 'info', 'missing-resource-limits', id FROM nodes WHERE type = 'pod' AND md['resources_limits.cpu'] IS NULL
UNION ALL SELECT 'info', 'absent-encryption-config', id FROM nodes WHERE type IN ('database', 'disk') AND coalesce(md['encrypted'], md['storage_encrypted'], md['StorageEncrypted']) IS NULL
UNION ALL SELECT 'warning', 'mutable-container-image', id FROM nodes WHERE type = 'container' AND md['image'] LIKE '%:latest'
UNION ALL SELECT 'info', 'compose-missing-init', id FROM nodes WHERE source = 'compose' AND (md['ports'] IS NOT NULL OR md['healthcheck'] IS NOT NULL) AND coalesce(md['init'], '') <> 'true'
UNION ALL SELECT 'info', 'exposed-service-no-healthcheck', id FROM nodes WHERE source = 'compose' AND md['ports'] IS NOT NULL AND coalesce(md['healthcheck'], '') <> 'true')"""


@case(FINDINGS + " SELECT severity, rule, resource_id FROM f")
def a21_audit(nodes, edges):
    """All rules A1 to A20."""
    return A.audit(nodes, edges).select("severity", "rule", "resource_id")


@case(FINDINGS + " SELECT rule, severity, count(*) AS n FROM f WHERE resource_id IN (SELECT id FROM nodes WHERE type IN ('database', 'pod')) GROUP BY 1, 2")
def a21_audit_for(nodes, edges):
    some, _ = A.audit_for(A.audit(nodes, edges), nodes.where("type in ('database', 'pod')").select("id"))
    return some.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


@case("SELECT id AS resource_id, 'Secret is not mounted by any workload' AS description FROM nodes WHERE type = 'secret' AND id NOT IN (SELECT to_id FROM edges WHERE type = 'mounts_secret')")
def a10_orphan_secret(nodes, edges):
    return A.orphan_secrets(nodes, edges).select("resource_id", "description")


@case(FINDINGS + " SELECT level, count(*) FILTER (level = 'info' OR severity = 'critical' OR (level = 'warning' AND severity = 'warning')) AS failures FROM f, (SELECT unnest(['critical', 'warning', 'info']) AS level) GROUP BY 1")
def a22_severity_gate(nodes, edges):
    found = A.audit(nodes, edges)
    parts = [A.severity_gate(found, x).select(F.lit(x).alias("level"), "failures") for x in ("critical", "warning", "info")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@case(FINDINGS + " SELECT count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM f")
def g5_audit_summary(nodes, edges):
    return R.audit_summary(A.audit(nodes, edges))


@case(FINDINGS + " SELECT resource_id, max_by(severity, CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END) AS severity, string_agg(rule, ',' ORDER BY rule) AS rules FROM f GROUP BY 1")
def g6_worst_severity(nodes, edges):
    return R.worst_severity(A.audit(nodes, edges)).select("resource_id", "severity", joined("rules").alias("rules"))


DAYS = "CAST(trunc((epoch_us(expires_at) - epoch_us(TIMESTAMP '1998-01-01')) / 86400000000) AS INTEGER)"


@case(f"SELECT id, coalesce({DAYS}, -1) AS days_remaining, CASE WHEN expires_at IS NULL THEN 'unknown' WHEN {DAYS} < 0 THEN 'expired' WHEN {DAYS} <= 7 THEN 'critical' WHEN {DAYS} <= 30 THEN 'warning' ELSE 'ok' END AS status FROM nodes WHERE type = 'certificate'")
def e1_list_certs(nodes, edges):
    return E.list_certs(nodes, as_of()).select("id", "days_remaining", "status")


@case(f"SELECT id, {DAYS} AS days_remaining FROM nodes WHERE type = 'certificate' AND expires_at BETWEEN {AT} AND {AT} + INTERVAL 365 DAY")
def e2_expiring_certs(nodes, edges):
    return E.expiring_certs(nodes, 365, as_of()).select("id", "days_remaining")


@case("SELECT DISTINCT md['host'] || ':443' AS endpoint FROM nodes WHERE type = 'ingress'")
def e3_discover_endpoints(nodes, edges):
    return E.discover_endpoints(nodes)


@case(f"SELECT id, CASE WHEN {DAYS} < 0 THEN 'expired' WHEN {DAYS} <= 7 THEN 'critical' ELSE 'warning' END AS severity, 'cert_expiring' AS event_type FROM nodes WHERE type = 'certificate' AND {DAYS} <= 30")
def e4_cert_alerts(nodes, edges):
    return E.cert_alerts(E.list_certs(nodes, as_of()), as_of()).select(F.col("asset.id").alias("id"), "severity", "event_type")


@direct("SELECT 'probe:certificate:' || lower(c_name) AS id, c_mktsegment AS name, lower(c_name) || ':443' AS source_file FROM customer")
def e5_observed_certs(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    none = F.lit(None).cast("timestamp")
    probes = c.select(F.lower("c_name").alias("host"), F.lit(443).alias("port"), F.col("c_mktsegment").alias("subject"), F.lit("ca").alias("issuer"), none.alias("not_before"), as_of().alias("not_after"), F.col("c_custkey").cast("string").alias("serial"), F.array("c_name").alias("dns_names"))
    return E.observed_certs(probes, as_of()).select("id", "name", "source_file")


@case(FINDINGS + """ SELECT 'nodes_by_type' AS part, type AS key, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'nodes_by_source', source, count(*) FROM nodes GROUP BY 2
UNION ALL SELECT 'edges_by_type', type, count(*) FROM edges GROUP BY 2 UNION ALL SELECT 'findings', rule, count(*) FROM f GROUP BY 2""")
def b1_report(nodes, edges):
    from infragraph.operators.report import report

    scans = nodes.sparkSession.createDataFrame([], "id long, status string")
    t = report(nodes, edges.where("type <> 'correlates_with'"), scans)
    named = [("nodes_by_type", "type"), ("nodes_by_source", "source"), ("edges_by_type", "type")]
    parts = [t[k].select(F.lit(k).alias("part"), F.col(c).alias("key"), "n") for k, c in named]
    parts.append(t["findings"].groupBy(F.col("rule").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("findings").alias("part"), "key", "n"))
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


# ---- exports and scalar functions


@case("""SELECT '  "' || from_id || '" -> "' || to_id || '" [label="' || type || '"];' AS line FROM edges""")
def s7_export_dot(nodes, edges):
    return store.export_dot(nodes, edges).where(F.col("line").contains(" -> "))


@case("SELECT '  ' || translate(id, ':.-/', '____') || '[\"' || name || ' (' || type || ')\"]' AS line FROM nodes UNION ALL SELECT '  ' || translate(from_id, ':.-/', '____') || ' -->|' || type || '| ' || translate(to_id, ':.-/', '____') FROM edges UNION ALL SELECT 'graph LR'")
def s8_export_mermaid(nodes, edges):
    return store.export_mermaid(nodes, edges)


@case(f"""SELECT 'infragraph_nodes_total ' || count(*) AS line FROM nodes UNION ALL SELECT 'infragraph_edges_total ' || count(*) FROM edges
UNION ALL SELECT 'infragraph_nodes_by_type{{type="' || type || '"}} ' || count(*) FROM nodes GROUP BY type UNION ALL SELECT 'infragraph_edges_by_type{{type="' || type || '"}} ' || count(*) FROM edges GROUP BY type
UNION ALL SELECT 'infragraph_certs_expiring_total ' || count(*) FROM nodes WHERE type = 'certificate' AND expires_at BETWEEN {AT} AND {AT} + INTERVAL 30 DAY
UNION ALL SELECT 'infragraph_scans_completed_total 0' UNION ALL SELECT 'infragraph_scans_failed_total 0'""")
def s9_metrics_lines(nodes, edges):
    scans = nodes.sparkSession.createDataFrame([], "id long, status string")
    return store.metrics_lines(nodes, edges, scans, as_of()).select("line")


@case("SELECT 'node' AS kind, count(*) AS n FROM nodes UNION ALL SELECT 'edge', count(*) FROM edges")
def s6_export_json(nodes, edges):
    return store.export_json(nodes, edges).where(F.get_json_object("json", "$.id").isNotNull()).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@case("SELECT id AS stored, from_id || '->' || type || '->' || to_id AS made FROM edges")
def x1_edge_id(nodes, edges):
    return edges.select(F.col("id").alias("stored"), edge_id("from_id", "type", "to_id").alias("made"))


@direct("SELECT page_id, regexp_extract(url, '://([^/?#:]+)', 1) AS host FROM pages")
def x6_potential_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(potential_hosts("url"), ",").alias("host"))


@case("SELECT id, md['image'] LIKE '%:latest' AS latest FROM nodes WHERE type = 'container'")
def x7_image_uses_latest(nodes, edges):
    return nodes.where("type = 'container'").select("id", image_uses_latest(F.col("metadata")["image"]).alias("latest"))


@case(f"SELECT id, {DAYS} AS days FROM nodes WHERE expires_at IS NOT NULL")
def x9_days_until(nodes, edges):
    return nodes.where("expires_at is not null").select("id", days_until("expires_at", as_of()).alias("days"))


@direct("""SELECT o_orderkey, array_to_string(list_concat(p[k:], p[:k - 1]), ',') AS turned FROM (SELECT o_orderkey, p, list_position(p, list_min(p)) AS k FROM (SELECT o_orderkey, ['c7', 'c' || o_custkey, 'c' || o_orderkey] AS p FROM orders))""")
def x4_normalize_cycle(spark, sf_dir):
    ring = F.array(F.lit("c7"), F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("c"), "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(normalize_cycle(ring), ",").alias("turned"))


@direct("SELECT user_id AS id, max_by(event_type, (ts, event_type, value)) AS event_type, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1")
def r2_latest_rows(spark, sf_dir):
    from infragraph.streaming.streams import latest_rows

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_type", "value", "ts")
    return latest_rows(e).select("id", "event_type", "first_seen", "last_seen")


@case("SELECT id, coalesce(nullif(md['encrypted'], ''), nullif(md['storage_encrypted'], ''), '') AS encrypted, coalesce(md['publicly_accessible'], '') = 'true' AS open FROM nodes WHERE type IN ('database', 'bucket')")
def x2_meta_value(nodes, edges):
    from infragraph.functions.scalar import meta_true, meta_value

    some = nodes.where("type in ('database', 'bucket')")
    return some.select("id", meta_value("metadata", "encrypted", "storage_encrypted").alias("encrypted"), meta_true("metadata", "publicly_accessible").alias("open"))


@direct("SELECT p_partkey, regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g') AS key, p_size % 2 = 0 AND p_type = 'ECONOMY' AS matches FROM part")
def x3_x5_keys_and_labels(spark, sf_dir):
    """Normalised brand names; a selector of two pairs against labels."""
    from infragraph.functions.scalar import labels_match, normalize_identity_key

    p = table(spark, sf_dir, "part")
    labels = F.create_map(F.lit("even"), (F.col("p_size") % 2 == 0).cast("string"), F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"))
    want = F.create_map(F.lit("even"), F.lit("true"), F.lit("type"), F.lit("ECONOMY"))
    return p.select("p_partkey", normalize_identity_key("p_brand").alias("key"), labels_match(want, labels).alias("matches"))


@direct("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'k8s:service:default/' || c_name ELSE 'k8s:service:' || lower(c_mktsegment) || '/' || c_name END AS service,
CASE WHEN c_custkey % 2 = 0 THEN 'redis://' || c_name || '.default.svc.cluster.local:6379/' || c_nationkey ELSE 'redis://' || c_name || '.' || lower(c_mktsegment) || '.svc.cluster.local:6379/' || c_nationkey END AS link,
replace(lower(c_name), '@', '_') AS part FROM customer""")
def x8_service_names(spark, sf_dir):
    from infragraph.functions.scalar import k8s_service_id, redis_connection_string, sanitize_node_part

    c = table(spark, sf_dir, "customer")
    target = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat(F.lower("c_mktsegment"), F.lit("/"), "c_name"))
    service = k8s_service_id(target)
    return c.select("c_custkey", service.alias("service"), redis_connection_string(service, F.lit(""), F.col("c_nationkey").cast("string")).alias("link"), sanitize_node_part("c_name").alias("part"))


@direct("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'terraform' WHEN 1 THEN 'terraform-plan' WHEN 2 THEN 'compose' WHEN 3 THEN 'cloudformation' WHEN 4 THEN 'ansible' END AS source FROM part""")
def s2_classify_source(spark, sf_dir):
    from infragraph.sources.documents import classify_source

    names = "array('a/{}.tfstate', 'tfplan-{}.json', 'b/docker-compose.{}.yml', 'cfn-x/cloudformation/{}.json', 'ansible/{}.ini', 'docs/{}.txt')"
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", f"replace(element_at({names}, p_size % 6 + 1), '{{}}', cast(p_partkey as string)) as path")
    return p.select("p_partkey", classify_source().alias("source"))


@case("SELECT 'node' AS kind, id, type FROM nodes UNION ALL SELECT 'edge', id, type FROM edges")
def s5_save_and_load(nodes, edges):
    from infragraph.plans.lineage import scratch_path

    spark = nodes.sparkSession
    path = scratch_path(spark, "graph")
    store.save_graph(nodes, edges, path)
    n, e = store.load_graph(spark, path)
    return n.select(F.lit("node").alias("kind"), "id", "type").unionAll(e.select(F.lit("edge").alias("kind"), "id", "type"))


@direct(f"SELECT status, count(*) AS n FROM (SELECT {STATUS} AS status FROM events UNION ALL SELECT 'completed') GROUP BY 1")
def p2_record_scan(spark, sf_dir):
    scans = scans_of(spark, sf_dir)
    last = scans.agg((F.max("id") + 1).alias("id")).select("id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in scans.schema.fields[1:-1]], F.lit("completed").alias("status"))
    return S.record_scan(scans, last).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@case("SELECT source, false AS initial FROM nodes GROUP BY 1 UNION ALL SELECT 'ansible', true")
def dr4_is_initial(nodes, edges):
    names = ["terraform", "cloudformation", "pulumi", "kubernetes", "compose", "ansible"]
    return S.initial_sources(nodes, nodes.sparkSession.createDataFrame([(x,) for x in names], "source string"))


@case("SELECT 'removed' AS change, id FROM edges WHERE type = 'member_of'")
def b2_report_with_baseline(nodes, edges):
    """The edges' part of a report's difference to a report written before."""
    from infragraph.operators.report import baseline_tables, report_with_baseline, write_report
    from infragraph.plans.lineage import scratch_path

    spark, path = nodes.sparkSession, scratch_path(nodes.sparkSession, "report")
    write_report(baseline_tables(nodes, edges), path)
    d = report_with_baseline(baseline_tables(nodes, edges.where("type <> 'member_of'")), spark, path)
    return d.where("kind = 'edges'").select("change", "id")


# ---- ingest: documents written from the tables, parsed again, and held against the tables

Tables = tuple[DataFrame, DataFrame, DataFrame]


def parsed(source: str, docs: DataFrame) -> DataFrame:
    """(kind, id, detail): node types, edges' via, and warnings of parsed documents."""
    import infragraph.sources.all_parsers  # noqa: F401
    from infragraph.sources.documents import PARSERS

    n, e, w = PARSERS[source](docs.withColumn("source", F.lit(source)), as_of())
    out = n.select(F.lit("node").alias("kind"), "id", F.concat_ws("|", "name", "type", "provider").alias("detail"))
    out = out.unionAll(e.select(F.lit("edge").alias("kind"), "id", F.coalesce(F.col("metadata")["via"], F.col("metadata")["source"], F.lit("")).alias("detail")))
    return out.unionAll(w.select(F.lit("warning").alias("kind"), F.col("source_file").alias("id"), F.col("message").alias("detail")))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation and region."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))


@direct("""SELECT 'node' AS kind, 'tf:vm:' || c_name AS id, c_name || '|vm|aws' AS detail FROM customer UNION ALL SELECT 'node', 'tf:subnet:' || n_name, n_name || '|subnet|aws' FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)
UNION ALL SELECT 'edge', 'tf:vm:' || c_name || '->depends_on->tf:subnet:' || n_name, 'tfstate_dependency' FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'edge', 'tf:vm:' || c_name || '->connects_to->tf:subnet:' || n_name, 'subnetwork' FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT DISTINCT 'warning', n_name || '.tfstate', 'unmapped resource type: null_resource.nothing' FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)""")
def i1_tf_state(spark, sf_dir):
    """A state file for each nation."""
    provider = "'provider[\"registry.terraform.io/hashicorp/aws\"]'"
    vm = f"named_struct('mode', 'managed', 'type', 'aws_instance', 'name', concat('c', c_custkey), 'provider', {provider}, 'instances', array(named_struct('attributes', named_struct('name', c_name, 'subnetwork', concat('projects/x/', n_name)), 'dependencies', array(concat('aws_subnet.', n_name), 'aws_subnet.unknown'))))"
    own = f"named_struct('mode', 'managed', 'type', 'aws_subnet', 'name', n_name, 'provider', {provider}, 'instances', array(named_struct('attributes', named_struct('name', n_name, 'subnetwork', ''), 'dependencies', array(''))))"
    none = f"named_struct('mode', 'managed', 'type', 'null_resource', 'name', 'nothing', 'provider', {provider}, 'instances', array(named_struct('attributes', named_struct('name', 'x', 'subnetwork', ''), 'dependencies', array(''))))"
    data = own.replace("'managed'", "'data'")
    files = placed(spark, sf_dir).groupBy("n_name").agg(F.expr(f"collect_list({vm})").alias("vms"))
    docs = files.selectExpr("concat(n_name, '.tfstate') as path", f"to_json(named_struct('version', 4, 'resources', concat(vms, array({own}, {none}, {data})))) as text")
    return parsed("terraform", docs)


@direct("""SELECT 'node' AS kind, 'tf:vm:' || c_name AS id, c_name || '|vm|aws' AS detail FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 'action', c_mktsegment, CASE c_mktsegment WHEN 'MACHINERY' THEN 'create' WHEN 'HOUSEHOLD' THEN 'delete' WHEN 'FURNITURE' THEN 'replace' ELSE 'update' END FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 2""")
def i4_tf_plan(spark, sf_dir):
    """A plan for each nation; the segment decides the actions."""
    import infragraph.sources.all_parsers  # noqa: F401
    from infragraph.sources.documents import PARSERS

    actions = "case c_mktsegment when 'MACHINERY' then array('create') when 'HOUSEHOLD' then array('delete') when 'FURNITURE' then array('delete', 'create') when 'BUILDING' then array('no-op') else array('update') end"
    after = "if(c_mktsegment = 'HOUSEHOLD', null, named_struct('name', c_name, 'region', c_mktsegment))"
    change = f"named_struct('address', concat('aws_instance.c', c_custkey), 'mode', 'managed', 'type', 'aws_instance', 'name', concat('c', c_custkey), 'provider_name', 'registry.terraform.io/hashicorp/aws', 'change', named_struct('actions', {actions}, 'before', named_struct('name', c_name, 'region', c_mktsegment), 'after', {after}))"
    docs = placed(spark, sf_dir).groupBy("n_name").agg(F.expr(f"collect_list({change})").alias("c")).selectExpr("concat('tfplan-', n_name, '.json') as path", "to_json(named_struct('resource_changes', c)) as text")
    n, _, _ = PARSERS["terraform-plan"](docs, as_of())
    seen = n.select(F.lit("action").alias("kind"), F.col("metadata")["region"].alias("id"), F.col("metadata")["plan_action"].alias("detail")).distinct()
    return n.select(F.lit("node").alias("kind"), "id", F.concat_ws("|", "name", "type", "provider").alias("detail")).unionAll(seen)


@direct("""SELECT 'node' AS kind, 'cfn:subnet:' || n_name AS id, n_name || '|subnet|aws' AS detail FROM nation UNION ALL SELECT 'node', 'cfn:network:' || r_name, r_name || '|network|aws' FROM region
UNION ALL SELECT 'edge', 'cfn:subnet:' || n_name || '->depends_on->cfn:network:' || r_name, CASE WHEN n_nationkey % 2 = 0 THEN 'DependsOn' ELSE 'Ref' END FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'edge', 'cfn:subnet:' || n_name || '->connects_to->cfn:network:' || r_name, 'VpcId' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0""")
def i6_cloudformation(spark, sf_dir):
    """A template for each region; references by DependsOn, nested Ref, and plain ids."""
    t = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    body = "to_json(named_struct('Type', 'AWS::EC2::Subnet', 'DependsOn', if(n_nationkey % 2 = 0, r_name, null), 'Properties', named_struct('CidrBlock', named_struct('Fn::Join', array(named_struct('Ref', r_name))), 'VpcId', if(n_nationkey % 3 = 0, r_name, null))))"
    entry = f"concat('\"', n_name, '\":', {body})"
    docs = t.groupBy("r_name").agg(F.expr(f"array_join(collect_list({entry}), ',')").alias("e"))
    return parsed("cloudformation", docs.selectExpr("concat('cloudformation/', r_name, '.json') as path", "concat('{\"Resources\":{\"', r_name, '\":{\"Type\":\"AWS::EC2::VPC\"},', e, '}}') as text"))


@direct("""SELECT 'node' AS kind, 'plm:vm:' || c_name AS id, c_name || '|vm|aws' AS detail FROM customer UNION ALL SELECT 'node', 'plm:subnet:' || n_name, n_name || '|subnet|aws' FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)
UNION ALL SELECT 'edge', 'plm:vm:' || c_name || '->' || k || '->plm:subnet:' || n_name, via FROM customer JOIN nation ON c_nationkey = n_nationkey, (VALUES ('depends_on', 'dependencies'), ('connects_to', 'subnetId'), ('member_of', 'parent')) v(k, via)""")
def i9_pulumi(spark, sf_dir):
    """A stack for each nation."""
    vm = "named_struct('urn', concat('urn::', c_custkey), 'type', 'aws:ec2/instance:Instance', 'parent', concat('urn::', n_name), 'inputs', named_struct('name', c_name, 'subnetId', n_name), 'dependencies', array(concat('urn::', n_name)))"
    own = "named_struct('urn', concat('urn::', n_name), 'type', 'aws:ec2/subnet:Subnet', 'parent', '', 'inputs', named_struct('name', '', 'subnetId', ''), 'dependencies', cast(array() as array<string>))"
    stack = own.replace("aws:ec2/subnet:Subnet", "pulumi:pulumi:Stack")
    docs = placed(spark, sf_dir).groupBy("n_name").agg(F.expr(f"collect_list({vm})").alias("v")).selectExpr("concat('pulumi/', n_name, '.json') as path", f"to_json(named_struct('deployment', named_struct('resources', concat(v, array({own}, {stack}))))) as text")
    return parsed("pulumi", docs)


@direct("""SELECT 'node' AS kind, 'compose:container:' || s_name AS id, s_name || '|container|docker' AS detail FROM supplier UNION ALL SELECT DISTINCT 'node', 'compose:network:' || n_name, n_name || '|network|docker' FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT DISTINCT 'node', 'compose:volume:' || n_name || '-data', n_name || '-data|disk|docker' FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'edge', 'compose:container:' || s_name || '->connects_to->compose:network:' || n_name, 'networks' FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'edge', 'compose:container:' || s_name || '->mounts_volume->compose:volume:' || n_name || '-data', 'volumes' FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def i11_compose(spark, sf_dir):
    """A file for each nation; a host path and an undeclared volume make no edge."""
    t = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    body = "to_json(named_struct('image', 'shop/app:1', 'networks', array(n_name), 'volumes', array(concat(n_name, '-data:/data'), '/var:/var', 'other:/x')))"
    docs = t.groupBy("n_name").agg(F.expr(f"array_join(collect_list(concat('\"', s_name, '\":', {body})), ',')").alias("e"))
    text = "concat('{\"services\":{', e, '},\"networks\":{\"', n_name, '\":{}},\"volumes\":{\"', n_name, '-data\":{}}}')"
    return parsed("compose", docs.selectExpr("concat(n_name, '/docker-compose.yml') as path", f"{text} as text"))


@direct("""SELECT 'node' AS kind, 'k8s:' || k || ':shop/' || lower(split_part(s_name, '#', 2)) AS id, lower(split_part(s_name, '#', 2)) || '|' || k || '|kubernetes' AS detail FROM supplier, (VALUES ('pod'), ('service'), ('secret')) v(k)
UNION ALL SELECT 'edge', 'k8s:pod:shop/' || x || '->member_of->k8s:service:shop/' || x, 'selector' FROM (SELECT split_part(s_name, '#', 2) AS x FROM supplier)
UNION ALL SELECT 'edge', 'k8s:pod:shop/' || x || '->mounts_secret->k8s:secret:shop/' || x, 'envFrom' FROM (SELECT split_part(s_name, '#', 2) AS x FROM supplier)
UNION ALL SELECT 'edge', 'k8s:pod:shop/' || x || '->connects_to->k8s:service:shop/' || x, 'env:SELF' FROM (SELECT split_part(s_name, '#', 2) AS x FROM supplier)""")
def i12_kubernetes(spark, sf_dir):
    """A file for each nation with a Deployment and a Service for each supplier; secrets are only referred to."""
    t = table(spark, sf_dir, "supplier").withColumn("x", F.split("s_name", "#")[1])
    meta = "named_struct('name', x, 'namespace', 'shop')"
    pod = f"to_json(named_struct('kind', 'Deployment', 'metadata', {meta}, 'spec', named_struct('template', named_struct('metadata', named_struct('labels', map('app', x, 'tier', 'web')), 'spec', named_struct('containers', array(named_struct('name', 'c', 'image', 'a:1', 'envFrom', array(named_struct('secretRef', named_struct('name', x))), 'env', array(named_struct('name', 'SELF', 'value', concat('http://', x, '.shop.svc:80/'))))))))))"
    service = f"to_json(named_struct('kind', 'Service', 'metadata', {meta}, 'spec', named_struct('selector', map('app', x))))"
    docs = t.groupBy("s_nationkey").agg(F.expr(f"array_join(collect_list(concat({pod}, ',', {service})), ',')").alias("e"))
    return parsed("kubernetes", docs.selectExpr("concat('k8s/', s_nationkey, '.yaml') as path", "concat('{\"kind\":\"List\",\"items\":[', e, ']}') as text"))


@direct("""SELECT 'node' AS kind, 'ansible:vm:c' || c_custkey AS id, 'c' || c_custkey || '|vm|local' AS detail FROM customer UNION ALL SELECT 'node', 'ansible:database:shop@c' || min(c_custkey), 'shop@c' || min(c_custkey) || '|database|postgres' FROM customer GROUP BY c_mktsegment
UNION ALL SELECT 'edge', 'ansible:vm:c' || c_custkey || '->depends_on->ansible:database:shop@c' || m, 'ansible_inventory_var' FROM (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_mktsegment) AS m FROM customer) WHERE c_custkey <> m
UNION ALL SELECT 'edge', 'ansible:database:shop@c' || min(c_custkey) || '->connects_to->ansible:vm:c' || min(c_custkey), 'ansible_inventory_var' FROM customer GROUP BY c_mktsegment""")
def i18_ansible(spark, sf_dir):
    """An INI inventory for each segment, whose hosts use a database on its first host."""
    c = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.min("c_custkey").alias("m"), F.array_join(F.collect_list(F.concat(F.lit("c"), "c_custkey", F.lit(" rack=1"))), "\n").alias("hosts"))
    text = F.concat(F.lit("["), "c_mktsegment", F.lit("]\n"), "hosts", F.lit("\n["), "c_mktsegment", F.lit(":vars]\ndb_host = c"), "m", F.lit("\ndb_name=shop\n"))
    return parsed("ansible", c.select(F.concat(F.lit("ansible/"), "c_mktsegment", F.lit(".ini")).alias("path"), text.alias("text")))
