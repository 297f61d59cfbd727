"""Graph operators on small hand-built graphs."""

from __future__ import annotations

import datetime as dt
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from infragraph.functions import scalar as X
from infragraph.functions.schema import EDGE_SCHEMA, NODE_SCHEMA
from infragraph.operators import audit as A
from infragraph.operators import certs as E
from infragraph.operators import correlate as C
from infragraph.operators import relational as R
from infragraph.operators import state as S
from infragraph.operators import traverse as T
from infragraph.plans.components import connected_components
from infragraph.sources import store

NOW = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def graph(spark):
    def build(*edges, nodes=(), **types):
        ids = sorted({x for e in edges for x in e[:2]} | set(nodes))
        n = spark.createDataFrame([(i, i, types.get(i, "vm"), "test", "f", "p", {}, None, NOW, NOW) for i in ids], NODE_SCHEMA)
        rows = [(f"{e[0]}->{e[2] if len(e) > 2 else 'depends_on'}->{e[1]}", e[0], e[1], e[2] if len(e) > 2 else "depends_on", {}) for e in edges]
        return n, spark.createDataFrame(rows, EDGE_SCHEMA)

    return build


def ids_of(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def node(id, type="vm", source="test", meta=None, name=None, expires=None):
    return (id, name or id, type, source, "f", "p", meta or {}, expires, NOW, NOW)


def test_linear_chain(spark, graph):
    n, e = graph(("A", "B"), ("B", "C"), C="network", B="vm")
    rows = {r["node_id"]: (r["depth"], r["parent_id"], r["path"]) for r in T.blast_radius(n, e, ids_of(spark, "C")).collect()}
    assert rows == {"B": (1, "C", ["C", "B"]), "A": (2, "B", ["C", "B", "A"])}
    assert T.blast_summary(T.blast_radius(n, e, ids_of(spark, "C", "A")), n, ids_of(spark, "C", "A")).orderBy("root_id").collect()[0]["affected"] == 0
    assert {r["node_id"] for r in T.dependency_chain(e, ids_of(spark, "A")).collect()} == {"B", "C"}
    assert {r["node_id"] for r in T.dependency_chain(e, ids_of(spark, "A"), 1).collect()} == {"B"}
    assert T.dependency_chain(e, ids_of(spark, "A"), 0).count() == 0
    path = T.shortest_path(e, spark.createDataFrame([("A", "C"), ("C", "C")], "from_id string, to_id string")).collect()
    assert sorted((r["step"], r["node_id"], r["edge_id"]) for r in path if r["from_id"] == "A") == [(0, "A", None), (1, "B", "A->depends_on->B"), (2, "C", "B->depends_on->C")]
    assert [r["node_id"] for r in path if r["from_id"] == "C"] == ["C"]


def test_diamond_fan_and_order(spark, graph):
    n, e = graph(("A", "C"), ("B", "C"), ("A", "D"), ("B", "D"))
    assert {r["node_id"] for r in T.blast_radius(n, e, ids_of(spark, "C")).collect()} == {"A", "B"}
    n, e = graph(("A", "D"), ("B", "D"), ("C", "D"))
    tree = T.impact_tree(T.blast_radius(n, e, ids_of(spark, "D"))).collect()
    assert len(tree) == 1 and tree[0]["children"] == ["A", "B", "C"]
    # X is reached from both M (by a later edge type) and N (by an earlier one): the first discovered parent wins
    n, e = graph(("M", "R", "a"), ("N", "R", "b"), ("X", "M", "z"), ("X", "N", "a"))
    assert {r["node_id"]: r["parent_id"] for r in T.blast_radius(n, e, ids_of(spark, "R")).collect()}["X"] == "M"


def test_cycles(spark, graph):
    n, e = graph(("A", "B"), ("B", "C"), ("C", "A"))
    assert {r["node_id"] for r in T.dependency_chain(e, ids_of(spark, "A")).collect()} == {"B", "C"}
    assert [r["cycle"] for r in T.find_cycles(e).collect()] == [["A", "B", "C"]]
    n, e = graph(("A", "B"), ("B", "A"), ("D", "E"), ("E", "D"), ("S", "S"), ("S", "A"))
    assert [r["cycle"] for r in T.find_cycles(e).collect()] == [["S"], ["A", "B"], ["D", "E"]]
    turned = spark.createDataFrame([(["C", "A", "B"],), ([],)], "c array<string>").select(X.normalize_cycle("c").alias("c")).collect()
    assert [r["c"] for r in turned] == [["A", "B", "C"], []]


def test_spof(spark, graph):
    n, e = graph(("A", "C"), ("B", "C"), ("D", "C"))
    assert [(r["id"], r["affected"], r["by_type"]) for r in T.spof(n, e).collect()] == [("C", 3, {"vm": 3})]
    assert T.spof(n, e, min_affected=4).count() == 0
    n, e = graph(("A", "C"), ("B", "D"))
    assert [r["id"] for r in T.spof(n, e).collect()] == ["C", "D"]
    size = 12
    n, e = graph(*[(f"n{i:02d}", f"n{i - 1:02d}") for i in range(1, size)])
    assert [r["affected"] for r in T.spof(n, e, limit=0).collect()] == list(range(size - 1, 0, -1))
    assert [r["affected"] for r in T.spof_approx(n, e, limit=0).collect()] == list(range(size - 1, 0, -1))


def test_no_path_neighbours_orphans(spark, graph):
    n, e = graph(("A", "B", "connects_to"), ("C", "A", "connects_to"), nodes=("X",))
    assert {r["id"] for r in R.neighbors(n, e, ids_of(spark, "A")).collect()} == {"B", "C"}
    assert [r["id"] for r in R.orphans(n, e).collect()] == ["X"]
    assert [(r["found"], r["step"]) for r in T.shortest_path(e, spark.createDataFrame([("A", "X")], "from_id string, to_id string")).collect()] == [(False, None)]
    assert {r["node_id"] for r in T.reachable_undirected(e, ids_of(spark, "B")).collect()} == {"A", "C"}
    good, bad = R.dangling_edges(n.where("id <> 'B'"), e)
    assert good.count() == 1 and bad.count() == 1


def test_random_graphs_against_plain_search(spark, graph):
    rng = random.Random(9)
    edges = sorted({(f"n{rng.randrange(30):02d}", f"n{rng.randrange(30):02d}", rng.choice("ab")) for _ in range(60)})
    n, e = graph(*edges)
    roots = [r["id"] for r in n.collect()]
    up = {}
    for a, b, t in sorted(edges, key=lambda x: (x[2], x[0])):
        up.setdefault(b, []).append((t, a))
    want = {}
    for root in roots:
        seen, todo = {root: (0, None, None)}, deque([root])
        while todo:
            x = todo.popleft()
            for t, a in up.get(x, []):
                if a not in seen:
                    seen[a] = (seen[x][0] + 1, x, t)
                    todo.append(a)
        want |= {(root, k): v for k, v in seen.items() if k != root}
    got = {(r["root_id"], r["node_id"]): (r["depth"], r["parent_id"], r["edge_type"]) for r in T.blast_radius(n, e, n.select("id")).collect()}
    assert got == want
    pairs = T.closure(e)
    assert {(r["root_id"], r["node_id"]) for r in pairs.collect()} == set(want)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7), (None, 5)]
    parent = {x: x for e in links for x in e if x is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    sizes = {}
    for x in parent:
        sizes.setdefault(root(x), []).append(x)
    assert got == {x: root(x) for own in sizes.values() if len(own) > 1 for x in own}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_secrets_exposure_plan(spark, graph):
    n, e = graph(("app", "s1", "mounts_secret"), ("app", "db"), ("lb", "app"), ("far", "lb"), lb="load_balancer", s1="secret")
    assert {r["node_id"] for r in T.secrets_touched(e, ids_of(spark, "db")).collect()} == {"db", "app", "s1"}
    assert T.secrets_touched(e.where("type <> 'mounts_secret'"), ids_of(spark, "db")).count() == 0
    got = {r["root_id"]: (r["exposed"], r["entry_id"]) for r in T.external_exposure(n, e, ids_of(spark, "db", "far")).collect()}
    assert got == {"db": (True, "lb"), "far": (False, None)}


def test_audit_twins(spark):
    rows = [
        node("db:bad", "database", meta={"publicly_accessible": "true", "storage_encrypted": "false", "deletion_protection": "false", "multi_az": "false"}),
        node("db:ok", "database", meta={"publicly_accessible": "false", "storage_encrypted": "true", "deletion_protection": "true", "multi_az": "true"}),
        node("sg:bad", "firewall_rule", meta={"ingress_cidrs": "10.0.0.0/8, ::/0,0.0.0.0/0"}), node("sg:ok", "firewall_rule", meta={"ingress_cidrs": "10.0.0.0/8"}),
        node("b:bad", "bucket", meta={"acl": "public-read"}), node("b:ok", "bucket", meta={"acl": "private"}),
        node("vm:bad", "vm", meta={"public_ip": "1.2.3.4"}), node("vm:ok", "vm"),
        node("pod:bad", "pod", meta={"security.web.privileged": "true", "security.web.allow_privilege_escalation": "true", "security.web.run_as_non_root": "false", "security.web.read_only_root_fs": "false", "security.host_network": "true", "security.host_pid": "true", "resources_limits": "1"}),
        node("svc:bad", "service", meta={"service_type": "LoadBalancer"}), node("svc:ok", "service", meta={"service_type": "ClusterIP"}),
        node("s:lone", "secret"), node("s:used", "secret"), node("ing", "ingress", meta={"hosts": "a"}), node("c", "container", "compose", {"image": "nginx", "ports": "80"}), node("nothing", "vm", meta=None),
    ]
    n = spark.createDataFrame(rows, NODE_SCHEMA)
    e = spark.createDataFrame([("x", "pod:bad", "s:used", "mounts_secret", {})], EDGE_SCHEMA)
    found = A.audit(n, e)
    by_rule = {r["rule"]: r["count"] for r in found.groupBy("rule").count().collect()}
    one = "public-database unencrypted-storage permissive-firewall no-deletion-protection single-az-database public-bucket privileged-container public-load-balancer orphan-secret public-instance allow-privilege-escalation run-as-root writable-root-fs unencrypted-ingress mutable-container-image compose-missing-init exposed-service-no-healthcheck".split()
    assert by_rule == {r: 1 for r in one} | {"host-namespace": 2}
    assert {r["resource_id"] for r in found.collect()}.isdisjoint({"db:ok", "sg:ok", "b:ok", "vm:ok", "svc:ok", "s:used"})
    text = {r["rule"]: r["description"] for r in found.collect()}
    assert text["privileged-container"] == 'Container "web" runs in privileged mode' and "::/0" in text["permissive-firewall"]
    assert A.severity_gate(found, "none").first()["failed"] is False and A.severity_gate(found, "critical").first()["failures"] == 7
    own = A.Rule("named-nothing", "info", lambda: F.array(F.when(F.col("name") == "nothing", F.lit("no name"))))
    assert A.audit(n, e, [*A.RULES, own]).where("rule = 'named-nothing'").count() == 1
    assert A.audit(n.limit(0), e.limit(0)).count() == 0


def test_images(spark):
    images = {"nginx": True, "nginx:latest": True, "ghcr.io/org/app:latest": True, "ghcr.io/org/app:1.2.3": False, "registry:5000/app:1.2.3": False, "registry:5000/app": True, "app@sha256:abc": False, "": False}
    rows = spark.createDataFrame([(k,) for k in images], "i string").select("i", X.image_uses_latest("i").alias("x")).collect()
    assert {r["i"]: r["x"] for r in rows} == images


def test_correlation(spark):
    rows = [
        node("a", "database", "compose", name="ledger-store"), node("b", "database", "terraform", name="Ledger Store"), node("c", "database", "ansible", name="database@ledger-store"),
        node("d", "container", "compose", name="quote-desk"), node("e", "pod", "kubernetes", {"label:app": "quote-desk"}, name="x1"), node("f", "vm", "ansible", name="gatehouse"),
        node("g", "network", "compose", name="quote-desk"), node("h", "vm", "terraform", {"hostname": "db.svc.cluster.local"}, name="q1"), node("i", "vm", "pulumi", {"hostname": "api.svc.cluster.local"}, name="q2"),
    ]
    n, e = spark.createDataFrame(rows, NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA)
    made = C.correlate(n, e)
    assert {(r["from_id"], r["to_id"], r["metadata"]["confidence"]) for r in made.collect()} == {("a", "b", "high"), ("a", "c", "high"), ("b", "c", "high"), ("d", "e", "medium")}
    every = e.unionByName(made)
    assert C.correlate(n, every).count() == 0
    assert {(r["key"], r["hub"], r["node_id"]) for r in C.correlation_stars(n).collect()} == {("ledger-store", "a", x) for x in "abc"} | {("quote-desk", "d", x) for x in "de"}
    assert C.correlate(n, e, spark.createDataFrame([("quote-desk",)], "key string")).count() == 1
    groups = C.correlated_groups(n, every).collect()
    assert [(r["key"], r["sources"], r["node_ids"]) for r in groups] == [("ledger-store", ["ansible", "compose", "terraform"], ["a", "b", "c"]), ("quote-desk", ["compose", "kubernetes"], ["d", "e"])]


def test_edges_are_marked_in_one_pass(spark):
    """Ids of any kind come back, and there are two joins for both answers."""
    n = spark.createDataFrame([node("a"), node("b"), node("a")], NODE_SCHEMA)
    rows = [("a->t->b", "a", "b", "t"), ("own", "a", "x", "t"), (None, "b", "a", "t"), ("", "x", "b", "t"), ("q", None, "b", "t")]
    e = spark.createDataFrame([(*r, {"k": "v"}) for r in rows], EDGE_SCHEMA)
    marked = R.marked_edges(n, e)
    assert sorted(((r["id"], r["from_id"], r["to_id"], r["type"], r["valid"]) for r in marked.collect()), key=str) == sorted(((*r, r[1] in ("a", "b") and r[2] in ("a", "b")) for r in rows), key=str)
    assert marked._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
    good, bad = R.dangling_edges(n, e)
    assert good.count() == 2 and bad.count() == 3 and good.columns == e.columns


def test_a_baseline_is_small_on_disk(spark, tmp_path):
    from infragraph.operators.report import baseline_tables, report_with_baseline, write_report

    n = spark.createDataFrame([node(f"asset-{i:05}") for i in range(3000)], NODE_SCHEMA)
    e = spark.createDataFrame([], EDGE_SCHEMA)
    write_report(baseline_tables(n, e), str(tmp_path / "r"))
    assert sum(f.stat().st_size for f in tmp_path.rglob("part-*")) < 150_000
    assert report_with_baseline(baseline_tables(n, e), spark, str(tmp_path / "r")).count() == 0
    assert report_with_baseline(baseline_tables(n.where("id <> 'asset-00007'"), e), spark, str(tmp_path / "r")).collect()[0][:3] == ("assets", "removed", "asset-00007")


def test_links_are_made_once_and_counted_without_making_them(spark):
    """Nodes share up to three keys; pairs, counts and groups are those of brute force, also where some links are stored, and no pair is shuffled."""
    sources, rows = ("compose", "terraform", "ansible"), []
    for i in range(60):
        meta = {k: v for k, v in (("hostname", f"host-{i % 7}"), ("app", f"team-{i % 4}")) if i % 3 or k == "app"}
        rows.append(node(f"n{i:02}", "database", sources[i * 7 % 11 % 3], meta, name=f"thing-{i % 11}"))
    n = spark.createDataFrame(rows, NODE_SCHEMA)
    keys = {}
    for r in C.correlation_keys(n).collect():
        keys.setdefault((r["node_id"], r["source"]), set()).add(r["key"])
    wanted = {(a, b, min(ka & kb)) for (a, sa), ka in keys.items() for (b, sb), kb in keys.items() if a < b and sa != sb and ka & kb}
    pairs = lambda df: sorted((r["from_id"], r["to_id"], r["metadata"]["key"]) for r in df.collect())
    none = spark.createDataFrame([], EDGE_SCHEMA)
    made = C.correlate(n, none, block=5)
    assert pairs(made) == sorted(wanted) and len(wanted) > 200
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0]
    some = made.where("crc32(id) % 3 = 0").collect()
    stored = spark.createDataFrame(some, EDGE_SCHEMA)
    left = C.correlate(n, stored, block=5)
    assert pairs(left) == sorted(wanted - {(r["from_id"], r["to_id"], r["metadata"]["key"]) for r in some})
    for edges in (none, stored):
        new = C.correlate(n, edges)
        counts = C.link_counts(n, edges, block=2)
        by_key = {r["key"]: r["n"] for r in new.selectExpr("metadata['key'] as key").groupBy("key").agg(F.count("*").alias("n")).collect()}
        assert {r["key"]: r["links"] for r in counts.collect()} == by_key
        slow, fast = C.correlated_groups(n, edges.unionByName(new)), C.correlated_groups(n, edges, counts)
        assert [tuple(r) for r in fast.collect()] == [tuple(r) for r in slow.collect()]
        assert C.correlation_summary(counts, fast).collect() == C.correlation_summary(new, slow).collect()


def test_drift_and_upsert(spark):
    old = spark.createDataFrame([node("1", meta={"instance_type": "a", "region": "r"}), node("2"), node("9", source="other")], NODE_SCHEMA)
    new = spark.createDataFrame([node("1", meta={"instance_type": "b", "region": "r"}, name="one"), node("3")], NODE_SCHEMA)
    got = {(r["change"], r["id"]): r["changes"] for r in S.node_drift(old, new, "test").collect()}
    assert got == {("modified", "1"): ["name", "metadata.instance_type"], ("removed", "2"): [], ("added", "3"): []}
    assert S.node_drift(old, old.where("source = 'test'"), "test").count() == 0
    assert S.is_initial(old, "none") and not S.is_initial(old, "test")
    up = {r["id"]: r["name"] for r in S.upsert_nodes(old, new).collect()}
    assert up == {"1": "one", "2": "2", "3": "3", "9": "9"}
    with pytest.raises(ValueError, match="prune"):
        S.prune(old, spark.createDataFrame([], EDGE_SCHEMA))


def test_certs(spark):
    at = F.lit(NOW)
    ends = {"gone": -2, "soon": 3, "later": 20, "fine": 90}
    rows = [node(k, "certificate", expires=NOW + dt.timedelta(days=v)) for k, v in ends.items()] + [node("none", "certificate")]
    n = spark.createDataFrame(rows, NODE_SCHEMA)
    assert {r["id"]: r["status"] for r in E.list_certs(n, at).collect()} == {"gone": "expired", "soon": "critical", "later": "warning", "fine": "ok", "none": "unknown"}
    assert [r["id"] for r in E.expiring_certs(n, 30, at).collect()] == ["soon", "later"]
    assert E.cert_alerts(E.list_certs(n, at), at).count() == 3
    ends = spark.createDataFrame([node("i", "ingress", meta={"host": "a.example", "port": "8443"}), node("l", "load_balancer", meta={"ip_address": "::1"}), node("d", "dns_record", name="d.example")], NODE_SCHEMA)
    assert {r["endpoint"] for r in E.discover_endpoints(ends).collect()} == {"a.example:8443", "[::1]:443", "d.example:443"}


def test_store_and_exports(spark, graph, tmp_path):
    n, e = graph(("a:1", "b.2"), **{"a:1": "vm"})
    store.save_graph(n, e, f"{tmp_path}/g")
    n2, e2 = store.load_graph(spark, f"{tmp_path}/g")
    assert sorted(map(str, n2.collect())) == sorted(map(str, n.collect())) and e2.count() == 1
    dot = [r["line"] for r in store.export_dot(n, e).collect()]
    assert dot[0].startswith("digraph") and dot[-1] == "}" and '  "a:1" -> "b.2" [label="depends_on"];' in dot
    assert [r["line"] for r in store.export_mermaid(n, e).collect()] == ["graph LR", '  a_1["a:1 (vm)"]', '  b_2["b.2 (vm)"]', "  a_1 -->|depends_on| b_2"]
    drift = spark.createDataFrame([(1, "a"), (2, "b")], "scan_id int, id string")
    store.store_drift(drift, f"{tmp_path}/d")
    store.store_drift(drift.where("scan_id = 2").withColumn("id", F.lit("c")), f"{tmp_path}/d")
    assert [r["id"] for r in store.get_drift(spark, f"{tmp_path}/d", 2).collect()] == ["c"] and store.get_drift(spark, f"{tmp_path}/d", 1).count() == 1


def test_report_baseline(spark, graph, tmp_path):
    from infragraph.operators.report import report, report_row, report_with_baseline, write_report

    n, e = graph(("A", "B"), A="secret")
    scans = spark.createDataFrame([], "id long, status string")
    base = report(n, e, scans)
    write_report(base, f"{tmp_path}/r")
    n2, e2 = graph(("A", "C"), A="vm")
    diff = {(r["kind"], r["change"], r["id"]) for r in report_with_baseline(report(n2, e2, scans), spark, f"{tmp_path}/r").collect()}
    assert ("assets", "added", "C") in diff and ("assets", "removed", "B") in diff and ("assets", "changed", "A") in diff
    assert ("findings", "resolved", "info|orphan-secret|A") in diff
    assert '"nodes":2' in report_row(base).first()["report"]


def test_components_run_few_tasks(spark):
    """Tasks cost the driver memory: 219 on edges in 8 partitions, 339 with unions and a distinct within each round."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    links = spark.range(1, 4000).selectExpr("id as a", "id div 3 as b").repartition(8, "a")
    sc = spark.sparkContext
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        sc.setJobGroup("few-tasks", "components")
        got = connected_components(links)
        jobs = sc.statusTracker().getJobIdsForGroup("few-tasks")
    finally:
        sc._jsc.clearJobGroup()
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got.where("component <> 0").isEmpty() and got.count() == 4000
    stages = {s for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds}
    tasks = sum(sc.statusTracker().getStageInfo(s).numCompletedTasks for s in stages)
    assert tasks <= 270
