"""The store of deltas, and the graph kept in it by scans, against whole tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from infragraph.functions.schema import EDGE_SCHEMA, NODE_SCHEMA, WARNING_SCHEMA
from infragraph.operators import correlate as C
from infragraph.plans.components import connected_components
from infragraph.plans.union_find import PARENTS, find_roots, merge_links, stored_components
from infragraph.sources.delta_store import DeltaStore, KeyedTable, co_partitioned
from infragraph.streaming import graph_store as G
from infragraph.streaming.streams import ingest_batch, keyed_state, stream_latest

PLAIN = T.StructType([T.StructField("k", T.StringType()), T.StructField("p", T.IntegerType()), T.StructField("v", T.LongType()), T.StructField("m", T.MapType(T.StringType(), T.StringType()))])


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.fixture
def plain(spark, tmp_path):
    return DeltaStore(spark, f"file://{tmp_path}/store", {"t": KeyedTable(PLAIN, ("k", "p"), ("k",))}, 4)


def test_store_against_a_dict(spark, plain):
    rng, model = random.Random(5), {}
    for step in range(6):
        some = {(f"k{rng.randrange(12)}", rng.randrange(3)): (rng.randrange(100), {"s": str(step)}) for _ in range(rng.randint(0, 8))}
        gone = [k for k in model if rng.random() < 0.15 and k not in some]
        view = plain.view().stage("t", spark.createDataFrame([(*k, *v) for k, v in some.items()], PLAIN), spark.createDataFrame(gone, "k string, p int"))
        plain.commit(view.compacted(max_deltas=3, share=0.8) if step % 2 else view)
        model = {k: v for k, v in model.items() if k not in gone} | some
        assert rows(plain.view().read("t")) == sorted(str((*k, *v)) for k, v in model.items())
    wanted = spark.createDataFrame([(f"k{i}", i % 4) for i in range(14)], "k string, p int")
    keys = {(f"k{i}", i % 4) for i in range(14)}
    with co_partitioned(spark):
        view = plain.view()
        found = {(r["k"], r["p"]): r["stored"] and (r["stored"]["v"], r["stored"]["m"]) for r in view.lookup("t", wanted).collect()}
        assert found == {k: model.get(k) for k in keys}
        assert rows(view.unmatched("t", wanted, "v >= 20")) == sorted(str((*k, *v)) for k, v in model.items() if k not in keys and v[0] >= 20)
        assert rows(view.matching("t", wanted.select("k").distinct())) == sorted(str((*k, *v)) for k, v in model.items() if k[0] in {x for x, _ in keys})
    assert plain.view(0).state["version"] == 0 and plain.vacuum() > 0
    assert rows(plain.view().read("t")) == sorted(str((*k, *v)) for k, v in model.items()) and plain.versions() == [5]


def test_store_reads_buckets_as_they_lie(spark, plain):
    """No shuffle of what is stored: each one in the plan is above the batch."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        view = plain.view().stage("t", spark.createDataFrame([("a", 1, 1, {})], PLAIN)).compacted()
        view = view.stage("t", spark.createDataFrame([("a", 1, 2, {})], PLAIN))
        wanted = spark.createDataFrame([("a", 1)], "k string, p int")
        with co_partitioned(spark):
            for df in (view.lookup("t", wanted), view.unmatched("t", wanted, "true")):
                plan = df._jdf.queryExecution().executedPlan().toString()
                for line, after in zip(plan.split("\n"), plan.split("\n")[1:], strict=False):
                    assert "Exchange" not in line or "Filter" in after or "ExistingRDD" in after, plan
                assert plan.count("Bucketed: true") >= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_store_commits_once(spark, plain):
    first = plain.view().stage("t", spark.createDataFrame([("a", 1, 1, {})], PLAIN))
    other = plain.view().stage("t", spark.createDataFrame([("b", 1, 1, {})], PLAIN))
    plain.commit(first)
    with pytest.raises(Exception, match="exists"):
        plain.commit(other)
    assert rows(plain.view().read("t")) == ["('a', 1, 1, {})"]
    assert plain.vacuum() == 1


def test_components_that_grow(spark, tmp_path):
    rng = random.Random(8)
    store, every = DeltaStore(spark, f"file://{tmp_path}/uf", {"parents": PARENTS}, 4), []
    for _ in range(4):
        links = [tuple(f"n{rng.randrange(60):02d}" for _ in range(2)) for _ in range(rng.randint(0, 12))]
        every += links
        store.commit(merge_links(store.view(), spark.createDataFrame(links, "a string, b string")).compacted(max_deltas=2))
        want = rows(connected_components(spark.createDataFrame(every, "a string, b string")))
        assert rows(stored_components(store.view())) == want
    some = spark.createDataFrame([("n01",), ("zz",)], "node string")
    assert ("zz", "zz") in {tuple(r) for r in find_roots(store.view(), some).collect()}


NAMES = "ledger-store quote-desk gate-house tax-office bike-shed".split()


def scan(spark, rng, source, n=12, new=None):
    """A parser that finds the same random nodes and edges in any documents."""
    nodes, edges = {}, {}
    for _ in range(n):
        i = f"{rng.choice('abc')}{rng.randrange(14):02d}"
        meta = {x: y for x, y in (("app", rng.choice(NAMES)), ("hostname", f"h{rng.randrange(6)}.corp.example")) if rng.random() < 0.5}
        nodes[i] = (i, rng.choice(NAMES) if rng.random() < 0.6 else i, rng.choice(["vm", "pod", "network"]), new or source, "f", "p", meta, None, None, None)
    ids = [*nodes, "nowhere", "c03"]
    for _ in range(n):
        a, b, kind = rng.choice(ids), rng.choice(ids), rng.choice(["depends_on", "connects_to"])
        edges[a, b, kind] = (f"{a}->{kind}->{b}", a, b, kind, {"w": str(rng.randrange(3))})
    made = spark.createDataFrame(list(nodes.values()), NODE_SCHEMA), spark.createDataFrame(list(edges.values()), EDGE_SCHEMA), spark.createDataFrame([], WARNING_SCHEMA)
    return lambda docs: made


def plain_tables(t):
    return {"nodes": rows(t["nodes"].drop("first_seen")), "edges": rows(t["edges"].select(*EDGE_SCHEMA.names))}


def test_scans_equal_whole_tables(spark, tmp_path):
    """Nodes, edges, drift, links between sources and components after each of several scans; a source takes nodes over on the way."""
    rng, store = random.Random(13), G.graph_store(spark, f"file://{tmp_path}/graph", 4)
    nodes, edges = spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA)
    for step, (source, new) in enumerate([("terraform", None), ("kubernetes", None), ("pulumi", "terraform"), ("kubernetes", None)]):
        parse = scan(spark, rng, source, new=new)
        want = ingest_batch(spark.range(1), parse, nodes, edges, source)
        got = G.apply_scan(store, spark.range(1), parse, source, f"scan-{step}")
        nodes, edges = (spark.createDataFrame(want[k].collect(), s) for k, s in (("nodes", NODE_SCHEMA), ("edges", EDGE_SCHEMA)))
        assert plain_tables(G.read_graph(store)) == plain_tables({"nodes": nodes, "edges": edges}), step
        for k in ("node_drift", "edge_drift", "rejected"):
            assert rows(got[k]) == rows(want[k]), (step, k)
        links = edges.where("type = 'correlates_with'")
        assert rows(G.read_graph(store)["components"]) == rows(connected_components(links, "from_id", "to_id"))
        assert G.apply_scan(store, spark.range(1), parse, source, f"scan-{step}") is None
    assert links.count() > 5 and store.view().state["notes"]["flipped"]
    G.settle(store)
    assert plain_tables(G.read_graph(store)) == plain_tables({"nodes": nodes, "edges": edges}) and not store.view().state["notes"]["flipped"]
    assert [r["status"] for r in G.read_graph(store)["scans"].collect()] == ["completed"] * 4


def test_scan_that_breaks_and_one_that_is_small(spark, tmp_path, monkeypatch):
    store, rng = G.graph_store(spark, f"file://{tmp_path}/graph", 4), random.Random(3)
    G.apply_scan(store, spark.range(1), scan(spark, rng, "terraform", n=200), "terraform", "one")
    store.vacuum()
    before, parse = plain_tables(G.read_graph(store)), scan(spark, rng, "kubernetes", n=4)
    staged = []

    def breaks(view, table, *more):
        staged.append(table)
        if len(staged) == 4:
            raise OSError("lost")
        return keep(view, table, *more)

    keep = G.View.stage
    monkeypatch.setattr(G.View, "stage", breaks)
    with pytest.raises(OSError, match="lost"):
        G.apply_scan(store, spark.range(1), parse, "kubernetes", "two")
    monkeypatch.undo()
    assert plain_tables(G.read_graph(store)) == before and store.versions() == [0]
    assert store.vacuum() == 3
    G.apply_scan(store, spark.range(1), parse, "kubernetes", "two")
    # what the second scan wrote follows its own four nodes and edges
    deltas = {t: sum(n for _, n in own["deltas"]) for t, own in store.view().state["tables"].items()}
    assert deltas["nodes"] <= 4 and deltas["edges"] <= 4 * 20 and store.view().state["tables"]["nodes"]["base"][1] > 30


def test_hot_keys_are_cut(spark):
    """The pairs of a key of many members, made part by part, are all of them."""
    made = [(f"{s}{i:03d}", "one name for all" if i % 3 else f"own-{i}", "vm", s, "f", "p", {}, None, None, None) for i in range(60) for s in ("x", "y")]
    n, e = spark.createDataFrame(made, NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA)
    assert rows(C.correlate(n, e, block=7)) == rows(C.correlate(n, e)) and C.correlate(n, e, block=7).count() == 40 * 40 + 20
    assert [tuple(r) for r in C.hot_keys(C.correlation_stars(n), block=50).collect()] == [("one-name-for-all", 80, 2)]
    assert C.correlate(n, n.select("id"), block=7).count() == 1620 and C.correlate(n.limit(0), e).count() == 0


def test_stream_state_survives(spark, tmp_path):
    """Two runs of one checkpoint keep the rows of all keys in RocksDB."""
    schema, path = "id string, v string, ts timestamp", str(tmp_path / "ev")
    for run, values in enumerate(("('a', 'x', timestamp'2024-01-05'), ('b', 'u', timestamp'2024-01-02')", "('a', 'y', timestamp'2024-01-03'), ('a', 'z', timestamp'2024-01-09')")):
        spark.sql(f"select * from values {values} as t(id, v, ts)").write.mode("append").parquet(path)
        stream_latest(spark.readStream.schema(schema).parquet(path), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
        got = [(r["id"], r["v"], r["first_seen"].day, r["last_seen"].day) for r in spark.read.parquet(str(tmp_path / f"out/v{run}")).orderBy("id").collect()]
        assert got == ([("a", "x", 5, 5), ("b", "u", 2, 2)], [("a", "z", 3, 9)])[run]
    files = [str(p) for p in (tmp_path / "ck").rglob("*")]
    assert any(f.endswith((".zip", ".changelog")) for f in files)
    with keyed_state(spark):
        assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") or "")
