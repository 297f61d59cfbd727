"""Searches over chains, from both ends and by strong components, against plain Python."""

from __future__ import annotations

import random
import time
from collections import deque
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from infragraph.functions.schema import EDGE_SCHEMA, NODE_SCHEMA
from infragraph.operators import traverse as T
from infragraph.plans.chains import find_chains


def tables(spark, arcs, extra=()):
    """Nodes and edges of (from, to) or (from, to, type); the type of a node is its first letter."""
    edges = [(f"{a[0]}->{a[2] if len(a) > 2 else 't'}->{a[1]}", a[0], a[1], a[2] if len(a) > 2 else "t", {}) for a in arcs]
    ids = sorted({x for a in arcs for x in a[:2]} | set(extra))
    return spark.createDataFrame([(i, i, i[0], "s", "f", "p", {}, None, None, None) for i in ids], NODE_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA)


def plain_search(arcs, root, up=True):
    """{node: (depth, parent, type)} in the order of parents, types, ids."""
    after = {}
    for a, b, t in sorted(((b, a, t) if up else (a, b, t) for a, b, t in arcs), key=lambda x: (x[2], x[1])):
        after.setdefault(a, []).append((t, b))
    seen, todo = {root: (0, None, None)}, deque([root])
    while todo:
        x = todo.popleft()
        for t, y in after.get(x, []):
            if y not in seen:
                seen[y] = (seen[x][0] + 1, x, t)
                todo.append(y)
    return {k: v for k, v in seen.items() if k != root}


def chained(rng):
    """A random graph, some of whose edges are long chains, of different and of equal lengths."""
    names = iter(f"x{i:03d}" for i in range(900))
    hubs = [f"h{i}" for i in range(9)]
    arcs = {(rng.choice(hubs), rng.choice(hubs), rng.choice("ab")) for _ in range(12)}
    for _ in range(9):
        a, b, n = rng.choice(hubs), rng.choice(hubs), rng.choice([1, 3, 11, 11, 12, 20])
        way = [a, *(next(names) for _ in range(n)), b]
        arcs |= {(x, y, rng.choice("ab")) for x, y in zip(way, way[1:], strict=False)}
    tail = [rng.choice(hubs), *(next(names) for _ in range(15))]
    return sorted(arcs | {(y, x, "a") for x, y in zip(tail, tail[1:], strict=False)}), hubs


def test_searches_over_chains(spark):
    for seed in (1,):
        rng = random.Random(seed)
        arcs, hubs = chained(rng)
        nodes, edges = tables(spark, arcs)
        flat = [e for e in arcs if e[0] != e[1]]
        middle = max((x for e in flat for x in e[:2] if x[0] == "x"), key=lambda x: sum(x in e for e in flat))
        roots = [h for h in hubs[:3] if any(h in e[:2] for e in arcs)] + [middle]
        ids = spark.createDataFrame([(r,) for r in roots], "id string")
        assert find_chains(T._arcs(edges, True).groupBy("src", "dst").agg(F.min("type").alias("type")), ids) is not None
        want = {(r, k): v for r in roots for k, v in plain_search(arcs, r).items()}
        found = T.blast_radius(nodes, edges, ids).collect()
        assert {(r["root_id"], r["node_id"]): (r["depth"], r["parent_id"], r["edge_type"]) for r in found} == want and len(found) == len(want)
        for r in found:
            assert len(r["path"]) == r["depth"] + 1 and r["path"][0] == r["root_id"] and r["path"][-1] == r["node_id"] and (len(r["path"]) < 2 or r["path"][-2] == r["parent_id"])
        plain = T.blast_radius(nodes, edges, ids, paths=False, max_depth=14)
        assert {(r["root_id"], r["node_id"]): r["depth"] for r in plain.collect()} == {k: v[0] for k, v in want.items() if v[0] <= 14}


@pytest.mark.parametrize("after", [0, 3])
def test_chains_found_on_the_way(spark, monkeypatch, after):
    """Chains that a search looks for only after some levels, when it may stand in the middle of one."""
    monkeypatch.setattr(T, "CHAINS_AFTER", after)
    arcs, hubs = chained(random.Random(1))
    nodes, edges = tables(spark, arcs)
    roots = [h for h in hubs[:3] if any(h in e[:2] for e in arcs)]
    found = T.blast_radius(nodes, edges, spark.createDataFrame([(r,) for r in roots], "id string"), paths=False, parents=True).collect()
    want = {(r, k): v for r in roots for k, v in plain_search(arcs, r).items()}
    assert {(r["root_id"], r["node_id"]): (r["depth"], r["parent_id"], r["edge_type"]) for r in found} == want and len(found) == len(want)


def test_a_search_keeps_little_on_disk_and_ends_at_its_doors(spark):
    """Levels and arcs lie compressed; a root whose entry is found goes no further."""
    size = lambda: sum(f.stat().st_size for f in Path(spark.conf.get("spark.checkpoint.dir")[7:]).rglob("*") if f.is_file())
    leaves = [(f"compose:container:order-{i:08}", "door") for i in range(20_000)]
    nodes, edges = tables(spark, [("door", "root", "routes_to"), ("gate", "root", "routes_to"), *leaves])
    nodes = nodes.withColumn("type", F.when(F.col("id").isin("door", "gate"), "ingress").otherwise("vm"))
    ids = spark.createDataFrame([("root",)], "id string")
    before = size()
    rows = T.blast_radius(nodes, edges, ids, paths=False, parents=True)
    assert size() - before < 1_000_000 and rows.count() == 20_002
    assert T._search(T._arcs(edges, True), ids, until=nodes.where("type = 'ingress'").select("id")).count() == 1
    assert [tuple(r) for r in T.external_exposure(nodes, edges, ids).collect()] == [("root", True, "door", ["root", "door"])]


def test_a_shared_end_is_searched_once(spark, monkeypatch):
    """Pairs with the same ends share what is seen from them; a depth limit counts a pair's own steps."""
    from infragraph.operators import paths as P

    kept, real = [], P._meetings
    monkeypatch.setattr(P, "_meetings", lambda *a: kept.append(real(*a)) or kept[-1])
    arcs = [(f"n{i}", f"n{i + 1}") for i in range(6)] + [("n0", "m"), ("m", "n5")]
    _, edges = tables(spark, arcs)
    pairs = [("n0", f"n{i}") for i in range(1, 7)] + [("n2", "n6")]
    want = {("n0", "n1"): 1, ("n0", "n2"): 2, ("n0", "n3"): 3, ("n0", "n4"): 3, ("n0", "n5"): 2, ("n0", "n6"): 3, ("n2", "n6"): 4}
    for limit in (None, 3, 2):
        rows = T.shortest_path(edges, spark.createDataFrame(pairs, "from_id string, to_id string"), limit).collect()
        found = {}
        for r in rows:
            found[r["from_id"], r["to_id"]] = max(found.get((r["from_id"], r["to_id"]), 0), r["step"] or 0)
        assert found == {k: v if limit is None or v <= limit else 0 for k, v in want.items()}
    seen = kept[0][0]
    assert seen.columns[:3] == ["side", "root", "node_id"] and seen.groupBy("side", "root", "node_id").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("levels", [16, 2])
def test_reachable_from_many_roots(spark, monkeypatch, levels):
    """Roots of one component and of others, by a search; components are cut only where the search is too short."""
    whole, real = [], T.connected_components
    monkeypatch.setattr(T, "connected_components", lambda e, a, b: whole.append(a == "from_id") or real(e, a, b))
    arcs = [("a", "b"), ("c", "b"), ("c", "d"), ("e", "d"), ("e", "f"), ("x", "y"), ("z", "z"), ("p", "q"), ("q", "r"), ("r", "p")]
    _, edges = tables(spark, arcs)
    near = {x: {x} for a in arcs for x in a}
    for _ in arcs:
        for a, b in arcs:
            near[a] |= near[b]
            near[b] |= near[a]
    roots = ["a", "d", "f", "x", "z", "nowhere", "q"]
    found = [tuple(r) for r in T.reachable_undirected(edges, spark.createDataFrame([(r,) for r in roots], "id string"), levels).collect()]
    assert sorted(found) == sorted((r, n) for r in roots for n in near.get(r, {r}) if n != r)
    assert levels == 2 or not any(whole)
    alone = [tuple(r) for r in T.reachable_undirected(edges, spark.createDataFrame([("a",)], "id string"), levels).collect()]
    assert sorted(alone) == [("a", n) for n in "bcdef"] and any(whole) == (levels == 2)


def test_a_closure_keeps_little_on_disk(spark):
    """Pairs lie as compressed columns, and what was written together again is gone."""
    folder = Path(spark.conf.get("spark.checkpoint.dir")[7:])
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    edges = spark.range(1, 300).selectExpr("id as from_id", "id - 1 as to_id")
    before = size()
    assert T.closure(edges).count() == 299 * 300 // 2
    assert size() - before < 1_000_000


def test_reference_chains_in_time(spark):
    """A chain of 500 takes a few rounds, its counts too."""
    nodes, edges = tables(spark, [(f"n{i}", f"n{i - 1}") for i in range(1, 500)])
    began = time.perf_counter()
    rows = T.blast_radius(nodes, edges, spark.createDataFrame([("n0",)], "id string"), paths=False)
    assert rows.agg(F.count("*"), F.max("depth")).first() == (499, 499)
    nodes, edges = tables(spark, [(f"n{i:03d}", f"n{i - 1:03d}") for i in range(1, 150)])
    found = T.spof(nodes, edges, limit=0).collect()
    assert [r["affected"] for r in found] == list(range(149, 0, -1)) and found[0]["id"] == "n000" and found[0]["by_type"] == {"n": 149}
    assert time.perf_counter() - began < 120


def plain_paths(arcs, a, b):
    """All shortest undirected trails, smallest first."""
    near = {}
    for x, y, *_ in arcs:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    level = {a: [[a]]}
    seen = {a}
    while level and b not in level:
        fresh = {}
        for x, ways in level.items():
            for y in near.get(x, ()):
                if y not in seen:
                    fresh.setdefault(y, []).extend(w + [y] for w in ways)
        seen |= set(fresh)
        level = fresh
    return min(level[b]) if b in level else None


def test_shortest_paths_from_both_ends(spark):
    for seed, n, m in ((4, 40, 60),):
        rng = random.Random(seed)
        arcs = sorted({(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}", rng.choice("ab")) for _ in range(m)})
        _, edges = tables(spark, arcs)
        pairs = sorted({(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(25)} | {("n00", "zz"), ("n01", "n01")})
        rows = T.shortest_path(edges, spark.createDataFrame(pairs, "from_id string, to_id string")).collect()
        got = {}
        for r in rows:
            got.setdefault((r["from_id"], r["to_id"]), []).append((r["step"], r["node_id"], r["edge_id"], r["found"]))
        assert set(got) == set(pairs)
        by_ends = {}
        for a, b, t in arcs:
            by_ends.setdefault((a, b), []).append(f"{a}->{t}->{b}")
        for (a, b), own in got.items():
            want = [a] if a == b else plain_paths(arcs, a, b)
            if want is None:
                assert own == [(None, None, None, False)]
                continue
            own.sort()
            assert [s[0] for s in own] == list(range(len(want))) and [s[1] for s in own] == want, (a, b)
            for x, y, s in zip(want, want[1:], own[1:], strict=False):
                assert s[2] == min(by_ends.get((x, y)) or by_ends[(y, x)])
    assert T.shortest_path(edges.limit(0), spark.createDataFrame([("a", "b")], "from_id string, to_id string")).first()["found"] is False


def plain_reach(arcs):
    up = {}
    for a, b, *_ in arcs:
        up.setdefault(b, set()).add(a)
    out = {}
    for root in {x for e in arcs for x in e[:2]}:
        seen, todo = set(), [root]
        while todo:
            for x in up.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        out[root] = seen
    return out


@pytest.mark.parametrize("seed", [7])
def test_components_counts_and_cycles(spark, seed):
    rng = random.Random(seed)
    arcs = sorted({(f"{rng.choice('ab')}{rng.randrange(12):02d}", f"{rng.choice('ab')}{rng.randrange(12):02d}") for _ in range(30)} | {("a90", "a91"), ("a91", "a90"), ("a91", "a92"), ("a93", "a93")})
    nodes, edges = tables(spark, arcs)
    reach = plain_reach(arcs)
    strong = {x: {y for y in reach[x] if x in reach[y]} | {x} for x in reach}
    want = {x: min(c) for x, c in strong.items() if len(c) > 1}
    assert {r["node"]: r["component"] for r in T.strong_components(edges).collect()} == want
    counts = {x: s - {x} for x, s in reach.items() if s - {x}}
    found = {r["id"]: (r["affected"], r["by_type"]) for r in T.spof(nodes, edges, limit=0).collect()}
    assert found == {x: (len(s), {t: sum(y[0] == t for y in s) for t in {y[0] for y in s}}) for x, s in counts.items()}
    assert {(r["root_id"], r["node_id"]) for r in T.closure(edges, plain_rounds=2).collect()} == {(x, y) for x, s in counts.items() for y in s}
    cycles = set()

    def grow(path):
        for a, b in arcs:
            if a == path[-1]:
                if b == path[0]:
                    cycles.add(tuple(path))
                elif b > path[0] and b not in path and len(path) < 6:
                    grow([*path, b])

    for x in reach:
        grow([x])
    in_order = sorted((len(c), list(c)) for c in cycles)
    for task_arcs in (0, 20_000):
        got = [(r["length"], r["cycle"]) for r in T.find_cycles(edges, max_len=6, limit=0, task_arcs=task_arcs).collect()]
        assert got == in_order
        assert [(r["length"], r["cycle"]) for r in T.find_cycles(edges, max_len=6, limit=4, task_arcs=task_arcs).collect()] == in_order[:4]
