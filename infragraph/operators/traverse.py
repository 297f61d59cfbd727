"""Graph traversal (T1 to T14): level-by-level joins, many roots at once.

A search keeps its frontier and the pairs (root, node) it has seen; each level is one equi-join with the
edges, one anti-join with the seen pairs and one combinable aggregate, and is checkpointed so that the
lineage stays short and a lost executor costs one level. An edge "from depends on to".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from infragraph.operators.cycles import find_cycles, strong_components
from infragraph.operators.paths import shortest_path
from infragraph.operators.relational import both_ways
from infragraph.plans.chains import find_chains
from infragraph.plans.components import connected_components
from infragraph.plans.lineage import bucketed, cut, discard, packed, release

__all__ = ["find_cycles", "shortest_path", "strong_components"]

SEEN_PARTS = 16  # levels after which what was seen is written together
CHAINS_AFTER = 12  # levels that a search walks before it looks for chains


def by_source(arcs: DataFrame) -> DataFrame:
    """Arcs (src, dst, type) in buckets of ``src``, which levels join without a shuffle; levels make what repeats distinct."""
    n = int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bucketed(arcs.where("src is not null and dst is not null").select("src", "dst", "type").repartition(n, "src"), "src", "arcs")


def _search(arcs: DataFrame, roots: DataFrame, max_depth: int | None = None, ordered: bool = True, until: DataFrame | None = None) -> DataFrame:
    """Breadth-first over arcs (src, dst, type): (root_id, node_id, parent_id, edge_type, depth, place), without the roots.

    W2: inside a level, nodes come in the order of (their parent's place, edge type, node id), and the first
    discoverer of a node is its parent. Places are numbers that grow in this order: a level is sorted by
    range, so no root's level is gathered in one task. Without ``ordered`` there is no parent, edge type and
    place: a level is only made distinct.

    A search that is not over after ``CHAINS_AFTER`` levels walks a long chain of nodes with one way in and out in one
    step: who enters it arrives at its end as many levels later. Nobody else can discover its nodes, so levels in which all
    are on their way are passed over. Until it arrives, a walker takes part in the order of the levels, at the place of
    its node there. The chain's nodes are filled in at the end; their place is their walker's last one. Roots, the nodes
    reached last before that and those of ``until`` are not in chains.

    ``until`` (id) ends a root's search (ordered) at the first of these nodes, which is all that its last level has.
    """
    arcs = by_source(arcs)
    start = roots.select(F.col("id").alias("root_id")).distinct()
    columns = ["parent_id", "edge_type", "place"] if ordered else []
    kinds = {"parent_id": "string", "edge_type": "string", "place": "bigint"}
    front = packed(start.select("root_id", F.col("root_id").alias("node_id"), F.lit(0).alias("depth"), *[F.lit(0 if c == "place" else None).cast(kinds[c]).alias(c) for c in columns]))
    own, seen, out, depth, levels, walkers, chains, old, chained = front, front, None, 0, 0, None, None, [], 0
    while max_depth is None or depth < max_depth:
        if levels == CHAINS_AFTER:
            kept = start.select(F.col("root_id").alias("id")).unionByName(front.select(F.col("node_id").alias("id")))
            chains = find_chains(arcs.groupBy("src", "dst").agg(F.min("type").alias("type")), kept if until is None else kept.unionByName(until.select("id")))
            if chains is not None:
                heads, links = chains
                inner = heads.select(F.col("head").alias("src")).unionByName(links.select(F.col("node_id").alias("src")))
                whole, arcs, chained = arcs, by_source(arcs.join(inner, "src", "left_anti")), depth
                discard(whole)
        depth, levels = depth + 1, levels + 1
        if walkers is not None and front.isEmpty():
            depth = walkers.agg(F.min("arrive")).first()[0]
            if depth is None or (max_depth is not None and depth > max_depth):
                break
        step = front.select("root_id", F.col("node_id").alias("via"), *(["place"] if ordered else [])).join(arcs, F.col("via") == F.col("src")).select("root_id", "via", "dst", *(["place", "type"] if ordered else []))
        if walkers is not None:
            ended = walkers.where(F.col("arrive") == depth).select("root_id", F.col("last").alias("via"), F.col("end").alias("dst"), *(["place", F.col("end_type").alias("type")] if ordered else []))
            step = step.unionByName(ended)
        if ordered:
            first = step.groupBy("root_id", F.col("dst").alias("node_id")).agg(F.min(F.struct("place", "type", F.col("via").alias("parent_id"))).alias("m"))
            first = first.select("root_id", "node_id", F.lit(depth).alias("depth"), "m.parent_id", F.col("m.type").alias("edge_type"), F.col("m.place").alias("before"))
        else:
            first = step.select("root_id", F.col("dst").alias("node_id"), F.lit(depth).alias("depth")).distinct()
        first = first.join(seen.select("root_id", "node_id"), ["root_id", "node_id"], "left_anti")
        still = None if walkers is None else walkers.where(F.col("arrive") > depth)
        if until is not None:
            met = first.join(until.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi")
            best = met.groupBy("root_id").agg(F.min(F.struct("before", "edge_type", "node_id", "parent_id")).alias("m"))
            ends = packed(best.select("root_id", "m.node_id", F.lit(depth).alias("depth"), "m.parent_id", "m.edge_type", F.lit(0).cast("bigint").alias("place")))
            first = first.join(ends.select("root_id"), "root_id", "left_anti")
            still = None if still is None else still.join(ends.select("root_id"), "root_id", "left_anti")
            out = ends if out is None else out.unionByName(ends)
        if chains is not None:
            entered = heads.select(F.col("head").alias("node_id"), "last", (F.col("k") + depth).cast("int").alias("arrive"), "end", "end_type")
            first = first.join(entered, "node_id", "left").withColumn("new", F.lit(True))
            if still is not None:
                first = first.unionByName(still.withColumn("before", F.col("place")).drop("place") if ordered else still)
        if ordered:
            order = ["before", "edge_type", "node_id"]
            first = first.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()).drop("before")
        level = packed(first)
        if chains is not None:
            fresh, front = level.where("new").drop("new", *["last", "arrive", "end", "end_type"]), level.where("new and arrive is null").drop("new", "last", "arrive", "end", "end_type")
            walkers = level.where("arrive is not null").withColumn("new", F.lit(False))
        else:
            fresh = front = level
        if level.isEmpty():
            break
        out = fresh if out is None else out.unionByName(fresh)
        seen = seen.unionByName(fresh)
        if levels % SEEN_PARTS == 0:  # a deep search does not read one part for each level
            out = packed(out)
            seen = out.unionByName(own)
            discard(*old)
            old = [out]
        old.append(level)
        release(own.sparkSession)
    discard(arcs)
    if out is None:
        return front.limit(0)
    if chains is not None:
        walked = out.where(F.col("depth") > chained).select("root_id", F.col("node_id").alias("head"), "depth", *(["place"] if ordered else [])).join(links, "head")
        walked = walked.select("root_id", "node_id", (F.col("depth") + F.col("step")).alias("depth"), *columns)
        out = out.unionByName(walked if max_depth is None else walked.where(F.col("depth") <= max_depth))
    return out


def with_paths(rows: DataFrame) -> DataFrame:
    """``rows`` of an ordered search with ``path``, the nodes from the root on.

    Each row knows its parent; ways upward are joined end to end and so double in length each round.
    """
    ways = cut(rows.select("root_id", "node_id", F.when(F.col("parent_id") != F.col("root_id"), F.col("parent_id")).alias("up"), F.array("node_id").alias("way")))
    done = ways.where("up is null")
    open_ = ways.where("up is not null")
    while not open_.isEmpty():
        above = ways.select("root_id", F.col("node_id").alias("up"), F.col("up").alias("up_"), F.col("way").alias("way_"))
        ways = cut(open_.join(above, ["root_id", "up"]).select("root_id", "node_id", F.col("up_").alias("up"), F.concat("way_", "way").alias("way")).unionByName(done))
        done, open_ = ways.where("up is null"), ways.where("up is not null")
    paths = done.select("root_id", "node_id", F.concat(F.array("root_id"), "way").alias("path"))
    return rows.join(paths, ["root_id", "node_id"])


def _arcs(edges: DataFrame, upstream: bool, edge_types: list[str] | None = None) -> DataFrame:
    e = edges.where(F.col("type").isin(edge_types)) if edge_types else edges
    src, dst = ("to_id", "from_id") if upstream else ("from_id", "to_id")
    return e.select(F.col(src).alias("src"), F.col(dst).alias("dst"), "type")


def blast_radius(nodes: DataFrame, edges: DataFrame, roots: DataFrame, edge_types: list[str] | None = None, max_depth: int | None = None, paths: bool = True, parents: bool = False) -> DataFrame:
    """(root_id, node_id, parent_id, edge_type, depth, path): all that transitively points to each root.

    Roots are a column ``id``; the root itself is left out and cycles are safe. All edge types count,
    ``correlates_with`` too, unless ``edge_types`` names some (D5). Without ``paths`` only (root_id, node_id,
    depth) is found, which is all that counting needs, and with ``parents`` the tree's edges too.
    """
    rows = _search(_arcs(edges, True, edge_types), roots, max_depth, ordered=paths or parents)
    return with_paths(rows).select("root_id", "node_id", "parent_id", "edge_type", "depth", "path") if paths else rows


def blast_summary(rows: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_id, affected, by_type) for every root, 0 and an empty map where nothing is affected."""
    typed = rows.join(nodes.select(F.col("id").alias("node_id"), "type"), "node_id", "left")
    by_type = typed.where("type is not null").groupBy("root_id", "type").agg(F.count(F.lit(1)).alias("n"))
    maps = by_type.groupBy("root_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"))
    total = rows.groupBy("root_id").agg(F.count(F.lit(1)).alias("affected"))
    out = roots.select(F.col("id").alias("root_id")).distinct().join(total, "root_id", "left").join(maps, "root_id", "left")
    return out.select("root_id", F.coalesce("affected", F.lit(0)).alias("affected"), F.coalesce("by_type", F.create_map().cast("map<string,bigint>")).alias("by_type"))


def impact_tree(rows: DataFrame) -> DataFrame:
    """(root_id, parent_id, children, n_children). Parents are those of the breadth-first search."""
    kids = F.array_sort(F.collect_list("node_id"))
    return rows.groupBy("root_id", "parent_id").agg(kids.alias("children"), F.count(F.lit(1)).alias("n_children"))


def impact_warnings(rows: DataFrame, nodes: DataFrame, as_of: Column, roots: DataFrame, days: int = 30) -> DataFrame:
    """T4: nodes of the impact set, roots included, that expire within ``days`` or have expired."""
    from infragraph.functions.scalar import days_until

    every = rows.select("root_id", "node_id").unionAll(roots.select(F.col("id").alias("root_id"), F.col("id").alias("node_id")).distinct())
    n = nodes.where(F.col("expires_at").isNotNull()).select(F.col("id").alias("node_id"), days_until("expires_at", as_of).alias("days"))
    return every.join(n, "node_id").where(F.col("days") <= days).select("root_id", "node_id", "days")


def dependency_chain(edges: DataFrame, roots: DataFrame, max_depth: int = 10) -> DataFrame:
    """T5: what each root depends on, up to ``max_depth`` hops; nothing for a depth of 0 or less."""
    return with_paths(_search(_arcs(edges, False), roots, max(0, max_depth))).select("root_id", "node_id", "parent_id", "edge_type", "depth", "path")


def closure(edges: DataFrame, max_depth: int | None = None, plain_rounds: int = 4) -> DataFrame:
    """Pairs (root_id, node_id): each node with all that transitively points to it; semi-naive.

    The first rounds add an edge each, as most graphs are shallow; from then on what is new is joined with all pairs so
    far, which doubles the distance a round, so that a deep graph takes a logarithm of its depth.
    """
    kind = edges.schema["to_id"].dataType.simpleString()
    step = packed(edges.select(F.col("to_id").cast(kind).alias("root_id"), F.col("from_id").alias("node_id")).where("root_id <> node_id").distinct())
    every, fresh, depth, old = step, step, 1, []
    while max_depth is None or depth < max_depth:
        depth += 1
        far = step if max_depth is not None or depth <= plain_rounds else every
        hop = far.select(F.col("root_id").alias("via"), F.col("node_id").alias("next"))
        more = fresh.join(hop, fresh["node_id"] == hop["via"]).select("root_id", F.col("next").alias("node_id")).where("root_id <> node_id").distinct()
        fresh = packed(more.join(every, ["root_id", "node_id"], "left_anti"))
        if fresh.isEmpty():
            break
        every = every.unionAll(fresh)
        if depth % plain_rounds == 0:
            every = packed(every)
            discard(*old)
            old = [every]
            release(edges.sparkSession)
        old.append(fresh)
    return every


def reach_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, affected, by_type) of every node that others depend on, exactly, over the graph of strong components.

    Nodes on a common cycle are one place; places have dense numbers, so the closure holds pairs of numbers between places
    instead of names between nodes. What a place counts of each type is counted once.
    """
    every = packed(edges.select("from_id", "to_id").where("from_id <> to_id").distinct())
    ends = every.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    strong = strong_components(every).withColumnRenamed("node", "id")
    placed = ends.join(strong, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    numbers = packed(placed.select("component").distinct().repartitionByRange("component").sortWithinPartitions("component").withColumn("place", F.monotonically_increasing_id()))
    place = packed(placed.join(numbers, "component").join(nodes.select("id", "type"), "id", "left").select("id", "place", "type"))
    number = lambda end: place.select(F.col("id").alias(f"{end}_id"), F.col("place").alias(end))
    arcs = every.join(number("from"), "from_id").join(number("to"), "to_id").where("`from` <> `to`").select(F.col("from").alias("from_id"), F.col("to").alias("to_id")).distinct()
    pairs = closure(arcs)
    held = place.groupBy("place", "type").agg(F.count(F.lit(1)).alias("n"))
    own = held.withColumn("root_place", F.col("place")).select("root_place", "type", "n")
    above = pairs.select(F.col("root_id").alias("root_place"), F.col("node_id").alias("place")).join(held, "place").select("root_place", "type", "n")
    counts = packed(own.unionByName(above).groupBy("root_place", "type").agg(F.sum("n").alias("n")))
    # of its own place a node counts the others
    each = place.join(counts.withColumnRenamed("root_place", "place").withColumnRenamed("type", "kind"), "place").select("id", "kind", (F.col("n") - F.when(F.col("kind").eqNullSafe(F.col("type")), 1).otherwise(0)).alias("n")).where("n > 0")
    return each.groupBy("id").agg(F.sum("n").alias("affected"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct(F.col("kind").alias("type"), "n"))))).alias("by_type"))


def spof(nodes: DataFrame, edges: DataFrame, min_affected: int = 1, limit: int = 20, max_depth: int | None = None, lg_k: int = 12, most: int = 2000) -> DataFrame:
    """(id, affected, by_type) of every node that at least ``min_affected`` others depend on.

    Most affected first, ties by id. The first ``limit`` are found by sketches of all nodes: only those whose
    estimate comes within six standard errors of the last place are searched exactly, so the result is right unless an
    estimate is off by more, and where more than ``most`` nodes come that near (ties) all are counted instead. A limit of
    0 means all, by ``reach_counts``; a ``max_depth`` takes the closure of names.
    """
    known = nodes.select("id")
    roots = None
    if limit and max_depth is None:
        error = 6 * 1.04 / 2 ** (lg_k / 2)
        ranked = cut(_reach_sketches(edges, lg_k).join(known, "id", "left_semi"))
        last = ranked.orderBy(F.desc("affected")).limit(limit).agg(F.min("affected")).first()[0] or 0
        roots = cut(ranked.where(F.col("affected") * (1 + error) >= last * (1 - error)).select("id"))
        roots = None if roots.count() > most else roots
    if roots is not None:
        pairs = _search(_arcs(edges, True), roots, ordered=False)
    elif max_depth is None:
        counted = reach_counts(nodes, edges).join(known, "id", "left_semi").where(F.col("affected") >= min_affected).orderBy(F.desc("affected"), "id")
        return counted.limit(limit) if limit else counted
    else:
        pairs = closure(edges, max_depth).join(known.withColumnRenamed("id", "root_id"), "root_id", "left_semi")
        roots = pairs.select(F.col("root_id").alias("id")).distinct()
    out = blast_summary(pairs, nodes, roots).where(F.col("affected") >= min_affected).withColumnRenamed("root_id", "id").orderBy(F.desc("affected"), "id")
    return out.limit(limit) if limit else out


def _reach_sketches(edges: DataFrame, lg_k: int, max_rounds: int | None = None) -> DataFrame:
    """(id, affected): the estimated number of nodes that transitively point to each node that any points to.

    Each round passes on, along the edges, only the sketches that the round before changed; it ends when none
    changes. On a cycle a node counts itself, as one more.
    """
    e = packed(edges.select("from_id", "to_id").where("from_id <> to_id").distinct())
    own = packed(e.groupBy(F.col("to_id").alias("id")).agg(F.hll_sketch_agg("from_id", F.lit(lg_k)).alias("sketch")).select("id", "sketch", F.hll_sketch_estimate("sketch").alias("affected"), F.lit(True).alias("fresh")))
    rounds = 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        sent = e.join(own.where("fresh").select(F.col("id").alias("from_id"), "sketch"), "from_id").groupBy(F.col("to_id").alias("id")).agg(F.hll_union_agg("sketch").alias("more"))
        both = own.select("id", "sketch", F.col("affected").alias("before")).join(sent, "id", "left").withColumn("sketch", F.when(F.col("more").isNull(), F.col("sketch")).otherwise(F.hll_union("sketch", "more")))
        last, own = own, packed(both.withColumn("affected", F.hll_sketch_estimate("sketch")).select("id", "sketch", "affected", (F.col("affected") != F.col("before")).alias("fresh")))
        discard(last)
        release(edges.sparkSession)
        if own.where("fresh").isEmpty():
            break
    discard(e)
    return own.select("id", "affected")


def spof_approx(nodes: DataFrame, edges: DataFrame, min_affected: int = 1, limit: int = 20, lg_k: int = 12, max_rounds: int | None = None) -> DataFrame:
    """(id, affected): the ranking of T6 with a sketch of 2^lg_k slots for each node instead of the closure."""
    out = _reach_sketches(edges, lg_k, max_rounds).join(nodes.select("id"), "id", "left_semi")
    out = out.where(F.col("affected") >= min_affected).orderBy(F.desc("affected"), "id")
    return out.limit(limit) if limit else out


def _reached(edges: DataFrame, roots: DataFrame, levels: int) -> DataFrame | None:
    """(node, component) of all nodes connected to roots (root_id), by a search from all roots at once; None if it takes more levels.

    A node takes the label of one root that reaches it and is walked from once; labels that meet at a node are linked, and
    components are found among the labels alone.
    """
    arcs = by_source(both_ways(edges).where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(None).cast("string").alias("type")))
    front = packed(roots.where("root_id is not null").select(F.col("root_id").alias("node"), F.col("root_id").alias("label")))
    seen, links = front, []
    for _ in range(levels):
        step = front.join(arcs, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "label")
        met = step.groupBy("node").agg(F.collect_set("label").alias("labels")).join(seen.withColumnRenamed("label", "old"), "node", "left")
        kept = F.coalesce("old", F.array_min("labels"))
        other = F.filter("labels", lambda x: x != kept)
        level = packed(met.where(F.col("old").isNull() | (F.size(other) > 0)).select("node", kept.alias("label"), F.col("old").isNull().alias("new"), other.alias("others")))
        links.append(packed(level.select("label", F.explode("others").alias("other")).distinct()))
        front = level.where("new").select("node", "label")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        release(edges.sparkSession)
    discard(arcs)
    if not front.isEmpty():
        return None
    every = links[0]
    for x in links[1:]:
        every = every.unionByName(x)
    joint = connected_components(every, "label", "other").withColumnRenamed("node", "label")
    return seen.join(joint, "label", "left").select("node", F.coalesce("component", "label").alias("component"))


def reachable_undirected(edges: DataFrame, roots: DataFrame, levels: int = SEEN_PARTS) -> DataFrame:
    """(root_id, node_id): all nodes connected to each root, whatever the direction, roots left out.

    A graph that a search from the roots does not exhaust in ``levels`` levels is cut into components, which takes a
    logarithm of its depth.
    """
    own = roots.select(F.col("id").alias("root_id")).distinct()
    parts = _reached(edges, own, levels)
    if parts is None:
        parts = connected_components(edges, "from_id", "to_id")
    own = own.join(parts, F.col("root_id") == F.col("node")).select("root_id", "component")
    return own.join(parts, "component").where("node <> root_id").select("root_id", F.col("node").alias("node_id"))


def secrets_touched(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_id, node_id): ends of the search tree's mounts_secret edges, and the root; none without such."""
    arcs = both_ways(edges).select(F.col("a").alias("src"), F.col("b").alias("dst"), "type")
    ends = _search(arcs, roots).where("edge_type = 'mounts_secret'").select("root_id", F.explode(F.array("node_id", "parent_id", "root_id")).alias("node_id"))
    return ends.distinct()


def external_exposure(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_id, exposed, entry_id, path): the nearest upstream ingress or load balancer of each root."""
    entries = nodes.where(F.col("type").isin("ingress", "load_balancer")).select("id")
    rows = _search(_arcs(edges, True), roots, until=entries)
    near = rows.join(entries.withColumnRenamed("id", "node_id"), "node_id", "left_semi").select("root_id", "node_id")
    # the ways down from the doors that were found, a level a round
    way = cut(near.select("root_id", F.col("node_id").alias("entry_id"), F.col("node_id").alias("at"), F.array("node_id").alias("path")))
    parent = rows.select("root_id", F.col("node_id").alias("at"), "parent_id")
    while not way.where("at <> root_id").isEmpty():
        way = cut(way.join(parent, ["root_id", "at"], "left").select("root_id", "entry_id", F.coalesce("parent_id", "at").alias("at"), F.when(F.col("parent_id").isNull(), F.col("path")).otherwise(F.concat(F.array("parent_id"), "path")).alias("path")))
    out = roots.select(F.col("id").alias("root_id")).distinct().join(way, "root_id", "left")
    return out.select("root_id", F.col("entry_id").isNotNull().alias("exposed"), "entry_id", "path")


def focus_upstream(nodes: DataFrame, edges: DataFrame, roots: DataFrame, k: int) -> DataFrame:
    """T1 up to ``k`` hops."""
    return blast_radius(nodes, edges, roots, max_depth=k)


def focus_downstream(edges: DataFrame, roots: DataFrame, k: int) -> DataFrame:
    """T5 up to ``k`` hops."""
    return dependency_chain(edges, roots, k)


def plan_impact(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, action, affected, by_type) of every planned node; creations affect nothing."""
    planned = nodes.where("source = 'terraform-plan'").select("id", F.col("metadata")["plan_action"].alias("action"))
    roots = planned.where(F.col("action").isin("update", "delete", "replace")).select("id")
    found = blast_summary(blast_radius(nodes, edges, roots, paths=False), nodes, roots).withColumnRenamed("root_id", "id")
    return planned.join(found, "id", "left").select("id", "action", F.coalesce("affected", F.lit(0)).alias("affected"), F.coalesce("by_type", F.create_map().cast("map<string,bigint>")).alias("by_type"))
