"""Compose files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from infragraph.sources.documents import LIST, MAP, Tables, decode_documents, edges_of, first_of, js, last_nodes, nodes_of, pairs, register_parser


def _list_or_keys(c: Column) -> Column:
    """A JSON list's items, or a JSON map's keys."""
    return F.coalesce(js(c, LIST), F.map_keys(js(c)), F.array().cast(LIST))


@register_parser("compose")
def compose(docs: DataFrame, as_of: Column) -> Tables:
    """Services, networks and volumes; named volumes count only if the file declares them."""
    bodies, bad = decode_documents(docs)
    top = js("body")
    files = bodies.select("path", *[js(top[k]).alias(k) for k in ("services", "networks", "volumes")])
    s = files.select("path", "volumes", F.explode("services").alias("name", "raw")).select("path", "volumes", "name", F.coalesce(js("raw"), F.create_map().cast(MAP)).alias("s")).withColumn("node_id", F.concat(F.lit("compose:container:"), "name"))
    meta = pairs(
        ("image", F.col("s")["image"]), ("ports", F.array_join(js(F.col("s")["ports"], LIST), ",")), ("init", F.col("s")["init"]),
        ("healthcheck", F.when(F.coalesce(F.col("s")["healthcheck"], F.lit("null")) != "null", "true")),
    )
    nodes = nodes_of(s, as_of, id=F.col("node_id"), name=F.col("name"), type=F.lit("container"), source=F.lit("compose"), provider=F.lit("docker"), metadata=meta)
    for field, kind, word in (("networks", "network", "network"), ("volumes", "disk", "volume")):
        declared = files.select("path", F.explode(F.map_keys(field)).alias("name"))
        nodes = nodes.unionByName(nodes_of(declared, as_of, id=F.concat(F.lit(f"compose:{word}:"), "name"), name=F.col("name"), type=F.lit(kind), source=F.lit("compose"), provider=F.lit("docker")))
    deps = s.select("node_id", F.explode(_list_or_keys(F.col("s")["depends_on"])).alias("raw"))
    edges = edges_of(deps, F.col("node_id"), F.concat(F.lit("compose:container:"), "raw"), "depends_on", via=F.lit("depends_on"), raw_value=F.col("raw"))
    nets = s.select("node_id", F.explode(_list_or_keys(F.col("s")["networks"])).alias("raw"))
    edges = edges.unionByName(edges_of(nets, F.col("node_id"), F.concat(F.lit("compose:network:"), "raw"), "connects_to", via=F.lit("networks"), raw_value=F.col("raw")))
    vols = s.select("node_id", "volumes", F.explode(js(F.col("s")["volumes"], LIST)).alias("raw")).withColumn("volume", F.substring_index("raw", ":", 1))
    vols = vols.where(~F.col("volume").rlike("^[/.]") & F.coalesce(F.map_contains_key("volumes", F.col("volume")), F.lit(False)))
    edges = edges.unionByName(edges_of(vols, F.col("node_id"), F.concat(F.lit("compose:volume:"), "volume"), "mounts_volume", via=F.lit("volumes"), raw_value=F.col("raw")))
    return last_nodes(nodes), first_of(edges), bad
