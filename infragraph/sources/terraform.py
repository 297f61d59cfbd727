"""Terraform state and plan documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from infragraph.functions.scalar import after_last
from infragraph.sources.documents import LIST, MAP, MAPS, Tables, by_suffix, edges_of, first_of, js, last_nodes, merged, nodes_of, pairs, picked, prefixed, read_states, register_parser
from infragraph.sources.lookup import resource_type_lookup

#: Attributes that are kept, and those that are flags.
KEPT = (
    "region zone location machine_type instance_type image ami arn self_link project network subnetwork ip_address private_ip "
    "public_ip network_ip nat_ip engine engine_version db_name acl"
).split()
FLAGS = "encrypted storage_encrypted publicly_accessible associate_public_ip_address deletion_protection multi_az".split()
LINKS = ["network", "subnetwork", "vpc_id"]


def plan_action(actions: Column) -> Column:
    """I5."""
    n = F.size(F.coalesce(actions, F.array().cast(LIST)))
    one = F.get(actions, F.lit(0))
    return F.when(n == 0, "no-op").when((n == 1) & one.isin("read", "no-op"), "no-op").when(n == 2, "replace").otherwise(one)


def provider_name(ref: Column) -> Column:
    """The last part of a provider reference."""
    return F.regexp_replace(after_last(F.coalesce(ref, F.lit("")), "/"), r'^provider\["|"\]$', "")


def _cidrs(rules: Column) -> Column:
    blocks = F.transform(js(rules, MAPS), lambda r: F.concat(F.coalesce(js(r["cidr_blocks"], LIST), F.array().cast(LIST)), F.coalesce(js(r["ipv6_cidr_blocks"], LIST), F.array().cast(LIST))))
    return F.array_join(F.flatten(blocks), ",")


def extract_metadata(attrs: Column, resource_type: Column) -> Column:
    """I24 for Terraform; numbers in tags keep their JSON text."""
    logging = js(attrs["logging"], LIST)
    extra = pairs(
        ("ingress_cidrs", _cidrs(attrs["ingress"])), ("egress_cidrs", _cidrs(attrs["egress"])),
        ("versioning", F.get(js(attrs["versioning"], MAPS), F.lit(0))["enabled"]),
        ("logging", F.when(logging.isNotNull(), (F.size(logging) > 0).cast("string"))), ("tf_type", resource_type),
    )
    return merged(picked(attrs, KEPT + FLAGS), prefixed(js(attrs["tags"]), "tag:"), prefixed(js(attrs["labels"]), "label:"), extra)


def _link_edges(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """connects_to what a network attribute's last part names; rows (node_id, attrs), refs (node_id)."""
    links = rows.select(F.col("node_id").alias("from"), F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("via"), F.col("attrs")[k].alias("raw")) for i, k in enumerate(LINKS)]), lambda x: x["raw"] != "")).alias("l"))
    found = by_suffix(links.select("from", "l.i", "l.via", "l.raw", after_last("l.raw", "/").alias("name")), "name", refs)
    made = edges_of(found, F.col("from"), F.col("target"), "connects_to", via=F.col("via"), raw_value=F.col("raw"))
    return first_of(made)


def tf_resources(states: DataFrame) -> DataFrame:
    """Mapped and unmapped resource instances of states: (path, type, block, asset, provider, attrs, deps, node_id, name)."""
    r = states.select("path", F.posexplode(js(js("body")["resources"], MAPS)).alias("r_no", "r"))
    r = r.where(F.coalesce(F.col("r")["mode"], F.lit("")) != "data").select("path", "r_no", F.col("r")["type"].alias("type"), F.col("r")["name"].alias("block"), F.col("r")["provider"].alias("ref"), js(F.col("r")["instances"], MAPS).alias("instances"))
    asset = F.broadcast(resource_type_lookup(states.sparkSession, "terraform"))
    r = r.join(asset, F.col("type") == F.col("resource_type"), "left").select("path", "r_no", "type", "block", "asset", provider_name(F.col("ref")).alias("provider"), F.posexplode_outer("instances").alias("i_no", "i"))
    r = r.select("*", F.coalesce(js(F.col("i")["attributes"]), F.create_map().cast(MAP)).alias("attrs"), js(F.col("i")["dependencies"], LIST).alias("deps"))
    name = F.coalesce(F.nullif(F.col("attrs")["name"], F.lit("")), F.col("block"))
    return r.withColumn("name", name).withColumn("node_id", F.concat(F.lit("tf:"), "asset", F.lit(":"), "name"))


@register_parser("terraform")
def tf_state(docs: DataFrame, as_of: Column) -> Tables:
    """I1 to I3. References are looked up over all files; of equal ones the last file's last instance counts."""
    states, bad = read_states(docs)
    r = tf_resources(states)
    known = r.where("asset is not null and i_no is not null")
    expires = F.when(F.col("asset") == "certificate", F.try_to_timestamp(F.col("attrs")["not_after"]))
    nodes = nodes_of(
        known, as_of, id=F.col("node_id"), name=F.col("name"), type=F.col("asset"), source=F.lit("terraform"), provider=F.col("provider"),
        metadata=extract_metadata(F.col("attrs"), F.col("type")), expires_at=expires,
    )
    refs = known.groupBy(F.concat("type", F.lit("."), "block").alias("ref")).agg(F.max_by("node_id", F.struct("path", "r_no", "i_no")).alias("target"))
    deps = known.select(F.col("node_id").alias("from"), F.explode("deps").alias("dep")).join(refs, F.col("dep") == F.col("ref"))
    edges = first_of(edges_of(deps, F.col("from"), F.col("target"), "depends_on", source=F.lit("tfstate_dependency"), reference=F.col("dep")))
    edges = edges.unionByName(_link_edges(known, refs.select(F.col("target").alias("node_id"))))
    unmapped = r.where("asset is null").select(F.col("path").alias("source_file"), F.concat(F.lit("unmapped resource type: "), "type", F.lit("."), "block").alias("message")).distinct()
    return last_nodes(nodes), edges, bad.unionByName(unmapped)


@register_parser("terraform-plan")
def tf_plan(docs: DataFrame, as_of: Column) -> Tables:
    """I4: planned changes; a node's source is terraform-plan and its id that of the state's node."""
    plans, bad = read_states(docs)
    c = plans.select("path", F.posexplode(js(js("body")["resource_changes"], MAPS)).alias("no", "c"))
    change = js(F.col("c")["change"])
    attrs = F.coalesce(js(change["after"]), js(change["before"]), F.create_map().cast(MAP))
    c = c.where(F.coalesce(F.col("c")["mode"], F.lit("")) != "data").select(
        "path", "no", F.col("c")["address"].alias("address"), F.col("c")["type"].alias("type"), F.col("c")["name"].alias("block"), provider_name(F.col("c")["provider_name"]).alias("provider"), plan_action(js(change["actions"], LIST)).alias("action"), attrs.alias("attrs")
    ).where("action <> 'no-op'")
    c = c.join(F.broadcast(resource_type_lookup(docs.sparkSession, "terraform")), F.col("type") == F.col("resource_type"), "left")
    c = c.withColumn("name", F.coalesce(F.nullif(F.col("attrs")["name"], F.lit("")), "block")).withColumn("node_id", F.concat(F.lit("tf:"), "asset", F.lit(":"), "name"))
    known = c.where("asset is not null")
    meta = merged(extract_metadata(F.col("attrs"), F.col("type")), pairs(("plan_action", F.col("action"))))
    nodes = nodes_of(known, as_of, id=F.col("node_id"), name=F.col("name"), type=F.col("asset"), source=F.lit("terraform-plan"), provider=F.col("provider"), metadata=meta)
    refs = known.groupBy("address").agg(F.max_by("node_id", F.struct("path", "no")).alias("node_id")).select("node_id")
    unmapped = c.where("asset is null").select(F.col("path").alias("source_file"), F.concat(F.lit("unmapped resource type: "), "address").alias("message"))
    return last_nodes(nodes), _link_edges(known, refs), bad.unionByName(unmapped)
