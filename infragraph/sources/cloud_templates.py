"""CloudFormation templates and Pulumi stacks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from infragraph.functions.scalar import after_last
from infragraph.sources.documents import LIST, MAP, MAPS, Tables, by_suffix, decode_documents, edges_of, first_of, js, last_nodes, merged, nodes_of, pairs, picked, prefixed, read_states, register_parser
from infragraph.sources.lookup import resource_type_lookup

#: Properties that are kept.
CFN_KEPT = (
    "InstanceType CidrBlock Engine Runtime BucketName FunctionName DBInstanceClass AvailabilityZone EngineVersion DBName "
    "PubliclyAccessible StorageEncrypted DeletionProtection MultiAZ AccessControl"
).split()
PULUMI_KEPT = (
    "region zone location availabilityZone instanceType machineType vmSize ami image arn selfLink project cidrBlock ipCidrRange "
    "engine engineVersion dbName acl encrypted storageEncrypted publiclyAccessible deletionProtection multiAz"
).split()
PULUMI_LINKS = "vpcId networkId network virtualNetworkName subnetId subnet subnetwork networkSecurityGroupId".split()
PULUMI_LISTS = "subnetIds securityGroupIds securityGroups".split()


def nested_references(bodies: pd.Series) -> pd.Series:
    """Logical ids named by Ref and Fn::GetAtt anywhere in a JSON value; below such a map nothing is searched."""

    def names(text: str | None) -> list[str]:
        found, todo = set(), [json.loads(text)] if text else []
        while todo:
            x = todo.pop()
            if isinstance(x, list):
                todo += x
            elif isinstance(x, dict) and isinstance(x.get("Ref"), str):
                if not x["Ref"].startswith("AWS::"):
                    found.add(x["Ref"])
            elif isinstance(x, dict) and "Fn::GetAtt" in x:
                at = x["Fn::GetAtt"]
                if isinstance(at, list) and at and isinstance(at[0], str):
                    found.add(at[0])
            elif isinstance(x, dict):
                todo += x.values()
        return sorted(found)

    return bodies.map(names)


def references(bodies: str) -> Column:
    return F.pandas_udf(nested_references, LIST)(bodies)


def _cfn_metadata(props: Column, kind: Column) -> Column:
    """I24 for CloudFormation."""
    cidrs = F.flatten(F.transform(js(props["SecurityGroupIngress"], MAPS), lambda r: F.array_compact(F.array(F.nullif(r["CidrIp"], F.lit("")), F.nullif(r["CidrIpv6"], F.lit(""))))))
    tags = F.filter(js(props["Tags"], MAPS), lambda t: F.coalesce(t["Key"], F.lit("")) != "")
    names = F.array_distinct(F.transform(tags, lambda t: t["Key"]))
    tag_map = F.map_from_arrays(names, F.transform(names, lambda k: F.coalesce(F.element_at(F.filter(tags, lambda t: t["Key"] == k), -1)["Value"], F.lit(""))))
    simple = F.map_filter(picked(props, CFN_KEPT), lambda k, v: ~v.startswith("{") & ~v.startswith("["))
    return merged(simple, prefixed(tag_map, "tag:"), pairs(("ingress_cidrs", F.array_join(cidrs, ",")), ("cfn_type", kind)))


@register_parser("cloudformation")
def cloudformation(docs: DataFrame, as_of: Column) -> Tables:
    """I6 to I8. References are looked up over all files; DependsOn beats Ref for the same edge."""
    bodies, bad = decode_documents(docs)
    top = js("body")
    missing = bodies.where(js(top["Resources"]).isNull()).select(F.col("path").alias("source_file"), F.lit("no resources in the template").alias("message"))
    r = bodies.select("path", F.explode(js(top["Resources"])).alias("logical", "res")).select("path", "logical", js("res").alias("res"))
    r = r.select("path", "logical", F.col("res")["Type"].alias("type"), F.col("res")["DependsOn"].alias("depends"), F.col("res")["Properties"].alias("raw_props"), F.coalesce(js(F.col("res")["Properties"]), F.create_map().cast(MAP)).alias("props"))
    r = r.join(F.broadcast(resource_type_lookup(docs.sparkSession, "cloudformation")), F.col("type") == F.col("resource_type"), "left").withColumn("node_id", F.concat(F.lit("cfn:"), "asset", F.lit(":"), "logical"))
    known = r.where("asset is not null")
    nodes = nodes_of(known, as_of, id=F.col("node_id"), name=F.col("logical"), type=F.col("asset"), source=F.lit("cloudformation"), provider=F.lit("aws"), metadata=_cfn_metadata(F.col("props"), F.col("type")))
    refs = known.groupBy(F.col("logical").alias("ref")).agg(F.max_by("node_id", "path").alias("target"))

    def to(rows: DataFrame, name: str, kind: str, **meta: Column) -> DataFrame:
        return edges_of(rows.join(refs, F.col(name) == F.col("ref")), F.col("node_id"), F.col("target"), kind, **meta)

    listed = F.coalesce(js("depends", LIST), F.when(F.col("depends") != "", F.array("depends")))
    a = to(known.select("node_id", F.explode(listed).alias("dep")), "dep", "depends_on", via=F.lit("DependsOn"), raw_value=F.col("dep")).withColumn("rank", F.lit(0))
    b = to(known.select("node_id", F.explode(references("raw_props")).alias("dep")), "dep", "depends_on", via=F.lit("Ref")).where("from_id <> to_id").withColumn("rank", F.lit(1))
    plain = F.array(*[F.struct(F.lit(k).alias("via"), F.col("props")[k].alias("raw")) for k in ("VpcId", "SubnetId", "SubnetIds")])
    groups = F.transform(F.coalesce(js(F.col("props")["SecurityGroupIds"], LIST), F.array().cast(LIST)), lambda g: F.struct(F.lit("SecurityGroupIds").alias("via"), g.alias("raw")))
    c = to(known.select("node_id", F.explode(F.concat(plain, groups)).alias("l")).select("node_id", "l.via", "l.raw"), "raw", "connects_to", via=F.col("via"), raw_value=F.col("raw")).withColumn("rank", F.lit(2))
    edges = first_of(a.unionByName(b).unionByName(c), "rank")
    unmapped = r.where("asset is null").select(F.col("path").alias("source_file"), F.concat(F.lit("unmapped CFN resource type: "), F.coalesce("type", F.lit("")), F.lit(" ("), "logical", F.lit(")")).alias("message"))
    return last_nodes(nodes), edges, bad.unionByName(missing).unionByName(unmapped)


def _listed(values: Column, via: str) -> Column:
    return F.transform(F.coalesce(js(values, LIST), F.array().cast(LIST)), lambda x: F.struct(F.lit(via).alias("via"), x.alias("raw")))


@register_parser("pulumi")
def pulumi(docs: DataFrame, as_of: Column) -> Tables:
    """I9, I10."""
    stacks, bad = read_states(docs)
    r = stacks.select("path", F.posexplode(js(js(js("body")["deployment"])["resources"], MAPS)).alias("no", "r"))
    r = r.select("path", "no", *[F.col("r")[k].alias(k) for k in ("urn", "type", "parent", "delete")], F.coalesce(js(F.col("r")["inputs"]), F.create_map().cast(MAP)).alias("inputs"), F.coalesce(js(F.col("r")["outputs"]), F.create_map().cast(MAP)).alias("outputs"), js(F.col("r")["dependencies"], LIST).alias("deps"))
    r = r.where((F.coalesce("delete", F.lit("false")) != "true") & (F.col("type") != "pulumi:pulumi:Stack") & ~F.col("type").startswith("pulumi:providers:"))
    name = F.coalesce(F.nullif(F.col("outputs")["name"], F.lit("")), F.nullif(F.col("inputs")["name"], F.lit("")), after_last("urn", "::"))
    r = r.join(F.broadcast(resource_type_lookup(docs.sparkSession, "pulumi")), F.col("type") == F.col("resource_type"), "left").withColumn("name", name).withColumn("node_id", F.concat(F.lit("plm:"), "asset", F.lit(":"), "name"))
    known = r.where("asset is not null")
    both = merged(F.col("inputs"), F.col("outputs"))
    meta = merged(picked(both, PULUMI_KEPT), prefixed(js(both["tags"]), "tag:"), prefixed(js(both["labels"]), "label:"), pairs(("pulumi_type", F.col("type"))))
    nodes = nodes_of(known, as_of, id=F.col("node_id"), name=F.col("name"), type=F.col("asset"), source=F.lit("pulumi"), provider=F.substring_index("type", ":", 1), metadata=meta)
    refs = known.groupBy("urn").agg(F.max_by("node_id", F.struct("path", "no")).alias("target"))
    to = refs.withColumnRenamed("urn", "ref")
    deps = known.select("node_id", F.explode("deps").alias("dep")).join(to, F.col("dep") == F.col("ref"))
    a = edges_of(deps, F.col("node_id"), F.col("target"), "depends_on", via=F.lit("dependencies"))
    single = F.array(*[F.struct(F.lit(k).alias("via"), F.col("inputs")[k].alias("raw")) for k in PULUMI_LINKS])
    several = [_listed(F.col("inputs")[k], k) for k in PULUMI_LISTS]
    links = known.select(F.col("node_id").alias("from"), F.posexplode(F.concat(single, *several)).alias("rank", "l")).select("from", "rank", "l.via", "l.raw").where("raw <> ''")
    found = by_suffix(links, "raw", refs.select(F.col("target").alias("node_id"))).where("target <> from")
    b = first_of(edges_of(found, F.col("from"), F.col("target"), "connects_to", via=F.col("via"), raw_value=F.col("raw")))
    parents = known.join(to, F.col("parent") == F.col("ref"))
    c = edges_of(parents, F.col("node_id"), F.col("target"), "member_of", via=F.lit("parent"))
    unmapped = r.where("asset is null").select(F.col("path").alias("source_file"), F.concat(F.lit("unmapped Pulumi resource type: "), "type", F.lit(" ("), "urn", F.lit(")")).alias("message"))
    return last_nodes(nodes), first_of(a).unionByName(b).unionByName(first_of(c)), bad.unionByName(unmapped)
