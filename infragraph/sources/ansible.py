"""Ansible inventories and playbooks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from infragraph.functions.scalar import first_non_empty, k8s_service_id, redis_connection_string, sanitize_node_part, split_targets
from infragraph.sources.documents import MAP, MAPS, Tables, decode_documents, edges_of, first_of, js, last_nodes, merged, nodes_of, pairs, picked, register_parser

#: Variable, edge type, kind of target, hint.
HOST_RULES = [
    ("db_host", "depends_on", "host", "database"),
    ("db_hosts", "depends_on", "host", "database"),
    ("database_host", "depends_on", "host", "database"),
    ("database_hosts", "depends_on", "host", "database"),
    ("postgres_host", "depends_on", "host", "database"),
    ("postgres_hosts", "depends_on", "host", "database"),
    ("mysql_host", "depends_on", "host", "database"),
    ("mysql_hosts", "depends_on", "host", "database"),
    ("redis_host", "connects_to", "host", ""),
    ("redis_hosts", "connects_to", "host", ""),
    ("cache_host", "connects_to", "host", ""),
    ("cache_hosts", "connects_to", "host", ""),
]
SERVICE_RULES = [
    ("k8s_service", "connects_to", "service", ""),
    ("k8s_services", "connects_to", "service", ""),
    ("kubernetes_service", "connects_to", "service", ""),
    ("kubernetes_services", "connects_to", "service", ""),
    ("k8s_redis_service", "connects_to", "service", ""),
    ("k8s_redis_services", "connects_to", "service", ""),
    ("redis_k8s_service", "connects_to", "service", ""),
    ("redis_k8s_services", "connects_to", "service", ""),
    ("kubernetes_redis", "connects_to", "service", ""),
    ("kubernetes_redis_svc", "connects_to", "service", ""),
]
DOCKER_KEPT = ["name", "image", "state", "restart_policy", "network_mode"]


def is_ini(text: str | Column = "text") -> Column:
    return ~F.trim(text).rlike(r"^(---|all:|- |[\[{]\s*[\"{])") | F.col("path").endswith(".ini")


def ansible_ini_hosts(docs: DataFrame) -> DataFrame:
    """(path, place, hostname, groups, vars) of INI inventories.

    A line's section is the last header above it. Host variables beat those of the groups that list the host
    directly; ``children`` sections add the parent group, one level.
    """
    lines = docs.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", "[\r\t]", " "))).where(~F.col("line").rlike("^([#;]|$)"))
    header = F.when(F.col("line").rlike(r"^\[.*\]$"), F.regexp_extract("line", r"^\[(.*)\]$", 1))
    lines = lines.withColumn("header", header).selectExpr("*", "last(header, true) over (partition by path order by pos) as section").where("header is null")
    group = F.substring_index(F.coalesce("section", F.lit("")), ":", 1)
    kind = F.when(F.col("section").contains(":vars"), "vars").when(F.col("section").contains(":children"), "children").otherwise("hosts")
    lines = lines.select("path", "pos", "line", F.when(kind == "hosts", F.coalesce("section", F.lit(""))).otherwise(group).alias("grp"), kind.alias("kind"))
    fields = F.split("line", r"\s+")
    pairs_of = F.filter(F.slice(fields, 2, 100_000), lambda x: x.contains("="))
    own = F.expr("reduce(ps, cast(map() as map<string,string>), (m, p) -> map_concat(map_filter(m, (k, v) -> k <> substring_index(p, '=', 1)), map(substring_index(p, '=', 1), substr(p, instr(p, '=') + 1))))")
    hosts = lines.where("kind = 'hosts'").select("path", "pos", "grp", fields[0].alias("hostname"), pairs_of.alias("ps")).withColumn("own", own).drop("ps")
    pair = lines.where((F.col("kind") == "vars") & F.col("line").contains("=")).select("path", "grp", "pos", F.trim(F.substring_index("line", "=", 1)).alias("k"), F.trim(F.expr("substr(line, instr(line, '=') + 1)")).alias("v"))
    shared = pair.groupBy("path", "grp", "k").agg(F.max_by("v", "pos").alias("v")).groupBy("path", "grp").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("shared"))
    children = lines.where("kind = 'children'").select("path", F.col("grp").alias("parent"), F.col("line").alias("child")).distinct()
    parents = hosts.select("path", "hostname", F.col("grp").alias("child")).join(children, ["path", "child"]).groupBy("path", "hostname").agg(F.collect_set("parent").alias("parents"))
    out = hosts.join(shared, ["path", "grp"], "left").join(parents, ["path", "hostname"], "left")
    named = F.when(F.col("grp") != "", F.array("grp")).otherwise(F.array().cast("array<string>"))
    groups = F.array_distinct(F.concat(named, F.coalesce("parents", F.array().cast("array<string>"))))
    return out.select("path", F.col("pos").cast("long").alias("place"), "hostname", groups.alias("groups"), merged(F.col("shared"), F.col("own")).alias("vars"))


HOSTS = "array<struct<hostname:string,groups:array<string>,vars:map<string,string>>>"


def nested_hosts(bodies: pd.Series) -> pd.Series:
    """Hosts of a nested inventory; variables go down, a child's beat its parents', a host's beat all."""

    def text(v: object) -> str:
        return v if isinstance(v, str) else json.dumps(v)

    def hosts(body: str) -> list[dict]:
        top = json.loads(body)
        out, todo = [], [((top.get("all") or {}) if isinstance(top, dict) else {}, ["all"], {})]
        while todo:
            group, path, above = todo.pop(0)
            own = above | {k: text(v) for k, v in (group.get("vars") or {}).items()}
            for name, given in (group.get("hosts") or {}).items():
                out.append({"hostname": name, "groups": path, "vars": own | {k: text(v) for k, v in (given or {}).items()}})
            todo += [(child or {}, [*path, name], own) for name, child in (group.get("children") or {}).items()]
        return out

    return bodies.map(hosts)


def ansible_yaml_hosts(bodies: DataFrame) -> DataFrame:
    """I19 as rows (path, place, hostname, groups, vars)."""
    rows = bodies.where(~F.col("body").startswith("[")).select("path", "doc_no", F.posexplode(F.pandas_udf(nested_hosts, HOSTS)("body")).alias("i", "h"))
    return rows.select("path", (F.col("doc_no") * 1_000_000 + F.col("i")).cast("long").alias("place"), "h.hostname", "h.groups", "h.vars")


def merge_hosts(hosts: DataFrame) -> DataFrame:
    """(hostname, source_file, groups, vars): groups united, the last value of a variable, the first file."""
    base = hosts.groupBy("hostname").agg(F.min_by("path", F.struct("path", "place")).alias("source_file"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("groups")))).alias("groups"))
    v = hosts.select("hostname", "path", "place", F.explode("vars").alias("k", "v")).groupBy("hostname", "k").agg(F.max_by("v", F.struct("path", "place")).alias("v"))
    v = v.groupBy("hostname").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("vars"))
    return base.join(v, "hostname", "left").withColumn("vars", F.coalesce("vars", F.create_map().cast(MAP)))


def _host_provider() -> Column:
    h = first_non_empty(F.col("vars")["ansible_host"], F.col("hostname"))
    return F.when(h.contains("amazonaws.com"), "aws").when(h.contains("googleusercontent.com") | h.contains("gcp"), "gcp").when(h.contains("azure"), "azure").otherwise("local")


def _trimmed(*keys: str, default: str | None = None) -> Column:
    given = [F.trim(F.col("vars")[k]) for k in keys]
    return first_non_empty(*given, F.lit(default)) if default is not None else first_non_empty(*given)


def inferred(hosts: DataFrame, as_of: Column) -> Tables:
    """Edges, databases and services that host variables tell of."""
    rules = F.broadcast(hosts.sparkSession.createDataFrame(HOST_RULES + SERVICE_RULES, "rule string, edge_type string, target_kind string, hint string"))
    v = hosts.select("hostname", F.col("source_file").alias("path"), "vars", F.explode("vars").alias("key", "raw")).join(rules, F.lower(F.trim("key")) == F.col("rule"))
    t = v.select("*", F.explode(split_targets(F.trim("raw"))).alias("target")).withColumn("from_id", F.concat(F.lit("ansible:vm:"), "hostname"))
    services = t.where("target_kind = 'service'").withColumn("to_id", k8s_service_id("target"))
    redis = F.lower("key").contains("redis") | F.lower("to_id").contains("redis")
    link = F.when(redis, redis_connection_string("to_id", _trimmed("redis_port", "cache_port"), _trimmed("redis_db", "cache_db")))
    nodes = nodes_of(services, as_of, id=F.col("to_id"), name=F.substring_index(F.regexp_replace("to_id", "^k8s:service:", ""), "/", -1), type=F.lit("service"), source=F.lit("ansible"), provider=F.lit("kubernetes"), metadata=pairs(("inferred", F.lit("true")), ("from_var", F.col("key")), ("connection_string", link)))
    known = hosts.select(F.col("hostname").alias("target"), F.lit(True).alias("is_host"), F.trim(F.col("vars")["ansible_host"]).alias("address"))
    h = t.where("target_kind = 'host' and target <> hostname").join(known, "target", "left").withColumn("is_host", F.coalesce("is_host", F.lit(False)))
    lost = h.where(~F.col("is_host") & ~F.col("target").contains(":"))
    warnings = lost.select(F.col("path").alias("source_file"), F.format_string('ansible dependency %s on %s references unknown target "%s"', "hostname", "key", "target").alias("message"))
    h = h.where(F.col("is_host") | F.col("target").contains(":"))
    mysql = F.lower("key").contains("mysql")
    db, port, scheme = _trimmed("db_name", "database_name", "postgres_db", "mysql_database", default="database"), _trimmed("db_port", "database_port", "postgres_port", "mysql_port"), _trimmed("db_scheme", "database_scheme")
    h = h.withColumn("db", db).withColumn("port", F.when(port == "", F.when(mysql, "3306").otherwise("5432")).otherwise(port)).withColumn("scheme", F.when(scheme == "", F.when(mysql, "mysql").otherwise("postgres")).otherwise(scheme))
    h = h.withColumn("db_id", F.when(F.col("hint") == "database", F.concat(F.lit("ansible:database:"), sanitize_node_part("db"), F.lit("@"), sanitize_node_part("target"))))
    given = _trimmed("db_connection_string", "database_url", "connection_string")
    built = F.concat("scheme", F.lit("://"), first_non_empty("address", "target"), F.lit(":"), "port", F.lit("/"), "db")
    dbs = h.where("db_id is not null")
    meta = pairs(("inferred", F.lit("true")), ("from_var", F.col("key")), ("db_name", F.col("db")), ("db_host", F.col("target")), ("db_port", F.col("port")), ("connection_string", F.when(given == "", built).otherwise(given)))
    nodes = nodes.unionByName(nodes_of(dbs, as_of, id=F.col("db_id"), name=F.concat("db", F.lit("@"), "target"), type=F.lit("database"), source=F.lit("ansible"), provider=F.col("scheme"), metadata=meta))
    host_id = F.concat(F.lit("ansible:vm:"), "target")
    edges = edges_of(dbs.where("is_host"), F.col("db_id"), host_id, "connects_to", source=F.lit("ansible_inventory_var"), role=F.lit("database_host"))
    to = F.coalesce("db_id", F.when(F.col("is_host"), host_id).otherwise(F.col("target")))
    told = {"source": F.lit("ansible_inventory_var"), "var": F.col("key"), "raw_value": F.col("target")}
    edges = edges.unionByName(edges_of(h, F.col("from_id"), to, F.col("edge_type"), **told)).unionByName(edges_of(services, F.col("from_id"), F.col("to_id"), F.col("edge_type"), **told))
    return last_nodes(nodes), first_of(edges), warnings


def playbook_graph(bodies: DataFrame, hosts: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Containers and services of playbook tasks, managed by the hosts of the play's pattern."""
    plays = bodies.where(F.col("body").startswith("[")).select("path", "doc_no", F.posexplode(js("body", MAPS)).alias("p_no", "p"))
    tasks = plays.select("path", F.coalesce(F.col("p")["hosts"], F.lit("")).alias("pattern"), F.explode(js(F.col("p")["tasks"], MAPS)).alias("t"))
    module = F.array(
        F.struct(F.lit("docker_container").alias("module"), js(F.coalesce(F.col("t")["docker_container"], F.col("t")["community.docker.docker_container"])).alias("m")),
        F.struct(F.lit("service").alias("module"), js(F.col("t")["service"]).alias("m")),
    )
    rows = tasks.select("path", "pattern", F.col("t")["name"].alias("task"), F.explode(module).alias("x")).select("path", "pattern", "task", "x.module", "x.m").where(F.coalesce(F.col("m")["name"], F.lit("")) != "")
    docker = F.col("module") == "docker_container"
    rows = rows.withColumn("kind", F.when(docker, "container").otherwise("service")).withColumn("node_id", F.concat(F.lit("ansible:"), "kind", F.lit(":"), F.col("m")["name"]))
    meta = F.when(docker, picked(F.col("m"), DOCKER_KEPT)).otherwise(F.create_map(F.lit("state"), F.coalesce(F.col("m")["state"], F.lit(""))))
    nodes = nodes_of(rows, as_of, id=F.col("node_id"), name=F.col("m")["name"], type=F.col("kind"), source=F.lit("ansible"), provider=F.when(docker, "docker").otherwise("systemd"), metadata=meta)
    parts = rows.select("node_id", "task", "module", F.explode(F.transform(F.split("pattern", ","), lambda x: F.trim(x))).alias("part")).withColumn("part", F.when(F.col("part") == "*", "all").otherwise(F.col("part")))
    # a host answers to its name, or else to its groups, and to "all"
    names = hosts.select("hostname", F.col("hostname").alias("part"), F.lit(0).alias("rank")).unionAll(hosts.select("hostname", F.explode("groups").alias("part"), F.lit(1).alias("rank"))).unionAll(hosts.select("hostname", F.lit("all").alias("part"), F.lit(0).alias("rank")))
    best = names.groupBy("part").agg(F.min("rank").alias("rank"))
    hit = parts.join(names.join(best, ["part", "rank"]).drop("rank").distinct(), "part")
    return last_nodes(nodes), first_of(edges_of(hit, F.col("node_id"), F.concat(F.lit("ansible:vm:"), "hostname"), "managed_by", task=F.col("task"), module=F.col("module")))


@register_parser("ansible")
def ansible(docs: DataFrame, as_of: Column) -> Tables:
    """I18 to I23."""
    ini = docs.where(is_ini())
    bodies, bad = decode_documents(docs.where(~is_ini()))
    hosts = merge_hosts(ansible_ini_hosts(ini).unionByName(ansible_yaml_hosts(bodies)))
    meta = merged(F.col("vars"), pairs(("groups", F.array_join("groups", ","))))
    nodes = nodes_of(hosts, as_of, id=F.concat(F.lit("ansible:vm:"), "hostname"), name=F.col("hostname"), type=F.lit("vm"), source=F.lit("ansible"), source_file=F.col("source_file"), provider=_host_provider(), metadata=meta)
    more, edges, warnings = inferred(hosts, as_of)
    played, managed = playbook_graph(bodies, hosts, as_of)
    return nodes.unionByName(more).unionByName(played), edges.unionByName(managed), bad.unionByName(warnings)
