"""Security audit (A1 to A22): one pass over the nodes for all rules, and one anti-join.

A rule is a condition and a description on a node's columns. Rules that look at metadata keys by pattern
give one finding for each key; the others give at most one. Rule gaps of D10 are kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from infragraph.functions.scalar import image_uses_latest, meta_true, meta_value
from infragraph.operators.relational import audit_summary

M = "metadata"
ENCRYPTED = ("encrypted", "storage_encrypted", "StorageEncrypted")


@dataclass(frozen=True)
class Rule:
    """``found``: the descriptions of a node's findings as an array of strings; null entries do not count."""

    id: str
    severity: str
    found: Callable[[], Column]


def _one(condition: Callable[[], Column], text: Callable[[], Column] | str) -> Callable[[], Column]:
    return lambda: F.array(F.when(condition(), F.lit(text) if isinstance(text, str) else text()))


def _is(*types: str) -> Column:
    return F.col("type").isin(*types)


def _keys(ending: str, value: str, text: str) -> Callable[[], Column]:
    """Pods: a finding for each metadata key with this ending and value; the container is the key's second part."""

    def found() -> Column:
        hits = F.filter(F.map_entries(M), lambda e: e["key"].endswith(ending) & (e["value"] == value))
        named = F.transform(hits, lambda e: F.format_string(text, F.split(e["key"], r"\.", 3)[1]))
        return F.when(_is("pod"), F.array_sort(named)).otherwise(F.array().cast("array<string>"))

    return found


def _open_cidr() -> Column:
    parts = F.transform(F.split(meta_value(M, "ingress_cidrs"), ","), lambda x: F.trim(x))
    return F.get(F.filter(parts, lambda x: x.isin("0.0.0.0/0", "::/0")), F.lit(0))


def _host_spaces() -> Column:
    named = (("host_network", "host network namespace"), ("host_pid", "host PID namespace"), ("host_ipc", "host IPC namespace"))
    return F.array(*[F.when(_is("pod") & (F.col(M)[f"security.{k}"] == "true"), F.lit(f"Pod uses {text}")) for k, text in named])


def _compose() -> Column:
    return (F.col("source") == "compose") & _is("container")


def _sized_key() -> Column:
    return F.exists(F.map_keys(M), lambda k: k.contains("resources_limits") | k.contains("resources_requests"))


#: The built-in rules on one node, in their order; identifiers, severities and texts are fixed values.
RULES = [
    Rule("public-database", "critical", _one(lambda: _is("database") & meta_true(M, "publicly_accessible", "PubliclyAccessible"), "Database is publicly accessible")),
    Rule("unencrypted-storage", "critical", _one(lambda: _is("database", "bucket", "disk") & (meta_value(M, *ENCRYPTED) == "false"), lambda: F.concat("type", F.lit(" storage is not encrypted")))),
    Rule("permissive-firewall", "critical", _one(lambda: _is("firewall_rule") & _open_cidr().isNotNull(), lambda: F.format_string("Security group allows ingress from %s (world-open)", _open_cidr()))),
    Rule("no-deletion-protection", "warning", _one(lambda: _is("database") & (meta_value(M, "deletion_protection", "DeletionProtection", "deletionProtection") == "false"), "Database has deletion protection disabled")),
    Rule("single-az-database", "warning", _one(lambda: _is("database") & (meta_value(M, "multi_az", "MultiAZ", "multiAz") == "false"), "Database is not deployed across multiple availability zones")),
    Rule("public-bucket", "critical", _one(lambda: _is("bucket") & meta_value(M, "acl", "AccessControl").isin("public-read", "public-read-write", "authenticated-read"), lambda: F.concat(F.lit("Bucket has permissive ACL: "), meta_value(M, "acl", "AccessControl")))),
    Rule("privileged-container", "critical", _keys(".privileged", "true", 'Container "%s" runs in privileged mode')),
    Rule("host-namespace", "critical", _host_spaces),
    Rule("public-load-balancer", "info", _one(lambda: _is("service") & (F.col(M)["service_type"] == "LoadBalancer"), "Service is exposed via a LoadBalancer (publicly accessible)")),
    Rule("public-instance", "warning", _one(lambda: _is("vm") & ((meta_value(M, "public_ip", "nat_ip") != "") | meta_true(M, "associate_public_ip_address")), "VM instance has a public IP address")),
    Rule("allow-privilege-escalation", "warning", _keys(".allow_privilege_escalation", "true", 'Container "%s" allows privilege escalation')),
    Rule("run-as-root", "warning", _keys(".run_as_non_root", "false", 'Container "%s" does not enforce non-root execution')),
    Rule("writable-root-fs", "info", _keys(".read_only_root_fs", "false", 'Container "%s" has a writable root filesystem')),
    Rule("unencrypted-ingress", "warning", _one(lambda: _is("ingress") & (meta_value(M, "tls", "tls_hosts") == ""), "Ingress does not have TLS configured")),
    Rule("missing-resource-limits", "info", _one(lambda: _is("pod") & ~F.coalesce(_sized_key(), F.lit(False)), "Pod does not define container resource requests/limits")),
    Rule("absent-encryption-config", "info", _one(lambda: _is("database", "disk") & (meta_value(M, *ENCRYPTED) == ""), lambda: F.concat("type", F.lit(" has no encryption configuration specified")))),
    Rule("mutable-container-image", "warning", _one(lambda: _is("container", "pod") & image_uses_latest(meta_value(M, "image")), lambda: F.format_string('Container image "%s" uses a mutable latest tag', meta_value(M, "image")))),
    Rule("compose-missing-init", "info", _one(lambda: _compose() & (meta_value(M, "ports", "healthcheck") != "") & (meta_value(M, "init") != "true"), "Compose service is long-running/exposed but does not set init: true")),
    Rule("exposed-service-no-healthcheck", "info", _one(lambda: _compose() & (meta_value(M, "ports") != "") & (meta_value(M, "healthcheck") != "true"), "Compose service publishes ports but has no healthcheck evidence")),
]


def orphan_secrets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A10: secrets that no mounts_secret edge points to."""
    mounted = edges.where("type = 'mounts_secret'").select(F.col("to_id").alias("id"))
    text = "Secret is not mounted by any workload"
    lone = nodes.where(_is("secret")).join(mounted, "id", "left_anti")
    return lone.select(F.lit("info").alias("severity"), F.lit("orphan-secret").alias("rule"), F.col("id").alias("resource_id"), F.col("name").alias("resource"), "type", F.lit(text).alias("description"), F.lit(text).alias("title"))


def _described(rule: Rule) -> Column:
    """A node's findings of one rule as an array of structs."""
    texts = F.filter(rule.found(), lambda d: d.isNotNull())
    return F.transform(texts, lambda d: F.struct(F.lit(rule.severity).alias("severity"), F.lit(rule.id).alias("rule"), d.alias("description")))


def node_findings(nodes: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Findings of the rules on one node: a single pass."""
    each = [_described(r) for r in rules]
    rows = nodes.withColumn(M, F.coalesce(M, F.create_map().cast("map<string,string>"))).select("id", "name", "type", F.explode(F.concat(*each)).alias("f"))
    return rows.select("f.severity", "f.rule", F.col("id").alias("resource_id"), F.col("name").alias("resource"), "type", "f.description", F.col("f.description").alias("title"))


#: Checks beyond the node rules: name -> function of (nodes, edges) that returns findings.
CHECKS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"orphan-secret": orphan_secrets}


def audit(nodes: DataFrame, edges: DataFrame, rules: list[Rule] | None = None, checks: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Findings of all rules and checks; pass longer lists to add your own."""
    out = node_findings(nodes, RULES if rules is None else rules)
    for check in (CHECKS if checks is None else checks).values():
        out = out.unionByName(check(nodes, edges))
    return out


def audit_for(findings: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings of some resources, and a fresh summary of them."""
    some = findings.join(ids.select(F.col("id").alias("resource_id")).distinct(), "resource_id", "left_semi")
    return some, audit_summary(some)


def severity_gate(findings: DataFrame, fail_on: str = "critical") -> DataFrame:
    """One row (failures, failed); ``fail_on`` is critical, warning, info (all) or none."""
    levels = {"critical": ["critical"], "warning": ["critical", "warning"], "info": ["critical", "warning", "info"], "none": []}[fail_on]
    n = F.count_if(F.col("severity").isin(levels)) if levels else F.lit(0).cast("long")
    return findings.agg(F.coalesce(n, F.lit(0)).alias("failures") if levels else F.count_if(F.lit(False)).alias("failures")).withColumn("failed", F.col("failures") > 0)
