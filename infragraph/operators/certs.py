"""Certificates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from infragraph.functions.scalar import days_until, meta_value
from infragraph.operators.relational import expiring_within


def list_certs(nodes: DataFrame, as_of: Column) -> DataFrame:
    """Certificates with days_remaining and status; without an expiry -1 and unknown."""
    days = F.coalesce(days_until("expires_at", as_of), F.lit(-1))
    status = F.when(F.col("expires_at").isNull(), "unknown").when(days < 0, "expired").when(days <= 7, "critical").when(days <= 30, "warning").otherwise("ok")
    return nodes.where("type = 'certificate'").withColumn("days_remaining", days).withColumn("status", status)


def expiring_certs(nodes: DataFrame, days: int, as_of: Column) -> DataFrame:
    """Certificates that expire within ``days``, soonest first; expired ones are not among them."""
    return list_certs(expiring_within(nodes, days, as_of), as_of).orderBy("expires_at", "id")


def _endpoint(host: Column, port: Column) -> Column:
    named = F.when(host.contains(":") & ~host.startswith("["), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    return F.concat(named, F.lit(":"), port)


def discover_endpoints(nodes: DataFrame) -> DataFrame:
    """Distinct (endpoint): ingress host and hostname, load balancer address, DNS record name, with the port."""
    port = meta_value("metadata", "port", "tls_port")
    port = F.when(port == "", "443").otherwise(port)
    hosts = (
        F.when(F.col("type") == "ingress", F.array(F.col("metadata")["host"], F.col("metadata")["hostname"]))
        .when(F.col("type") == "load_balancer", F.array(F.col("metadata")["ip_address"]))
        .when(F.col("type") == "dns_record", F.array(F.col("name")))
    )
    rows = nodes.where(hosts.isNotNull()).select(F.explode(hosts).alias("host"), port.alias("port"))
    return rows.where("host is not null and host <> ''").select(_endpoint(F.col("host"), F.col("port")).alias("endpoint")).distinct()


def cert_alerts(certs: DataFrame, as_of: Column) -> DataFrame:
    """An event for each warning, critical or expired certificate; also right on a streaming DataFrame."""
    told = F.when(F.col("status") == "expired", F.concat(F.lit("Certificate "), "name", F.lit(" has expired"))).otherwise(F.concat(F.lit("Certificate "), "name", F.lit(" expires in "), F.col("days_remaining").cast("string"), F.lit(" days")))
    asset = F.struct("id", "name", "type", "source", "provider")
    return certs.where(F.col("status").isin("warning", "critical", "expired")).select(
        F.lit("certs").alias("source"), F.lit("cert_expiring").alias("event_type"), F.col("status").alias("severity"), asset.alias("asset"), told.alias("message"), as_of.alias("timestamp")
    )


def observed_certs(probes: DataFrame, as_of: Column) -> DataFrame:
    """E5: certificate nodes from a table of probe results (host, port, subject, issuer, not_before, not_after, serial, dns_names)."""
    meta = F.map_filter(
        F.create_map(*[x for k, c in (("host", "host"), ("port", "port"), ("subject", "subject"), ("issuer", "issuer"), ("not_before", "not_before"), ("serial", "serial")) for x in (F.lit(k), F.col(c).cast("string"))], F.lit("dns_names"), F.array_join("dns_names", ",")),
        lambda k, v: v.isNotNull() & (v != ""),
    )
    return probes.select(
        F.concat(F.lit("probe:certificate:"), "host").alias("id"), F.coalesce(F.nullif(F.col("subject"), F.lit("")), F.col("host")).alias("name"), F.lit("certificate").alias("type"),
        F.lit("probe").alias("source"), F.concat("host", F.lit(":"), F.col("port").cast("string")).alias("source_file"), F.lit("").alias("provider"), meta.alias("metadata"),
        F.col("not_after").alias("expires_at"), as_of.alias("last_seen"), as_of.alias("first_seen"),
    )
