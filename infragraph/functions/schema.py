"""Row types of the asset graph and its fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

_STR, _LONG, _TS = T.StringType(), T.LongType(), T.TimestampType()
META = T.MapType(_STR, _STR)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


NODE_SCHEMA = _struct(
    ("id", _STR), ("name", _STR), ("type", _STR), ("source", _STR), ("source_file", _STR), ("provider", _STR),
    ("metadata", META), ("expires_at", _TS), ("last_seen", _TS), ("first_seen", _TS),
)
EDGE_SCHEMA = _struct(("id", _STR), ("from_id", _STR), ("to_id", _STR), ("type", _STR), ("metadata", META))
SCAN_SCHEMA = _struct(
    ("id", _LONG), ("source", _STR), ("source_path", _STR), ("started_at", _TS), ("finished_at", _TS),
    ("nodes_found", _LONG), ("edges_found", _LONG), ("status", _STR),
)
FINDING_SCHEMA = _struct(*[(c, _STR) for c in ("severity", "rule", "resource_id", "resource", "type", "description", "title")])
WARNING_SCHEMA = _struct(("source_file", _STR), ("message", _STR))

NODE_COLUMNS, EDGE_COLUMNS = NODE_SCHEMA.names, EDGE_SCHEMA.names

#: Fixed values.
NODE_TYPES = (
    "vm container pod service ingress load_balancer database bucket dns_record certificate secret firewall_rule network subnet "
    "ip_address namespace node queue pubsub iam_binding iam_policy kms_key service_account iam_group cdn disk instance_group "
    "health_check backend_service monitor function api_gateway nosql_database configmap"
).split()
EDGE_TYPES = (
    "depends_on routes_to terminates_tls authenticates_with resolves_to member_of mounts_secret mounts_volume exposed_by "
    "connects_to managed_by correlates_with"
).split()
