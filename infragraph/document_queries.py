"""More registered queries: documents in their formats, metadata, search trees, streams and own rules.

As in ``queries``: inputs are written from the driver's tables, go through the operators, and the SQL asks
the tables directly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from infragraph.functions.schema import NODE_SCHEMA
from infragraph.operators import audit as A
from infragraph.operators import state as S
from infragraph.operators import traverse as T
from infragraph.operators.correlate import correlation_stars
from infragraph.plans.lineage import scratch_path, stored
from infragraph.plans.table_graph import as_of, table
from infragraph.queries import AT, KEYS, case, changed_nodes, direct, parsed, placed
from infragraph.sources import store
from infragraph.sources.documents import PARSERS, Tables, decode_documents, ingest, nodes_of, read_documents, read_states, register_parser


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with their nation; ``x`` is the number in a supplier's name."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("x", F.element_at(F.split("s_name", "#"), -1))


PLACES = "(SELECT *, split_part(s_name, '#', -1) AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def parser(source: str) -> Callable[[DataFrame, Column], Tables]:
    import infragraph.sources.all_parsers  # noqa: F401  registers them

    return PARSERS[source]


def metadata_rows(source: str, docs: DataFrame) -> DataFrame:
    """(id, key, value) of the metadata of parsed nodes."""
    nodes, _, _ = parser(source)(docs.withColumn("source", F.lit(source)), as_of())
    return nodes.select("id", F.explode("metadata").alias("key", "value"))


def entries(sql: str, *pairs: str) -> str:
    """SQL rows (id, key, value) for pairs ``key: expression`` over ``sql``, which has a column id; null values are left out."""
    listed = ", ".join("{'key': '%s', 'value': CAST(%s AS VARCHAR)}" % tuple(p.split(": ", 1)) for p in pairs)
    return f"SELECT id, e.key AS key, e.value AS value FROM (SELECT id, unnest([{listed}]) AS e FROM ({sql})) WHERE e.value IS NOT NULL"


# ---- documents


@direct("SELECT 'pulumi' AS source, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0")
def s1_read_documents(spark, sf_dir):
    """One file for each supplier, half of them in a folder that is skipped."""
    root = scratch_path(spark, "documents")
    rows = places(spark, sf_dir).select("s_suppkey", F.struct(F.col("s_name").alias("name")))
    for folder, rest in (("pulumi", 0), ("pulumi/node_modules", 1)):
        rows.where(F.col("s_suppkey") % 2 == rest).drop("s_suppkey").select("*").write.option("maxRecordsPerFile", 1).json(f"{root}/{folder}")
    docs = read_documents(spark, [root])
    return docs.select("source", F.regexp_extract("text", '"name":"([^"]*)"', 1).alias("name"))


@direct(f"""SELECT 'yaml/' || x || '.yaml' AS path, k AS kind, CASE k WHEN 'A' THEN s_name || '|1992-02-01|' || n_name WHEN 'C' THEN CAST(s_nationkey AS VARCHAR) WHEN 'warning' THEN 'document 2 cannot be decoded' ELSE '' END AS detail
FROM {PLACES}, (VALUES ('A'), ('C'), ('D'), ('warning')) v(k)""")
def s3_decode_documents(spark, sf_dir):
    """S3: YAML files of several documents: one with a date and a tag, a blank one, a broken one, and a list."""
    text = F.concat(F.lit("kind: A\nname: '"), "s_name", F.lit("'\nwhen: 1992-02-01\nat: !Ref "), "n_name", F.lit("\n---\n\n--- # broken\nkind: [\n---\nkind: BList\nitems:\n- kind: C\n  n: "), F.col("s_nationkey").cast("string"), F.lit("\n- kind: D\n"))
    bodies, bad = decode_documents(places(spark, sf_dir).select(F.concat(F.lit("yaml/"), "x", F.lit(".yaml")).alias("path"), text.alias("text")))
    field = lambda p: F.get_json_object("body", p)
    detail = F.when(field("$.kind") == "A", F.concat_ws("|", field("$.name"), field("$.when"), field("$.at.Ref"))).otherwise(F.coalesce(field("$.n"), F.lit("")))
    return bodies.select("path", field("$.kind").alias("kind"), detail.alias("detail")).unionAll(bad.select(F.col("source_file").alias("path"), F.lit("warning").alias("kind"), F.col("message").alias("detail")))


@direct("SELECT s_name || '.tfstate' AS path, CASE WHEN s_suppkey % 3 = 0 THEN 'invalid JSON' ELSE s_name END AS detail FROM supplier")
def s4_read_states(spark, sf_dir):
    """A third of the files is cut off."""
    s = table(spark, sf_dir, "supplier")
    body = F.to_json(F.struct(F.col("s_name").alias("serial"), F.array(F.col("s_suppkey")).alias("resources")))
    docs = s.select(F.concat("s_name", F.lit(".tfstate")).alias("path"), F.when(F.col("s_suppkey") % 3 == 0, F.substring(body, 1, 12)).otherwise(body).alias("text"))
    good, bad = read_states(docs)
    return good.select("path", F.get_json_object("body", "$.serial").alias("detail")).unionAll(bad.select(F.col("source_file").alias("path"), F.col("message").alias("detail")))


def manifests(df: DataFrame, *objects: str) -> DataFrame:
    """One list document for each row, of objects given as SQL expressions of structs."""
    items = ", ',', ".join(f"to_json({o})" for o in objects)
    return df.selectExpr("concat('k8s/', x, '.yaml') as path", f"concat('{{\"kind\":\"List\",\"items\":[', {items}, ']}}') as text")


@direct(f"""WITH s AS {PLACES} SELECT 'node' AS kind, 'k8s:' || k || ':default/' || n AS id, n || '|' || k || '|kubernetes' AS detail FROM (SELECT x AS n, 'ingress' AS k FROM s UNION ALL SELECT 'tls-' || x, 'secret' FROM s UNION ALL SELECT 'tls-' || x, 'certificate' FROM s)
UNION ALL SELECT 'edge', 'k8s:ingress:default/' || x || '->routes_to->k8s:service:default/' || CASE WHEN s_suppkey % 2 = 0 THEN 'new-' ELSE 'old-' END || x, lower(x) || '.example.com /' || s_nationkey FROM s
UNION ALL SELECT 'edge', 'k8s:ingress:default/' || x || '->terminates_tls->k8s:' || k || ':default/tls-' || x, lower(x) || '.example.com,b' FROM s, (VALUES ('secret'), ('certificate')) v(k)
UNION ALL SELECT 'edge', 'k8s:secret:default/tls-' || x || '->depends_on->k8s:certificate:default/tls-' || x, 'tls_secret' FROM s""")
def i14_ingress(spark, sf_dir):
    """Rules with the new and the old form of a backend, and TLS blocks that make a secret and a certificate."""
    backend = "if(s_suppkey % 2 = 0, named_struct('service', named_struct('name', concat('new-', x)), 'serviceName', null), named_struct('service', null, 'serviceName', concat('old-', x)))"
    host = "concat(lower(x), '.example.com')"
    spec = f"named_struct('rules', array(named_struct('host', {host}, 'http', named_struct('paths', array(named_struct('path', concat('/', s_nationkey), 'backend', {backend}))))), 'tls', array(named_struct('hosts', array({host}, 'b'), 'secretName', concat('tls-', x))))"
    docs = manifests(places(spark, sf_dir), f"named_struct('kind', 'Ingress', 'metadata', named_struct('name', x), 'spec', {spec})")
    n, e, _ = parser("kubernetes")(docs.withColumn("source", F.lit("kubernetes")), as_of())
    m = lambda k: F.col("metadata")[k]
    detail = F.coalesce(m("via"), m("hosts"), F.concat_ws(" ", m("host"), m("path")))
    return n.select(F.lit("node").alias("kind"), "id", F.concat_ws("|", "name", "type", "provider").alias("detail")).unionAll(e.select(F.lit("edge").alias("kind"), "id", detail.alias("detail")))


@direct(f"""WITH s AS {PLACES} SELECT 'node' AS kind, 'k8s:rolebinding:shop/' || x AS id, x || '|iam_binding|kubernetes' AS detail FROM s UNION ALL SELECT 'node', 'k8s:clusterrolebinding:' || x, x || '|iam_binding|kubernetes' FROM s
UNION ALL SELECT 'node', 'k8s:hpa:shop/' || x, x || '|monitor|kubernetes' FROM s UNION ALL SELECT 'node', 'k8s:certificate:shop/' || x, x || '|certificate|cert-manager' FROM s UNION ALL SELECT 'node', 'k8s:secret:shop/cert-' || x, 'cert-' || x || '|secret|cert-manager' FROM s
UNION ALL SELECT 'edge', 'k8s:rolebinding:shop/' || x || '->depends_on->k8s:role:shop/reader', 'roleRef' FROM s UNION ALL SELECT 'edge', 'k8s:clusterrolebinding:' || x || '->depends_on->k8s:clusterrole:admin', 'roleRef' FROM s
UNION ALL SELECT 'edge', 'k8s:serviceaccount:shop/bot->managed_by->k8s:rolebinding:shop/' || x, 'subject' FROM s UNION ALL SELECT 'edge', 'k8s:serviceaccount:ops/bot->managed_by->k8s:clusterrolebinding:' || x, 'subject' FROM s
UNION ALL SELECT 'edge', 'k8s:pod:shop/' || x || '->managed_by->k8s:hpa:shop/' || x, 'scaleTargetRef' FROM s WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'edge', 'k8s:certificate:shop/' || x || '->depends_on->k8s:secret:shop/cert-' || x, 'cert-manager' FROM s""")
def i17_bindings(spark, sf_dir):
    """Role bindings with their subjects, autoscalers of workloads and of others, and certificates with their secrets."""
    meta = "named_struct('name', x, 'namespace', 'shop')"
    docs = manifests(
        places(spark, sf_dir),
        f"named_struct('kind', 'RoleBinding', 'metadata', {meta}, 'roleRef', named_struct('kind', 'Role', 'name', 'reader'), 'subjects', array(named_struct('kind', 'ServiceAccount', 'name', 'bot', 'namespace', ''), named_struct('kind', 'User', 'name', 'u', 'namespace', '')))",
        "named_struct('kind', 'ClusterRoleBinding', 'metadata', named_struct('name', x), 'roleRef', named_struct('kind', 'ClusterRole', 'name', 'admin'), 'subjects', array(named_struct('kind', 'ServiceAccount', 'name', 'bot', 'namespace', 'ops')))",
        f"named_struct('kind', 'HorizontalPodAutoscaler', 'metadata', {meta}, 'spec', named_struct('maxReplicas', 3, 'scaleTargetRef', named_struct('kind', if(s_suppkey % 2 = 0, 'Deployment', 'Rollout'), 'name', x)))",
        f"named_struct('kind', 'Certificate', 'metadata', {meta}, 'spec', named_struct('secretName', concat('cert-', x), 'dnsNames', array(x)))",
    )
    return parsed("kubernetes", docs)


@direct("""SELECT 'ansible:vm:c' || c_custkey AS id, least('all', c_mktsegment) || ',' || greatest('all', c_mktsegment) AS groups, CASE WHEN c_custkey % 2 = 0 THEN 'host' ELSE 'child' END AS zone, 'gold' AS tier, '{"a": 1}' AS extra FROM customer""")
def i19_yaml_hosts(spark, sf_dir):
    """A nested inventory for each nation and segment; a host's variables beat its group's, and those its parents'."""
    host = "concat('\"c', c_custkey, '\":', if(c_custkey % 2 = 0, '{\"zone\":\"host\"}', 'null'))"
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.array_join(F.collect_list(F.expr(host)), ",").alias("hosts"))
    text = F.concat(F.lit('{"all":{"vars":{"tier":"gold","zone":"top","extra":{"a": 1}},"children":{"'), "c_mktsegment", F.lit('":{"vars":{"zone":"child"},"hosts":{'), "hosts", F.lit("}}}}}"))
    docs = c.select(F.concat(F.lit("ansible/"), "c_nationkey", F.lit("-"), "c_mktsegment", F.lit(".yml")).alias("path"), text.alias("text"), F.lit("ansible").alias("source"))
    nodes, _, _ = parser("ansible")(docs, as_of())
    m = lambda k: F.col("metadata")[k].alias(k)
    return nodes.select("id", m("groups"), m("zone"), m("tier"), m("extra"))


@direct("""WITH g AS (SELECT DISTINCT c_nationkey AS k FROM customer) SELECT 'node' AS kind, 'ansible:container:app-' || k AS id, 'shop/app:1 started' AS detail FROM g UNION ALL SELECT 'node', 'ansible:service:proxy-' || k, 'reloaded' FROM g
UNION ALL SELECT 'edge', 'ansible:' || n || c_nationkey || '->managed_by->ansible:vm:c' || c_custkey, t FROM customer, (VALUES ('container:app-', 'run|docker_container'), ('service:proxy-', '|service')) v(n, t)""")
def i23_playbooks(spark, sf_dir):
    """A playbook for each nation, over the group of its customers' hosts."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.collect_list(F.concat(F.lit("c"), "c_custkey")), "\n").alias("hosts"))
    hosts = c.select(F.concat(F.lit("ansible/"), "c_nationkey", F.lit(".ini")).alias("path"), F.concat(F.lit("[n"), "c_nationkey", F.lit("]\n"), "hosts").alias("text"))
    tasks = "- hosts: n{}, nowhere\n  tasks:\n  - name: run\n    docker_container: {{name: app-{}, image: 'shop/app:1', state: started, ports: ['1:1']}}\n  - service: {{name: proxy-{}, state: reloaded}}\n  - debug: {{msg: x}}\n"
    text = F.regexp_replace(F.lit(tasks.replace("{{", "<").replace("}}", ">").replace("{}", "@")), "@", F.col("c_nationkey").cast("string"))
    plays = c.select(F.concat(F.lit("ansible/play-"), "c_nationkey", F.lit(".yml")).alias("path"), F.translate(text, "<>", "{}").alias("text"))
    n, e, _ = parser("ansible")(hosts.unionAll(plays).withColumn("source", F.lit("ansible")), as_of())
    m = lambda k: F.coalesce(F.col("metadata")[k], F.lit(""))
    nodes = n.where("type <> 'vm'").select(F.lit("node").alias("kind"), "id", F.trim(F.concat_ws(" ", m("image"), m("state"))).alias("detail"))
    return nodes.unionAll(e.select(F.lit("edge").alias("kind"), "id", F.concat_ws("|", m("task"), m("module")).alias("detail")))


@direct(entries("SELECT *, 'tf:firewall_rule:' || c_custkey AS id FROM customer", "tag:Name: c_name", "label:seg: c_mktsegment", "ingress_cidrs: '10.0.0.' || c_custkey || '/32,::/0'", "encrypted: CASE WHEN c_custkey % 2 = 0 THEN 'false' ELSE 'true' END", "region: CASE WHEN c_nationkey <> 0 THEN c_nationkey END", "versioning: 'true'", "logging: CASE WHEN c_custkey % 3 = 0 THEN 'true' ELSE 'false' END", "tf_type: 'aws_security_group'"))
def i24_terraform_metadata(spark, sf_dir):
    """Attributes that are kept, flags, tags, labels, address ranges and nested blocks."""
    attrs = "named_struct('name', cast(c_custkey as string), 'region', if(c_nationkey <> 0, cast(c_nationkey as string), ''), 'secret', 'x', 'encrypted', c_custkey % 2 <> 0, 'tags', map('Name', c_name), 'labels', map('seg', c_mktsegment), 'ingress', array(named_struct('cidr_blocks', array(concat('10.0.0.', c_custkey, '/32')), 'ipv6_cidr_blocks', array('::/0'))), 'versioning', array(named_struct('enabled', true)), 'logging', if(c_custkey % 3 = 0, array('bucket'), cast(array() as array<string>)))"
    one = f"named_struct('mode', 'managed', 'type', 'aws_security_group', 'name', 'g', 'provider', 'p/aws', 'instances', array(named_struct('attributes', {attrs})))"
    docs = table(spark, sf_dir, "customer").selectExpr("concat(c_custkey, '.tfstate') as path", f"to_json(named_struct('resources', array({one}))) as text")
    return metadata_rows("terraform", docs)


@direct(entries("SELECT *, 'cfn:bucket:S' || s_suppkey AS id FROM supplier", "BucketName: s_name", "AccessControl: CASE WHEN s_suppkey % 2 = 0 THEN 'public-read' END", "tag:Owner: 'n' || s_nationkey", "cfn_type: 'AWS::S3::Bucket'") + " UNION ALL " + entries("SELECT *, 'cfn:firewall_rule:G' || s_suppkey AS id FROM supplier", "ingress_cidrs: '10.' || s_nationkey || '.0.0/16,::/0'", "cfn_type: 'AWS::EC2::SecurityGroup'"))
def i24_cloudformation_metadata(spark, sf_dir):
    """Plain properties, none that are references, tag lists and address ranges."""
    bucket = "to_json(named_struct('Type', 'AWS::S3::Bucket', 'Properties', named_struct('BucketName', s_name, 'AccessControl', if(s_suppkey % 2 = 0, 'public-read', null), 'Engine', named_struct('Ref', 'X'), 'Tags', array(named_struct('Key', 'Owner', 'Value', concat('n', s_nationkey))))))"
    group = "to_json(named_struct('Type', 'AWS::EC2::SecurityGroup', 'Properties', named_struct('SecurityGroupIngress', array(named_struct('CidrIp', concat('10.', s_nationkey, '.0.0/16'), 'CidrIpv6', ''), named_struct('CidrIp', null, 'CidrIpv6', '::/0')))))"
    docs = table(spark, sf_dir, "supplier").selectExpr("concat('cloudformation/', s_suppkey, '.json') as path", f"concat('{{\"Resources\":{{\"S', s_suppkey, '\":', {bucket}, ',\"G', s_suppkey, '\":', {group}, '}}}}') as text")
    return metadata_rows("cloudformation", docs)


@direct(entries("SELECT *, 'plm:database:' || p_partkey AS id FROM part", "engine: p_brand", "multiAz: CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END", "region: 'out-' || p_size", "tag:size: p_size", "label:kind: 'x'", "pulumi_type: 'aws:rds/instance:Instance'"))
def i24_pulumi_metadata(spark, sf_dir):
    """Inputs and outputs, of which outputs win, tags and labels."""
    inputs = "named_struct('name', cast(p_partkey as string), 'engine', p_brand, 'multiAz', p_size % 2 = 0, 'region', 'in', 'tags', map('size', cast(p_size as string)), 'labels', map('kind', 'x'), 'password', 'y')"
    one = f"named_struct('urn', concat('urn::', p_partkey), 'type', 'aws:rds/instance:Instance', 'inputs', {inputs}, 'outputs', named_struct('region', concat('out-', p_size)))"
    docs = table(spark, sf_dir, "part").selectExpr("concat('pulumi/', p_partkey, '.json') as path", f"to_json(named_struct('deployment', named_struct('resources', array({one})))) as text")
    return metadata_rows("pulumi", docs)


# ---- search trees


def tree_sql(arcs: str, roots: str, levels: int) -> str:
    """Common table expressions l0 to l<levels> of a breadth-first search whose trails of (edge type, node) are smallest."""
    out = [f", arcs AS MATERIALIZED ({arcs})", f"l0 AS MATERIALIZED (SELECT id AS root_id, id AS node_id, NULL::VARCHAR AS parent_id, NULL::VARCHAR AS edge_type, CAST([] AS VARCHAR[]) AS trail, 0 AS depth FROM nodes WHERE {roots})"]
    for k in range(1, levels + 1):
        seen = " UNION ALL ".join(f"SELECT root_id, node_id FROM l{i}" for i in range(k))
        out.append(f"l{k} AS MATERIALIZED (SELECT root_id, dst AS node_id, arg_min(l.node_id, l.trail || [arcs.type, dst]) AS parent_id, arg_min(arcs.type, l.trail || [arcs.type, dst]) AS edge_type, min(l.trail || [arcs.type, dst]) AS trail, {k} AS depth FROM l{k - 1} l JOIN arcs ON src = l.node_id WHERE (root_id, dst) NOT IN ({seen}) GROUP BY 1, 2)")
    return ", ".join(out) + ", tree AS (" + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(1, levels + 1)) + ")"


@case(tree_sql("SELECT to_id AS src, from_id AS dst, type FROM edges", "type = 'network'", 5) + " SELECT root_id, node_id, parent_id, edge_type, depth, root_id || '>' || array_to_string(list_filter(trail, lambda x, i: i % 2 = 0), '>') AS path FROM tree")
def w2_bfs_order(nodes, edges):
    """Parents, edge types and paths of the impact search."""
    rows = T.blast_radius(nodes, edges, nodes.where("type = 'network'").select("id"))
    return rows.select("root_id", "node_id", "parent_id", "edge_type", "depth", F.array_join("path", ">").alias("path"))


@case(tree_sql("SELECT from_id AS src, to_id AS dst, type FROM edges UNION SELECT to_id, from_id, type FROM edges", "type = 'network'", 8) + ", m AS (SELECT * FROM tree WHERE edge_type = 'mounts_secret') SELECT root_id, node_id FROM m UNION SELECT root_id, parent_id FROM m UNION SELECT root_id, root_id FROM m")
def t11_secrets_touched(nodes, edges):
    return T.secrets_touched(edges, nodes.where("type = 'network'").select("id"))


# ---- correlation, drift, rules, streams


@case(KEYS + """, g AS (SELECT key, min(node_id) AS hub, count(*) AS n, count(DISTINCT source) AS sources FROM ks GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT source) >= 2)
SELECT key, hub, node_id, source, n, sources FROM ks JOIN g USING (key)""")
def c2_correlation_stars(nodes, edges):
    """C2 as members and a hub for each key, without pairs."""
    return correlation_stars(nodes)


@case("""SELECT 1::BIGINT AS scan_id, CASE WHEN type = 'subnet' THEN 'removed' ELSE 'modified' END AS change, id FROM nodes WHERE source = 'terraform' AND type IN ('subnet', 'vm', 'bucket')""")
def p3_store_drift(nodes, edges):
    """The drift of two scans is stored, the first of them twice; that one is read again."""
    path = scratch_path(nodes.sparkSession, "drift")
    drift = stored(S.node_drift(nodes, changed_nodes(nodes), "terraform").select("change", "id"), "drift-rows")
    for scan, rows in ((1, drift.limit(3)), (2, drift), (1, drift)):
        store.store_drift(rows.withColumn("scan_id", F.lit(scan).cast("long")), path)
    return store.get_drift(nodes.sparkSession, path, 1).select("scan_id", "change", "id")


@case("""SELECT 'allow-privilege-escalation' AS rule, 'warning' AS severity, 'k8s:pod:default/' || s_name AS resource_id, 'Container "web" allows privilege escalation' AS description FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'writable-root-fs', 'info', 'k8s:pod:default/' || s_name, 'Container "web" has a writable root filesystem' FROM supplier WHERE s_suppkey % 3 = 0""")
def a12_a14_pods(nodes, edges):
    """Pods whose container may gain rights or write its root."""
    key = F.regexp_extract("name", r"(\d+)$", 1).cast("int")
    more = F.map_filter(F.create_map(F.lit("security.web.allow_privilege_escalation"), (key % 2 == 0).cast("string"), F.lit("security.web.read_only_root_fs"), (key % 3 != 0).cast("string")), lambda k, v: v.isNotNull())
    pods = nodes.withColumn("metadata", F.when(F.col("type") == "pod", F.map_concat("metadata", more)).otherwise(F.col("metadata")))
    return A.audit(pods, edges).where("rule in ('allow-privilege-escalation', 'writable-root-fs')").select("rule", "severity", "resource_id", "description")


@case("SELECT 'shouting-name' AS rule, id AS resource_id, name || ' shouts' AS description FROM nodes WHERE type = 'network' UNION ALL SELECT 'lonely', id, 'no edges' FROM nodes WHERE type = 'bucket'")
def y1_own_rules(nodes, edges):
    """A rule on one node and a check over the graph, beside the built-in ones."""
    from infragraph.operators.relational import orphans

    shouting = A.Rule("shouting-name", "info", lambda: F.array(F.when((F.col("type") == "network") & (F.upper("name") == F.col("name")), F.concat("name", F.lit(" shouts")))))

    def lonely(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        text = F.lit("no edges")
        return orphans(nodes, edges).where("type = 'bucket'").select(F.lit("info").alias("severity"), F.lit("lonely").alias("rule"), F.col("id").alias("resource_id"), F.col("name").alias("resource"), "type", text.alias("description"), text.alias("title"))

    found = A.audit(nodes, edges, [*A.RULES, shouting], A.CHECKS | {"lonely": lonely})
    return found.where("rule in ('shouting-name', 'lonely')").select("rule", "resource_id", "description")


@direct("SELECT 'csv:vm:' || c_name AS id, c_mktsegment AS name FROM customer UNION ALL SELECT 'compose:container:' || s_name, s_name FROM supplier")
def y2_own_parser(spark, sf_dir):
    """Y2: a parser of one's own goes through ``ingest`` with the others."""

    def lines(docs: DataFrame, at: Column):
        rows = docs.select("path", F.explode(F.split("text", "\n")).alias("line")).select("path", F.split("line", ",").alias("c"))
        none = spark.createDataFrame([], "id string, from_id string, to_id string, type string, metadata map<string,string>")
        nodes = nodes_of(rows, at, id=F.concat(F.lit("csv:vm:"), F.col("c")[0]), name=F.col("c")[1], type=F.lit("vm"), source=F.lit("csv"))
        return nodes, none, spark.createDataFrame([], "source_file string, message string")

    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    docs = c.select(F.lit("csv").alias("source"), F.concat("c_name", F.lit(".csv")).alias("path"), F.concat("c_name", F.lit(","), "c_mktsegment").alias("text"))
    files = s.select(F.lit("compose").alias("source"), F.concat("s_name", F.lit("/docker-compose.yml")).alias("path"), F.concat(F.lit('{"services":{"'), "s_name", F.lit('":{"image":"a:1"}}}')).alias("text"))
    register_parser("csv")(lines)
    try:
        nodes, _, _ = ingest(docs.unionByName(files), as_of())
    finally:
        PARSERS.pop("csv")
    return nodes.select("id", "name")


@direct("""SELECT 'node' AS kind, 'plm:vm:' || s_name AS id FROM supplier UNION ALL SELECT 'drift', CASE WHEN s_suppkey % 2 = 0 THEN 'removed' ELSE 'added' END || ' plm:vm:' || s_name FROM supplier
UNION ALL SELECT 'scan', '0 completed ' || count(*) FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'scan', '1 completed ' || count(*) FROM supplier WHERE s_suppkey % 2 = 1""")
def r1_stream_ingest(spark, sf_dir):
    """Two streams with checkpoints of their own, each over half of the suppliers' files, keep one graph current."""
    from infragraph.streaming.graph_store import graph_store, read_graph
    from infragraph.streaming.streams import stream_ingest

    one = "named_struct('urn', concat('urn::', s_suppkey), 'type', 'aws:ec2/instance:Instance', 'inputs', named_struct('name', s_name))"
    files = table(spark, sf_dir, "supplier").selectExpr("s_suppkey % 2 as part", "concat('pulumi/', s_suppkey, '.json') as path", "'pulumi' as source", f"to_json(named_struct('deployment', named_struct('resources', array({one})))) as text")
    root = scratch_path(spark, "stream")
    parse = lambda docs: parser("pulumi")(docs, as_of())
    for part in (0, 1):
        files.where(F.col("part") == part).drop("part").coalesce(1).write.parquet(f"{root}/docs{part}")
        docs = spark.readStream.schema("path string, source string, text string").parquet(f"{root}/docs{part}")
        stream_ingest(docs, f"{root}/graph", parse, "pulumi", f"{root}/checkpoint{part}").awaitTermination()
    graph = read_graph(graph_store(spark, f"{root}/graph"))
    nodes, scans = graph["nodes"], graph["scans"]
    drift = store.get_drift(spark, f"{root}/graph/drift", 1).where("kind = 'node'")
    return (
        nodes.select(F.lit("node").alias("kind"), "id")
        .unionAll(drift.select(F.lit("drift").alias("kind"), F.concat_ws(" ", "change", "id").alias("id")))
        .unionAll(scans.select(F.lit("scan").alias("kind"), F.concat_ws(" ", F.col("id").cast("string"), "status", F.col("nodes_found").cast("string")).alias("id")))
    )


@case(f"SELECT id, CASE WHEN d < 0 THEN 'expired' WHEN d <= 7 THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN d < 0 THEN 'Certificate ' || name || ' has expired' ELSE 'Certificate ' || name || ' expires in ' || d || ' days' END AS message FROM (SELECT id, name, CAST(trunc((epoch_us(expires_at) - epoch_us({AT})) / 86400000000) AS INTEGER) AS d FROM nodes WHERE type = 'certificate' AND expires_at IS NOT NULL) WHERE d <= 30")
def r3_stream_cert_alerts(nodes, edges):
    """Alerts of a stream of certificate rows."""
    from infragraph.streaming.streams import stream_cert_alerts

    spark = nodes.sparkSession
    root = scratch_path(spark, "alerts")
    nodes.where("type = 'certificate'").write.parquet(f"{root}/certs")
    stream_cert_alerts(spark.readStream.schema(NODE_SCHEMA).parquet(f"{root}/certs"), as_of(), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.json(f"{root}/out").select("asset.id", "severity", "message")
