"""The driver's tables as an asset graph, for queries and benchmarks.

Regions are networks, nations subnets, customers virtual machines (each with a certificate that ends at
their first order), suppliers services with a pod, parts databases with a secret, orders containers. Whatever
a rule looks at is derived from column values. ``SQL`` holds the same tables for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from infragraph.functions.scalar import edge_id
from infragraph.functions.schema import NODE_COLUMNS

AS_OF = "1998-01-01 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _when(condition: str, value: str, key: str) -> tuple[Column, Column]:
    return F.lit(key), F.expr(f"if({condition}, {value}, null)")


def _nodes(df: DataFrame, prefix: str, key: str, name: str, kind: str, source: str | Column, meta: list[tuple[Column, Column]], expires: str = "null", seen: str | None = None) -> DataFrame:
    m = F.map_filter(F.create_map(*[x for kv in meta for x in kv]), lambda k, v: v.isNotNull()) if meta else F.create_map().cast("map<string,string>")
    at = F.expr(f"cast({seen} as timestamp)") if seen else as_of()
    cols = {
        "id": F.concat(F.lit(prefix), F.expr(key)), "name": F.expr(name), "type": F.lit(kind), "source": F.lit(source) if isinstance(source, str) else source, "source_file": F.lit(f"{kind}.json"),
        "provider": F.lit("aws"), "metadata": m, "expires_at": F.expr(f"cast({expires} as timestamp)"), "last_seen": at, "first_seen": at,
    }
    return df.select(*[cols[c].alias(c) for c in NODE_COLUMNS])


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    nation, region, customer, supplier, part, orders = (t(n) for n in ("nation", "region", "customer", "supplier", "part", "orders"))
    source = F.expr("element_at(array('terraform', 'cloudformation', 'pulumi'), cast(p_partkey % 3 + 1 as int))")
    last = customer.join(orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("ends")), F.col("c_custkey") == F.col("o_custkey"), "left")
    parts = [
        _nodes(region, "tf:network:", "r_name", "r_name", "network", "terraform", []),
        _nodes(region, "tf:firewall_rule:", "r_name", "r_name", "firewall_rule", "terraform", [_when("true", "if(r_regionkey % 2 = 0, '10.0.0.0/8, 0.0.0.0/0', '10.0.0.0/8')", "ingress_cidrs")]),
        _nodes(nation, "tf:subnet:", "n_name", "n_name", "subnet", "terraform", []),
        _nodes(nation, "tf:bucket:", "n_name", "n_name", "bucket", "terraform", [_when("n_nationkey % 3 = 0", "'public-read'", "acl"), _when("n_nationkey % 4 = 0", "'false'", "encrypted")]),
        _nodes(nation, "k8s:ingress:default/", "n_name", "n_name", "ingress", "kubernetes", [_when("true", "concat(lower(n_name), '.example.com')", "host"), _when("n_nationkey % 2 = 0", "'true'", "tls")]),
        _nodes(customer, "tf:vm:", "c_name", "c_name", "vm", "terraform", [_when("c_custkey % 7 = 0", "concat('10.0.0.', c_custkey)", "public_ip"), _when("true", "c_mktsegment", "namespace")]),
        _nodes(last, "k8s:certificate:default/", "c_name", "c_name", "certificate", "kubernetes", [], expires="ends"),
        _nodes(supplier, "k8s:service:default/", "s_name", "s_name", "service", "kubernetes", [_when("true", "if(s_suppkey % 5 = 0, 'LoadBalancer', 'ClusterIP')", "service_type"), _when("true", "concat('http://', lower(s_name), '.svc:80')", "api_url")]),
        _nodes(supplier, "k8s:pod:default/", "s_name", "s_name", "pod", "kubernetes", [_when("s_suppkey % 4 = 0", "'true'", "security.app.privileged"), _when("s_suppkey % 3 = 0", "'false'", "security.app.run_as_non_root"), _when("s_suppkey % 6 = 0", "'true'", "security.host_network"), _when("s_suppkey % 2 = 0", "'1'", "resources_limits.cpu")]),
        _nodes(part, "tf:database:part-", "p_partkey", "p_name", "database", source, [_when("true", "if(p_size % 2 = 0, 'true', 'false')", "publicly_accessible"), _when("p_size % 3 < 2", "if(p_size % 3 = 0, 'false', 'true')", "storage_encrypted"), _when("p_size % 5 = 0", "'false'", "deletion_protection"), _when("p_size % 7 = 0", "'false'", "MultiAZ")]),
        _nodes(part, "k8s:secret:default/part-", "p_partkey", "concat('part-', p_partkey)", "secret", "kubernetes", []),
        _nodes(orders, "compose:container:order-", "o_orderkey", "concat('order-', o_orderkey)", "container", "compose", [_when("true", "concat('shop/app:', if(o_orderkey % 4 = 0, 'latest', cast(o_orderkey % 4 as string)))", "image"), _when("o_orderkey % 3 = 0", "'80:80'", "ports"), _when("o_orderkey % 6 = 0", "'true'", "healthcheck"), _when("o_orderkey % 9 = 0", "'true'", "init")], seen="o_orderdate"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _edges(df: DataFrame, src: tuple[str, str], dst: tuple[str, str], kind: str) -> DataFrame:
    """Edges between (prefix, column) ends. They are made distinct by the columns, before the longer ids are made of them."""
    e = df.select(F.col(src[1]).alias("src"), F.col(dst[1]).alias("dst")).distinct()
    e = e.select(F.concat(F.lit(src[0]), "src").alias("from_id"), F.concat(F.lit(dst[0]), "dst").alias("to_id"), F.lit(kind).alias("type"))
    return e.select(edge_id("from_id", "type", "to_id").alias("id"), "from_id", "to_id", "type", F.create_map(F.lit("via"), F.lit("tables")).alias("metadata"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    nation, region, customer, supplier, orders = (t(n) for n in ("nation", "region", "customer", "supplier", "orders"))
    line = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    sold = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    order, service, subnet, vm, pod, secret = "compose:container:order-", "k8s:service:default/", "tf:subnet:", "tf:vm:", "k8s:pod:default/", "k8s:secret:default/part-"
    parts = [
        _edges(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), (subnet, "n_name"), ("tf:network:", "r_name"), "connects_to"),
        _edges(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), (vm, "c_name"), (subnet, "n_name"), "depends_on"),
        _edges(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")), (service, "s_name"), (subnet, "n_name"), "depends_on"),
        _edges(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")), ("k8s:ingress:default/", "n_name"), (service, "s_name"), "routes_to"),
        _edges(supplier, (pod, "s_name"), (service, "s_name"), "member_of"),
        _edges(orders.join(customer, F.col("o_custkey") == F.col("c_custkey")), (order, "o_orderkey"), (vm, "c_name"), "depends_on"),
        _edges(sold, (order, "l_orderkey"), (service, "s_name"), "connects_to"),
        _edges(sold, (order, "l_orderkey"), ("tf:database:part-", "l_partkey"), "mounts_volume"),
        _edges(sold.where("l_returnflag = 'A' and l_quantity >= 45"), (service, "s_name"), (secret, "l_partkey"), "mounts_secret"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's suppliers -> the nation whose customers bought most lines of them (ties by name): a graph with cycles."""
    t = lambda n: table(spark, sf_dir, n)
    sold = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = sold.groupBy("s_nationkey", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    names = t("nation")
    named = n.join(names.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("a")), "s_nationkey").join(names.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("b")), "c_nationkey")
    best = named.groupBy("a").agg(F.min(F.struct(-F.col("n"), F.col("b").alias("b"))).alias("m"))
    e = best.select(F.col("a").alias("from_id"), F.col("m.b").alias("to_id"), F.lit("connects_to").alias("type"))
    return e.select(edge_id("from_id", "type", "to_id").alias("id"), "from_id", "to_id", "type", F.create_map().cast("map<string,string>").alias("metadata"))


SQL = """
WITH RECURSIVE ends AS (SELECT o_custkey, min(o_orderdate) AS ends FROM orders GROUP BY 1),
n0 AS (
  SELECT 'tf:network:' || r_name AS id, r_name AS name, 'network' AS type, 'terraform' AS source, MAP {} AS md, NULL::TIMESTAMP AS expires_at, TIMESTAMP '1998-01-01' AS last_seen FROM region
  UNION ALL SELECT 'tf:firewall_rule:' || r_name, r_name, 'firewall_rule', 'terraform', MAP {'ingress_cidrs': CASE WHEN r_regionkey % 2 = 0 THEN '10.0.0.0/8, 0.0.0.0/0' ELSE '10.0.0.0/8' END}, NULL, TIMESTAMP '1998-01-01' FROM region
  UNION ALL SELECT 'tf:subnet:' || n_name, n_name, 'subnet', 'terraform', MAP {}, NULL, TIMESTAMP '1998-01-01' FROM nation
  UNION ALL SELECT 'tf:bucket:' || n_name, n_name, 'bucket', 'terraform', MAP {'acl': CASE WHEN n_nationkey % 3 = 0 THEN 'public-read' END, 'encrypted': CASE WHEN n_nationkey % 4 = 0 THEN 'false' END}, NULL, TIMESTAMP '1998-01-01' FROM nation
  UNION ALL SELECT 'k8s:ingress:default/' || n_name, n_name, 'ingress', 'kubernetes', MAP {'host': lower(n_name) || '.example.com', 'tls': CASE WHEN n_nationkey % 2 = 0 THEN 'true' END}, NULL, TIMESTAMP '1998-01-01' FROM nation
  UNION ALL SELECT 'tf:vm:' || c_name, c_name, 'vm', 'terraform', MAP {'public_ip': CASE WHEN c_custkey % 7 = 0 THEN '10.0.0.' || c_custkey END, 'namespace': c_mktsegment}, NULL, TIMESTAMP '1998-01-01' FROM customer
  UNION ALL SELECT 'k8s:certificate:default/' || c_name, c_name, 'certificate', 'kubernetes', MAP {}, ends, TIMESTAMP '1998-01-01' FROM customer LEFT JOIN ends ON c_custkey = o_custkey
  UNION ALL SELECT 'k8s:service:default/' || s_name, s_name, 'service', 'kubernetes', MAP {'service_type': CASE WHEN s_suppkey % 5 = 0 THEN 'LoadBalancer' ELSE 'ClusterIP' END, 'api_url': 'http://' || lower(s_name) || '.svc:80'}, NULL, TIMESTAMP '1998-01-01' FROM supplier
  UNION ALL SELECT 'k8s:pod:default/' || s_name, s_name, 'pod', 'kubernetes', MAP {'security.app.privileged': CASE WHEN s_suppkey % 4 = 0 THEN 'true' END, 'security.app.run_as_non_root': CASE WHEN s_suppkey % 3 = 0 THEN 'false' END, 'security.host_network': CASE WHEN s_suppkey % 6 = 0 THEN 'true' END, 'resources_limits.cpu': CASE WHEN s_suppkey % 2 = 0 THEN '1' END}, NULL, TIMESTAMP '1998-01-01' FROM supplier
  UNION ALL SELECT 'tf:database:part-' || p_partkey, p_name, 'database', ['terraform', 'cloudformation', 'pulumi'][p_partkey % 3 + 1], MAP {'publicly_accessible': CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END, 'storage_encrypted': CASE p_size % 3 WHEN 0 THEN 'false' WHEN 1 THEN 'true' END, 'deletion_protection': CASE WHEN p_size % 5 = 0 THEN 'false' END, 'MultiAZ': CASE WHEN p_size % 7 = 0 THEN 'false' END}, NULL, TIMESTAMP '1998-01-01' FROM part
  UNION ALL SELECT 'k8s:secret:default/part-' || p_partkey, 'part-' || p_partkey, 'secret', 'kubernetes', MAP {}, NULL, TIMESTAMP '1998-01-01' FROM part
  UNION ALL SELECT 'compose:container:order-' || o_orderkey, 'order-' || o_orderkey, 'container', 'compose', MAP {'image': 'shop/app:' || CASE WHEN o_orderkey % 4 = 0 THEN 'latest' ELSE CAST(o_orderkey % 4 AS VARCHAR) END, 'ports': CASE WHEN o_orderkey % 3 = 0 THEN '80:80' END, 'healthcheck': CASE WHEN o_orderkey % 6 = 0 THEN 'true' END, 'init': CASE WHEN o_orderkey % 9 = 0 THEN 'true' END}, NULL, o_orderdate FROM orders
), nodes AS (SELECT * FROM n0),
sold AS (SELECT * FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
e0 AS (
  SELECT 'tf:subnet:' || n_name AS from_id, 'tf:network:' || r_name AS to_id, 'connects_to' AS type FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT 'tf:vm:' || c_name, 'tf:subnet:' || n_name, 'depends_on' FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT 'k8s:service:default/' || s_name, 'tf:subnet:' || n_name, 'depends_on' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION SELECT 'k8s:ingress:default/' || n_name, 'k8s:service:default/' || s_name, 'routes_to' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION SELECT 'k8s:pod:default/' || s_name, 'k8s:service:default/' || s_name, 'member_of' FROM supplier
  UNION SELECT 'compose:container:order-' || o_orderkey, 'tf:vm:' || c_name, 'depends_on' FROM orders JOIN customer ON o_custkey = c_custkey
  UNION SELECT 'compose:container:order-' || l_orderkey, 'k8s:service:default/' || s_name, 'connects_to' FROM sold
  UNION SELECT 'compose:container:order-' || l_orderkey, 'tf:database:part-' || l_partkey, 'mounts_volume' FROM sold
  UNION SELECT 'k8s:service:default/' || s_name, 'k8s:secret:default/part-' || l_partkey, 'mounts_secret' FROM sold WHERE l_returnflag = 'A' AND l_quantity >= 45
), edges AS (SELECT from_id || '->' || type || '->' || to_id AS id, from_id, to_id, type FROM e0)
"""

TRADE_SQL = """
WITH RECURSIVE traded AS (
  SELECT s.n_name AS a, c.n_name AS b, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation s ON s_nationkey = s.n_nationkey JOIN nation c ON c_nationkey = c.n_nationkey GROUP BY 1, 2
), trade AS (SELECT a AS from_id, b AS to_id FROM traded QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) = 1)
"""
