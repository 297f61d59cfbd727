"""Kubernetes manifests (I12 to I17). Every rule works inside one file, so each join carries the path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from infragraph.functions.scalar import potential_hosts
from infragraph.sources.documents import Tables, decode_documents, edges_of, first_of, last_nodes, merged, nodes_of, pairs, prefixed, register_parser

_NAMED = "struct<name:string>"
_KEYED = "struct<name:string,key:string>"
_SC = "struct<privileged:string,runAsNonRoot:string,readOnlyRootFilesystem:string,allowPrivilegeEscalation:string,runAsUser:string>"
_CONTAINER = f"struct<name:string,image:string,securityContext:{_SC},envFrom:array<struct<secretRef:{_NAMED},configMapRef:{_NAMED}>>,env:array<struct<name:string,value:string,valueFrom:struct<secretKeyRef:{_KEYED},configMapKeyRef:{_KEYED}>>>>"
_POD = f"struct<hostNetwork:string,hostPID:string,hostIPC:string,serviceAccountName:string,containers:array<{_CONTAINER}>,initContainers:array<{_CONTAINER}>,volumes:array<struct<secret:struct<secretName:string>,configMap:{_NAMED}>>>"
_PATHS = f"array<struct<path:string,backend:struct<service:{_NAMED},serviceName:string>>>"
_SPEC = (
    f"struct<replicas:string,type:string,selector:string,ports:array<struct<port:string,protocol:string>>,template:struct<metadata:struct<labels:map<string,string>>,spec:{_POD}>,"
    f"rules:array<struct<host:string,http:struct<paths:{_PATHS}>>>,tls:array<struct<hosts:array<string>,secretName:string>>,ingressClassName:string,dnsNames:array<string>,secretName:string,"
    "podSelector:struct<matchLabels:map<string,string>>,policyTypes:array<string>,schedule:string,minReplicas:string,maxReplicas:string,scaleTargetRef:struct<kind:string,name:string>>"
)
SCHEMA = f"kind string, type string, metadata struct<name:string,namespace:string,labels:map<string,string>>, spec {_SPEC}, data map<string,string>, status struct<notAfter:string>, roleRef struct<kind:string,name:string>, subjects array<struct<kind:string,name:string,namespace:string>>"

#: Kind, its part of the id ("" before the name if it has no namespace), and the asset type.
KINDS = [
    ("Deployment", "pod", "pod"), ("StatefulSet", "pod", "pod"), ("DaemonSet", "pod", "pod"), ("ReplicaSet", "pod", "pod"), ("Job", "job", "pod"), ("CronJob", "cronjob", "pod"),
    ("Service", "service", "service"), ("Ingress", "ingress", "ingress"), ("Secret", "secret", "secret"), ("ConfigMap", "configmap", "configmap"), ("Namespace", "namespace", "namespace"),
    ("Certificate", "certificate", "certificate"), ("ServiceAccount", "serviceaccount", "service_account"), ("Role", "role", "iam_policy"), ("ClusterRole", "clusterrole", "iam_policy"),
    ("RoleBinding", "rolebinding", "iam_binding"), ("ClusterRoleBinding", "clusterrolebinding", "iam_binding"), ("NetworkPolicy", "networkpolicy", "firewall_rule"), ("HorizontalPodAutoscaler", "hpa", "monitor"),
]
CLUSTER_SCOPED = ["Namespace", "ClusterRole", "ClusterRoleBinding"]
WORKLOADS = ["Deployment", "StatefulSet", "DaemonSet", "ReplicaSet"]
LABELLED = [*WORKLOADS, "Service", "Ingress", "Secret", "ConfigMap", "Certificate", "ServiceAccount"]
SILENT = (
    "Endpoints EndpointSlice Event LimitRange ResourceQuota PodDisruptionBudget StorageClass CSIDriver CSINode VolumeAttachment PriorityClass "
    "MutatingWebhookConfiguration ValidatingWebhookConfiguration CustomResourceDefinition APIService List ComponentStatus Node"
).split()


def k8s_id(kind: str | Column, ns: Column, name: Column) -> Column:
    return F.concat(F.lit("k8s:"), F.lit(kind) if isinstance(kind, str) else kind, F.lit(":"), ns, F.lit("/"), name)


def objects(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed objects (path, doc_no, o, kind, ns, name, part, asset, node_id) and warnings."""
    bodies, bad = decode_documents(docs)
    o = bodies.select("path", "doc_no", F.from_json("body", SCHEMA).alias("o")).where(F.col("o.metadata.name").isNotNull())
    kinds = F.broadcast(docs.sparkSession.createDataFrame(KINDS, "kind string, part string, asset string"))
    o = o.select("*", F.col("o.kind").alias("k"), F.coalesce(F.nullif(F.col("o.metadata.namespace"), F.lit("")), F.lit("default")).alias("ns"), F.col("o.metadata.name").alias("name"))
    o = o.join(kinds, F.col("k") == F.col("kind"), "left").drop("kind").withColumnRenamed("k", "kind")
    flat = F.concat(F.lit("k8s:"), "part", F.lit(":"), "name")
    return o.withColumn("node_id", F.when(F.col("kind").isin(CLUSTER_SCOPED), flat).otherwise(k8s_id(F.col("part"), F.col("ns"), F.col("name")))), bad


def _containers() -> Column:
    c = F.col("o.spec.template.spec")
    none = F.array().cast(f"array<{_CONTAINER}>")
    return F.concat(F.coalesce(c["containers"], none), F.coalesce(c["initContainers"], none))


def _security() -> Column:
    """Flags of each container as ``security.<container>.<flag>``."""

    def flags(c: Column) -> Column:
        s = c["securityContext"]
        named = (("privileged", F.when(s["privileged"] == "true", "true")), ("run_as_non_root", s["runAsNonRoot"]), ("read_only_root_fs", s["readOnlyRootFilesystem"]), ("allow_privilege_escalation", s["allowPrivilegeEscalation"]), ("run_as_user", s["runAsUser"]))
        return F.array(*[F.struct(F.concat(F.lit("security."), c["name"], F.lit(f".{k}")).alias("key"), v.alias("value")) for k, v in named])

    every = F.filter(F.flatten(F.transform(_containers(), flags)), lambda e: e["value"].isNotNull() & e["key"].isNotNull())
    keys = F.array_distinct(F.transform(every, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(every, lambda e: e["key"] == k), -1)["value"]))


def _metadata() -> Column:
    """Metadata by kind; entries without a value are left out."""
    s, kind, pod = F.col("o.spec"), F.col("kind"), F.col("o.spec.template.spec")
    work, is_ = kind.isin(WORKLOADS), lambda *k: kind.isin(*k)
    images = F.filter(F.transform(pod["containers"], lambda c: c["image"]), lambda i: i.isNotNull() & (i != ""))
    ports = F.transform(s["ports"], lambda p: F.concat(F.coalesce(p["port"], F.lit("0")), F.lit("/"), F.coalesce(p["protocol"], F.lit(""))))
    hosts = F.filter(F.transform(s["rules"], lambda r: r["host"]), lambda h: h.isNotNull() & (h != ""))
    own = pairs(
        ("kind", F.when(work | is_("Job", "CronJob", "Role", "ClusterRole", "RoleBinding", "ClusterRoleBinding"), kind)), ("namespace", F.when(~is_("Namespace"), F.col("ns"))),
        ("replicas", F.when(work, s["replicas"])), ("images", F.when(work, F.array_join(images, ","))), ("service_account", F.when(work, pod["serviceAccountName"])),
        *[(f"security.{k}", F.when(work & (pod[c] == "true"), "true")) for k, c in (("host_network", "hostNetwork"), ("host_pid", "hostPID"), ("host_ipc", "hostIPC"))],
        ("service_type", F.when(is_("Service"), s["type"])), ("ports", F.when(is_("Service"), F.array_join(ports, ","))), ("hosts", F.when(is_("Ingress"), F.array_join(hosts, ","))),
        ("ingress_class", F.when(is_("Ingress"), s["ingressClassName"])), ("type", F.when(is_("Secret"), F.trim("o.type"))), ("dns_names", F.when(is_("Certificate"), F.array_join(s["dnsNames"], ","))),
        ("secret_name", F.when(is_("Certificate"), s["secretName"])), ("not_after", F.when(is_("Certificate"), F.date_format(_not_after(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))),
        ("policy_types", F.when(is_("NetworkPolicy"), F.array_join(s["policyTypes"], ","))), ("schedule", F.when(is_("CronJob"), s["schedule"])),
        ("min_replicas", F.when(is_("HorizontalPodAutoscaler"), s["minReplicas"])), ("max_replicas", F.when(is_("HorizontalPodAutoscaler"), s["maxReplicas"])),
    )
    return merged(own, F.when(kind.isin(LABELLED), prefixed(F.col("o.metadata.labels"), "label:")), F.when(work, _security()))


def _not_after() -> Column:
    return F.try_to_timestamp(F.trim("o.status.notAfter"))


def _selected(o: DataFrame, kind: str, selector: Column, edge_type: str, via: str) -> DataFrame:
    """Workload -> kind for selectors whose pairs are all among the workload's template labels.

    Relational division inside each file: equal pairs are counted against the selector's size.
    """
    own = o.where(F.col("kind") == kind).select("path", F.col("node_id").alias("target"), F.map_filter(selector, lambda k, v: v.isNotNull()).alias("sel")).where(F.size("sel") > 0)
    want = own.select("path", "target", F.size("sel").alias("n"), F.explode("sel").alias("k", "v"))
    have = o.where(F.col("kind").isin(WORKLOADS)).select("path", "node_id", F.explode("o.spec.template.metadata.labels").alias("k", "v")).distinct()
    hit = want.join(have, ["path", "k", "v"]).groupBy("path", "target", "n", "node_id").agg(F.count(F.lit(1)).alias("hits")).where("hits = n")
    return edges_of(hit, F.col("node_id"), F.col("target"), edge_type, via=F.lit(via))


def config_references(o: DataFrame) -> DataFrame:
    """(path, ns, node_id, kind, name, key, via, rank) of secrets and config maps that workloads use."""
    w = o.where(F.col("kind").isin(WORKLOADS)).select("path", "ns", "node_id", F.col("o.spec.template.spec.volumes").alias("v"), _containers().alias("c"))
    ref = lambda kind, name, key, via, rank: F.struct(F.lit(kind).alias("kind"), name.alias("name"), key.alias("key"), F.lit(via).alias("via"), F.lit(rank).alias("rank"))
    no = F.lit(None).cast("string")
    volumes = w.select("path", "ns", "node_id", F.explode("v").alias("v")).select("path", "ns", "node_id", F.explode(F.array(ref("secret", F.col("v.secret.secretName"), no, "volume", 0), ref("configmap", F.col("v.configMap.name"), no, "volume", 0))).alias("r"))
    c = w.select("path", "ns", "node_id", F.explode("c").alias("c"))
    froms = c.select("path", "ns", "node_id", F.explode("c.envFrom").alias("e")).select("path", "ns", "node_id", F.explode(F.array(ref("secret", F.col("e.secretRef.name"), no, "envFrom", 1), ref("configmap", F.col("e.configMapRef.name"), no, "envFrom", 1))).alias("r"))
    envs = c.select("path", "ns", "node_id", F.explode("c.env").alias("e")).select("path", "ns", "node_id", F.explode(F.array(ref("secret", F.col("e.valueFrom.secretKeyRef.name"), no, "env", 2), ref("configmap", F.col("e.valueFrom.configMapKeyRef.name"), F.col("e.valueFrom.configMapKeyRef.key"), "env", 2))).alias("r"))
    return volumes.unionAll(froms).unionAll(envs).select("path", "ns", "node_id", "r.*").where("name is not null and name <> ''").withColumn("target", k8s_id(F.col("kind"), F.col("ns"), F.col("name")))


def _inferred_services(o: DataFrame, refs: DataFrame) -> DataFrame:
    """I16: workload -> service for hosts found in environment values and config map entries, among the file's services."""
    c = o.where(F.col("kind").isin(WORKLOADS)).select("path", "ns", "node_id", F.explode(_containers()).alias("c"))
    env = c.select("path", "ns", "node_id", F.explode("c.env").alias("e")).where(F.trim("e.value") != "").select("path", "ns", "node_id", F.concat(F.lit("env:"), "e.name").alias("via"), F.col("e.value").alias("raw"))
    data = o.where("kind = 'ConfigMap'").select("path", F.col("node_id").alias("target"), F.explode("o.data").alias("entry", "raw"))
    used = refs.where("kind = 'configmap' and via <> 'volume'").join(data, ["path", "target"])
    whole = used.where("via = 'envFrom'").select("path", "ns", "node_id", F.concat(F.lit("configmap:"), "name", F.lit(":"), "entry").alias("via"), "raw")
    one = used.where("via = 'env' and key = entry").select("path", "ns", "node_id", F.concat(F.lit("configmap_key:"), "name", F.lit(":"), "entry").alias("via"), "raw")
    hosts = env.unionAll(whole).unionAll(one).select("*", F.explode(potential_hosts("raw")).alias("host"))
    part = F.split(F.trim(F.lower("host"), F.lit(".")), r"\.")
    other = F.get(part, F.lit(1))
    wider = F.when(other.isNotNull() & ~other.isin("svc", "cluster", "local"), k8s_id("service", other, part[0]))
    places = hosts.select("path", "node_id", "via", "raw", F.explode(F.array_compact(F.array(k8s_id("service", F.col("ns"), part[0]), wider))).alias("target"))
    known = o.where("kind = 'Service'").select("path", F.col("node_id").alias("target")).distinct()
    return edges_of(places.join(known, ["path", "target"], "left_semi"), F.col("node_id"), F.col("target"), "connects_to", via=F.col("via"), raw_value=F.col("raw"))


@register_parser("kubernetes")
def kubernetes(docs: DataFrame, as_of: Column) -> Tables:
    """I12 to I17. Secrets, config maps and certificates that are only referred to are made, declared ones win."""
    o, bad = objects(docs)
    known = o.where("asset is not null")
    provider = F.when(F.col("kind") == "Certificate", "cert-manager").otherwise("kubernetes")
    nodes = nodes_of(known, as_of, id=F.col("node_id"), name=F.col("name"), type=F.col("asset"), source=F.lit("kubernetes"), provider=provider, metadata=_metadata(), expires_at=F.when(F.col("kind") == "Certificate", _not_after()))
    made: list[DataFrame] = []

    def make(df: DataFrame, kind: str, rank: int, provider: str = "kubernetes", **meta: Column) -> None:
        row = nodes_of(df, as_of, id=k8s_id(kind, F.col("ns"), F.col("name")), name=F.col("name"), type=F.lit(kind), source=F.lit("kubernetes"), provider=F.lit(provider), metadata=pairs(*meta.items()))
        made.append(row.withColumn("rank", F.lit(rank)))

    tls = known.where("kind = 'Secret'").where(F.lower(F.trim("o.type")) == "kubernetes.io/tls")
    make(tls, "certificate", 0, namespace=F.col("ns"), derived_from_secret=F.lit("true"), secret_name=F.col("name"))
    edges = edges_of(tls, F.col("node_id"), k8s_id("certificate", F.col("ns"), F.col("name")), "depends_on", via=F.lit("tls_secret"))

    edges = edges.unionByName(_selected(o, "Service", F.from_json("o.spec.selector", "map<string,string>"), "member_of", "selector"))
    edges = edges.unionByName(_selected(o, "NetworkPolicy", F.col("o.spec.podSelector.matchLabels"), "managed_by", "podSelector"))

    ingress = known.where("kind = 'Ingress'")
    routes = ingress.select("path", "ns", "node_id", F.explode("o.spec.rules").alias("r")).select("path", "ns", "node_id", "r.host", F.explode("r.http.paths").alias("p"))
    routes = routes.withColumn("name", F.coalesce(F.col("p.backend.service.name"), F.col("p.backend.serviceName"))).where("name is not null and name <> ''")
    edges = edges.unionByName(edges_of(routes, F.col("node_id"), k8s_id("service", F.col("ns"), F.col("name")), "routes_to", host=F.col("host"), path=F.col("p.path")))
    ends = ingress.select("path", "ns", "node_id", F.explode("o.spec.tls").alias("t")).select("path", "ns", "node_id", F.col("t.secretName").alias("name"), F.array_join("t.hosts", ",").alias("hosts")).where("name is not null and name <> ''")
    secret, cert = k8s_id("secret", F.col("ns"), F.col("name")), k8s_id("certificate", F.col("ns"), F.col("name"))
    edges = edges.unionByName(edges_of(ends, F.col("node_id"), secret, "terminates_tls", hosts=F.col("hosts"))).unionByName(edges_of(ends, F.col("node_id"), cert, "terminates_tls", hosts=F.col("hosts")))
    edges = edges.unionByName(edges_of(ends, secret, cert, "depends_on", via=F.lit("tls_secret")))
    make(ends, "secret", 1, type=F.lit("kubernetes.io/tls"))
    make(ends, "certificate", 1, namespace=F.col("ns"), derived_from_secret=F.lit("true"), secret_name=F.col("name"), dns_names=F.col("hosts"))

    refs = config_references(o)
    kind = F.when(F.col("kind") == "secret", "mounts_secret").otherwise("depends_on")
    used = edges_of(refs, F.col("node_id"), F.col("target"), kind, via=F.col("via"))
    place = F.when(F.col("metadata")["via"] == "volume", 0).when(F.col("metadata")["via"] == "envFrom", 1).otherwise(2)
    edges = edges.unionByName(first_of(used.withColumn("rank", place), "rank"))
    for k in ("secret", "configmap"):
        make(refs.where(F.col("kind") == k), k, 2, namespace=F.col("ns"), auto_created=F.lit("true"))
    edges = edges.unionByName(_inferred_services(o, refs))

    certs = known.where("kind = 'Certificate'").select("path", "ns", "node_id", F.col("o.spec.secretName").alias("name")).where("name is not null and name <> ''")
    edges = edges.unionByName(edges_of(certs, F.col("node_id"), secret, "depends_on", via=F.lit("cert-manager")))
    make(certs, "secret", 3, "cert-manager", type=F.lit("kubernetes.io/tls"))
    bindings = known.where("kind in ('RoleBinding', 'ClusterRoleBinding')")
    role = F.when(F.col("o.roleRef.kind") == "ClusterRole", F.concat(F.lit("k8s:clusterrole:"), "o.roleRef.name")).otherwise(k8s_id("role", F.col("ns"), F.col("o.roleRef.name")))
    edges = edges.unionByName(edges_of(bindings.where("o.roleRef.name is not null"), F.col("node_id"), role, "depends_on", via=F.lit("roleRef")))
    subjects = bindings.select("ns", "node_id", F.explode("o.subjects").alias("s")).where("s.kind = 'ServiceAccount'")
    account = k8s_id("serviceaccount", F.coalesce(F.nullif(F.col("s.namespace"), F.lit("")), F.col("ns")), F.col("s.name"))
    edges = edges.unionByName(edges_of(subjects, account, F.col("node_id"), "managed_by", via=F.lit("subject")))
    scaled = known.where("kind = 'HorizontalPodAutoscaler'").where(F.lower("o.spec.scaleTargetRef.kind").isin("deployment", "statefulset", "replicaset"))
    edges = edges.unionByName(edges_of(scaled, k8s_id("pod", F.col("ns"), F.col("o.spec.scaleTargetRef.name")), F.col("node_id"), "managed_by", via=F.lit("scaleTargetRef")))

    extra = made[0]
    for m in made[1:]:
        extra = extra.unionByName(m)
    rest = [c for c in nodes.columns if c != "id"]
    best = extra.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("rank", "source_file", F.to_json("metadata"))).alias("n"))
    extra = best.select(*[F.col(c) if c == "id" else F.col(f"n.{c}").alias(c) for c in nodes.columns]).join(nodes.select("id"), "id", "left_anti").select(*nodes.columns)
    unknown = o.where(F.col("asset").isNull() & ~F.col("kind").isin(SILENT)).select(F.col("path").alias("source_file"), F.concat(F.lit("skipping unsupported kind: "), "kind", F.lit("/"), "name").alias("message"))
    return last_nodes(nodes).unionByName(extra), first_of(edges), bad.unionByName(unknown)
