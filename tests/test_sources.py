"""Parsers and streams on small documents."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

import infragraph.sources.all_parsers  # noqa: F401
from infragraph.functions import scalar as X
from infragraph.sources.documents import PARSERS, classify_source, decode_documents, ingest, read_documents
from infragraph.sources.lookup import resource_types

def at():
    return F.lit("2024-01-01").cast("timestamp")



@pytest.fixture(scope="module")
def parse(spark):
    def run(source, **files):
        docs = spark.createDataFrame([(k.replace("__", "/").replace("_", "."), source, v) for k, v in files.items()], "path string, source string, text string")
        n, e, w = PARSERS[source](docs, at())
        return {r["id"]: r for r in n.collect()}, {r["id"]: r["metadata"] for r in e.collect()}, [r["message"] for r in w.collect()]

    return run


def test_lookup_sizes():
    assert {k: len(resource_types(k)) for k in ("terraform", "cloudformation", "pulumi")} == {"terraform": 123, "cloudformation": 42, "pulumi": 114}


def test_classify(spark):
    want = {
        "a/x.tfstate": "terraform", "tfplan-1.json": "terraform-plan", "docker-compose.prod.yml": "compose", "cloudformation/a.json": "cloudformation", "cloudformation/readme.md": None,
        "pulumi/s.json": "pulumi", "ansible/h.ini": "ansible", "deploy/k.yaml": "kubernetes", "x.txt": None,
    }
    rows = spark.createDataFrame([(k,) for k in want], "path string").select("path", classify_source().alias("s")).collect()
    assert {r["path"]: r["s"] for r in rows} == want


def test_read_and_decode(spark, tmp_path):
    for name, text in (("k/a.yaml", "kind: A\n---\n\n---\nkind: [broken\n---\nkind: BList\nitems:\n- kind: C\n- kind: D\n"), (".git/x.yaml", "kind: Z"), ("k/n.md", "no")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    docs = read_documents(spark, [str(tmp_path)])
    assert docs.count() == 1
    out, bad = decode_documents(docs)
    assert sorted(json.loads(r["body"])["kind"] for r in out.collect()) == ["A", "C", "D"] and bad.count() == 1


def test_terraform(parse):
    def res(kind, name, *instances, mode="managed"):
        return {"mode": mode, "type": kind, "name": name, "provider": 'provider["registry.terraform.io/hashicorp/aws"]', "instances": [{"attributes": a, "dependencies": d} for a, d in instances]}

    one = json.dumps({"resources": [
        res("aws_vpc", "main", ({"name": "net", "tags": {"Env": "x", "n": 1000000}}, [])),
        res("aws_db_instance", "db", ({"storage_encrypted": False, "vpc_id": "a/net", "ingress": [{"cidr_blocks": ["1.1.1.1/32"], "ipv6_cidr_blocks": ["::/0"]}]}, ["aws_vpc.main", "aws_vpc.nope"])),
        res("aws_ami", "ignored", ({"name": "i"}, []), mode="data"), res("odd_thing", "t", ({}, [])),
    ]})
    two = json.dumps({"resources": [res("tls_self_signed_cert", "c", ({"not_after": "2025-01-02T03:04:05Z"}, ["aws_db_instance.db"]))]})
    n, e, w = parse("terraform", a_tfstate=one, b_tfstate=two, c_tfstate="{broken")
    assert set(n) == {"tf:network:net", "tf:database:db", "tf:certificate:c"}
    assert n["tf:database:db"]["metadata"] == {"storage_encrypted": "false", "ingress_cidrs": "1.1.1.1/32,::/0", "tf_type": "aws_db_instance"}
    assert n["tf:network:net"]["metadata"]["tag:n"] == "1000000" and n["tf:network:net"]["provider"] == "aws" and n["tf:certificate:c"]["expires_at"].year == 2025
    assert set(e) == {"tf:database:db->depends_on->tf:network:net", "tf:database:db->connects_to->tf:network:net", "tf:certificate:c->depends_on->tf:database:db"}
    assert e["tf:database:db->connects_to->tf:network:net"] == {"via": "vpc_id", "raw_value": "a/net"}
    assert sorted(w) == ["invalid JSON", "unmapped resource type: odd_thing.t"]


def test_terraform_plan(parse):
    change = lambda name, actions, **k: {"address": f"aws_instance.{name}", "type": "aws_instance", "name": name, "change": {"actions": actions, **k}}
    plan = {"resource_changes": [change("a", ["create"], after={"name": "A"}), change("b", ["delete"], before={"name": "B"}), change("c", ["delete", "create"], after={}), change("d", ["no-op"], after={}), change("e", [], after={}), change("f", ["read"])]}
    n, _, _ = parse("terraform-plan", tfplan_json=json.dumps(plan))
    assert {k: v["metadata"]["plan_action"] for k, v in n.items()} == {"tf:vm:A": "create", "tf:vm:B": "delete", "tf:vm:c": "replace"}


def test_cloudformation_yaml(parse):
    text = """
Resources:
  Net: {Type: "AWS::EC2::VPC"}
  Sub:
    Type: AWS::EC2::Subnet
    DependsOn: [Net]
    Properties: {VpcId: !Ref Net, CidrBlock: 10.0.0.0/24, Tags: [{Key: Name, Value: s}]}
  Vm:
    Type: AWS::EC2::Instance
    Properties: {SubnetId: Sub, UserData: {"Fn::Join": ["", [!GetAtt Sub.Id, {Ref: "AWS::Region"}]]}, SecurityGroupIds: [Net]}
  Odd: {Type: "AWS::Odd::Thing"}
"""
    n, e, w = parse("cloudformation", t_yaml=text, bad_yaml="just: text")
    assert set(n) == {"cfn:network:Net", "cfn:subnet:Sub", "cfn:vm:Vm"} and n["cfn:subnet:Sub"]["metadata"] == {"CidrBlock": "10.0.0.0/24", "tag:Name": "s", "cfn_type": "AWS::EC2::Subnet"}
    assert {k: v["via"] for k, v in e.items()} == {"cfn:subnet:Sub->depends_on->cfn:network:Net": "DependsOn", "cfn:vm:Vm->depends_on->cfn:subnet:Sub": "Ref", "cfn:vm:Vm->connects_to->cfn:subnet:Sub": "SubnetId", "cfn:vm:Vm->connects_to->cfn:network:Net": "SecurityGroupIds"}
    assert len(w) == 2


def test_kubernetes(parse):
    text = """
kind: Deployment
metadata: {name: api, labels: {team: x}}
spec:
  replicas: 2
  template:
    metadata: {labels: {app: api, tier: b}}
    spec:
      hostNetwork: true
      containers:
      - name: web
        image: a:1
        securityContext: {privileged: true, runAsNonRoot: false}
        envFrom: [{secretRef: {name: s-env}}, {configMapRef: {name: cm}}]
        env: [{name: DB, value: "postgres://u@pg.data:5432/x"}, {name: K, valueFrom: {secretKeyRef: {name: s-key, key: k}}}]
      initContainers: [{name: init, env: [{name: C, valueFrom: {configMapKeyRef: {name: cm2, key: url}}}]}]
      volumes: [{secret: {secretName: s-vol}}, {configMap: {name: cm-vol}}]
---
kind: Service
metadata: {name: api-svc}
spec: {type: ClusterIP, selector: {app: api}, ports: [{port: 80, protocol: TCP}]}
---
kind: Service
metadata: {name: pg, namespace: data}
spec: {selector: {app: other}}
---
kind: Service
metadata: {name: cache}
spec: {}
---
kind: ConfigMap
metadata: {name: cm}
data: {REDIS: "cache:6379"}
---
kind: Ingress
metadata: {name: in}
spec:
  rules: [{host: a.example, http: {paths: [{path: /, backend: {service: {name: api-svc}}}, {path: /old, backend: {serviceName: gone}}]}}]
  tls: [{hosts: [a.example], secretName: tls-s}]
---
kind: Secret
metadata: {name: t}
type: kubernetes.io/tls
---
kind: ClusterRoleBinding
metadata: {name: crb}
roleRef: {kind: ClusterRole, name: admin}
subjects: [{kind: ServiceAccount, name: sa, namespace: n}, {kind: User, name: u}]
---
kind: HorizontalPodAutoscaler
metadata: {name: h}
spec: {maxReplicas: 3, scaleTargetRef: {kind: Deployment, name: api}}
---
kind: NetworkPolicy
metadata: {name: np, namespace: elsewhere}
spec: {podSelector: {matchLabels: {tier: b}}}
---
kind: Gadget
metadata: {name: g}
---
kind: Node
metadata: {name: quiet}
"""
    n, e, w = parse("kubernetes", k_yaml=text)
    pod = "k8s:pod:default/api"
    assert n[pod]["metadata"] == {"kind": "Deployment", "namespace": "default", "replicas": "2", "images": "a:1", "label:team": "x", "security.host_network": "true", "security.web.privileged": "true", "security.web.run_as_non_root": "false"}
    assert n["k8s:service:default/api-svc"]["metadata"]["ports"] == "80/TCP" and n["k8s:secret:default/s-env"]["metadata"] == {"namespace": "default", "auto_created": "true"}
    assert n["k8s:certificate:default/tls-s"]["metadata"]["dns_names"] == "a.example" and "k8s:certificate:default/t" in n
    want = {
        f"{pod}->member_of->k8s:service:default/api-svc", f"{pod}->managed_by->k8s:networkpolicy:elsewhere/np", f"{pod}->managed_by->k8s:hpa:default/h",
        f"{pod}->mounts_secret->k8s:secret:default/s-env", f"{pod}->mounts_secret->k8s:secret:default/s-key", f"{pod}->mounts_secret->k8s:secret:default/s-vol",
        f"{pod}->depends_on->k8s:configmap:default/cm", f"{pod}->depends_on->k8s:configmap:default/cm2", f"{pod}->depends_on->k8s:configmap:default/cm-vol",
        f"{pod}->connects_to->k8s:service:data/pg", f"{pod}->connects_to->k8s:service:default/cache",
        "k8s:ingress:default/in->routes_to->k8s:service:default/api-svc", "k8s:ingress:default/in->routes_to->k8s:service:default/gone",
        "k8s:ingress:default/in->terminates_tls->k8s:secret:default/tls-s", "k8s:ingress:default/in->terminates_tls->k8s:certificate:default/tls-s",
        "k8s:secret:default/tls-s->depends_on->k8s:certificate:default/tls-s", "k8s:secret:default/t->depends_on->k8s:certificate:default/t",
        "k8s:clusterrolebinding:crb->depends_on->k8s:clusterrole:admin", "k8s:serviceaccount:n/sa->managed_by->k8s:clusterrolebinding:crb",
    }
    assert set(e) == want
    assert w == ["skipping unsupported kind: Gadget/g"]


def test_ansible(parse):
    ini = "[web]\nw1 ansible_host=1.2.3.4 db_host=db1\nw2 redis_host=nowhere port=1\n\n[web:vars]\nport=80\ndb_name=exampledb\n[db]\ndb1 ansible_host=10.0.0.9\n[all_of:children]\nweb\n; c\n"
    yml = "all:\n  vars: {zone: a}\n  hosts: {w1: {extra: 1}}\n  children:\n    inner: {vars: {zone: b}, hosts: {y1: {k8s_redis_service: data/redis}}}\n"
    play = "- hosts: web,db1\n  tasks:\n  - {name: t, docker_container: {name: app, image: a}}\n  - {service: {name: nginx, state: started}}\n"
    n, e, w = parse("ansible", hosts_ini=ini, inv_yml=yml, play_yml=play)
    assert set(n) == {"ansible:vm:w1", "ansible:vm:w2", "ansible:vm:db1", "ansible:vm:y1", "ansible:database:exampledb@db1", "k8s:service:data/redis", "ansible:container:app", "ansible:service:nginx"}
    assert n["ansible:vm:w2"]["metadata"] == {"redis_host": "nowhere", "port": "1", "db_name": "exampledb", "groups": "all.of,web"} or n["ansible:vm:w2"]["metadata"]["groups"] == "all_of,web"
    assert n["ansible:vm:w1"]["metadata"]["extra"] == "1" and n["ansible:vm:y1"]["metadata"]["zone"] == "b" and n["ansible:vm:y1"]["metadata"]["groups"] == "all,inner"
    assert n["ansible:database:exampledb@db1"]["metadata"]["connection_string"] == "postgres://10.0.0.9:5432/exampledb"
    assert n["k8s:service:data/redis"]["metadata"]["connection_string"] == "redis://redis.data.svc.cluster.local:6379/0"
    assert {k for k in e if "managed_by" not in k} == {"ansible:vm:w1->depends_on->ansible:database:exampledb@db1", "ansible:database:exampledb@db1->connects_to->ansible:vm:db1", "ansible:vm:y1->connects_to->k8s:service:data/redis"}
    assert {k for k in e if "managed_by" in k} == {f"ansible:{x}->managed_by->ansible:vm:{h}" for x in ("container:app", "service:nginx") for h in ("w1", "w2", "db1")}
    assert len(w) == 1 and "nowhere" in w[0]


def test_compose_and_ingest_all(spark):
    text = "services:\n  api: {image: a, depends_on: {db: {}}, networks: [back], ports: ['80:80'], init: true}\n  db: {volumes: ['data:/x', './y:/y'], healthcheck: {test: x}}\nnetworks: {back: }\nvolumes: {data: {}}\n"
    docs = spark.createDataFrame([("docker-compose.yml", "compose", text), ("x.tfstate", "terraform", '{"resources": []}')], "path string, source string, text string")
    n, e, w = ingest(docs, at())
    assert {r["id"] for r in n.collect()} == {"compose:container:api", "compose:container:db", "compose:network:back", "compose:volume:data"}
    assert {r["id"] for r in e.collect()} == {"compose:container:api->depends_on->compose:container:db", "compose:container:api->connects_to->compose:network:back", "compose:container:db->mounts_volume->compose:volume:data"}
    assert w.count() == 0


def test_scalars(spark):
    one = spark.range(1)
    got = one.select(
        X.potential_hosts(F.lit('http://u@a.b:80/x, "redis:6379";[c.d] e/f')).alias("h"), X.split_targets(F.lit("a, b,,c")).alias("c"), X.split_targets(F.lit("a  b")).alias("s"),
        X.labels_match(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))).alias("l"), X.normalize_identity_key(F.lit(" --Ä b__c/9- ")).alias("k"),
    ).first()
    assert got["h"] == ["a.b", "redis", "c.d", "e"] and got["c"] == ["a", "b", "c"] and got["s"] == ["a", "b"] and got["l"] is True and got["k"] == "ä-b-c-9"


def test_streams(spark, tmp_path):
    from infragraph.functions.schema import NODE_SCHEMA
    from infragraph.streaming.graph_store import graph_store, read_graph
    from infragraph.streaming.streams import stream_cert_alerts, stream_ingest, stream_latest

    docs = tmp_path / "docs"
    parse = lambda df: PARSERS["terraform"](df, at())
    state = lambda name: json.dumps({"resources": [{"mode": "managed", "type": "aws_instance", "name": name, "provider": "p/aws", "instances": [{"attributes": {}, "dependencies": []}]}]})
    schema = "path string, source string, text string"
    for i, name in enumerate(("one", "two")):
        spark.createDataFrame([(f"{name}.tfstate", "terraform", state(name))], schema).write.mode("append").json(str(docs))
        stream_ingest(spark.readStream.schema(schema).json(str(docs)), str(tmp_path / "graph"), parse, "terraform", str(tmp_path / "ck")).awaitTermination(120)
        assert read_graph(graph_store(spark, str(tmp_path / "graph")))["nodes"].count() == i + 1
        time.sleep(0.1)
    drift = {(r["change"], r["id"]) for r in spark.read.parquet(str(tmp_path / "graph/drift/scan_id=1")).where("kind = 'node'").collect()}
    assert drift == {("added", "tf:vm:two"), ("removed", "tf:vm:one")}
    spark.sql("select 'a' id, 'x' v, timestamp'2024-01-02' ts union all select 'a', 'y', timestamp'2024-01-03'").write.parquet(str(tmp_path / "ev"))
    stream_latest(spark.readStream.schema("id string, v string, ts timestamp").parquet(str(tmp_path / "ev")), str(tmp_path / "last"), str(tmp_path / "ck2")).awaitTermination(120)
    r = spark.read.parquet(str(tmp_path / "last/v0")).first()
    assert (r["v"], r["first_seen"].day, r["last_seen"].day) == ("y", 2, 3)
    spark.createDataFrame([("c", "c", "certificate", "s", "f", "p", {}, None, None, None)], NODE_SCHEMA).withColumn("expires_at", at()).write.parquet(str(tmp_path / "certs"))
    stream_cert_alerts(spark.readStream.schema(NODE_SCHEMA).parquet(str(tmp_path / "certs")), at(), str(tmp_path / "alerts"), str(tmp_path / "ck3")).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "alerts")).first()["severity"] == "critical"
