"""Topologies from documents: known answers, values of mixed types, odd documents."""

import json

import pytest
from pyspark.sql import functions as F

from facetgraph.functions import values as V
from facetgraph.operators import bundles, partition, render, topology

COMPOSE = {"services": {"web": {"build": {"context": ".", "dockerfile": "Dockerfile"}, "ports": ["8080:80"], "depends_on": ["db", "cache"], "links": ["cache:6379"]}, "db": {"image": "postgres:17"}, "cache": {"image": "redis:8"}, "queue": {"image": "rabbitmq:3"}}}
CLUSTER = [
    {"kind": "Deployment", "metadata": {"name": "api"}, "spec": {"replicas": 2, "template": {"metadata": {"labels": {"app": "api"}}, "spec": {"containers": [{"name": "api", "image": "example/api:1"}]}}}},
    {"kind": "Service", "metadata": {"name": "api-service"}, "spec": {"selector": {"app": "api"}}},
    {"kind": "Ingress", "metadata": {"name": "public"}, "spec": {"rules": [{"http": {"paths": [{"path": "/", "backend": {"service": {"name": "api-service", "port": {"number": 80}}}}]}}]}},
]


def _rows(df, *columns):
    return sorted(tuple(sorted(v.items()) if isinstance(v, dict) else v for v in r) for r in df.select(*columns).collect())


def _documents(spark, documents):
    return spark.createDataFrame([("f", i, d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)], "graph string, pos long, json string")


def test_compose_file(spark):
    nodes, connections = topology.compose_topology(_documents(spark, [COMPOSE]))
    assert _rows(nodes, "id", "label", "kind", "confidence", "environment", "source", "metadata") == [
        ("compose:cache", "cache", "cache", "confirmed", "compose", "f", [("image", "redis:8")]),
        ("compose:db", "db", "database", "confirmed", "compose", "f", [("image", "postgres:17")]),
        ("compose:queue", "queue", "message-queue", "confirmed", "compose", "f", [("image", "rabbitmq:3")]),
        ("compose:web", "web", "service", "confirmed", "compose", "f", [("build", "{'context': '.', 'dockerfile': 'Dockerfile'}"), ("ports", "8080:80")]),
    ]
    assert _rows(connections, "source", "target", "relation") == [("compose:web", "compose:cache", "depends_on"), ("compose:web", "compose:cache", "links"), ("compose:web", "compose:db", "depends_on")]


def test_cluster_documents(spark):
    nodes, connections = topology.cluster_topology(_documents(spark, CLUSTER))
    assert _rows(nodes, "id", "label", "kind", "metadata") == [
        ("k8s:deployment:api", "api", "workload", [("images", "example/api:1"), ("kind", "Deployment"), ("replicas", "2")]),
        ("k8s:ingress:public", "public", "ingress", []),
        ("k8s:service:api-service", "api-service", "service-endpoint", []),
    ]
    assert _rows(connections, "source", "target", "relation") == [("k8s:ingress:public", "k8s:service:api-service", "routes_to"), ("k8s:service:api-service", "k8s:deployment:api", "routes_to")]


def test_build_files(spark):
    nodes, connections = topology.image_topology(spark.createDataFrame([("Dockerfile", "FROM --platform=linux/amd64 python:3.13-slim AS build\nFROM gcr.io/d\nFROM gcr.io/d\n"), ("none", "RUN x"), ("null", None)], "graph string, text string"))
    assert _rows(nodes, "id", "metadata") == [("docker:Dockerfile", [("base_images", "python:3.13-slim, gcr.io/d, gcr.io/d")]), ("image:gcr.io/d", []), ("image:python:3.13-slim", [])]
    assert _rows(connections, "source", "target") == [("docker:Dockerfile", "image:gcr.io/d"), ("docker:Dockerfile", "image:python:3.13-slim")]


def test_missing_values_and_odd_documents(spark):
    assert topology.cluster_topology(_documents(spark, [None, "", "[1]", "no", "{}", {"kind": "Pod"}, {"kind": "Service", "spec": 3}]))[0].count() == 0
    assert topology.compose_topology(_documents(spark, [None, "", "[1]", "no", "{}", {"services": [1]}, {"services": None}]))[0].count() == 0
    odd = [
        {"kind": "Pod", "metadata": {"name": "p", "labels": {"a": 1, "b": True}}, "spec": {"containers": [{}, {"image": ""}, 7, {"image": "x"}]}},
        {"kind": "Job", "metadata": {"name": None}, "spec": {"template": {"metadata": {"labels": {"a": "1"}}}, "containers": [{"image": "own"}]}},
        {"kind": "Service", "metadata": {"name": "one"}, "spec": {"selector": {"a": "1", "b": "True"}}},
        {"kind": "Service", "metadata": {"name": "lacks"}, "spec": {"selector": {"b": None}}},
        {"kind": "Service", "metadata": {"name": "both"}, "spec": {"selector": {"a": 1, "z": None}}},
        {"kind": "Service", "metadata": {"name": "empty"}, "spec": {"selector": {}}},
        {"kind": "Ingress", "metadata": {"name": "i"}, "spec": {"defaultBackend": {"service": {"name": "one"}}, "rules": [None, {"http": {"paths": [{"backend": {"service": {"name": "gone"}}}, {"backend": {"service": {"name": "one"}}}]}}]}},
    ]
    nodes, connections = topology.cluster_topology(_documents(spark, odd))
    assert _rows(nodes.where("kind = 'workload'"), "id", "metadata") == [("k8s:job:None", [("images", "own"), ("kind", "Job"), ("replicas", "None")]), ("k8s:pod:p", [("images", "None, None, x"), ("kind", "Pod"), ("replicas", "None")])]
    assert _rows(connections, "source", "target") == [
        ("k8s:ingress:i", "k8s:service:one"),
        ("k8s:service:both", "k8s:job:None"),
        ("k8s:service:both", "k8s:pod:p"),
        ("k8s:service:lacks", "k8s:job:None"),
        ("k8s:service:one", "k8s:pod:p"),
    ]


@pytest.mark.parametrize("value", [None, True, False, "x", "it's", 'a"b\'c', "a\\b\n\t\r", 3, 1.5, [], {}, [None, True, "q,[{:"], {"b": {"c": [1, {"d": "'"}]}, "a": False, "long": "x" * 20000}])
def test_values_as_text(spark, value):
    row = spark.createDataFrame([(json.dumps(value),)], "j string").select(V.value_text(F.try_parse_json("j"))).first()[0]

    def shown(v):
        if isinstance(v, dict):
            return "{" + ", ".join(f"{shown(k)}: {shown(v[k])}" for k in sorted(v)) + "}"
        return "[" + ", ".join(map(shown, v)) + "]" if isinstance(v, list) else repr(v)

    assert row == (value if isinstance(value, str) else shown(value))


def test_topology_as_a_chart(spark):
    nodes, connections = topology.compose_topology(_documents(spark, [COMPOSE]))
    text = render.deployment_flowchart(nodes, connections).first()["text"]
    assert text.split("\n")[:6] == ["flowchart LR", '    n0["cache\\\\nredis:8\\\\n[compose]"]', '    n1[("db\\\\npostgres:17\\\\n[compose]")]', '    n2["queue\\\\nrabbitmq:3\\\\n[compose]"]', '    n3["web\\\\n[compose]"]', '    n3 -->|"depends_on [confirmed]"| n0']
    assert text.endswith("    class n2 confirmed;\n    class n3 confirmed;\n")
    members = partition.partition(nodes.select("graph", F.col("id").alias("node")), connections.select("graph", F.col("source").alias("src"), F.col("target").alias("dst")))
    outputs = {r["output_name"]: r["text"] for r in bundles.deployment_bundle(members, nodes, connections).collect()}
    assert len(outputs) >= 2 and all(t.startswith("flowchart LR\n    n0") for t in outputs.values()) and sum("compose:web" in n or "_web" in n for n in outputs) == 1
