"""Deployment topologies from configuration documents.

Documents come as JSON text, decoded as VARIANT, so that a field may be a scalar, an array
or an object. What is no JSON, or not of the expected form, gives no nodes. Nodes are
(graph, id, label, kind, confidence, environment, source, metadata), connections (graph,
source, target, relation, confidence); all are confirmed, and `source` of a node names
the file. A connection is given as often as the file states it. Targets are looked up by
joins on (graph, name): a file's names are never gathered in one row. These joins are merged
by a hint, as Spark takes what comes out of a text for small and would send it to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetgraph.functions import text as T
from facetgraph.functions import values as V

# The kinds of documents that run containers.
WORKLOADS = ("Deployment", "StatefulSet", "DaemonSet", "Pod", "Job", "CronJob")


def _metadata(**fields: Column) -> Column:
    """A map of the fields that are not null."""
    pairs = [x for name, value in sorted(fields.items()) for x in (F.lit(name), value)]
    return F.map_filter(F.create_map(*pairs), lambda _, value: value.isNotNull())


def _nodes(rows: DataFrame, id: Column, label: Column, kind: Column, environment: str, metadata: Column | None = None) -> DataFrame:
    none = F.create_map().cast("map<string,string>")
    return rows.select("graph", id.alias("id"), label.alias("label"), kind.alias("kind"), F.lit("confirmed").alias("confidence"), F.lit(environment).alias("environment"), F.col("graph").alias("source"), (none if metadata is None else metadata).alias("metadata"))


def _connections(rows: DataFrame, source: Column, target: Column, relation: Column) -> DataFrame:
    return rows.select("graph", source.alias("source"), target.alias("target"), relation.alias("relation"), F.lit("confirmed").alias("confidence"))


def image_topology(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files(graph, text): each build file with its base images, each image once a file; a file without any has no node."""
    bases = files.select("graph", T.base_images(F.col("text")).alias("bases")).where(F.size("bases") > 0)
    own = F.concat(F.lit("docker:"), "graph")
    each = bases.select("graph", F.explode(F.array_distinct("bases")).alias("base"))
    image = F.concat(F.lit("image:"), "base")
    nodes = _nodes(bases, own, F.col("graph"), F.lit("container-image"), "container", _metadata(base_images=F.array_join("bases", ", ")))
    return nodes.unionByName(_nodes(each, image, F.col("base"), F.lit("external-image"), "registry")), _connections(each, own, image, F.lit("FROM"))


def compose_topology(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents(graph, json): the services of each file, what they depend on and link to, if the file has it.

    Image, build and ports are kept as metadata; ports as one text. A service that is null
    or no object has a node without metadata.
    """
    services = V.entries(V.at(F.try_parse_json("json"), "$.services"))
    rows = documents.select("graph", F.explode(services).alias("name", "spec"))
    given = lambda path: F.when(V.is_given(V.at(F.col("spec"), path)), V.value_text(V.at(F.col("spec"), path)))
    ports = F.nullif(F.array_join(V.text_list(V.at(F.col("spec"), "$.ports")), ", "), F.lit(""))
    rows = rows.select("graph", "name", "spec", given("$.image").alias("image"), given("$.build").alias("build"), ports.alias("ports"))
    ident = F.concat(F.lit("compose:"), "name")
    kind = T.service_kind(F.col("name"), F.coalesce("image", F.lit("")))
    nodes = _nodes(rows, ident, F.col("name"), kind, "compose", _metadata(image=F.col("image"), build=F.col("build"), ports=F.col("ports")))
    links = F.transform(V.text_list(V.at(F.col("spec"), "$.links")), lambda x: F.substring_index(x, ":", 1))
    wanted = F.concat(
        F.transform(V.text_list(V.at(F.col("spec"), "$.depends_on")), lambda x: F.struct(F.lit("depends_on").alias("relation"), x.alias("target"))),
        F.transform(links, lambda x: F.struct(F.lit("links").alias("relation"), x.alias("target"))),
    )
    known = rows.select("graph", F.col("name").alias("target")).hint("merge")
    met = rows.select("graph", "name", F.explode(wanted).alias("w")).select("graph", "name", "w.*").join(known, ["graph", "target"], "left_semi")
    return nodes, _connections(met, ident, F.concat(F.lit("compose:"), "target"), F.col("relation"))


def _pods(rows: DataFrame) -> DataFrame:
    """The documents that run containers, with `id`, their images and what labels their pods have (a map of texts)."""
    inner = V.entries(V.at(F.col("v"), "$.spec.template")).isNotNull()
    pick = lambda nested, own: F.when(inner, V.at(F.col("v"), nested)).otherwise(V.at(F.col("v"), own))
    # without a spec in its template, a pod is described by the document's own
    spec = pick("$.spec.template.spec", "$.spec")
    containers = F.coalesce(V.items(V.at(F.when(V.entries(spec).isNotNull(), spec).otherwise(V.at(F.col("v"), "$.spec")), "$.containers")), F.array().cast("array<variant>"))
    images = F.filter(F.transform(containers, lambda c: V.value_text(V.at(c, "$.image"))), lambda x: x != "")
    labels = F.transform_values(V.entries(pick("$.spec.template.metadata.labels", "$.metadata.labels")), lambda _, value: V.value_text(value))
    ident = F.concat(F.lit("k8s:"), F.lower("kind"), F.lit(":"), "name")
    return rows.where(F.col("kind").isin(*WORKLOADS) & (F.col("name") != "")).select("graph", "pos", "kind", "name", ident.alias("id"), F.nullif(F.array_join(images, ", "), F.lit("")).alias("images"), F.nullif(V.value_text(V.at(F.col("v"), "$.spec.replicas")), F.lit("")).alias("replicas"), F.coalesce(labels, F.create_map().cast("map<string,string>")).alias("labels"))


def selected_pods(services: DataFrame, pods: DataFrame) -> DataFrame:
    """services(graph, ..., selector) with `id` of each of pods(graph, id, labels) whose labels meet all items of the selector; maps of texts.

    An item None is met by a label of that text and by none at all. They meet by equality
    in the selector's first real item, then all items are compared; a selector without
    one meets all pods of its graph, an empty one nothing.
    """
    text = lambda key, value: F.concat(F.length(key).cast("string"), F.lit(":"), key, value)
    real = F.array_sort(F.transform(F.map_entries(F.map_filter("selector", lambda _, value: value != "None")), lambda e: text(e["key"], e["value"])))
    probes = services.where(F.size("selector") > 0).withColumn("__item", F.coalesce(F.get(real, F.lit(0)), F.lit("")))
    own = F.concat(F.transform(F.map_entries("labels"), lambda e: text(e["key"], e["value"])), F.array(F.lit("")))
    found = pods.select("graph", "id", "labels", F.explode(own).alias("__item"))
    met = F.forall(F.map_entries("selector"), lambda e: F.coalesce(F.try_element_at("labels", e["key"]), F.lit("None")) == e["value"])
    return probes.join(found.hint("merge"), ["graph", "__item"]).where(met).drop("__item", "labels")


def cluster_topology(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents(graph, pos, json), one for each document of a file: workloads, services that route to those they select, ingresses to services.

    Missing values that are shown are the text None. Of workloads with one id each has a
    node; the last one's labels count. A document without a name has no node.
    """
    v = F.try_parse_json("json")
    name = F.when(V.at(F.col("v"), "$.metadata.name").isNull(), "").otherwise(V.value_text(V.at(F.col("v"), "$.metadata.name")))
    rows = documents.select("graph", "pos", v.alias("v")).where(F.col("v").isNotNull()).withColumns({"kind": V.value_text(V.at(F.col("v"), "$.kind")), "name": name})
    pods = _pods(rows)
    services, ingresses = rows.where("kind = 'Service'"), rows.where("kind = 'Ingress'")
    ident = lambda kind, of="name": F.concat(F.lit(f"k8s:{kind}:"), of)
    nodes = _nodes(pods, F.col("id"), F.col("name"), F.lit("workload"), "kubernetes", _metadata(kind=F.col("kind"), images=F.col("images"), replicas=F.col("replicas")))
    nodes = nodes.unionByName(_nodes(services.where("name != ''"), ident("service"), F.col("name"), F.lit("service-endpoint"), "kubernetes"))
    nodes = nodes.unionByName(_nodes(ingresses.where("name != ''"), ident("ingress"), F.col("name"), F.lit("ingress"), "kubernetes"))

    selector = F.transform_values(V.entries(V.at(F.col("v"), "$.spec.selector")), lambda _, value: V.value_text(value))
    last = pods.groupBy("graph", "id").agg(F.max_by("labels", "pos").alias("labels"))
    selected = selected_pods(services.select("graph", "name", selector.alias("selector")), last)
    routes = _connections(selected, ident("service"), F.col("id"), F.lit("routes_to"))

    none = F.array().cast("array<variant>")
    paths = F.flatten(F.transform(F.coalesce(V.items(V.at(F.col("v"), "$.spec.rules")), none), lambda r: F.coalesce(V.items(V.at(r, "$.http.paths")), none)))
    backends = F.concat(F.array(V.at(F.col("v"), "$.spec.defaultBackend")), F.transform(paths, lambda p: V.at(p, "$.backend")))
    named = F.array_distinct(F.transform(backends, lambda b: V.value_text(V.at(b, "$.service.name"))))
    wanted = ingresses.select("graph", "name", F.explode(named).alias("target"))
    known = services.where("name != ''").select("graph", F.col("name").alias("target")).hint("merge")
    met = wanted.join(known, ["graph", "target"], "left_semi")
    return nodes, routes.unionByName(_connections(met, ident("ingress"), ident("service", "target"), F.lit("routes_to")))
