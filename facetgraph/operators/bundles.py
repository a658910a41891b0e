"""Diagrams of a partitioned graph: an output for each series and for each shared node.

A series shows its nodes, all edges that leave them, and the nodes beyond its boundary
that these lead to; a shared node's output shows its edges both ways. A node that is not
at home in an output is drawn as a stub that names the output where it goes on. Graphs
are cut before anything is drawn: an output is as large as a series and its boundary.

members is what partition() gives, outputs what output_names() gives. Graphs of `small` rows
or fewer are laid out in tasks (series.py), larger ones by joins. What is looked up grows
with the graphs, so that these joins are merged by a hint and nothing goes to the driver.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetgraph.functions.names import object_key, stable_output_name
from facetgraph.operators import render
from facetgraph.operators.partition import output_name, output_names
from facetgraph.operators.series import drawn_of
from facetgraph.operators.tasks import SMALL, by_size, in_tasks
from facetgraph.operators.traverse import _same
from facetgraph.sources.scratch import Scratch, written


def output_edges(members: DataFrame, outputs: DataFrame, edges: DataFrame) -> DataFrame:
    """edges(graph, src, dst, ...) with output_name, once for each output that draws them."""
    homes = outputs.alias("o").join(members.select("graph", "node", "shared").alias("m"), _same("o", "m", {"node": "node"})).select("o.graph", "o.node", "o.output_name", "m.shared")
    placed = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    for end in ("src", "dst"):
        placed = placed.alias("e").join(homes.alias("h"), _same("e", "h", {end: "node"})).select("e.*", F.col("h.output_name").alias(f"__{end}"), F.col("h.shared").alias(f"__{end}_shared"))
    # the caller's output, and a shared callee's own
    drawn = F.array_compact(F.array("__src", F.when(F.col("__dst_shared") & (F.col("src") != F.col("dst")), F.col("__dst"))))
    return placed.withColumn("output_name", F.explode(drawn)).drop("__src", "__dst", "__src_shared", "__dst_shared")


def output_nodes(members: DataFrame, outputs: DataFrame, drawn: DataFrame) -> DataFrame:
    """(graph, output_name, node, reference, place) of all nodes in the outputs of output_edges(): reference names a stub's own output, place is 1 for a series' stubs."""
    homes = outputs.alias("o").join(members.select("graph", "node", "shared").alias("m"), _same("o", "m", {"node": "node"})).select("o.graph", "o.node", "o.output_name", "m.shared")
    ends = drawn.select("graph", "output_name", F.explode(F.array("src", "dst")).alias("node")).distinct()
    ends = ends.alias("e").join(homes.alias("h"), _same("e", "h", {"node": "node"})).where("e.output_name != h.output_name").select("e.graph", "e.output_name", "e.node", F.col("h.output_name").alias("reference"))
    own = homes.select("graph", "output_name", "node", F.lit(None).cast("string").alias("reference"))
    shared = homes.where("shared").select("graph", "output_name")
    stubs = ends.alias("e").join(shared.alias("s"), _same("e", "s", {"output_name": "output_name"}), "left").select("e.*", F.when(F.col("s.output_name").isNull(), F.lit(1)).otherwise(F.lit(0)).alias("place"))
    return own.withColumn("place", F.lit(0)).unionByName(stubs)


def _with_neighbours(members: DataFrame, outputs: DataFrame, edges: DataFrame, drawn: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct columns of drawn, and of the edges between the neighbours that a shared node's output shows."""
    shared = members.where("shared").alias("m").join(outputs.alias("o"), _same("m", "o", {"node": "node"})).select("o.graph", "o.output_name")
    near = nodes.alias("n").join(shared.alias("s"), _same("n", "s", {"output_name": "output_name"}), "left_semi")
    between = edges.alias("e").join(near.alias("a"), _same("e", "a", {"src": "node"})).select("e.*", "a.output_name")
    between = between.alias("e").join(near.alias("b"), _same("e", "b", {"dst": "node", "output_name": "output_name"}), "left_semi")
    return drawn.select(*columns).union(between.select(*columns)).distinct()


def laid_out(members: DataFrame, edges: DataFrame, fallback: str, rest: list[str], neighbours: bool = False, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """output_edges() with the columns in rest, with neighbours _with_neighbours(), and output_nodes()."""
    with Scratch(members.sparkSession, "outputs") as scratch:
        ends = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("graph", "src", "dst", F.lit(None).cast("boolean").alias("shared"), F.lit(None).cast("string").alias("output_name"), *rest)
        node = members.schema["node"].dataType
        homes = members.select("graph", F.col("node").alias("src"), F.lit(None).cast(node).alias("dst"), "shared", output_name(fallback).alias("output_name"), *[F.lit(None).cast(edges.schema[c].dataType).alias(c) for c in rest])
        rows = scratch.write(homes.union(ends), "rows")
        here, large = by_size(rows, small, scratch)
        fields = {"output_name": T.StringType(), "src": node, "dst": node, "reference": T.StringType(), "place": T.IntegerType(), **{c: edges.schema[c].dataType for c in rest}}
        out = in_tasks(here, [T.StructField(*f) for f in fields.items()], partial(drawn_of, neighbours=neighbours))
        if large is not None:
            own = members.alias("m").join(large.where("dst IS NULL").select("graph", "src").alias("l"), _same("m", "l", {"node": "src"}), "left_semi")
            outputs, between = output_names(own, fallback), large.where("dst IS NOT NULL").select("graph", "src", "dst", *rest)
            drawn = output_edges(own, outputs, between)
            nodes = output_nodes(own, outputs, drawn)
            if neighbours:
                drawn = _with_neighbours(own, outputs, between, drawn, nodes, ["graph", "src", "dst", *rest, "output_name"])
            out = out.unionByName(drawn, allowMissingColumns=True).unionByName(nodes.withColumnRenamed("node", "src"), allowMissingColumns=True)
        out = written(out, "outputs")
    return out.where("dst IS NOT NULL").select("graph", "src", "dst", *rest, "output_name"), out.where("dst IS NULL").select("graph", "output_name", F.col("src").alias("node"), "reference", "place")


def _keyed(df: DataFrame) -> DataFrame:
    """An output is a graph of its own for what draws it."""
    return df.withColumn("graph", F.struct("graph", "output_name")).drop("output_name")


def _texts(df: DataFrame) -> DataFrame:
    return df.select("graph.graph", "graph.output_name", "text")


def placements(members: DataFrame, outputs: DataFrame) -> DataFrame:
    """(graph, output_name, directory, series_root, parent_series_root, depth, shared): where each output belongs."""
    rows = outputs.alias("o").join(members.alias("m"), _same("o", "m", {"node": "node"}))
    directory = F.when(F.col("m.shared"), F.lit("shared")).otherwise(stable_output_name("series", F.col("m.series"), "series"))
    root = F.when(F.col("m.shared"), F.col("m.node")).otherwise(F.col("m.series"))
    return rows.select("o.graph", "o.output_name", directory.alias("directory"), root.alias("series_root"), F.col("m.parent").alias("parent_series_root"), F.coalesce("m.depth", F.lit(0)).alias("depth"), "m.shared").distinct()


def call_graph_bundle(members: DataFrame, edges: DataFrame, direction: str = "LR") -> DataFrame:
    """(graph, output_name, text): flowcharts of edges(graph, src, dst, pos)."""
    drawn, nodes = laid_out(members, edges, "call_graph", ["pos"])
    return _texts(render.call_flowchart(_keyed(nodes), _keyed(drawn), direction))


def class_bundle(members: DataFrame, edges: DataFrame, classes: DataFrame, methods: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """(graph, output_name, text): class diagrams. classes(graph, node) are the known ones, methods(graph, node, name, visibility, pos, parameters?) their members.

    shown are the edges that are drawn, all by default: the partition is that of edges.
    """
    drawn, nodes = laid_out(members, edges if shown is None else shown, "class", ["relation", "pos"])
    known = classes.select("graph", "node").distinct()
    at_home = nodes.where("reference IS NULL").alias("n").join(known.hint("merge").alias("k"), _same("n", "k", {"node": "node"}), "left").select("n.*", F.col("k.node").isNull().alias("external"))
    nodes = at_home.unionByName(nodes.where("reference IS NOT NULL").withColumn("external", F.lit(True)))
    own = nodes.where("NOT external").select("graph", "node", "output_name").alias("n")
    bodies = methods.alias("m").join(own.hint("merge"), _same("m", "n", {"node": "node"})).select("m.*", "n.output_name")
    return _texts(render.class_diagram(_keyed(nodes), _keyed(drawn), _keyed(bodies)))


def object_bundle(members: DataFrame, edges: DataFrame, objects: DataFrame) -> DataFrame:
    """(graph, output_name, text): object diagrams. objects(graph, scope, name, type_name, fields?, pos): of equal keys the last one is drawn; nodes that none has are external."""
    drawn, nodes = laid_out(members, edges, "object", ["label"])
    columns = ["name", "type_name", *(["fields"] if "fields" in objects.columns else [])]
    last = objects.groupBy("graph", object_key(F.col("scope"), F.col("name")).alias("node")).agg(F.max_by(F.struct(*columns), F.struct("pos", "type_name")).alias("o"))
    rows = nodes.alias("n").join(last.hint("merge").alias("l"), _same("n", "l", {"node": "node"}), "left").select("n.*", "l.o")
    shown = {"name": F.coalesce("o.name", "node"), "type_name": F.coalesce("o.type_name", F.lit("external"))}
    if "fields" in columns:
        none = F.array().cast(objects.schema["fields"].dataType)
        shown["fields"] = F.when(F.col("reference").isNull(), F.coalesce("o.fields", none)).otherwise(none)
    return _texts(render.object_diagram(_keyed(rows.withColumns(shown).drop("o")), _keyed(drawn)))


def package_bundle(members: DataFrame, edges: DataFrame, cyclic: DataFrame, isolated: DataFrame) -> DataFrame:
    """(graph, output_name, text): package flowcharts; a shared package's output also shows the edges between its neighbours.

    cyclic and isolated(graph, node) are marked wherever they are drawn.
    """
    drawn, nodes = laid_out(members, edges, "package", [], neighbours=True)
    marked = lambda which: _keyed(nodes.alias("n").join(which.hint("merge").alias("w"), _same("n", "w", {"node": "node"}), "left_semi").select("graph", "output_name", "node"))
    return _texts(render.package_flowchart(_keyed(nodes), _keyed(drawn), marked(cyclic), marked(isolated)))


def deployment_bundle(members: DataFrame, nodes: DataFrame, connections: DataFrame) -> DataFrame:
    """(graph, output_name, text): deployment flowcharts of a topology's nodes and connections, equal connections once; a shared node's output also shows the connections between its neighbours."""
    edges = connections.withColumnsRenamed({"source": "src", "target": "dst"})
    drawn, shown = laid_out(members, edges, "deployment", ["relation", "confidence"], neighbours=True)
    own = nodes.withColumnRenamed("id", "node")
    boxes = shown.alias("s").join(own.hint("merge").alias("n"), _same("s", "n", {"node": "node"})).select("s.graph", "s.output_name", "s.reference", F.col("s.node").alias("id"), "n.label", "n.kind", "n.confidence", "n.environment", "n.metadata")
    return _texts(render.deployment_flowchart(_keyed(boxes), _keyed(drawn.withColumnsRenamed({"src": "source", "dst": "target"}))))
