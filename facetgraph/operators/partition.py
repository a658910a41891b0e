"""Partition of relation graphs into series: edges(graph, src, dst), repeated edges counting each, and nodes(graph, node).

Shared nodes are cut out, what hangs together without them is a component, and branches
of a component that one single edge enters become series of their own, within one
another.

A graph of SMALL rows or fewer is partitioned where it lies, in a task that takes many such
graphs one after the other (series.py); a larger one by rounds of joins over the cluster.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetgraph.functions.names import stable_output_name
from facetgraph.operators.series import series_of
from facetgraph.operators.tasks import SMALL, by_size, in_tasks
from facetgraph.operators.traverse import _between, _same, all_nodes, graph_rows, graph_tables, reachable, simple_edges, strong_components, weak_components
from facetgraph.sources.scratch import Scratch, written


def _greedy(branches: DataFrame, inside: DataFrame, scratch: Scratch) -> DataFrame:
    """Branches(graph, head, rank) taken by rising rank, each unless it overlaps one taken before.

    Two branches overlap where one is inside the other: inside(graph, outer, inner). A
    round takes all that no open one of lower rank overlaps; where ranks follow the
    nesting, one round and its check do.
    """
    pairs = inside.union(inside.select("graph", "inner", "outer")).toDF("graph", "one", "two")
    left, taken = branches, None
    while True:
        of = pairs.alias("p").join(left.alias("a"), _same("p", "a", {"one": "head"})).select("p.graph", "p.one", "p.two", F.col("a.rank").alias("rank_one"))
        open_pairs = of.alias("p").join(left.alias("b"), _same("p", "b", {"two": "head"})).select("p.graph", "p.one", "p.two", "p.rank_one", F.col("b.rank").alias("rank_two"))
        blocked = open_pairs.where("rank_one > rank_two").select("graph", F.col("one").alias("head")).distinct()
        chosen = scratch.write(left.alias("b").join(blocked.alias("x"), _same("b", "x", {"head": "head"}), "left_anti"), "chosen")
        taken = chosen if taken is None else scratch.write(taken.union(chosen), "taken")
        touched = pairs.alias("p").join(chosen.alias("c"), _same("p", "c", {"one": "head"}), "left_semi").select("graph", F.col("two").alias("head")).union(chosen.select("graph", "head"))
        left = scratch.write(left.alias("b").join(touched.alias("t"), _same("b", "t", {"head": "head"}), "left_anti"), "left")
        if left.isEmpty():
            return taken


def partition(nodes: DataFrame, edges: DataFrame, fan_in_threshold: int = 3, min_child: int = 3, small: int = SMALL) -> DataFrame:
    """(graph, node, shared, series, depth, parent, number): a node's series, named by its root; the last four null for a shared node.

    A node with fan_in_threshold distinct callers or more is shared, unless it is on a
    cycle. Weak components of the others are rooted at their smallest node without
    callers, else at their smallest. A branch is what a node reaches, if it has min_child
    nodes or more but not all, no cycle, and one single edge enters it, from a node with
    two callees or more. Branches are nested or apart. They are taken by their parent's
    distance from the root (unreached ones last), parent and head, unless they overlap one
    taken before; inside a branch that was taken, the branches within it are taken too.
    A node belongs to the innermost branch; depth counts the branches around it; parent is
    the root of the series around its own. Series are numbered from 1 in a graph:
    components by their smallest node, in each a series before those within it, and these
    in the order in which they are taken.
    """
    if fan_in_threshold < 1:
        raise ValueError("fan-in threshold must be at least 1")
    if min_child < 2:
        raise ValueError("minimum child series size must be at least 2")
    with Scratch(nodes.sparkSession, "graphs") as scratch:
        rows = scratch.write(graph_rows(nodes, edges), "rows")
        here, large = by_size(rows, small, scratch)
        node, count = rows.schema["src"].dataType, T.IntegerType()
        fields = {"node": node, "shared": T.BooleanType(), "series": node, "depth": count, "parent": node, "number": count}
        out = in_tasks(here, [T.StructField(*f) for f in fields.items()], partial(_series_rows, fan_in_threshold=fan_in_threshold, min_child=min_child))
        if large is not None:
            out = out.union(_partition_large(*graph_tables(large), fan_in_threshold, min_child))
        return written(out, "partition")


def _series_rows(rows: list[tuple], fan_in_threshold: int, min_child: int) -> list[tuple]:
    """Rows (src, dst, edge) of one graph to those of partition()."""
    nodes, edges = set(), []
    for src, dst, edge in rows:
        nodes.update((src, dst))
        if edge:
            edges.append((src, dst))
    return series_of(nodes, edges, fan_in_threshold, min_child)


def _partition_large(nodes: DataFrame, edges: DataFrame, fan_in_threshold: int, min_child: int) -> DataFrame:
    """partition() by joins and sums over the cluster.

    The pairs of a branch's head and its nodes are formed, for heads with one entering
    edge only: in the longest chain of branches they are quadratic in its length.
    """
    with Scratch(nodes.sparkSession, "partition") as scratch:
        edges = scratch.write(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("graph", "src", "dst"), "edges")
        fan_in = simple_edges(edges).groupBy("graph", F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))
        marked = strong_components(nodes, edges).alias("p").join(fan_in.alias("f"), _same("p", "f", {"node": "node"}), "left")
        marked = scratch.write(marked.select("p.graph", "p.node", "p.cyclic", (~F.col("p.cyclic") & (F.coalesce("f.fan_in", F.lit(0)) >= fan_in_threshold)).alias("shared")), "marked")
        regular = marked.where("NOT shared").select("graph", "node", "cyclic")
        links = scratch.write(_between(edges, regular), "regular-edges")
        ends = links.select("graph", F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("to"), F.lit(None).cast(links.schema["src"].dataType).alias("from")), F.struct(F.col("dst").alias("node"), F.lit(None).cast(links.schema["src"].dataType).alias("to"), F.col("src").alias("from")))).alias("e")).select("graph", "e.*")
        degrees = ends.groupBy("graph", "node").agg(F.count("from").alias("n_in"), F.count("to").alias("n_out"), F.countDistinct("to").alias("fan_out"), F.min("from").alias("from"))
        facts = weak_components(regular, links).alias("c").join(degrees.alias("d"), _same("c", "d", {"node": "node"}), "left").join(regular.alias("r"), _same("c", "r", {"node": "node"}))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c.split(".")[1])
        facts = scratch.write(facts.select("c.graph", "c.node", "c.component", zero("d.n_in"), zero("d.n_out"), zero("d.fan_out"), "d.from", "r.cyclic"), "facts")
        roots = facts.groupBy("graph", "component").agg(F.coalesce(F.min(F.when(F.col("n_in") == 0, F.col("node"))), F.min("node")).alias("root"), F.count("*").alias("nodes"))
        roots = scratch.write(roots, "roots")

        heads = facts.where("n_in = 1 AND NOT cyclic").alias("h").join(facts.select("graph", "node", "fan_out").alias("p"), _same("h", "p", {"from": "node"})).where("p.fan_out >= 2")
        heads = scratch.write(heads.select("h.graph", "h.node", "h.component", F.col("h.from").alias("parent")), "heads")
        reached = reachable(heads, links).select("graph", F.col("root").alias("head"), "node", "depth")
        reach = reached.drop("depth")
        within = reach.alias("b").join(facts.alias("f"), _same("b", "f", {"node": "node"})).select("b.graph", "b.head", "f.n_in", "f.n_out", "f.cyclic")
        # all edges that leave a node of the branch stay in it: the others are those that enter it
        closed = within.groupBy("graph", "head").agg(F.count("*").alias("nodes"), (F.sum("n_in") - F.sum("n_out")).alias("entering"), F.max("cyclic").alias("cyclic"))
        closed = closed.where(f"entering = 1 AND NOT cyclic AND nodes >= {int(min_child)}").alias("b")
        closed = closed.join(heads.alias("h"), _same("b", "h", {"head": "node"})).select("b.graph", "b.head", "b.nodes", "h.parent", "h.component").alias("b")
        closed = closed.join(roots.alias("r"), _same("b", "r", {"component": "component"})).where("b.nodes < r.nodes")
        closed = scratch.write(closed.select("b.graph", "b.head", "b.nodes", "b.parent", F.col("r.root").alias("root"), F.col("r.nodes").alias("all_nodes")), "closed")
        tops = roots.alias("r").join(closed.select("graph", "root").distinct().alias("c"), _same("r", "c", {"root": "root"}), "left_semi").select("graph", F.col("root").alias("node"))
        distance = reachable(tops, links).select("graph", "root", F.col("node").alias("parent"), "depth")
        branches = closed.alias("b").join(distance.alias("d"), _same("b", "d", {"root": "root", "parent": "parent"}), "left")
        branches = branches.select("b.graph", "b.head", "b.nodes", F.struct(F.coalesce("d.depth", F.col("b.all_nodes") + 1).alias("distance"), "b.parent", "b.head").alias("rank"))
        branches = scratch.write(branches, "branches")
        held = reach.alias("n").join(branches.alias("b"), _same("n", "b", {"head": "head"})).select("n.graph", "n.head", "n.node", "b.nodes")
        held = scratch.write(held, "held")
        inside = held.where("head != node").alias("o").join(branches.select("graph", "head").alias("i"), _same("o", "i", {"node": "head"}), "left_semi").select("graph", F.col("head").alias("outer"), F.col("node").alias("inner"))
        inside = scratch.write(inside, "inside")
        taken = _greedy(branches.select("graph", "head", "rank"), inside, scratch).select("graph", "head")
        within = inside.alias("i").join(taken.alias("t"), _same("i", "t", {"outer": "head"}), "left_semi").select("graph", F.col("inner").alias("head"))
        active = scratch.write(taken.union(within).distinct(), "active")

        held = held.alias("n").join(active.alias("a"), _same("n", "a", {"head": "head"}), "left_semi")
        own = scratch.write(held.groupBy("graph", "node").agg(F.array_sort(F.collect_list(F.struct("nodes", "head"))).alias("around")), "own")
        placed = facts.alias("f").join(own.alias("o"), _same("f", "o", {"node": "node"}), "left").join(roots.alias("r"), _same("f", "r", {"component": "component"}))
        at = lambda i: F.get("o.around", F.lit(i))["head"]
        depth = F.coalesce(F.size("o.around"), F.lit(0))
        placed = placed.select("f.graph", "f.node", "f.component", F.coalesce(at(0), "r.root").alias("series"), F.greatest(depth, F.lit(0)).alias("depth"), F.when(depth > 0, F.coalesce(at(1), "r.root")).alias("parent"), at(1).alias("outer"))
        placed = scratch.write(placed, "placed")

        # where a series stands among its siblings: by its parent node's distance from the head around it, or from the root
        heads = placed.where("depth > 0 AND node = series").select("graph", "component", "series", "depth", "parent", "outer").alias("s")
        heads = heads.join(branches.alias("b"), _same("s", "b", {"series": "head"})).select("s.*", "b.rank").alias("s")
        steps = reached.alias("d")
        heads = heads.join(steps, (F.col("s.graph").eqNullSafe(F.col("d.graph"))) & (F.col("s.outer") == F.col("d.head")) & (F.col("s.rank.parent") == F.col("d.node")), "left")
        place = F.struct(F.coalesce("d.depth", "s.rank.distance").cast("long").alias("distance"), F.col("s.rank.parent").alias("parent"), F.col("s.series").alias("head"))
        heads = scratch.write(heads.select("s.graph", "s.component", "s.series", "s.depth", "s.parent", place.alias("place")), "heads-placed")
        level = roots.select("graph", "component", F.col("root").alias("series"), F.lit(0).alias("depth"), F.array().cast(T.ArrayType(heads.schema["place"].dataType)).alias("way"))
        ways, deep = level, 0
        while True:
            deep += 1
            level = heads.where(F.col("depth") == deep).alias("s").join(level.alias("p"), _same("s", "p", {"component": "component", "parent": "series"})).select("s.graph", "s.component", "s.series", "s.depth", F.concat("p.way", F.array("s.place")).alias("way"))
            level = scratch.write(level, "level")
            if level.isEmpty():
                break
            ways = ways.union(level)
        number = F.row_number().over(Window.partitionBy("graph").orderBy("component", "way")).alias("number")
        # the depth tells a branch from the part around it, if that is named by the same node
        numbers = ways.select("graph", "component", "series", "depth", number)
        placed = placed.alias("p").join(numbers.alias("n"), _same("p", "n", {"component": "component", "series": "series", "depth": "depth"})).select("p.*", "n.number")
        out = marked.alias("m").join(placed.alias("p"), _same("m", "p", {"node": "node"}), "left")
        return written(out.select("m.graph", "m.node", "m.shared", "p.series", "p.depth", "p.parent", "p.number"), "partition-large")


def placed_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with src_series, dst_series, src_shared and dst_shared; members as partition() gives them."""
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    for end in ("src", "dst"):
        edges = edges.alias("e").join(members.hint("merge").alias("m"), _same("e", "m", {end: "node"})).select("e.*", F.col("m.series").alias(f"{end}_series"), F.col("m.shared").alias(f"{end}_shared"))
    return edges


def boundary_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges, repeated ones too, that leave a series or touch a shared node, with both ends' places."""
    return placed_edges(members, edges).where("src_shared OR dst_shared OR src_series != dst_series")


def partition_statistics(members: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a graph: nodes, edges, series, the largest and the mean series, the deepest one, shared nodes and edges between series.

    Ratios of nothing are 0. Graphs are those of members.
    """
    sizes = members.groupBy("graph", "series").agg(F.count("*").alias("n"), F.max("depth").alias("depth"))
    regular = F.col("series").isNotNull()
    shared = F.coalesce(F.sum(F.when(~regular, F.col("n"))), F.lit(0))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    by_node = sizes.groupBy("graph").agg(
        F.sum("n").alias("node_count"),
        F.count_if(regular).alias("series_count"),
        F.coalesce(F.max(F.when(regular, F.col("n"))), F.lit(0)).alias("max_nodes_per_series"),
        F.coalesce(F.avg(F.when(regular, F.col("n"))), F.lit(0.0)).alias("avg_nodes_per_series"),
        F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("max_partition_depth"),
        shared.alias("shared_node_count"),
        share(shared, F.sum("n")).alias("shared_node_ratio"),
    )
    both = ~F.col("src_shared") & ~F.col("dst_shared")
    cross = F.count_if(both & (F.col("src_series") != F.col("dst_series")))
    by_edge = placed_edges(members, edges).groupBy("graph").agg(F.count("*").alias("edge_count"), F.count_if(both).alias("regular_edge_count"), cross.alias("cross_series_edge_count"), share(cross, F.count_if(both)).alias("cross_series_edge_ratio"))
    out = by_node.alias("n").join(by_edge.alias("e"), F.col("n.graph").eqNullSafe(F.col("e.graph")), "left")
    counts = [F.coalesce(f"e.{c}", F.lit(0)).alias(c) for c in ("edge_count", "regular_edge_count", "cross_series_edge_count")]
    return out.select("n.*", *counts, F.coalesce("e.cross_series_edge_ratio", F.lit(0.0)).alias("cross_series_edge_ratio"))


def degree_distributions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, fan_in, fan_out): the nodes' distinct callers and callees as sorted arrays, one row a graph."""
    links = simple_edges(edges)
    ends = links.select("graph", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("graph", "e.*")
    alone = all_nodes(nodes, edges).select("graph", "node", F.lit(0).alias("i"), F.lit(0).alias("o"))
    sums = ends.union(alone).groupBy("graph", "node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return sums.groupBy("graph").agg(F.sort_array(F.collect_list("i")).alias("fan_in"), F.sort_array(F.collect_list("o")).alias("fan_out"))


def output_names(members: DataFrame, fallback: str = "graph") -> DataFrame:
    """(graph, node, output_name): the output that draws a node: its series', by its number and root, or its own if it is shared."""
    return members.select("graph", "node", output_name(fallback).alias("output_name"))


def output_name(fallback: str = "graph") -> Column:
    """A member's output."""
    own = stable_output_name("shared", F.col("node"), fallback)
    series = stable_output_name(F.concat(F.lit("series_"), F.col("number").cast("string")), F.col("series"), fallback)
    return F.when(F.col("shared"), own).otherwise(series)


def references(boundary: DataFrame, outputs: DataFrame) -> DataFrame:
    """(graph, output_name, node, reference): for each output, the nodes beyond its boundary and the outputs that go on with them.

    Each of boundary_edges() counts for both its ends; a node is named once in an output.
    """
    ends = boundary.select("graph", F.explode(F.array(F.struct(F.col("src").alias("near"), F.col("dst").alias("node")), F.struct(F.col("dst").alias("near"), F.col("src").alias("node")))).alias("pair")).select("graph", "pair.*")
    named = ends.alias("e").join(outputs.alias("a"), _same("e", "a", {"near": "node"})).select("e.graph", "e.node", "a.output_name")
    return named.alias("e").join(outputs.alias("b"), _same("e", "b", {"node": "node"})).select("e.graph", "e.output_name", "e.node", F.col("b.output_name").alias("reference")).distinct()
