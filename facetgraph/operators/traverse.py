"""Traversals of many relation graphs at once: edges(graph, src, dst) and nodes(graph, node).

Each round of an iteration is written to the shared folder and read back, so that plans
stay short and a lost executor costs its own tasks only. Edges with a null end, and nodes
that are null, take no part; a null graph is a graph of its own. Repeated edges count once.

Components, cycles and walks of a graph of `small` rows or fewer are taken in one task that
has many such graphs (walks.py); those of a larger graph by rounds of joins over the cluster.
"""

from __future__ import annotations

import itertools
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetgraph.functions.names import communication_name
from facetgraph.operators import walks
from facetgraph.operators.tasks import FEW, SMALL, by_size, in_tasks
from facetgraph.sources.scratch import Scratch, written


def _same(left: str, right: str, on: dict[str, str]) -> Column:
    """Null-safe on the graph, plain on the other columns."""
    out = F.col(f"{left}.graph").eqNullSafe(F.col(f"{right}.graph"))
    for x, y in on.items():
        out = out & (F.col(f"{left}.{x}") == F.col(f"{right}.{y}"))
    return out


def simple_edges(edges: DataFrame) -> DataFrame:
    return edges.select("graph", "src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def all_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Given nodes and all ends of edges, once each."""
    ends = edges.select("graph", F.explode(F.array("src", "dst")).alias("node"))
    return nodes.select("graph", "node").union(ends).where("node IS NOT NULL").distinct()


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, node, component): the smallest node that a walk in either direction reaches.

    Large-star and small-star rounds: each node hands its neighbours to its smallest
    neighbour until all edges point at a component's smallest node. A round aggregates
    minima before it joins, so that a node of very many neighbours is no single group.
    """
    links = simple_edges(edges).where("src != dst").select("graph", F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    links = written(links, "links")

    def star(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("graph", "a").agg(F.min("b").alias("m"))
        joined = pairs.alias("p").join(least.alias("l"), _same("p", "l", {"a": "a"}))
        return joined.select("p.graph", "p.a", "p.b", F.least("l.m", "p.a").alias("m"))

    def digest(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("graph", "a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    before = digest(links)
    while before[0]:
        both = links.union(links.select("graph", F.col("b").alias("a"), F.col("a").alias("b")))
        large = written(star(both).where("b > a").select("graph", F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        small = star(large).select("graph", F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("graph", "e.a", "e.b")
        links = written(small.where("a != b").distinct(), "small-star")
        after = digest(links)
        if after == before:
            break
        before = after
    named = all_nodes(nodes, edges).alias("n").join(links.alias("l"), _same("n", "l", {"node": "a"}), "left")
    return named.select("n.graph", "n.node", F.coalesce("l.b", "n.node").alias("component"))


def reachable(roots: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(graph, root, node, depth): breadth-first distances from roots(graph, node), the root at 0.

    Only newly met nodes are carried from round to round. With max_depth 0 the roots alone.
    """
    edges = written(simple_edges(edges), "edges")
    frontier = written(roots.select("graph", F.col("node").alias("root"), "node", F.lit(0).alias("depth")).where("node IS NOT NULL").distinct(), "frontier")
    found, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.alias("f").join(edges.alias("e"), _same("f", "e", {"node": "src"})).select("f.graph", "f.root", F.col("e.dst").alias("node"), F.lit(depth).alias("depth")).distinct()
        frontier = written(step.alias("s").join(found.alias("k"), _same("s", "k", {"root": "root", "node": "node"}), "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        found = found.union(frontier)
    return found


def _core_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(graph, node, label): equal labels for nodes that reach each other over links, for all their nodes.

    Colouring: the greatest name flows along edges to a fixed point; a node that kept its
    own name is a root, and whatever reaches it backwards inside its colour is its
    component. Found components leave, the rest goes on.
    """
    todo = scratch.write(all_nodes(links.select("graph", F.col("src").alias("node")).limit(0), links), "todo")
    done = todo.select("graph", "node", F.col("node").alias("label")).limit(0)
    while not todo.isEmpty():
        colour = todo.select("graph", "node", F.col("node").alias("label"))
        active = colour
        while True:
            sent = active.alias("c").join(links.alias("e"), _same("c", "e", {"node": "src"})).select("c.graph", F.col("e.dst").alias("node"), "c.label")
            best = sent.groupBy("graph", "node").agg(F.max("label").alias("sent"))
            merged = colour.alias("c").join(best.alias("b"), _same("c", "b", {"node": "node"}), "left")
            merged = scratch.write(merged.select("c.graph", "c.node", F.greatest("c.label", "b.sent").alias("label"), (F.coalesce("b.sent", "c.label") > F.col("c.label")).alias("moved")), "colour")
            colour, active = merged.drop("moved"), merged.where("moved").drop("moved")
            if active.isEmpty():
                break
        found = frontier = scratch.write(colour.where("node = label"), "component")
        while True:
            back = frontier.alias("f").join(links.alias("e"), _same("f", "e", {"node": "dst"})).select("f.graph", F.col("e.src").alias("node"), "f.label").distinct()
            back = back.alias("b").join(colour.alias("c"), _same("b", "c", {"node": "node", "label": "label"}), "left_semi")
            frontier = scratch.write(back.alias("b").join(found.alias("k"), _same("b", "k", {"node": "node"}), "left_anti"), "component")
            if frontier.isEmpty():
                break
            found = found.union(frontier)
        done = scratch.write(done.union(found), "done")
        todo = scratch.write(todo.alias("n").join(done.alias("k"), _same("n", "k", {"node": "node"}), "left_anti"), "todo")
        links = scratch.write(_between(links, todo), "links")
    return done


def _between(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links whose both ends are among nodes(graph, node)."""
    for end in ("src", "dst"):
        links = links.alias("e").join(nodes.alias("n"), _same("e", "n", {end: "node"}), "left_semi")
    return links


def graph_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, src, dst, edge): edges, and each node as a row of its own that is none."""
    alone = nodes.where("node IS NOT NULL").select("graph", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(False).alias("edge"))
    return alone.union(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("graph", "src", "dst", F.lit(True)))


def graph_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges that graph_rows() were made of."""
    return rows.where("NOT edge").select("graph", F.col("src").alias("node")), rows.where("edge").select("graph", "src", "dst")


def strong_components(nodes: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(graph, node, component, cyclic): the greatest node that reaches and is reached by the node. Cyclic: more than one node, or a self edge."""
    with Scratch(nodes.sparkSession, "graphs") as scratch:
        rows = scratch.write(graph_rows(nodes, edges), "rows")
        here, large = by_size(rows, small, scratch)
        node = rows.schema["src"].dataType
        out = in_tasks(here, [T.StructField("node", node), T.StructField("component", node), T.StructField("cyclic", T.BooleanType())], walks.strong_of)
        if large is not None:
            out = out.union(_strong_large(*graph_tables(large)))
        return written(out, "strong")


def _strong_large(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """strong_components() by joins over the cluster.

    First the graph is made small. In a round, nodes without incoming or outgoing edges
    leave, as components of their own; of the nodes with one of each, those that a hash
    ranks above such neighbours leave too, and their two edges become one. Such a node is
    in its neighbours' component if these are in one, and else alone. So trees and long
    paths are gone after a number of rounds in the logarithm of their length. What is left
    is coloured, in rounds as many as its longest walk between components.
    """
    with Scratch(nodes.sparkSession, "strong") as scratch:
        links = scratch.write(simple_edges(edges).where("src != dst"), "links")
        folded = []
        for turn in itertools.count():
            ends = links.select("graph", F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("after"), F.lit(None).cast(links.schema["src"].dataType).alias("before")), F.struct(F.col("dst").alias("node"), F.lit(None).cast(links.schema["src"].dataType).alias("after"), F.col("src").alias("before")))).alias("e")).select("graph", "e.*")
            marks = ends.groupBy("graph", "node").agg(F.count("before").alias("n_in"), F.count("after").alias("n_out"), F.min("before").alias("before"), F.min("after").alias("after"))
            marks = marks.where("n_in = 0 OR n_out = 0 OR n_in = 1 AND n_out = 1")
            rank = F.struct(F.xxhash64(F.lit(turn), "node"), F.col("node"))
            marks = scratch.write(marks.select("graph", "node", "before", "after", ((F.col("n_in") > 0) & (F.col("n_out") > 0)).alias("chain"), rank.alias("rank")), "marks")
            if marks.isEmpty():
                break
            bare = marks.where("NOT chain").select("graph", "node")
            chain = marks.where("chain").alias("m")
            for end in ("before", "after"):
                near = marks.select("graph", F.col("node").alias("near"), F.col("rank").alias("its_rank"), F.col("chain").alias("its_chain"))
                chain = chain.join(near.alias("n"), _same("m", "n", {end: "near"}), "left").where("its_rank IS NULL OR its_chain AND its_rank < rank").select("m.*").alias("m")
            fold = scratch.write(chain.select("graph", "node", "before", "after"), "fold")
            folded.append(fold)
            gone = bare.union(fold.select("graph", "node"))
            kept = links
            for end in ("src", "dst"):
                kept = kept.alias("e").join(gone.alias("n"), _same("e", "n", {end: "node"}), "left_anti")
            joined = fold.where("before != after").select("graph", F.col("before").alias("src"), F.col("after").alias("dst"))
            last, links = links, scratch.write(kept.union(joined).distinct(), "links")
            scratch.drop(last, marks)
        labels = _core_components(links, scratch)
        for fold in reversed(folded):
            # who was folded in later rounds has its label by now; without one a node is alone
            known = labels.select("graph", F.col("node").alias("near"), "label")
            two = fold.alias("f").join(known.alias("k"), _same("f", "k", {"before": "near"}), "left").select("f.*", F.coalesce("k.label", "f.before").alias("one"))
            two = two.alias("f").join(known.alias("k"), _same("f", "k", {"after": "near"}), "left").select("f.*", F.coalesce("k.label", "f.after").alias("two"))
            same = two.where("one = two")
            labels = scratch.write(labels.union(same.select("graph", "node", F.col("one").alias("label"))).union(same.select("graph", F.col("before").alias("node"), F.col("one").alias("label"))).distinct(), "labels")
        loops = simple_edges(edges).where("src = dst").select("graph", F.col("src").alias("node")).alias("o")
        names = labels.groupBy("graph", "label").agg(F.max("node").alias("component"))
        named = scratch.write(labels.alias("l").join(names.alias("n"), _same("l", "n", {"label": "label"})).select("l.graph", "l.node", "n.component"), "named")
        out = all_nodes(nodes, edges).alias("a").join(named.alias("n"), _same("a", "n", {"node": "node"}), "left").select("a.graph", "a.node", "n.component").alias("a")
        out = out.join(loops, _same("a", "o", {"node": "node"}), "left").select("a.graph", "a.node", "a.component", F.col("o.node").isNotNull().alias("loop"))
        sizes = named.groupBy("graph", "component").agg((F.count("*") > 1).alias("several")).alias("s")
        out = out.alias("a").join(sizes, _same("a", "s", {"component": "component"}), "left")
        return written(out.select("a.graph", "a.node", F.coalesce("a.component", "a.node").alias("component"), (F.coalesce("s.several", F.lit(False)) | F.col("a.loop")).alias("cyclic")), "strong")


def simple_cycles(nodes: DataFrame, edges: DataFrame, max_length: int | None = None, small: int = FEW) -> DataFrame:
    """(graph, cycle): each simple directed cycle once, as an array from its smallest node, closed.

    Their number is exponential in the worst case; max_length bounds the edges of the
    cycles returned. Of a graph of `small` edges or fewer they are given as they are found,
    and none but those under way are held.
    """
    with Scratch(nodes.sparkSession, "cycles") as scratch:
        links = scratch.write(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("graph", "src", "dst", F.lit(True).alias("edge")), "rows")
        here, large = by_size(links, small, scratch)
        out = in_tasks(here, [T.StructField("cycle", T.ArrayType(links.schema["src"].dataType))], partial(walks.cycles_of, max_length=max_length))
        if large is not None:
            out = out.union(_cycles_large(*graph_tables(large), max_length))
        return written(out, "cycles")


def _cycles_large(nodes: DataFrame, edges: DataFrame, max_length: int | None) -> DataFrame:
    """simple_cycles() by joins over the cluster: only edges inside a strong component are walked, and a path never goes below its first node."""
    parts = strong_components(nodes, edges).where("cyclic")
    inside = simple_edges(edges).alias("e").join(parts.alias("p"), _same("e", "p", {"src": "node"})).select("e.graph", "e.src", "e.dst", "p.component").alias("e")
    inside = written(inside.join(parts.alias("q"), _same("e", "q", {"dst": "node", "component": "component"}), "left_semi").select("graph", "src", "dst"), "inside")
    paths = inside.where("src <= dst").select("graph", F.array("src", "dst").alias("cycle"))
    found, length = None, 1
    while True:
        paths = written(paths, "paths")
        closed = paths.where(F.element_at("cycle", 1) == F.element_at("cycle", -1))
        found = closed if found is None else found.union(closed)
        open_paths = paths.where(F.element_at("cycle", 1) != F.element_at("cycle", -1)).withColumn("last", F.element_at("cycle", -1))
        if length == max_length or open_paths.isEmpty():
            return found
        length += 1
        steps = open_paths.alias("p").join(inside.alias("e"), _same("p", "e", {"last": "src"}))
        first = F.element_at("p.cycle", 1)
        free = ~F.array_contains("p.cycle", F.col("e.dst")) & (F.col("e.dst") > first)
        paths = steps.where((F.col("e.dst") == first) | free).select("p.graph", F.concat("p.cycle", F.array("e.dst")).alias("cycle"))


def _sent(level: DataFrame, calls: DataFrame, known: DataFrame, deepest: bool) -> DataFrame:
    """The calls that the walks of a level make at their tips: the level's columns, with k, caller, callee, label, internal, allowed, kind; ord goes on by k."""
    tip = level.withColumn("tip", F.element_at("path", -1)).alias("l")
    sent = tip.join(calls.alias("c"), _same("l", "c", {"tip": "src"})).select("l.graph", "l.root", "l.path", "l.num", F.concat("l.ord", F.array("c.k")).alias("ord"), F.col("l.tip").alias("caller"), F.col("c.dst").alias("callee"), F.col("c.raw").alias("label"))
    sent = sent.alias("s").join(known.alias("k"), _same("s", "k", {"callee": "node"}), "left").select("s.*", F.coalesce("k.internal", F.lit(False)).alias("internal"), F.coalesce("k.allowed", F.lit(False)).alias("allowed"))
    kind = F.when(F.array_contains("path", F.col("callee")), "recursive_call")
    if deepest:
        kind = kind.when(F.col("allowed"), "depth_truncated")
    return sent.withColumn("kind", kind.otherwise("call"))


def _next_level(sent: DataFrame) -> DataFrame:
    return sent.where("kind = 'call' AND allowed AND internal").select("graph", "root", F.concat("path", F.array("callee")).alias("path"), "ord", "num")


def _first_met(start: DataFrame, sent_at, levels: int, key: list[str], scratch: Scratch) -> DataFrame:
    """Of the calls sent_at(level, depth) in the walks from start, the first of each key in its walk's order; later ones are neither kept nor followed.

    A call is first or not by what comes before it in depth-first order, on branches that
    may themselves be left out. So rounds follow all walks level by level, and leave out
    what the round before holds earlier under the same key, and all but the first call of
    a key on one level. Up to its first error a round's result is right, and stays so; so
    the next round is right for one call more at least, and a result that repeats is the
    answer. Most walks repeat no key: they are done after one round, and only walks whose
    result changed go on. A level holds a key of a walk once, whatever its number of paths.
    """
    by = ["graph", "root", *key]
    rest = ["ord", "num", "path", *[c for c in ("caller", "callee", "label", "kind") if c not in key], "internal", "allowed"]
    same_root = lambda x, y: F.col(f"{x}.graph").eqNullSafe(F.col(f"{y}.graph")) & (F.col(f"{x}.root") == F.col(f"{y}.root"))
    siblings = Window.partitionBy("graph", "root", F.slice("ord", 1, F.size("ord") - 1)).orderBy("ord")
    before, least, done, todo = None, None, [], start
    while True:
        level, found = todo, []
        for depth in range(levels):
            sent = sent_at(level, depth)
            if least is not None:
                match = same_root("s", "k")
                for c in key:
                    match = match & F.col(f"s.{c}").eqNullSafe(F.col(f"k.{c}"))
                sent = sent.alias("s").join(least.alias("k"), match, "left").where("k.ord IS NULL OR s.ord <= k.ord").select("s.*")
            first = sent.groupBy(*by).agg(F.min_by(F.struct(*rest), "ord").alias("first"), F.count("*").alias("n")).select(*by, "first.*", "n")
            found.append(scratch.write(first.withColumn("num", F.concat("num", F.array(F.row_number().over(siblings)))).withColumn("depth", F.lit(depth)), "met"))
            level = _next_level(found[-1])
            if level.isEmpty():
                break
        now = found[0]
        for more in found[1:]:
            now = now.union(more)
        now = scratch.write(now, "round")
        if before is None:
            moved = now.groupBy(*by).agg(F.sum("n").alias("n")).where("n > 1")
        else:
            signed = now.select("graph", "root", "ord", F.lit(1).alias("sign")).union(before.select("graph", "root", "ord", F.lit(-1)))
            moved = signed.groupBy("graph", "root", "ord").agg(F.sum("sign").alias("sign")).where("sign != 0")
        moved = scratch.write(moved.select("graph", "root").distinct(), "moved")
        scratch.drop(*found)
        done.append(now.alias("s").join(moved.alias("m"), same_root("s", "m"), "left_anti"))
        if moved.isEmpty():
            break
        before = scratch.write(now.alias("s").join(moved.alias("m"), same_root("s", "m"), "left_semi"), "before")
        least = scratch.write(before.groupBy(*by).agg(F.min("ord").alias("ord")), "least")
        todo = start.alias("s").join(moved.alias("m"), same_root("s", "m"), "left_semi")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def _walk_tables(roots: DataFrame, calls: DataFrame, nodes: DataFrame, allowed: DataFrame | None, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The walks' starts, the numbered calls, and what is known of each node."""
    whole = F.row_number().over(Window.partitionBy("graph", "src").orderBy("pos", "dst", "raw"))
    calls = scratch.write(calls.where("src IS NOT NULL AND dst IS NOT NULL").select("graph", "src", "dst", "raw", whole.alias("k")), "calls")
    inside = nodes.where("node IS NOT NULL").select("graph", "node").distinct()
    permitted = inside if allowed is None else allowed.where("node IS NOT NULL").select("graph", "node").distinct()
    known = inside.select("graph", "node", F.lit(True).alias("internal")).alias("i").join(permitted.select("graph", "node", F.lit(True).alias("allowed")).alias("p"), _same("i", "p", {"node": "node"}), "full")
    known = scratch.write(known.select(F.coalesce("i.graph", "p.graph").alias("graph"), F.coalesce("i.node", "p.node").alias("node"), "internal", "allowed"), "known")
    none = F.array().cast("array<int>")
    return roots.where("node IS NOT NULL").select("graph", "node").distinct().select("graph", F.col("node").alias("root"), F.array("node").alias("path"), none.alias("ord"), none.alias("num")), calls, known


def _walk_rows(roots: DataFrame, calls: DataFrame, nodes: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """(graph, what, node, dst, raw, pos): the tables of a walk in one."""
    given = calls.where("src IS NOT NULL AND dst IS NOT NULL").select("graph", F.lit(walks.CALL).alias("what"), F.col("src").alias("node"), "dst", "raw", "pos")
    for what, rows in ((walks.NODE, nodes), (walks.ALLOWED, nodes if allowed is None else allowed), (walks.ROOT, roots)):
        none = [F.lit(None).cast(given.schema[c].dataType).alias(c) for c in ("dst", "raw", "pos")]
        given = given.union(rows.where("node IS NOT NULL").select("graph", F.lit(what).alias("what"), "node", *none))
    return given


def _walk_parts(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The roots, calls, nodes and allowed nodes that _walk_rows() were made of."""
    ends = [rows.where(F.col("what") == what).select("graph", "node") for what in (walks.ROOT, walks.NODE, walks.ALLOWED)]
    return ends[0], rows.where(F.col("what") == walks.CALL).select("graph", F.col("node").alias("src"), "dst", "raw", "pos"), ends[1], ends[2]


def expand_sequence(roots: DataFrame, calls: DataFrame, nodes: DataFrame, max_depth: int = 8, show_returns: bool = False, allowed: DataFrame | None = None, once: bool = False, small: int = FEW) -> DataFrame:
    """(graph, root, position, number, depth, caller, callee, label, kind): the messages of a depth-first walk from each root.

    calls(graph, src, dst, raw, pos): a callable's calls, each of them, in order. nodes
    (graph, node) are the internal callables; those in allowed, by default all, are
    expanded. A call of a callable on the way to it is a recursive_call and not expanded.
    The calls of a callable at max_depth are not expanded either: to allowed ones they are
    depth_truncated. With returns each other message to an internal callable is answered
    after all that it led to. depth is 0 for the root's own calls; `number` is the
    hierarchical one (1, 1.1, 2) over the calls shown, null for returns.

    With once, a message of a caller, callee, label and kind that the walk has sent before
    is not shown, not expanded and not answered; returns never count as repeats. Then a
    walk is linear in the calls it can reach. Without it the number of messages is
    exponential in the depth in the worst case.
    """
    if max_depth < 0:
        raise ValueError("max_depth must be at least 0")
    return numbered_messages(roots, calls, nodes, max_depth, show_returns, allowed, once, small=small).drop("caller_at", "callee_at", "met")


def numbered_messages(roots: DataFrame, calls: DataFrame, nodes: DataFrame, max_depth: int = 8, show_returns: bool = False, allowed: DataFrame | None = None, once: bool = False, owners: bool = False, small: int = FEW) -> DataFrame:
    """expand_sequence() with caller_at and callee_at, their positions among participants(), and whether the callee is `met` there first.

    With owners the positions are those of the callables without their last segment.
    """
    if max_depth < 0:
        raise ValueError("max_depth must be at least 0")
    with Scratch(nodes.sparkSession, "walks") as scratch:
        rows = scratch.write(_walk_rows(roots, calls, nodes, allowed), "rows")
        here, large = by_size(rows, small, scratch)
        node, label, count = rows.schema["node"].dataType, T.StringType(), T.IntegerType()
        fields = {"root": node, "position": count, "number": label, "depth": count, "caller": node, "callee": node, "label": label, "kind": label, "caller_at": count, "callee_at": count, "met": T.BooleanType()}
        out = in_tasks(here, [T.StructField(*f) for f in fields.items()], partial(walks.messages_of, max_depth=max_depth, show_returns=show_returns, once=once, owners=owners))
        if large is not None:
            out = out.union(_numbered(_expand_large(*_walk_parts(large), max_depth, show_returns, once), owners).select(out.columns))
        return written(out, "sequence")


def _numbered(messages: DataFrame, owners: bool) -> DataFrame:
    """The columns that numbered_messages() adds, by joins."""
    named = (lambda c: communication_name(F.col(c))) if owners else F.col
    people = participants(messages).groupBy("graph", "root", named("node").alias("node")).agg(F.min("position").alias("at"))
    people = people.withColumn("at", F.row_number().over(Window.partitionBy("graph", "root").orderBy("at")))
    rows = messages.withColumns({"__caller": named("caller"), "__callee": named("callee")}).alias("m")
    for end in ("caller", "callee"):
        on = _same("m", "p", {"root": "root", f"__{end}": "node"})
        rows = rows.join(people.alias("p"), on).select("m.*", F.col("p.at").alias(f"{end}_at")).alias("m")
    first = F.min("position").over(Window.partitionBy("graph", "root", "callee_at"))
    return rows.withColumn("met", (F.col("callee_at") > 1) & (F.col("position") == first))


def _expand_large(roots: DataFrame, calls: DataFrame, nodes: DataFrame, allowed: DataFrame, max_depth: int, show_returns: bool, once: bool) -> DataFrame:
    """expand_sequence() by joins over the cluster, a level of all walks at a time."""
    with Scratch(nodes.sparkSession, "sequence") as scratch:
        start, calls, known = _walk_tables(roots, calls, nodes, allowed, scratch)
        truncated = F.concat(F.lit("Further calls omitted: "), "label")

        def sent_at(level: DataFrame, depth: int) -> DataFrame:
            sent = _sent(level, calls, known, depth == max_depth)
            return sent.withColumn("label", F.when(F.col("kind") == "depth_truncated", truncated).otherwise(F.col("label")))

        if once:
            sent = _first_met(start, sent_at, max_depth + 1, ["caller", "callee", "label", "kind"], scratch)
        else:
            sent, level = None, start
            for depth in range(max_depth + 1):
                rows = scratch.write(sent_at(level, depth).withColumn("depth", F.lit(depth)).withColumn("num", F.col("ord")), "messages")
                sent = rows if sent is None else sent.union(rows)
                level = _next_level(rows)
                if level.isEmpty():
                    break
        number = F.array_join(F.col("num").cast("array<string>"), ".")
        out = sent.select("graph", "root", "ord", number.alias("number"), "depth", "caller", "callee", "label", "kind")
        if show_returns:
            answered = sent.where("internal AND kind != 'depth_truncated'")
            out = out.union(answered.select("graph", "root", F.concat("ord", F.array(F.lit(2**31 - 1))), F.lit(None).cast("string"), "depth", F.col("callee"), F.col("caller"), F.lit("return"), F.lit("return")))
        position = F.row_number().over(Window.partitionBy("graph", "root").orderBy("ord"))
        return written(out.select("graph", "root", position.alias("position"), "number", "depth", "caller", "callee", "label", "kind"), "sequence")


def continuations(roots: DataFrame, calls: DataFrame, nodes: DataFrame, max_depth: int = 8, allowed: DataFrame | None = None, once: bool = False, small: int = FEW) -> DataFrame:
    """(graph, node, turn): the roots of further diagrams, until each call left out for depth is in one.

    A callable whose call was left out, which has calls and no diagram yet, is the root of
    a next one, which may leave out calls in its turn. turn counts from 1; the given roots
    are not returned. Turns are at most as many as the calls on the longest way, by max_depth.
    """
    with Scratch(nodes.sparkSession, "walks") as scratch:
        rows = scratch.write(_walk_rows(roots, calls, nodes, allowed), "rows")
        here, large = by_size(rows, small, scratch)
        out = in_tasks(here, [T.StructField("node", rows.schema["node"].dataType), T.StructField("turn", T.IntegerType())], partial(walks.continuations_of, max_depth=max_depth, once=once))
        if large is not None:
            out = out.union(_continuations_large(*_walk_parts(large), max_depth, once))
        return written(out, "continuations")


def _continuations_large(roots: DataFrame, calls: DataFrame, nodes: DataFrame, allowed: DataFrame, max_depth: int, once: bool) -> DataFrame:
    """continuations() by joins over the cluster, a turn of walks at a time."""
    with Scratch(nodes.sparkSession, "continuations") as scratch:
        calling = calls.where("dst IS NOT NULL").select("graph", F.col("src").alias("node")).alias("c").join(nodes.select("graph", "node").alias("n"), _same("c", "n", {"node": "node"}), "left_semi").distinct()
        calling = scratch.write(calling, "calling")
        frontier = scratch.write(roots.where("node IS NOT NULL").select("graph", "node").distinct(), "roots")
        seen = scratch.write(frontier.withColumn("turn", F.lit(0)), "seen")
        turn = 0
        while not frontier.isEmpty():
            turn += 1
            cut = _expand_large(frontier, calls, nodes, allowed, max_depth, False, once).where("kind = 'depth_truncated'").select("graph", F.col("callee").alias("node")).distinct()
            for other, how in ((calling, "left_semi"), (seen, "left_anti")):
                cut = cut.alias("t").join(other.alias("o"), _same("t", "o", {"node": "node"}), how)
            frontier = scratch.write(cut, "frontier")
            last, seen = seen, scratch.write(seen.union(frontier.withColumn("turn", F.lit(turn))), "seen")
            scratch.drop(last)
        return written(seen.where("turn > 0"), "continuations")


def participants(messages: DataFrame) -> DataFrame:
    """(graph, root, node, position): a diagram's root first, then callables as they first appear in its messages."""
    if "met" in messages.columns:
        first = messages.where("position = 1").select("graph", "root", F.col("root").alias("node"), F.col("caller_at").alias("position"))
        return first.union(messages.where("met").select("graph", "root", "callee", "callee_at"))
    ends = messages.select("graph", "root", F.posexplode(F.array("root", "caller", "callee")).alias("end", "node"), "position")
    first = ends.groupBy("graph", "root", "node").agg(F.min(F.when(F.col("end") == 0, F.struct(F.lit(0).alias("position"), F.lit(0).alias("end"))).otherwise(F.struct("position", "end"))).alias("at"))
    return first.select("graph", "root", "node", F.row_number().over(Window.partitionBy("graph", "root").orderBy("at")).alias("position"))


def bounded_chain(roots: DataFrame, edges: DataFrame, max_depth: int = 5, small: int = SMALL) -> DataFrame:
    """(graph, root, position, node, depth): the callables that a depth-first walk from a root meets, in its order, without the root.

    edges(graph, src, dst, pos), walked by pos and dst. The walk enters no node twice and
    none at over max_depth steps (depth, from 1); a node first met at the bound leads no
    further, even if a later way to it is shorter.
    """
    if max_depth < 0:
        raise ValueError("max_depth must be at least 0")
    with Scratch(edges.sparkSession, "walks") as scratch:
        rows = scratch.write(_chain_rows(roots, edges), "rows")
        here, large = by_size(rows, small, scratch)
        node, count = rows.schema["node"].dataType, T.IntegerType()
        fields = {"root": node, "position": count, "node": node, "depth": count}
        out = in_tasks(here, [T.StructField(*f) for f in fields.items()], partial(walks.chains_of, max_depth=max_depth))
        if large is not None:
            starts, calls, _, _ = _walk_parts(large)
            out = out.union(_chain_large(starts, calls.select("graph", "src", "dst", "pos"), max_depth))
        return written(out, "chain")


def _chain_rows(roots: DataFrame, edges: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string").alias("raw")
    calls = edges.where("src != dst").select("graph", F.lit(walks.CALL).alias("what"), F.col("src").alias("node"), "dst", none, "pos")
    starts = roots.where("node IS NOT NULL").select("graph", F.lit(walks.ROOT).alias("what"), "node", F.lit(None).cast(calls.schema["dst"].dataType), none, F.lit(None).cast(calls.schema["pos"].dataType))
    return calls.union(starts)


def _chain_large(roots: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """bounded_chain() by joins over the cluster."""
    with Scratch(edges.sparkSession, "chain") as scratch:
        calls = edges.where("src != dst").select("graph", "src", "dst", F.col("dst").alias("raw"), "pos")
        start, calls, known = _walk_tables(roots, calls, all_nodes(roots, edges), None, scratch)
        met = _first_met(start, lambda level, _: _sent(level, calls, known, False).where("kind = 'call'"), max(max_depth, 1), ["callee"], scratch)
        position = F.row_number().over(Window.partitionBy("graph", "root").orderBy("ord"))
        rows = met.where(F.lit(max_depth > 0)).select("graph", "root", position.alias("position"), F.col("callee").alias("node"), (F.col("depth") + 1).alias("depth"))
        return written(rows, "chain")


def cycle_edges(cycles: DataFrame) -> DataFrame:
    """(graph, src, dst): the distinct edges of cycles(graph, cycle), which are closed arrays."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("cycle") - 1), lambda i: F.struct(F.element_at("cycle", i).alias("src"), F.element_at("cycle", i + 1).alias("dst")))
    return cycles.select("graph", F.explode(pairs).alias("e")).select("graph", "e.src", "e.dst").distinct()
