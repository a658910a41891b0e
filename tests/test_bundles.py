"""Bundles of diagrams against plain versions on random graphs."""

import hashlib
import re

from facetgraph.operators import bundles, partition
from tests.test_partition import frames, plain_partition, random_graphs, reach


def name(prefix, node, fallback):
    return f"{prefix}_{hashlib.sha256(node.encode()).hexdigest()[:10]}_{re.sub('[^A-Za-z0-9_-]+', '_', node).strip('_-') or fallback}"


def plain_outputs(nodes, edges, fallback):
    """For each output its own nodes, its edges in order, its stubs with the outputs where they go on, and whether it is a shared node's."""
    places = plain_partition(nodes, edges, 3, 3)
    home = {n: name("shared", n, fallback) if s is None else name(f"series_{number}", s, fallback) for n, (s, _, _, number) in places.items()}
    out = {}
    for output in set(home.values()):
        own = {n for n in home if home[n] == output}
        shared = output.startswith("shared_")
        drawn = [e for e in edges if e[0] in own or shared and e[1] in own]
        out[output] = own, drawn, {n: home[n] for e in drawn for n in e if home[n] != output}, shared
    return out


def test_bundles_equal_plain_versions(spark):
    graphs = random_graphs(14)
    graphs["alone"] = (["only"], [])
    graphs["hub"] = ([], [("a", "hub"), ("b", "hub"), ("c", "hub"), ("a", "b"), ("hub", "z"), ("y", "z"), ("x", "z")])
    nodes, edges = frames(spark, graphs)
    rows = [(g, a, b, i, "inheritance" if i % 3 else "uses") for g, (_, es) in graphs.items() for i, (a, b) in enumerate(es)]
    placed = spark.createDataFrame(rows, "graph string, src string, dst string, pos long, relation string")
    members = partition.partition(nodes, edges)
    one = lambda n: "n_" + re.sub("[^0-9A-Za-z_]", "_", n)
    hashed = lambda n: "c_" + hashlib.sha1(n.encode()).hexdigest()[:10]
    texts, classes, packages = {}, {}, {}
    for g, (ns, es) in graphs.items():
        for output, (own, drawn, stubs, _) in plain_outputs(ns, es, "call_graph").items():
            lines = [f'    {one(n)}["{n}{"<br/>続き: " + stubs[n] if n in stubs else ""}"]' for n in sorted({*own, *stubs})]
            texts[g, output] = "\n".join(["flowchart LR", *lines, *[f"    {one(a)} --> {one(b)}" for a, b in drawn]]) + "\n"
        for output, (own, drawn, stubs, shared) in plain_outputs(ns, es, "class").items():
            lines = []
            for n in sorted({*own, *stubs}) if shared else [*sorted(own), *sorted(stubs)]:
                lines.append(f'    class {hashed(n)}["{n}{"<br/>続き: " + stubs[n] if n in stubs else ""}"]')
                if n in stubs:
                    lines.append(f"    class {hashed(n)} <<external>>")
                elif n == "n03":
                    lines[-1] += " {\n        +run()\n    }"
            for i, (a, b) in enumerate(es):
                if (a, b) in drawn:
                    lines.append(f"    {hashed(b)} <|-- {hashed(a)}" if i % 3 else f"    {hashed(a)} --> {hashed(b)} : uses")
            classes[g, output] = "\n".join(["classDiagram", "direction LR", *lines]) + "\n"
        looped = {n for n in {x for e in es for x in e} if any(n in reach(b, es) for a, b in es if a == n)}
        for output, (own, drawn, stubs, shared) in plain_outputs(ns, es, "package").items():
            inside = {*own, *stubs}
            shown = sorted({e for e in es if e in drawn or shared and set(e) <= inside})
            box = lambda n: f'(["{n}<br/>続き: {stubs[n]}"])' if n in stubs else f'["{n}"]'  # noqa: B023, E731
            lines = [f"    pkg_{n}{box(n)}" for n in sorted(inside)] + [f"    pkg_{a} --> pkg_{b}" for a, b in shown]
            if looped & inside:
                lines.append("    classDef cycle stroke-width:3px\n    class " + ",".join(f"pkg_{n}" for n in sorted(looped & inside)) + " cycle")
            packages[g, output] = "\n".join(["flowchart LR", *lines]) + "\n"
    got = lambda df: {(r.graph, r.output_name): r.text for r in df.collect()}
    assert got(bundles.call_graph_bundle(members, placed)) == texts
    known = members.select("graph", "node")
    methods = known.where("node = 'n03'").selectExpr("graph", "node", "'run' AS name", "'public' AS visibility", "1L AS pos")
    assert got(bundles.class_bundle(members, placed, known, methods)) == classes
    cyclic = spark.createDataFrame([(g, n) for g, (_, es) in graphs.items() for n in {x for e in es for x in e} if any(n in reach(b, es) for a, b in es if a == n)], "graph string, node string")
    assert got(bundles.package_bundle(members, placed.select("graph", "src", "dst").distinct(), cyclic, cyclic.limit(0))) == packages
    assert any(t.count("続き") for t in texts.values()) and any(k[1].startswith("shared_") for k in texts)
    names = {(r.graph, r.output_name) for r in bundles.placements(members, partition.output_names(members, "call_graph")).collect()}
    assert names == set(texts)


def test_objects_of_a_series_show_their_last_value(spark):
    objects = spark.createDataFrame([("g", None, "a", "A", [("x", "1")], 1), ("g", None, "a", "B", [("x", "2")], 2), ("g", "f", "b", "C", [], 3)], "graph string, scope string, name string, type_name string, fields array<struct<name:string,value:string>>, pos long")
    nodes = spark.createDataFrame([("g", "<module>:a"), ("g", "f:b")], "graph string, node string")
    edges = spark.createDataFrame([("g", "<module>:a", "f:b", "uses"), ("g", "f:b", "g:lost", "k")], "graph string, src string, dst string, label string")
    rows = bundles.object_bundle(partition.partition(nodes, edges.select("graph", "src", "dst")), edges, objects).collect()
    assert len(rows) == 1 and rows[0].text == 'flowchart LR\n    o0["a : B<br/>x = 2"]\n    o1["b : C"]\n    o2["g:lost : external"]\n    o0 -->|uses| o1\n    o1 -->|k| o2\n'
    assert rows[0].output_name == name("series_1", "<module>:a", "object")
