"""Partitions and strong components against known answers and plain versions."""

import itertools
import random
import time

import pytest

from facetgraph.operators import partition, series, traverse

EDGES, NODES = "graph string, src string, dst string", "graph string, node string"
# Known answers: edges, fan-in threshold, smallest child, then (node, series, depth, parent), series None for shared nodes.
KNOWN = {
    "chain": (["ab", "bc", "cd"], 4, 3, {n: ("a", 0, None) for n in "abcd"}),
    "branches": (["AB", "AX", "BC", "BD", "CE", "CF"], 4, 3, {"A": ("A", 0, None), "X": ("A", 0, None), "B": ("B", 1, "A"), "D": ("B", 1, "A"), **{n: ("C", 2, "B") for n in "CEF"}}),
    "entered twice": (["AB", "AX", "BC", "BD", "XC"], 4, 3, {n: ("A", 0, None) for n in "ABCDX"}),
    "shared": (["fs", "gs", "sz"], 2, 3, {"f": ("f", 0, None), "g": ("g", 0, None), "z": ("z", 0, None), "s": (None, None, None)}),
    "cycle": (["AB", "AX", "BC", "CB"], 4, 3, {n: ("A", 0, None) for n in "ABCX"}),
}


def frames(spark, graphs):
    """Nodes and edges of {graph: (nodes, edges)}."""
    nodes = [(g, n) for g, (ns, _) in graphs.items() for n in ns]
    edges = [(g, a, b) for g, (_, es) in graphs.items() for a, b in es]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def reach(start, edges):
    found, todo = set(), [start]
    while todo:
        n = todo.pop()
        if n not in found:
            found.add(n)
            todo += [b for a, b in edges if a == n]
    return found


def plain_partition(nodes, edges, fan_in, least):
    nodes = set(nodes) | {n for e in edges for n in e}
    cyclic = {n for n in nodes if any(n in reach(b, edges) for a, b in edges if a == n)}
    shared = {n for n in nodes - cyclic if len({a for a, b in edges if b == n}) >= fan_in}
    links = [(a, b) for a, b in edges if not {a, b} & shared]
    out = {n: (None, None, None, None) for n in shared}
    numbers = itertools.count(1)

    def place(part, root, depth, parent):
        number = next(numbers)
        inner = [e for e in links if set(e) <= part]
        steps, layer = {root: 0}, {root}
        while layer:
            layer = {b for a, b in inner if a in layer} - set(steps)
            steps |= {n: max(steps.values()) + 1 for n in layer}
        options = []
        for p, head in sorted(set(inner)):
            tree = reach(head, inner)
            if len({b for a, b in inner if a == p}) > 1 and least <= len(tree) < len(part) and not tree & cyclic and [e for e in inner if e[1] in tree and e[0] not in tree] == [(p, head)]:
                options.append((steps.get(p, len(part) + 1), p, head, tree))
        rest = set(part)
        for _, _, head, tree in sorted(options, key=lambda x: x[:3]):
            if tree <= rest:
                rest -= tree
                place(tree, head, depth + 1, root)
        out.update({n: (root, depth, parent, number) for n in rest})

    left = nodes - shared
    while left:
        part = reach(min(left), [*links, *[(b, a) for a, b in links]])
        left -= part
        sources = part - {b for _, b in links}
        place(part, min(sources or part), 0, None)
    return out


def random_graphs(n=60):
    rng = random.Random(3)
    out = {}
    for i in range(n):
        names = [f"n{k:02d}" for k in range(rng.randint(4, 16))]
        edges = [(names[rng.randrange(k)], names[k]) for k in range(1, len(names)) if rng.random() < 0.93]
        edges += [tuple(rng.sample(names, 2)) for _ in range(rng.choice((0, 0, 1, 2, 4)))]
        edges += rng.sample(edges, min(len(edges), rng.choice((0, 0, 1)))) + ([(names[0], names[0])] if rng.random() < 0.1 else [])
        rename = dict(zip(names, rng.sample(names, len(names))))
        out[f"g{i}"] = (names, [(rename[a], rename[b]) for a, b in edges])
    return out


@pytest.mark.parametrize("small", [partition.SMALL, 12])
def test_partition(spark, small):
    """In tasks, and (graphs of more than 12 rows) over the cluster."""
    graphs = random_graphs(60 if small > 12 else 15)
    for fan_in, least in ((4, 3), (3, 2)) if small > 12 else ((4, 3),):
        known = {name: ([], [tuple(e) for e in es]) for name, (es, f, m, _) in KNOWN.items() if (f, m) == (fan_in, least)}
        got = {}
        members = partition.partition(*frames(spark, {**graphs, **known}), fan_in, least, small)
        for r in members.collect():
            got.setdefault(r.graph, {})[r.node] = (r.series, r.depth, r.parent, r.number)
            assert r.shared == (r.series is None)
        for name in known:
            assert {n: x[:3] for n, x in got[name].items()} == KNOWN[name][3]
        for name, (nodes, edges) in graphs.items():
            assert got[name] == plain_partition(nodes, edges, fan_in, least), (name, edges)
    assert sum(any(d for _, d, _, _ in plain_partition(*g, 4, 3).values() if d) for g in graphs.values()) > len(graphs) / 4


def test_partition_in_a_task_equals_plain_version():
    rng = random.Random(8)
    for graphs in (random_graphs(300), {i: ([], [(rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(12))]) for i in range(600)}):
        for nodes, edges in graphs.values():
            for fan_in, least in ((4, 3), (2, 2)):
                want = plain_partition(nodes, edges, fan_in, least)
                got = series.series_of(set(nodes) | {n for e in edges for n in e}, edges, fan_in, least)
                assert {n: tuple(x) for n, _, *x in got} == want and all(shared == (want[n][0] is None) for n, shared, *_ in got)


@pytest.mark.parametrize("reverse", [False, True])
def test_a_long_caterpillar_takes_linear_time(reverse):
    """10,000 nested branches, each with two leaves more than the one within it."""
    name = (lambda k: 99_999 - k) if reverse else (lambda k: k)
    edges = [(name(3 * k), name(3 * k + i)) for k in range(10_000) for i in (1, 2, 3)]
    start = time.process_time()
    rows = series.series_of({n for e in edges for n in e}, edges, 3, 3)
    assert time.process_time() - start < 5
    assert len(rows) == 30_001 and max(r[3] for r in rows) == 9_999 and len({r[5] for r in rows}) == 10_000


def test_statistics_of_shared_nodes_and_empty_graphs(spark):
    nodes, edges = frames(spark, {"g": ([], [("f", "s"), ("g", "s"), ("s", "z"), ("s", "z")])})
    members = partition.partition(nodes, edges, 2, 3)
    row = partition.partition_statistics(members, edges).first().asDict()
    assert row == {"graph": "g", "node_count": 4, "series_count": 3, "max_nodes_per_series": 1, "avg_nodes_per_series": 1.0, "max_partition_depth": 0, "shared_node_count": 1, "shared_node_ratio": 0.25, "edge_count": 4, "regular_edge_count": 0, "cross_series_edge_count": 0, "cross_series_edge_ratio": 0.0}
    assert partition.boundary_edges(members, edges).count() == 4
    degrees = partition.degree_distributions(nodes, edges).first()
    assert degrees.fan_in == [0, 0, 1, 2] and degrees.fan_out == [0, 1, 1, 1]
    none = partition.partition(nodes, edges.limit(0))
    assert none.collect() == [] == partition.partition_statistics(none, edges.limit(0)).collect()


def test_thresholds(spark):
    nodes, edges = frames(spark, {"g": (["a"], [("a", "b")])})
    for wrong in ((0, 3), (3, 1)):
        with pytest.raises(ValueError):
            partition.partition(nodes, edges, *wrong)


def test_strong_components(spark):
    graphs = random_graphs(40)
    graphs["known"] = (["D"], [("A", "B"), ("B", "C"), ("C", "B"), ("E", "E")])
    graphs["path"] = ([], [(f"{9999 - i}", f"{9998 - i}") for i in range(2000)])
    graphs["ring"] = ([], [(f"{i:04d}", f"{(i + 7) % 400:04d}") for i in range(400)])
    folds = []
    keep = traverse.Scratch.write
    traverse.Scratch.write = lambda self, df, label: folds.append(label) or keep(self, df, label)
    try:
        rows = traverse.strong_components(*frames(spark, graphs)).collect()
    finally:
        traverse.Scratch.write = keep
    assert folds.count("fold") < 40  # a path of 2,000 nodes takes rounds in the logarithm of its length
    got = {}
    for r in rows:
        got.setdefault(r.graph, {})[r.node] = (r.component, r.cyclic)
    for name, (nodes, edges) in graphs.items():
        if name in ("path", "ring"):
            continue
        to = {n: reach(n, edges) for n in {*nodes, *[n for e in edges for n in e]}}
        want = {n: {m for m in to[n] if n in to[m]} for n in to}
        assert got[name] == {n: (max(s), len(s) > 1 or (n, n) in edges) for n, s in want.items()}
    assert {c for c in got["path"].values()} == {(n, False) for n in got["path"]} and len(got["path"]) == 2001
    assert set(got["ring"].values()) == {("0399", True)}
