"""Message walks, chains and continuations against plain recursive walks on random graphs."""

import random

import pytest

from facetgraph.operators import traverse

CALLS = "graph string, src string, dst string, raw string, pos long"
NODES = "graph string, node string"


def plain_messages(root, calls, inside, allowed, max_depth, returns, once):
    out, sent = [], set()

    def send(*message):
        if once and message in sent:
            return False
        sent.add(message)
        out.append(message)
        return True

    def walk(caller, depth, active):
        for target, raw in calls.get(caller, []):
            kind, label = "call", raw
            if target in active:
                kind = "recursive_call"
            elif depth == max_depth and target in allowed:
                kind, label = "depth_truncated", "Further calls omitted: " + raw
            if not send(caller, target, label, kind):
                continue
            if kind == "call" and target in allowed and target in inside:
                walk(target, depth + 1, active | {target})
            if returns and target in inside and kind != "depth_truncated":
                out.append((target, caller, "return", "return"))

    walk(root, 0, {root})
    return out


def plain_chain(root, edges, max_depth):
    out, seen = [], {root}

    def walk(node, depth):
        if depth < max_depth:
            for target in edges.get(node, []):
                if target not in seen:
                    seen.add(target)
                    out.append((target, depth + 1))
                    walk(target, depth + 1)

    walk(root, 0)
    return out


@pytest.fixture(scope="module")
def graphs():
    """200 graphs: {graph: {caller: [(target, label)]}}, some with hubs, cycles, repeated calls and unknown targets."""
    rng = random.Random(3)
    out = {}
    for g in range(200):
        n = rng.randint(1, 7)
        calls = {}
        for _ in range(rng.randint(0, 14)):
            src, dst = f"n{rng.randrange(n)}", f"n{rng.randrange(n + 1)}"
            calls.setdefault(src, []).append((dst, rng.choice(["x", "y"])))
        out[f"g{g}"] = n, calls
    return out


@pytest.fixture(scope="module")
def tables(spark, graphs):
    calls = [(g, src, dst, raw, i) for g, (_, edges) in graphs.items() for src, sent in edges.items() for i, (dst, raw) in enumerate(sent)]
    nodes = [(g, f"n{i}") for g, (n, _) in graphs.items() for i in range(n)]
    return spark.createDataFrame(calls, CALLS).repartition(7), spark.createDataFrame(nodes, NODES)


def by_root(rows, *columns):
    out = {}
    for r in rows.orderBy("graph", "root", "position").collect():
        out.setdefault((r.graph, r.root), []).append(tuple(r[c] for c in columns))
    return out


@pytest.mark.parametrize("returns", [False, True])
@pytest.mark.parametrize("once", [False, True])
def test_messages_equal_a_plain_walk(tables, graphs, once, returns):
    calls, nodes = tables
    allowed = nodes.where("node != 'n2'")
    got = by_root(traverse.expand_sequence(nodes.where("node < 'n3'"), calls, nodes, 3, returns, allowed, once), "caller", "callee", "label", "kind")
    n_shorter = 0
    for g, (n, edges) in graphs.items():
        inside = {f"n{i}" for i in range(n)}
        for root in sorted(inside)[:3]:
            want = plain_messages(root, edges, inside, inside - {"n2"}, 3, returns, once)
            assert got.get((g, root), []) == want
            n_shorter += len(want) < len(plain_messages(root, edges, inside, inside - {"n2"}, 3, returns, False))
    assert not once or n_shorter > 50


def test_numbers_count_the_messages_shown(spark):
    calls = spark.createDataFrame([("g", "a", "b", "b", 1), ("g", "a", "b", "b", 2), ("g", "a", "c", "c", 3), ("g", "c", "b", "b", 1), ("g", "b", "d", "d", 1)], CALLS)
    nodes = spark.createDataFrame([("g", n) for n in "abcd"], NODES)
    out = traverse.expand_sequence(nodes.where("node = 'a'"), calls, nodes, once=True).orderBy("position").collect()
    assert [(r.number, r.caller, r.callee) for r in out] == [("1", "a", "b"), ("1.1", "b", "d"), ("2", "a", "c"), ("2.1", "c", "b")]


def test_once_is_linear_where_walks_are_exponential(spark):
    """Twelve layers of two callables that all call both of the next layer: 4096 walks, 46 messages."""
    calls = [("g", f"{i}{a}", f"{i + 1}{b}", "x", ord(b)) for i in range(12) for a in "ab" for b in "ab"]
    nodes = spark.createDataFrame([("g", f"{i}{a}") for i in range(13) for a in "ab"], NODES)
    out = traverse.expand_sequence(nodes.where("node = '0a'"), spark.createDataFrame(calls, CALLS), nodes, 12, once=True)
    assert out.count() == 2 + 11 * 4


@pytest.mark.parametrize("max_depth", [0, 1, 2, 4])
def test_chains_equal_a_plain_walk_where_the_bound_cuts(tables, graphs, max_depth):
    calls, nodes = tables
    edges = calls.join(nodes.withColumnRenamed("node", "dst"), ["graph", "dst"], "left_semi").groupBy("graph", "src", "dst").agg({"pos": "min"}).withColumnRenamed("min(pos)", "pos")
    got = by_root(traverse.bounded_chain(nodes.where("node < 'n2'"), edges, max_depth), "node", "depth")
    for g, (n, sent) in graphs.items():
        inside = {f"n{i}" for i in range(n)}
        plain = {src: [dst for dst, _ in out if dst in inside] for src, out in sent.items()}
        for root in sorted(inside)[:2]:
            assert got.get((g, root), []) == plain_chain(root, plain, max_depth)


@pytest.mark.parametrize("once", [False, True])
def test_continuations_until_nothing_is_left_out(tables, graphs, once):
    calls, nodes = tables
    got = {(r.graph, r.node): r.turn for r in traverse.continuations(nodes.where("node = 'n0'"), calls, nodes, 0 if once else 1, once=once).collect()}
    want = {}
    for g, (n, edges) in graphs.items():
        inside, turn, todo, seen = {f"n{i}" for i in range(n)}, 0, {"n0"}, {"n0"}
        while todo:
            turn += 1
            cut = {m[1] for root in todo for m in plain_messages(root, edges, inside, inside, 0 if once else 1, False, once) if m[3] == "depth_truncated"}
            todo = {c for c in cut if edges.get(c)} - seen
            seen |= todo
            want.update({(g, node): turn for node in todo})
    assert got == want and max(want.values()) > 1


def test_odd_rows_and_no_rows(spark):
    calls = spark.createDataFrame([(None, "a", "b", None, 1), (None, "a", "b", None, 2), ("g", None, "b", "b", 1), ("g", "a", None, "b", 1), ("g", "a", "", "", None), ("g", "", "a", "back", 1)], CALLS)
    nodes = spark.createDataFrame([(None, "a"), (None, "b"), ("g", "a"), ("g", ""), ("g", None), ("g", "a")], NODES)
    for once, n in ((False, 2), (True, 1)):
        out = by_root(traverse.expand_sequence(nodes, calls, nodes, once=once), "caller", "callee", "label", "kind")
        assert out == {(None, "a"): [("a", "b", None, "call")] * n, ("g", "a"): [("a", "", "", "call"), ("", "a", "back", "recursive_call")], ("g", ""): [("", "a", "back", "call"), ("a", "", "", "recursive_call")]}
    none = calls.limit(0)
    assert traverse.expand_sequence(nodes, none, nodes, once=True).isEmpty() and traverse.expand_sequence(nodes.limit(0), calls, nodes).isEmpty()
    assert traverse.bounded_chain(nodes, none).isEmpty() and traverse.continuations(nodes, none, nodes).isEmpty()
    with pytest.raises(ValueError):
        traverse.expand_sequence(nodes, calls, nodes, -1)
