"""Small graphs in tasks: as over the cluster, and in jobs whose number no graph's shape changes."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from facetgraph.operators import bundles, ci, partition, relations, render, tasks, topology, traverse
from facetgraph.sources import modules

EDGES = "graph string, src string, dst string"
NODES = "graph string, node string"


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def jobs_of(spark, work):
    """Spark's jobs while work() runs."""
    tracker, group = spark.sparkContext.statusTracker(), f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        work()
        return len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.fixture(scope="module")
def graph(spark):
    """60 graphs with nulls, self edges and repeated edges."""
    rng = random.Random(7)
    pick = lambda: None if rng.random() < 0.02 else f"n{rng.randrange(7)}"
    edges = [(rng.choice([None, *(f"g{i}" for i in range(60))]), pick(), pick()) for _ in range(700)]
    return spark.createDataFrame([(f"g{i}", f"n{j}") for i in range(60) for j in (0, 9)], NODES), spark.createDataFrame(edges, EDGES).repartition(5)


def test_components_and_cycles_as_over_the_cluster(graph):
    nodes, edges = graph
    assert rows(traverse.strong_components(nodes, edges)) == rows(traverse.strong_components(nodes, edges, small=5))
    few = edges.where("graph < 'g2'")
    for max_length in (None, 1, 3):
        got, want = (rows(traverse.simple_cycles(nodes, few, max_length, small)) for small in (1000, 5))
        assert got == want and len(got) > 10


def test_a_long_ring_takes_no_more_jobs(spark):
    """A ring of 40 nodes took 40 rounds of jobs."""
    edges = spark.createDataFrame([("g", f"{i:02}", f"{(i + 1) % 40:02}") for i in range(40)], EDGES)
    nodes = edges.select("graph", F.col("src").alias("node"))
    found = []
    n = jobs_of(spark, lambda: found.extend(traverse.simple_cycles(nodes, edges).collect()))
    assert [len(r.cycle) for r in found] == [41] and n < 12


def test_dense_graphs_do_not_walk_ways_without_an_end(spark):
    """24 layers of two nodes lead to a node that leads nowhere: 2 ** 24 ways, none of them round; one edge back makes one cycle of two."""
    edges = [("g", f"{i:02}{a}", f"{i + 1:02}{b}") for i in range(24) for a in "ab" for b in "ab"] + [("g", "24a", "23a")]
    nodes = spark.createDataFrame([("g", "00a")], NODES)
    assert [r.cycle for r in traverse.simple_cycles(nodes, spark.createDataFrame(edges, EDGES)).collect()] == [["23a", "24a", "23a"]]


@pytest.fixture(scope="module")
def calls(spark):
    rng = random.Random(5)
    given = [(rng.choice([None, *(f"g{i}" for i in range(20))]), f"S{rng.randrange(3)}.p{rng.randrange(5)}", rng.choice([f"S{rng.randrange(3)}.p{rng.randrange(6)}", "x.y"]), rng.choice(["r", None]), rng.choice([None, rng.randrange(9)])) for _ in range(260)]
    nodes = [(f"g{i}", f"S{a}.p{b}") for i in range(20) for a in range(3) for b in range(5)]
    return spark.createDataFrame(given, "graph string, src string, dst string, raw string, pos long").repartition(5), spark.createDataFrame(nodes, NODES)


@pytest.mark.parametrize("once", [False, True])
@pytest.mark.parametrize("owners", [False, True])
def test_walks_as_over_the_cluster(calls, once, owners):
    sent, nodes = calls
    roots = nodes.where("node LIKE 'S0%'")
    here, there = (traverse.numbered_messages(roots, sent, nodes, 3, True, once=once, owners=owners, small=small) for small in (1000, 5))
    assert rows(here) == rows(there) and here.count() > 50
    plain = here.drop("caller_at", "callee_at", "met")
    people = traverse.participants(plain)
    if owners:
        assert rows(render.communication_people(people)) == rows(traverse.participants(here).select("graph", "root", F.regexp_replace("node", r"\.[^.]*$", "").alias("node"), "position"))
        assert rows(render.communication_diagram(here, traverse.participants(here))) == rows(render.communication_diagram(plain, people))
    else:
        assert rows(people) == rows(traverse.participants(here))
        assert rows(render.sequence_diagram(here, traverse.participants(here))) == rows(render.sequence_diagram(plain, people))


def test_continuations_and_chains_as_over_the_cluster(calls):
    sent, nodes = calls
    roots = nodes.where("node LIKE 'S0%'")
    assert rows(traverse.continuations(roots, sent, nodes, 1)) == rows(traverse.continuations(roots, sent, nodes, 1, small=5)) != []
    edges = sent.groupBy("graph", "src", "dst").agg(F.coalesce(F.min("pos"), F.lit(0)).alias("pos"))
    assert rows(traverse.bounded_chain(roots, edges, 3)) == rows(traverse.bounded_chain(roots, edges, 3, small=5)) != []


def test_walks_that_repeat_take_no_more_jobs(spark):
    """Walks that meet their calls again in other ways took a round of jobs for each level and each turn."""
    sent = [("g", f"{i}{a}", f"{i + 1}{b}", "x", ord(b)) for i in range(6) for a in "ab" for b in "ab"]
    sent = spark.createDataFrame(sent, "graph string, src string, dst string, raw string, pos long")
    nodes = spark.createDataFrame([("g", f"{i}{a}") for i in range(7) for a in "ab"], NODES)
    roots = nodes.where("node = '0a'")
    assert jobs_of(spark, lambda: traverse.expand_sequence(roots, sent, nodes, 6, once=True)) < 12
    assert jobs_of(spark, lambda: traverse.continuations(roots, sent, nodes, 0)) < 12
    assert jobs_of(spark, lambda: traverse.bounded_chain(roots, sent, 6)) < 12


def test_names_as_over_the_cluster(spark):
    rng = random.Random(11)
    graph = lambda: f"g{rng.randrange(12)}"
    classes = [(graph(), rng.choice(["A", "m.A", "B", "m.B", "C.D", ""]), rng.randrange(50), rng.choice([None, [], ["A", None], ["x.A", "B.C"], ["m.A.z", "Root", ""]])) for _ in range(60)]
    methods = [(graph(), p, n, f"{p}.{n}") for p, n in ((rng.choice(["A", "B"]), rng.choice("fgh")) for _ in range(80))]
    refs = [(graph(), rng.choice(["A.f", "B.g", "A.h"]), rng.choice(["A", "B", "", None]), rng.choice(["self.f", "cls.g", "h", "A.f", "B.f.run", "m.A", "B", "self.x", None, ""]), rng.choice([None, rng.randrange(50)])) for _ in range(300)]
    classes = spark.createDataFrame(classes, "graph string, name string, pos long, bases array<string>")
    methods = spark.createDataFrame(methods, "graph string, parent string, name string, qualified string")
    refs = spark.createDataFrame(refs, "graph string, caller string, parent string, raw string, pos long").repartition(5)
    for got, want in zip(relations.class_graph(classes, methods, refs), relations.class_graph(classes, methods, refs, small=5)):
        assert rows(got) == rows(want) != []
    assert rows(relations.call_sequences(refs, methods)) == rows(relations.call_sequences(refs, methods, small=5)) != []
    modules = ["a", "a.b", "a.b.c", "d", "d.e"]
    whole = {"a": True, "d": True, "a.b": None}
    imports = [(graph(), m, rng.choice([None, "a.b.x", ".b", "..b.c", "...", "d", "d.e.f", "q", "."]), whole.get(m, False)) for m in rng.choices(modules, k=300)]
    imports = spark.createDataFrame(imports, "graph string, module string, reference string, is_package boolean")
    for got, want in zip(relations.package_graph(imports), relations.package_graph(imports, small=5)):
        assert rows(got) == rows(want) != []


@pytest.mark.parametrize("column", [pa.array(["a", None, "é"]), pa.array([1, None, 2**60 + 1]), pa.array([3, 4], pa.int32()), pa.array([True, None]), pa.array([["a", None], None, [], ["b"]]), pa.array([{"x": 1}, None]), pa.array([1.5, None]), pa.array([], pa.string())])
def test_values(column):
    assert tasks._values(column) == column.to_pylist() and tasks._values(column[1:]) == column[1:].to_pylist()


def test_a_module_is_decoded_once(spark):
    """A filter on the error decoded the text anew for each field that the rules read."""
    texts = spark.createDataFrame([("{}",)], "json string").repartition(2)
    again = modules.decoded(modules.encoded(modules.decoded(texts).where("error IS NULL"))).where("error IS NULL")
    plan = again.select("module")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2


@pytest.mark.parametrize("neighbours", [False, True])
def test_outputs_as_over_the_cluster(spark, neighbours):
    rng = random.Random(13)
    edges = [(f"g{rng.randrange(12)}", f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.choice("xy"), rng.randrange(9)) for _ in range(300)]
    edges = spark.createDataFrame(edges, "graph string, src string, dst string, label string, pos long").where("src != dst OR pos > 6")
    nodes = edges.select("graph", F.col("src").alias("node")).union(spark.createDataFrame([("g0", "z")], NODES))
    members = partition.partition(nodes, edges, 2)
    assert members.where("shared").count() > 5
    rest = ["label"] if neighbours else ["label", "pos"]
    for got, want in zip(bundles.laid_out(members, edges, "graph", rest, neighbours), bundles.laid_out(members, edges, "graph", rest, neighbours, small=5)):
        assert rows(got) == rows(want) != []


def test_a_bundle_joins_nothing(spark):
    """An output's nodes and edges were looked up by eight joins, each of which read the edges anew."""
    edges = spark.createDataFrame([("g", "a", "b", 1), ("g", "b", "c", 2)], EDGES + ", pos long")
    members = partition.partition(edges.select("graph", F.col("src").alias("node")), edges)
    text = bundles.call_graph_bundle(members, edges)
    assert "Join" not in text._jdf.queryExecution().optimizedPlan().toString() and text.count() == 1


def test_what_grows_with_the_files_is_not_broadcast(spark):
    """Spark takes names that come out of a text for small; they went to the driver."""
    files = spark.createDataFrame([("g", '{"services": {"a": {"links": ["b"]}, "b": {}}}')], "graph string, json string").repartition(2)
    nodes, connections = topology.compose_topology(files)
    objects = spark.createDataFrame([("g", "a", "b", "x")], EDGES + ", label string")
    named = spark.createDataFrame([("g", n, n, "t") for n in "ab"], NODES + ", name string, type_name string")
    for text in (connections, render.deployment_flowchart(nodes, connections), render.object_diagram(named, objects)):
        plan = text._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert [tuple(r)[:4] for r in connections.collect()] == [("g", "compose:a", "compose:b", "links")]


def test_steps_are_not_parsed_to_be_filtered(spark):
    """Filters on what was read from a step parsed its text anew for each field."""
    files = spark.createDataFrame([("g", '{"jobs": {"a": {"steps": [{"run": "x"}, 1, {}]}}}')], "graph string, json string").repartition(2)
    steps = ci.steps(files)
    plan = steps._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if "Filter" in line and "parseJson" in line]
    assert [r.step for r in steps.collect()] == ["run"]
