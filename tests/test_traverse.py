from facetgraph.operators import traverse

EDGES = "graph string, src string, dst string"
NODES = "graph string, node string"


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_components_with_nulls_and_repeats(spark):
    edges = spark.createDataFrame([("g", "b", "a"), ("g", "b", "a"), ("g", "c", "b"), ("g", None, "a"), (None, "a", "b"), ("g", "z", "z")], EDGES)
    nodes = spark.createDataFrame([("g", "x"), ("g", None)], NODES)
    assert rows(traverse.weak_components(nodes, edges)) == {("g", "a", "a"), ("g", "b", "a"), ("g", "c", "a"), ("g", "x", "x"), ("g", "z", "z"), (None, "a", "a"), (None, "b", "a")}


def test_no_edges(spark):
    edges, nodes = spark.createDataFrame([], EDGES), spark.createDataFrame([("g", "x")], NODES)
    assert rows(traverse.weak_components(nodes, edges)) == {("g", "x", "x")}
    assert rows(traverse.strong_components(nodes, edges)) == {("g", "x", "x", False)}
    assert rows(traverse.reachable(nodes, edges)) == {("g", "x", "x", 0)}
