"""Refused rows of graphs, output paths, task status and ranks: known answers and odd values."""

from pyspark.sql import functions as F

from facetgraph.operators import graph, outputs


def test_refused_rows(spark):
    nodes = spark.createDataFrame([("g", "a"), ("g", ""), ("g", None), ("g", "a")], "graph string, node string")
    edges = spark.createDataFrame([("g", "b", "c", None, 0), ("g", "", "c", "x", 1), ("g", "b", None, "x", 2), ("g", None, "", "x", 3), ("g", "b", "b", "", 4), ("h", "x", "y", "async", 5)], "graph string, src string, dst string, kind string, pos long")
    named, kept, refused = graph.validated(nodes, edges)
    assert sorted(map(tuple, named.collect())) == [("g", "a"), ("g", "b"), ("g", "c"), ("h", "x"), ("h", "y")]
    assert sorted(map(tuple, kept.collect())) == [("g", "b", "b", "direct", 4), ("g", "b", "c", "direct", 0), ("h", "x", "y", "async", 5)]
    assert sorted(map(str, map(tuple, refused.collect()))) == sorted(map(str, [("g", "node", None, "no name")] * 2 + [("g", "edge", 1, "no caller"), ("g", "edge", 2, "no callee"), ("g", "edge", 3, "no caller and no callee")]))
    none = graph.validated(nodes.limit(0), edges.limit(0))
    assert [df.count() for df in none] == [0, 0, 0]


def test_paths(spark):
    rows = spark.createDataFrame([(0, "c", ["s", "t"], "n", "mermaid"), (1, "c", ["s"], "t/n", "mermaid"), (2, "c", None, "n", None), (3, "c", [], "n", "source"), (4, "c", [], "n", "csv")], "i int, category string, relative_dir array<string>, name string, format string")
    got = {r["i"]: (r["path"], r["duplicate"]) for r in outputs.output_paths(rows).collect()}
    assert got == {0: ("c/s/t/n.mmd", True), 1: ("c/s/t/n.mmd", True), 2: ("c/n.txt", True), 3: ("c/n.txt", True), 4: ("c/n.csv", False)}


def test_tasks(spark):
    texts = [None, "", "## Goal\n##  Required Constraints \n## ACCEPTANCE\ntext\n## Required Context\n## Deferred", "# Goal\n### Required\n ## Acceptance\n##Working set"]
    got = [tuple(r["s"]) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(outputs.exploration_status(F.col("t")).alias("s")).collect()]
    nothing = (False,) * 5 + (["goal", "required", "acceptance", "working_set"], False)
    assert got == [nothing, nothing, (True,) * 5 + ([], True), nothing]
    issues = spark.createDataFrame([(0, [" P1", "p0"], None), (1, ["other"], "[P2] x"), (2, None, "[p3]"), (3, [], "P1"), (4, [None], None)], "i int, labels array<string>, title string")
    ranks = issues.orderBy("i").select(outputs.label_rank(F.col("labels"), F.col("title"), {"p0": 0, "p1": 1}, r"(?i)^\s*\[P([0-3])\]")).collect()
    assert [r[0] for r in ranks] == [0, 2, 3, 50, 50]


def test_rules_by_prefix_and_by_pattern(spark):
    import pytest

    from facetgraph.operators import relations, repository

    edges = [("g", "r0.a", "r1.b"), ("g", "r0.a", "r1.b"), ("g", "r0", "r1."), ("h", "r0.", "r1"), ("h", "x", "y"), ("h", None, "y"), ("h", "x", None), (None, "r0.q", "r1.")]
    rules = [("r0.", "r1.", "forbidden"), ("r0", "r1", "warning"), ("", "y", "any")]
    got = relations.policy_findings(spark.createDataFrame(edges, "graph string, src string, dst string"), spark.createDataFrame(rules, "source string, target string, severity string"))
    want = [(*e, s) for e in edges if e[1] is not None and e[2] is not None for a, b, s in rules if e[1].startswith(a) and e[2].startswith(b)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    changes = spark.createDataFrame([(1, "a.py"), (1, "b.go"), (2, "a.py"), (2, None)], "g int, path string")
    plan = spark.createDataFrame([(0, r"\.py$", "pytest"), (1, "^b", "go test"), (2, "a", "pytest")], "order int, pattern string, command string")
    assert sorted(map(tuple, repository.validation_plan(changes, plan, "g").collect())) == [(1, 0, "pytest"), (1, 1, "go test"), (2, 0, "pytest")]
    with pytest.raises(ValueError):
        repository.validation_plan(changes, spark.range(repository.MAX_RULES + 1).selectExpr("id AS order", "'x' AS pattern", "'y' AS command"), "g")


def test_activities(spark):
    from facetgraph.operators import render

    nodes = spark.createDataFrame([("g", "start", "Start", "activity", 0), ("g", "check", "Is valid?", "decision", 1), ("g", "fin-ish", "Finish", None, 2), ("h", "x", None, "decision", 0)], "graph string, node string, label string, kind string, pos int")
    edges = spark.createDataFrame([("g", "start", "check", None, 0), ("g", "check", "fin-ish", "Yes", 1), ("g", "check", "start", "", 2)], "graph string, src string, dst string, label string, pos int")
    got = {r["graph"]: r["text"] for r in render.activity_flowchart(nodes, edges).collect()}
    assert got == {"g": "flowchart TD\n    act_start[Start]\n    act_check{Is valid?}\n    act_fin_ish[Finish]\n    act_start --> act_check\n    act_check -->|Yes| act_fin_ish\n    act_check --> act_start\n", "h": "flowchart TD\n    act_x{}\n"}
