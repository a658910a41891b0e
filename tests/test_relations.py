"""Relation graphs, findings and texts against known answers."""

from pyspark.sql import functions as F

from facetgraph.operators import quality, relations, render, repository, traverse, workflows


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_class_and_object_graphs(spark):
    classes = spark.createDataFrame([("m", "Base", 1, []), ("m", "Helper", 2, []), ("m", "Service", 3, ["Base", "Base", "ThirdParty.Root", "Service"]), ("m", "Alpha.Shared", 5, []), ("m", "Beta.Shared", 6, [])], "graph string, name string, pos long, bases array<string>")
    methods = spark.createDataFrame([("m", "Service", "run", "Service.run")], "graph string, parent string, name string, qualified string")
    calls = spark.createDataFrame([("m", "Service.run", "Service", raw, 4) for raw in ("Helper", "Alpha.Shared", "Shared", "Helper")] + [("m", "No.run", "No", "Helper", 9)], "graph string, caller string, parent string, raw string, pos long")
    nodes, edges = relations.class_graph(classes, methods, calls)
    assert rows(nodes, "node") == [(n,) for n in ("Alpha.Shared", "Base", "Beta.Shared", "Helper", "Service", "ThirdParty.Root")]
    assert rows(edges, "src", "dst", "relation") == [("Service", "Alpha.Shared", "uses"), ("Service", "Base", "inheritance"), ("Service", "Helper", "uses"), ("Service", "ThirdParty.Root", "inheritance")]
    objects = [("left", "build", "right", "right"), ("right", "build", "left", "left"), ("caller", "build", "ambiguous", "duplicate"), ("duplicate", "first", None, None), ("duplicate", "second", None, None), ("isolated", "build", None, None), ("top", None, "x", "isolated"), ("other", "", "y", "top")]
    nodes, edges = relations.object_graph(spark.createDataFrame([("m", *o) for o in objects], "graph string, name string, scope string, label string, target string"))
    assert rows(edges, "src", "dst", "label") == [("<module>:other", "<module>:top", "y"), ("<module>:top", "build:isolated", "x"), ("build:left", "build:right", "right"), ("build:right", "build:left", "left")]


def test_calls(spark):
    callables = spark.createDataFrame([("m", "run", "Service", "Service.run"), ("m", "helper", "Service", "Service.helper"), ("m", "helper", "Other", "Other.helper"), ("m", "free", None, "free")], "graph string, name string, parent string, qualified string")
    raws = ["self.helper", "cls.helper", "helper", "free", "missing", "Other.helper"]
    calls = spark.createDataFrame([("m", "Service.run", "Service", raw, i) for i, raw in enumerate(raws)] + [("m", "free", None, "self.helper", 9)], "graph string, caller string, parent string, raw string, pos long")
    found = relations.call_sequences(calls, callables)
    assert [r.dst for r in found.where("src != 'free'").orderBy("pos").collect()] == ["Service.helper", "Service.helper", "helper", "free", "missing", "Other.helper"]
    assert rows(relations.sequence_graph(found, callables)[1], "src", "dst") == [("Service.run", "Other.helper"), ("Service.run", "Service.helper"), ("Service.run", "free")]
    # the last segment counts: Other.helper names two callables, of which the parent's own is taken
    assert rows(relations.static_calls(calls, callables), "caller", "target") == [("Service.run", "Service.helper"), ("Service.run", "free")]
    told = spark.createDataFrame([("m", "Service.run", "Other.helper"), ("m", "free", "unknown")], "graph string, caller string, target string")
    assert rows(relations.known_calls(calls, told, callables), "caller", "target") == [("Service.run", "Other.helper")]


def test_packages_and_components(spark):
    imports = spark.createDataFrame([("m", "pkg", True, None), ("m", "pkg.a", False, ".b"), ("m", "pkg.a", False, ".b"), ("m", "pkg.b", False, ".a.x"), ("m", "pkg.lone", False, None), ("m", "pkg", True, ".lone"), ("m", "pkg.a", False, "..pkg.lone"), ("m", "pkg.lone", False, "...b")], "graph string, module string, is_package boolean, reference string")
    nodes, edges = relations.package_graph(imports)
    assert rows(edges, "src", "dst") == [("pkg", "pkg.lone"), ("pkg.a", "pkg.b"), ("pkg.a", "pkg.lone"), ("pkg.b", "pkg.a")] and nodes.count() == 4
    imports = [("ui.view", "ui", "ui.controller"), ("ui.view", "ui", "data.repo"), ("ui.view", "ui", "requests"), ("ui.controller", "ui", "data.repo"), ("data.repo", "data", "ui.view"), ("data.repo", "data", "requests"), ("data.repo", "data", ".gone"), ("data.repo", "data", "ui.gone")]
    nodes, edges = relations.component_graph(spark.createDataFrame([("m", *i) for i in imports], "graph string, module string, component string, reference string"))
    assert rows(nodes, "node", "external") == [("data", False), ("external:requests", True), ("ui", False)]
    assert rows(edges, "src", "dst") == [("data", "external:requests"), ("data", "ui"), ("ui", "data"), ("ui", "external:requests")]
    assert rows(relations.deployment_topology(nodes, edges)[0], "id", "label", "kind")[-1] == ("external:requests", "requests", "external-dependency")
    text = render.component_flowchart(nodes.where("node != 'data'").replace("ui", "app"), spark.createDataFrame([("m", "app", "external:requests")], "graph string, src string, dst string")).first().text
    assert text == 'flowchart LR\n    component_app["app"]\n    component_external_requests(["requests"])\n    component_app --> component_external_requests\n'


def test_findings(spark):
    nodes = spark.createDataFrame([("m", "alpha"), ("m", "beta")], "graph string, node string")
    edges = spark.createDataFrame([("m", "alpha", "beta"), ("m", "beta", "alpha")], "graph string, src string, dst string")
    none = (nodes.limit(0), edges.limit(0))
    found = quality.design_findings((nodes, edges), none, quality.Thresholds(10, 10, 10, 0.25)).collect()
    assert [(r.code, r.subject) for r in sorted(found, key=lambda r: r.section)] == [("call-cycle", "alpha -> beta -> alpha"), ("strongly-connected-component", "alpha, beta")]
    metrics = {r.metric: r.value for r in quality.design_metrics(nodes, edges, "call_graph", 10).collect()}
    assert list(metrics) == list(quality.METRICS) and metrics["cycle_count"] == 1 and metrics["largest_scc_size"] == 2 and metrics["avg_nodes_per_series"] == 2.0
    table = spark.createDataFrame([("m", "call_graph", "node_count", 2.0, 0), ("n", "call_graph", "shared_node_ratio", 0.25, 0)], "graph string, scope string, metric string, value double, place int")
    texts = {r.graph: r.text for r in render.quality_markdown(table, spark.createDataFrame(found)).collect()}
    assert texts["n"] == "# 設計品質レポート\n\n## 指標\n\n| 対象 | 指標 | 値 |\n| --- | --- | ---: |\n| call_graph | shared_node_ratio | 0.25 |\n\n## 指摘\n\n現在の閾値では構造上の指摘は見つかりませんでした。\n"
    assert "\n### [WARNING] call-cycle: alpha -> beta -> alpha\n\n- 根拠: 2本のedgeを持つcycleを検出しました。\n" in texts["m"]


def test_sequences(spark):
    calls = spark.createDataFrame([("g", a, b, b, i) for i, (a, b) in enumerate(["ab", "bc", "cd", "ba", "bx", "ab"])], "graph string, src string, dst string, raw string, pos long")
    nodes = spark.createDataFrame([("g", n) for n in "abcd"], "graph string, node string")
    out = traverse.expand_sequence(nodes.where("node = 'a'"), calls, nodes, 1, True, nodes.where("node != 'c'")).orderBy("position").collect()
    # depth 1 is the bound: c is not allowed, so that its call is whole; d is never reached
    want = [("1", 0, "a", "b", "call"), ("1.1", 1, "b", "c", "call"), (None, 1, "c", "b", "return"), ("1.2", 1, "b", "a", "recursive_call"), (None, 1, "a", "b", "return"), ("1.3", 1, "b", "x", "call"), (None, 0, "b", "a", "return")]
    assert [(r.number, r.depth, r.caller, r.callee, r.kind) for r in out[:7]] == want
    assert [(r.number, r.kind) for r in out[7:]] == [("2", "call"), ("2.1", "call"), (None, "return"), ("2.2", "recursive_call"), (None, "return"), ("2.3", "call"), (None, "return")]
    cut = traverse.expand_sequence(nodes.where("node = 'a'"), calls.where("pos < 3"), nodes, 2).orderBy("position").collect()
    assert [(r.label, r.kind) for r in cut] == [("b", "call"), ("c", "call"), ("Further calls omitted: d", "depth_truncated")]


def test_texts_of_diagrams(spark):
    messages = spark.createDataFrame([("g", "Service.run", 1, "1", 0, "Service.run", "Repo.load", "load: item", "call"), ("g", "Service.run", 2, None, 0, "Repo.load", "Service.run", "return", "return")], "graph string, root string, position int, number string, depth int, caller string, callee string, label string, kind string")
    people = traverse.participants(messages)
    assert render.sequence_diagram(messages, people).first().text == "sequenceDiagram\n    participant p0 as Service.run\n    participant p1 as Repo.load\n    p0->>p1: load- item\n    p1-->>p0: return\n"
    assert render.sequence_diagram_plantuml(messages, people).first().text == '@startuml\nparticipant "Service.run" as p_e4fafa5fcc\nparticipant "Repo.load" as p_566c7a23a0\np_e4fafa5fcc -> p_566c7a23a0 : load: item\np_566c7a23a0 --> p_e4fafa5fcc : return\n@enduml\n'
    assert render.communication_diagram(messages.withColumn("label", F.regexp_replace("label", ":", "")), people).first().text == 'flowchart LR\n    p0["Service"]\n    p1["Repo"]\n    p0 -->|"1: load item"| p1\n'
    graph = "graph string, node string"
    edges = spark.createDataFrame([("g", "main", "helper", 1)], "graph string, src string, dst string, pos long")
    assert render.call_flowchart(spark.createDataFrame([("g", "main"), ("g", "helper")], graph), edges).first().text == 'flowchart LR\n    n_helper["helper"]\n    n_main["main"]\n    n_main --> n_helper\n'
    classes = spark.createDataFrame([("g", "Service", False), ("g", "Repo", False)], graph + ", external boolean")
    uses = spark.createDataFrame([("g", "Service", "Repo", "uses", 1)], "graph string, src string, dst string, relation string, pos long")
    members = spark.createDataFrame([("g", "Service", "run", "public", ["x"], 1)], "graph string, node string, name string, visibility string, parameters array<string>, pos long")
    assert render.class_diagram(classes, uses, members).first().text == 'classDiagram\ndirection LR\n    class c_e6ca57202c["Repo"]\n    class c_329cb8b6ba["Service"] {\n        +run(x)\n    }\n    c_329cb8b6ba --> c_e6ca57202c : uses\n'
    assert render.class_diagram_plantuml(classes, uses, members).first().text == '@startuml\nleft to right direction\nclass "Repo" as c_e6ca57202c {\n}\nclass "Service" as c_329cb8b6ba {\n  +run(x)\n}\nc_329cb8b6ba --> c_e6ca57202c : uses\n@enduml\n'
    objects = spark.createDataFrame([("g", "a", "service", "Service", [("name", "api")]), ("g", "b", "repo", "Repo", [])], "graph string, node string, name string, type_name string, fields array<struct<name:string,value:string>>")
    assert render.object_diagram(objects, spark.createDataFrame([("g", "a", "b", "repo")], "graph string, src string, dst string, label string")).first().text == 'flowchart LR\n    o0["service : Service<br/>name = api"]\n    o1["repo : Repo"]\n    o0 -->|repo| o1\n'
    packages = spark.createDataFrame([("g", "app"), ("g", "data")], graph)
    text = render.package_flowchart(packages, spark.createDataFrame([("g", "app", "data")], "graph string, src string, dst string"), packages, packages.where("node = 'data'")).first().text
    assert text == 'flowchart LR\n    pkg_app["app"]\n    pkg_data["data"]\n    pkg_app --> pkg_data\n    classDef cycle stroke-width:3px\n    class pkg_app,pkg_data cycle\n    classDef isolated stroke-dasharray: 5 5\n    class pkg_data isolated\n'
    told = spark.createDataFrame([("g", "Service", 'Says "x", then.', 1)], "graph string, name string, responsibility string, pos long")
    assert render.responsibility_csv(told).first().text == 'Class,Responsibility\nService,"Says ""x"", then."\n'


def test_workflows(spark):
    steps = [("w", "lint", 0, None, "echo a", None), ("w", "unit", 0, "Run tests", "make", None), ("w", "ship", 0, None, "build all", None), ("w", "ship", 1, None, "pytest", None), ("w", "both", 0, None, "build-and-test", None), ("w", "pack", 0, None, None, "x/package@v1"), ("v", "only", 0, None, " build ", None), ("v", "only", 1, None, "build", None)]
    steps = spark.createDataFrame(steps, "graph string, job string, i int, name string, command string, action string")
    jobs = spark.createDataFrame([("w", "lint", []), ("w", "unit", ["lint", "gone"]), ("w", "ship", []), ("w", "both", []), ("w", "pack", ["unit"]), ("v", "only", [])], "graph string, job string, needs array<string>")
    assert rows(workflows.untested_builds(steps, jobs), "graph", "job") == [("w", "ship")]
    assert rows(workflows.findings(steps, jobs), "graph", "code") == [("v", "duplicate-command"), ("v", "missing-test"), ("w", "build-without-test-dependency")]
    assert ("w", "unit", "lint") in rows(workflows.known_needs(jobs).where("need IS NOT NULL"), "graph", "job", "need") and workflows.known_needs(jobs).where("need IS NULL").count() == 4


def test_repository(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("one\ntwo API\n")
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "y.py").write_text("api")
    (tmp_path / "Dockerfile").write_text("FROM a\r\nRUN b.api")
    files = repository.scan(spark, str(tmp_path))
    assert rows(files, "path") == [("Dockerfile",), ("a/x.py",), ("build/y.py",)]
    assert rows(repository.project_files(files), "path", "language") == [("Dockerfile", "unknown"), ("a/x.py", "python")]
    assert rows(repository.deployment_files(files), "path") == [("Dockerfile",)]
    assert rows(repository.search(files, "path", ".api", case_sensitive=True), "path", "line", "text", "truncated") == [("Dockerfile", 2, "RUN b.api", False)]
    assert rows(repository.search(files, "path", "api", max_results=2), "path", "line", "truncated") == [("Dockerfile", 2, True), ("a/x.py", 2, True)]
    assert rows(repository.profile(files), "suffix", "files", "lines") == [("", 1, 2), (".py", 2, 3)]
    assert rows(repository.find_paths(files, "*/x.[!c]y"), "path") == [("a/x.py",)] == rows(repository.find_paths(files, "X.P"), "path")


def test_modules(spark):
    from facetgraph.sources import modules

    sound = '{"schema_version": "1", "language": "go", "entities": [{"kind": "class", "name": "A", "line": 2, "end_line": 2, "new_field": 1}], "imports": [], "diagnostics": [{"kind": "k", "message": "m"}], "objects": [{"name": "o", "values": [["k", "v"]]}]}'
    broken = {
        "null": (None, "decode Common IR payload"),
        "empty": ("", "decode Common IR payload"),
        "cut": (sound[:50], "decode Common IR payload"),
        "version": (sound.replace('"1", "lang', '"", "lang'), "payload.schema_version is required"),
        "language": (sound.replace('"go"', '""'), "common_ir.language is required"),
        "imports": (sound.replace('"imports": [], ', ""), "common_ir.imports must be a JSON array"),
        "name": (sound.replace('"A"', '""'), "common_ir.entities[0].kind and name are required"),
        "span": (sound.replace('"end_line": 2', '"end_line": 1'), "common_ir.entities[0] has invalid source range line=2 end_line=1"),
        "diagnostic": (sound.replace('"m"}', '"m"}, {"kind": "k"}'), "common_ir.diagnostics[1].kind and message are required"),
        "line": (sound.replace('"m"}', '"m", "line": 0}'), "common_ir.diagnostics[0].line must be a positive integer when present"),
    }
    rows_ = [("g", name, text) for name, (text, _) in broken.items()] + [("g", "sound", sound), ("g", "other", sound.replace('"go"', '"java"'))]
    out = modules.decoded(spark.createDataFrame(rows_, "graph string, module_id string, json string"))
    got = {r.module_id: r for r in out.collect()}
    assert {n: got[n].error for n in broken} == {n: e for n, (_, e) in broken.items()} and all(got[n].module is None for n in broken)
    assert got["sound"].error is None and got["sound"].module.entities[0].name == "A" and got["sound"].module["objects"][0]["values"] == [["k", "v"]]
    assert rows(modules.languages(out), "graph", "language") == [("g", "mixed")]
    assert rows(modules.facts_of(out, "entities"), "module_id", "ord", "name") == [("other", 0, "A"), ("sound", 0, "A")]
    assert modules.decoded(out.select("graph", "json").limit(0)).collect() == []


def test_state_and_use_case_texts(spark):
    machine = spark.createDataFrame([("g", "Worker", "state", "State", "IDLE")], "graph string, owner string, variable string, type string, initial string")
    moves = spark.createDataFrame([("g", "*", "RUNNING", "start", "ready", 1)], "graph string, source string, target string, event string, condition string, pos long")
    ends = spark.createDataFrame([("g", "RUNNING", 0)], "graph string, state string, pos long")
    assert render.state_diagram(machine, moves, ends).first().text == 'stateDiagram-v2\n    %% Worker.state : State\n    [*] --> IDLE\n    state "Any current state" as __any\n    __any --> RUNNING: start [ready]\n    RUNNING --> [*]\n'
    case = spark.createDataFrame([("g", "User", "Open", "button", "click", "Controller.on_open", ["Repo.load"], 1)], "graph string, actor string, name string, component string, event string, callable string, chain array<string>, pos long")
    assert render.use_case_diagram(case).first().text == 'flowchart LR\n    actor1["User"]\n    uc1(["Open"])\n    actor1 -->|"button / click"| uc1\n    %% handler-chain: Controller.on_open -> Repo.load\n'
