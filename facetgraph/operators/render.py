"""Text of relation graphs, one row (graph, text) for each.

A text is one value, so what is drawn should be cut into series first. Lines are put in
order by an aggregate for each graph; no graph's lines meet another's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetgraph.functions import text as T
from facetgraph.functions.names import communication_name

# The sign of each visibility.
VISIBILITY_SIGNS = {"public": "+", "protected": "#", "internal": "~", "private": "-", "unspecified": "~"}

# The shapes of deployment nodes by kind.
DEPLOYMENT_SHAPES = {
    ("database",): ('[("', '")]'),
    ("external-dependency", "external-image"): ('{{"', '"}}'),
    ("ingress",): ('(["', '"])'),
    ("workload", "container-image"): ('[["', '"]]'),
}

# For each kind of timing event the arrow to its target, what is said there, and what is noted without one.
TIMING_KINDS = {
    "call": ("->>", "call", "call"),
    "await": ("->>", "await", "await"),
    "parallel_start": ("-)", "parallel start", "parallel_start"),
    "parallel_join": ("", "", "join"),
    "wait": ("", "", "wait"),
    "sync_wait": ("", "", "sync wait"),
    "sync": ("", "", "sync"),
    "timer": ("-)", "timer", "timer"),
    "callback": ("-)", "callback", "callback"),
    "periodic": ("", "", "periodic"),
}


def _text(*parts: object) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _lines(df: DataFrame, part: int, line: Column, place: Column | None = None, name: Column | None = None) -> DataFrame:
    """Lines that come by part, then place, then name."""
    return df.select("graph", F.lit(part).alias("part"), (F.lit(0) if place is None else place).cast("long").alias("place"), (F.lit("") if name is None else name).alias("name"), line.alias("line"))


def _assembled(first: str, parts: list[DataFrame], last: str = "") -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "place", "name", "line"))), lambda x: x["line"]), "\n")
    return out.groupBy("graph").agg(F.concat(F.lit(first + "\n"), body, F.lit("\n" + last)).alias("text"))


def _continued(label: Column, nodes: DataFrame) -> Column:
    """A node's label, and below it the output that goes on with it, where nodes have one as `reference`."""
    return _text(label, F.when(F.col("reference").isNotNull(), _text("<br/>続き: ", F.col("reference"))).otherwise("")) if "reference" in nodes.columns else label


def call_flowchart(nodes: DataFrame, edges: DataFrame, direction: str = "LR") -> DataFrame:
    """Nodes(graph, node, reference?) by name, then all edges(graph, src, dst, pos) in their order, repeated ones too."""
    name = F.col("node")
    nodes = nodes.where("node IS NOT NULL").select("graph", "node", *[c for c in ("reference",) if c in nodes.columns]).distinct()
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    drawn = _text("    ", T.node_id(F.col("src")), " --> ", T.node_id(F.col("dst")))
    return _assembled(f"flowchart {direction}", [_lines(nodes, 0, _text("    ", T.node_id(name), '["', _continued(name, nodes), '"]'), name=name), _lines(edges, 1, drawn, F.col("pos"), _text(F.col("src"), " ", F.col("dst")))])


def package_flowchart(nodes: DataFrame, edges: DataFrame, cyclic: DataFrame, isolated: DataFrame) -> DataFrame:
    """Nodes(graph, node, reference?), stubs rounded, then edges, by name; then which nodes(graph, node) are on cycles and which stand alone."""
    one = lambda c: T.node_id(F.col(c), "pkg_")
    label = _continued(F.col("node"), nodes)
    box = _text('["', label, '"]')
    box = F.when(F.col("reference").isNotNull(), _text('(["', label, '"])')).otherwise(box) if "reference" in nodes.columns else box
    parts = [_lines(nodes, 0, _text("    ", one("node"), box), name=F.col("node")), _lines(edges, 1, _text("    ", one("src"), " --> ", one("dst")), name=_text(F.col("src"), "\x00", F.col("dst")))]
    for part, marked, kind, style in ((2, cyclic, "cycle", "stroke-width:3px"), (3, isolated, "isolated", "stroke-dasharray: 5 5")):
        ids = F.transform(F.array_sort(F.collect_list("node")), lambda x: T.node_id(x, "pkg_"))
        rows = marked.groupBy("graph").agg(F.array_join(ids, ",").alias("ids"))
        parts.append(_lines(rows, part, _text(f"    classDef {kind} {style}\n    class ", F.col("ids"), f" {kind}")))
    return _assembled("flowchart LR", parts)


def component_flowchart(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes(graph, node, external), external ones rounded and without their prefix, then edges, by name."""
    one = lambda c: T.node_id(F.col(c), "component_")
    label = F.regexp_replace("node", "^external:", "")
    shape = F.when(F.col("external"), _text('(["', label, '"])')).otherwise(_text('["', label, '"]'))
    return _assembled("flowchart LR", [_lines(nodes, 0, _text("    ", one("node"), shape), name=F.col("node")), _lines(edges, 1, _text("    ", one("src"), " --> ", one("dst")), name=_text(F.col("src"), "\x00", F.col("dst")))])


def deployment_flowchart(nodes: DataFrame, connections: DataFrame) -> DataFrame:
    """Nodes(graph, id, label, kind, confidence, environment, metadata, reference?) by id, numbered from 0, then connections(graph, source, target, relation, confidence) between them, then how sure each node is.

    Ids are distinct within a graph. A node shows its image or images and its environment.
    """
    by_id = Window.partitionBy("graph").orderBy("id")
    numbered = nodes.withColumn("n", F.row_number().over(by_id) - 1).withColumn("box", F.concat(F.lit("n"), F.col("n").cast("string")))
    image = F.coalesce(F.nullif(F.try_element_at("metadata", F.lit("image")), F.lit("")), F.nullif(F.try_element_at("metadata", F.lit("images")), F.lit("")))
    below = [F.when(F.col("reference").isNotNull(), F.concat(F.lit("続き: "), "reference"))] if "reference" in nodes.columns else []
    label = T.one_line(F.concat_ws("\\n", "label", *below, image, F.when(F.coalesce("environment", F.lit("")) != "", _text("[", F.col("environment"), "]"))))
    drawn = _text("    ", F.col("box"), '["', label, '"]')
    for kinds, (left, right) in DEPLOYMENT_SHAPES.items():
        drawn = F.when(F.col("kind").isin(*kinds), _text("    ", F.col("box"), left, label, right)).otherwise(drawn)
    ends = numbered.select("graph", "id", "box")
    rows = connections
    for end in ("source", "target"):
        rows = rows.join(ends.select("graph", F.col("id").alias(end), F.col("box").alias(f"{end}_box")).hint("merge"), ["graph", end])
    arrow = F.when(F.col("confidence") == "inferred", " -.->").otherwise(" -->")
    link = _text("    ", F.col("source_box"), arrow, '|"', T.one_line(_text(F.col("relation"), " [", F.col("confidence"), "]")), '"| ', F.col("target_box"))
    sure = F.when(F.col("confidence").isin("confirmed", "inferred"), F.col("confidence")).otherwise("unknown")
    styles = F.lit("    classDef confirmed stroke-width:2px;\n    classDef inferred stroke-dasharray:5 5;\n    classDef unknown stroke-dasharray:2 4;")
    parts = [
        _lines(numbered, 0, drawn, F.col("n")),
        _lines(rows, 1, link, name=F.concat_ws("\x00", "source", "target", "relation")),
        _lines(nodes.select("graph").distinct(), 2, styles),
        _lines(numbered, 3, _text("    class ", F.col("box"), " ", sure, ";"), F.col("n")),
    ]
    return _assembled("flowchart LR", parts)


def _member_lines(members: DataFrame, indent: str) -> DataFrame:
    """(graph, node, body): a class's members(graph, node, name, visibility, pos, parameters?) as lines in order."""
    given = F.array_join("parameters", ", ") if "parameters" in members.columns else F.lit("")
    sign = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in VISIBILITY_SIGNS.items() for x in pair]), F.col("visibility")), F.lit("~"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "name", _text(indent, sign, F.col("name"), "(", given, ")").alias("line"))))
    return members.groupBy("graph", "node").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("body"))


def class_diagram(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """Classes with their members, by place and name, then relations in order. nodes(graph, node, external, reference?, place?), edges(graph, src, dst, relation, pos)."""
    one = lambda c: T.hashed_id(F.col(c), "c_")
    nodes = nodes.join(_member_lines(members, "        ").hint("merge"), ["graph", "node"], "left")
    head = _text("    class ", one("node"), '["', _continued(T.quoted(F.col("node")), nodes), '"]')
    bare = F.when(F.col("external"), _text(head, "\n    class ", one("node"), " <<external>>")).otherwise(head)
    drawn = F.when(F.col("body").isNull(), bare).otherwise(_text(head, " {\n", F.col("body"), "\n    }"))
    relation = F.when(F.col("relation") == "inheritance", _text("    ", one("dst"), " <|-- ", one("src"))).otherwise(_text("    ", one("src"), " --> ", one("dst"), " : uses"))
    return _assembled("classDiagram\ndirection LR", [_lines(nodes, 0, drawn, F.col("place") if "place" in nodes.columns else None, F.col("node")), _lines(edges, 1, relation, F.col("pos"), _text(F.col("relation"), F.col("src"), "\x00", F.col("dst")))])


def class_diagram_plantuml(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """class_diagram() as PlantUML."""
    one = lambda c: T.hashed_id(F.col(c), "c_")
    nodes = nodes.join(_member_lines(members, "  ").hint("merge"), ["graph", "node"], "left")
    head = _text('class "', T.quoted(F.col("node")), '" as ', one("node"))
    inner = _text(head, " {\n", F.coalesce(_text(F.col("body"), "\n"), F.lit("")), "}")
    relation = F.when(F.col("relation") == "inheritance", _text(one("dst"), " <|-- ", one("src"))).otherwise(_text(one("src"), " --> ", one("dst"), " : uses"))
    parts = [_lines(nodes, 0, F.when(F.col("external"), _text(head, " <<external>>")).otherwise(inner), name=F.col("node")), _lines(edges, 1, relation, F.col("pos"), _text(F.col("relation"), F.col("src"), "\x00", F.col("dst")))]
    return _assembled("@startuml\nleft to right direction", parts, "@enduml\n")


def object_diagram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Objects o0, o1, ... of nodes(graph, node, name, type_name, fields?, reference?, place?) by place and node, then labelled references, by source, target and label.

    fields is an array of (name, value) structs.
    """
    numbered = nodes.withColumn("n", F.row_number().over(Window.partitionBy("graph").orderBy(*[c for c in ("place", "node") if c in nodes.columns])) - 1)
    ids = numbered.select("graph", "node", F.concat(F.lit("o"), F.col("n").cast("string")).alias("id"))
    drawn = edges.join(ids.select("graph", F.col("node").alias("src"), F.col("id").alias("a")).hint("merge"), ["graph", "src"]).join(ids.select("graph", F.col("node").alias("dst"), F.col("id").alias("b")).hint("merge"), ["graph", "dst"])
    label = F.replace(T.object_label(F.col("label")), F.lit("|"), F.lit("/"))
    shown = T.object_label(F.concat("name", F.lit(" : "), "type_name"))
    if "reference" in nodes.columns:
        shown = F.concat_ws("<br/>", shown, F.concat(F.lit("続き: "), "reference"))
    if "fields" in nodes.columns:
        shown = F.concat_ws("<br/>", shown, F.transform("fields", lambda x: T.object_label(F.concat(x["name"], F.lit(" = "), x["value"]))))
    name = F.concat_ws("\x00", "src", "dst", "label")
    return _assembled("flowchart LR", [_lines(numbered, 0, _text("    o", F.col("n").cast("string"), '["', shown, '"]'), F.col("n")), _lines(drawn, 1, _text("    ", F.col("a"), " -->|", label, "| ", F.col("b")), name=name)])


def _walk_ids(people: DataFrame, name: str) -> DataFrame:
    """(graph, root, name, id) of participants(), as p0, p1, ... in their order."""
    return people.select("graph", "root", F.col("node").alias(name), F.concat(F.lit("p"), (F.col("position") - 1).cast("string")).alias(f"{name}_id"))


def _with_ids(messages: DataFrame, people: DataFrame) -> DataFrame:
    """messages with caller_id and callee_id: as they are numbered, else looked up."""
    if "met" in messages.columns:
        return messages.withColumns({f"{c}_id": F.concat(F.lit("p"), (F.col(f"{c}_at") - 1).cast("string")) for c in ("caller", "callee")})
    return messages.join(_walk_ids(people, "caller"), ["graph", "root", "caller"]).join(_walk_ids(people, "callee"), ["graph", "root", "callee"])


def _one_graph(df: DataFrame) -> DataFrame:
    """A diagram has a graph and a root; both become its graph."""
    return df.withColumn("graph", F.struct("graph", "root"))


def _by_root(df: DataFrame) -> DataFrame:
    return df.select("graph.graph", "graph.root", "text")


def sequence_diagram(messages: DataFrame, people: DataFrame) -> DataFrame:
    """(graph, root, text) of expand_sequence() or numbered_messages(), and participants()."""
    rows = _with_ids(messages, people)
    arrow = F.when(F.col("kind") == "return", "-->>").when(F.col("kind") == "async_call", "-)").otherwise("->>")
    mark = F.when(F.col("kind") == "recursive_call", "[recursive] ").otherwise("")
    plain = _text(arrow, F.col("callee_id"), ": ", T.message_label(F.concat(mark, "label")))
    cut = _text("->>", F.col("callee_id"), ": [depth truncated] ", T.message_label(F.col("label")))
    drawn = _text("    ", F.col("caller_id"), F.when(F.col("kind") == "depth_truncated", cut).otherwise(plain))
    named = _text("    participant p", (F.col("position") - 1).cast("string"), " as ", T.message_label(F.col("node")))
    return _by_root(_assembled("sequenceDiagram", [_lines(_one_graph(people), 0, named, F.col("position")), _lines(_one_graph(rows), 1, drawn, F.col("position"))]))


def sequence_diagram_plantuml(messages: DataFrame, people: DataFrame) -> DataFrame:
    """sequence_diagram() as PlantUML."""
    one = lambda c: T.hashed_id(F.col(c), "p_")
    arrow = F.when(F.col("kind") == "return", "-->").when(F.col("kind") == "async_call", "->>").otherwise("->")
    mark = F.when(F.col("kind") == "recursive_call", "[recursive] ").when(F.col("kind") == "depth_truncated", "[depth truncated] ").otherwise("")
    drawn = _text(one("caller"), " ", arrow, " ", one("callee"), " : ", T.one_line(F.concat(mark, "label")))
    named = _text('participant "', T.one_line(F.col("node")), '" as ', one("node"))
    return _by_root(_assembled("@startuml", [_lines(_one_graph(people), 0, named, F.col("position")), _lines(_one_graph(messages), 1, drawn, F.col("position"))], "@enduml\n"))


def communication_people(people: DataFrame) -> DataFrame:
    """participants() by their owners: callables without their last segment, as they first appear."""
    first = people.groupBy("graph", "root", communication_name(F.col("node")).alias("node")).agg(F.min("position").alias("at"))
    return first.select("graph", "root", "node", F.row_number().over(Window.partitionBy("graph", "root").orderBy("at")).alias("position"))


def communication_diagram(messages: DataFrame, people: DataFrame) -> DataFrame:
    """(graph, root, text): numbered calls between owners; returns are left out. Messages that are numbered are so by owners, and people are."""
    people = people.withColumn("node", communication_name(F.col("node"))) if "met" in messages.columns else communication_people(people)
    calls = messages.where("kind != 'return'").withColumns({c: communication_name(F.col(c)) for c in ("caller", "callee")})
    rows = _with_ids(calls, people)
    mark = F.when(F.col("kind") == "recursive_call", "[recursive] ").when(F.col("kind") == "depth_truncated", "[depth truncated] ").otherwise("")
    drawn = _text("    ", F.col("caller_id"), ' -->|"', T.communication_label(F.concat("number", F.lit(": "), mark, "label")), '"| ', F.col("callee_id"))
    named = _text("    p", (F.col("position") - 1).cast("string"), '["', T.communication_label(F.col("node")), '"]')
    return _by_root(_assembled("flowchart LR", [_lines(_one_graph(people), 0, named, F.col("position")), _lines(_one_graph(rows), 1, drawn, F.col("position"))]))


def responsibility_markdown(rows: DataFrame) -> DataFrame:
    """rows(graph, name, responsibility, pos) as a table."""
    return _assembled("| Class | Responsibility |\n| --- | --- |", [_lines(rows, 0, _text("| ", F.col("name"), " | ", F.col("responsibility"), " |"), F.col("pos"), F.col("name"))])


def responsibility_csv(rows: DataFrame) -> DataFrame:
    """rows(graph, name, responsibility, pos) as CSV."""
    return _assembled("Class,Responsibility", [_lines(rows, 0, _text(T.csv_cell(F.col("name")), ",", T.csv_cell(F.col("responsibility"))), F.col("pos"), F.col("name"))])


def quality_markdown(metrics: DataFrame, findings: DataFrame) -> DataFrame:
    """A report of each graph: metrics(graph, scope, metric, value, place) as a table, then findings(graph, section, ...) of design_findings()."""
    value = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string"))
    table = _text("| ", T.table_cell(F.col("scope")), " | ", T.table_cell(F.col("metric")), " | ", value, " |")
    cell = lambda c: T.table_cell(F.col(c))
    found = _text("\n### [", F.upper("severity"), "] ", cell("code"), ": ", cell("subject"), "\n\n- 根拠: ", cell("evidence"), "\n- 解釈: ", cell("interpretation"), "\n- 補足: ", cell("note"))
    graphs = metrics.select("graph").distinct()
    none = graphs.join(findings.select("graph").distinct(), "graph", "left_anti")
    parts = [
        _lines(metrics, 0, table, F.col("place")),
        _lines(graphs, 1, F.lit("\n## 指摘")),
        _lines(findings, 2, found, F.col("section"), F.concat_ws("\x00", "code", "subject")),
        _lines(none, 2, F.lit("\n現在の閾値では構造上の指摘は見つかりませんでした。")),
    ]
    return _assembled("# 設計品質レポート\n\n## 指標\n\n| 対象 | 指標 | 値 |\n| --- | --- | ---: |", parts)


def state_diagram(machines: DataFrame, transitions: DataFrame, terminals: DataFrame) -> DataFrame:
    """machines(graph, owner, variable, type, initial), transitions(graph, source, target, event, condition, pos), terminals(graph, state, pos); source * is any state."""
    start = F.when(F.coalesce("initial", F.lit("")) != "", _text("\n    [*] --> ", F.col("initial"))).otherwise("")
    head = _text("    %% ", F.col("owner"), ".", F.col("variable"), " : ", F.col("type"), start)
    any_state = transitions.where("source = '*'").select("graph").distinct()
    given = F.concat_ws(" ", F.nullif("event", F.lit("")), F.when(F.coalesce("condition", F.lit("")) != "", F.concat(F.lit("["), "condition", F.lit("]"))))
    source = F.when(F.col("source") == "*", "__any").otherwise(F.col("source"))
    move = _text("    ", source, " --> ", F.col("target"), F.when(given != "", F.concat(F.lit(": "), given)).otherwise(""))
    parts = [
        _lines(machines, 0, head),
        _lines(any_state, 1, F.lit('    state "Any current state" as __any')),
        _lines(transitions, 2, move, F.col("pos"), F.concat_ws("\x00", "source", "target")),
        _lines(terminals, 3, _text("    ", F.col("state"), " --> [*]"), F.col("pos"), F.col("state")),
    ]
    return _assembled("stateDiagram-v2", parts)


def use_case_diagram(cases: DataFrame) -> DataFrame:
    """cases(graph, actor, name, component, event, callable, chain, pos) in order, below their actors; chain: what the handler leads to, as an array."""
    actors = cases.groupBy("graph", "actor").agg(F.lit(1)).withColumn("n", F.row_number().over(Window.partitionBy("graph").orderBy("actor"))).select("graph", "actor", "n")
    rows = cases.withColumn("k", F.row_number().over(Window.partitionBy("graph").orderBy("pos"))).join(actors, ["graph", "actor"])
    number = lambda c: F.col(c).cast("string")
    relation = T.one_line(F.concat("component", F.lit(" / "), "event"))
    chain = T.one_line(F.array_join(F.concat(F.array("callable"), F.coalesce("chain", F.array().cast("array<string>"))), " -> "))
    case = _text("    uc", number("k"), '(["', T.one_line(F.col("name")), '"])\n    actor', number("n"), ' -->|"', relation, '"| uc', number("k"), "\n    %% handler-chain: ", chain)
    return _assembled("flowchart LR", [_lines(actors, 0, _text("    actor", number("n"), '["', T.one_line(F.col("actor")), '"]'), F.col("n")), _lines(rows, 1, case, F.col("k"))])


def timing_chart(flows: DataFrame, events: DataFrame) -> DataFrame:
    """flows(graph, owner, is_async), one a graph, with events(graph, number, kind, target, detail, pos) in order of pos; flows without events have no chart.

    Participants are the owner and the distinct targets by name.
    """
    held = flows.join(events.select("graph").distinct(), "graph", "left_semi")
    targets = events.where("coalesce(target, '') != ''").groupBy("graph", "target").agg(F.lit(1)).withColumn("n", F.row_number().over(Window.partitionBy("graph").orderBy("target")))
    targets = targets.select("graph", "target", "n", _text("p", F.col("n").cast("string")).alias("to"))
    rows = events.join(targets, ["graph", "target"], "left")
    detail = T.one_line(F.coalesce(F.nullif("detail", F.lit("")), F.nullif("target", F.lit("")), "kind"))
    number = _text(F.col("number").cast("string"), ". ")
    note = lambda word: _text("    Note over p0: ", number, word, " ", detail)
    drawn = F.lit(None).cast("string")
    for kind, (arrow, sent, noted) in TIMING_KINDS.items():
        line = note(noted)
        if arrow:
            back = _text("\n    ", F.col("to"), "-->>p0: resume") if kind == "await" else F.lit("")
            line = F.when(F.col("to").isNotNull(), _text("    p0", arrow, F.col("to"), ": ", number, sent, " ", detail, back)).otherwise(line)
        drawn = F.coalesce(drawn, F.when(F.col("kind") == kind, line))
    parts = [
        _lines(held, 0, _text('    participant p0 as "', T.one_line(F.col("owner")), '"')),
        _lines(targets, 1, _text("    participant ", F.col("to"), ' as "', T.one_line(F.col("target")), '"'), F.col("n")),
        _lines(held.where("is_async"), 2, F.lit("    Note over p0: async flow")),
        _lines(rows, 3, F.coalesce(drawn, note(F.col("kind"))), F.col("pos")),
    ]
    return _assembled("sequenceDiagram", parts)


def activity_flowchart(nodes: DataFrame, edges: DataFrame, direction: str = "TD") -> DataFrame:
    """nodes(graph, node, label, kind, pos), decisions in braces, then edges(graph, src, dst, label, pos), an empty or null label not shown."""
    one = lambda c: T.node_id(F.col(c), "act_")
    label = F.coalesce("label", F.lit(""))
    box = F.when(F.col("kind") == "decision", _text("{", label, "}")).otherwise(_text("[", label, "]"))
    arrow = _text("    ", one("src"), " -->", F.when(label != "", _text("|", label, "|")).otherwise(""), " ", one("dst"))
    return _assembled(f"flowchart {direction}", [_lines(nodes, 0, _text("    ", one("node"), box), F.col("pos"), F.col("node")), _lines(edges, 1, arrow, F.col("pos"), F.concat_ws("\x00", "src", "dst"))])
