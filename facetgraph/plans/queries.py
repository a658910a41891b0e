"""Registered queries of the analytics operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetgraph.functions import names
from facetgraph.operators import graph, render, resolve, traverse
from facetgraph.plans import document_queries, module_queries, source_queries, text_queries
from facetgraph.sources.tables import event_steps, table

STEPS = "WITH s AS (SELECT user_id, event_id, ts, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), e AS (SELECT * FROM s WHERE dst IS NOT NULL)"


def ag1_fan_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fan_in_out(event_steps(spark, sf_dir))


def gr1_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_steps(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").alias("n"))


def wn11_first_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.first_label(event_steps(spark, sf_dir), "event_id", "event_id")


def ag6_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "error", "login", "purchase", "view"]
    counts = [F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds]
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n_events"), *counts)


def so3_largest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("chars")).orderBy(F.desc("chars"), "doc_id").limit(12)


def ag13_group_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("roles"))


def _day_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph for each user and day: event types, linked where the next event's value is larger."""
    by_day = Window.partitionBy("graph").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").withColumn("graph", F.concat(F.col("user_id").cast("string"), F.lit(":"), F.date_format("ts", "yyyy-MM-dd")))
    nxt = events.select("graph", F.col("event_type").alias("src"), "value", F.lead("event_type").over(by_day).alias("dst"), F.lead("value").over(by_day).alias("next"), F.col("event_id").alias("pos"))
    return events.select("graph", F.col("event_type").alias("node")).distinct(), nxt.where("dst IS NOT NULL AND next > value").select("graph", "src", "dst", "pos")


def gr15_isolated_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a pending urgent order."""
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("node"))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
    return graph.isolated(nodes, orders.select(F.col("o_custkey").cast("string").alias("src"), F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("dst")))


def se4_terminal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each day's graph, the event types that are entered and never left."""
    _, edges = _day_graphs(spark, sf_dir)
    return edges.select("graph", F.col("dst").alias("state")).distinct().join(edges.select("graph", F.col("src").alias("state")), ["graph", "state"], "left_anti")


def ag7_state_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States and transitions of each day's graph, transitions counted once each."""
    nodes, edges = _day_graphs(spark, sf_dir)
    moves = edges.select("graph", "src", "dst").distinct().groupBy("graph").agg(F.count("*").alias("transitions"))
    return nodes.groupBy("graph").agg(F.count("*").alias("states")).join(moves, "graph", "left").select("graph", "states", F.coalesce("transitions", F.lit(0)).alias("transitions"))


def rn7_state_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's graph as a state machine: from the first event type on, moves in the order of their first occurrence, how often they occur as their event."""
    _, edges = _day_graphs(spark, sf_dir)
    moves = edges.groupBy("graph", F.col("src").alias("source"), F.col("dst").alias("target")).agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    moves = moves.select("graph", "source", "target", F.concat(F.lit("x"), F.col("n").cast("string")).alias("event"), F.when(F.col("n") > 1, F.lit("often")).alias("condition"), "pos")
    machines = edges.groupBy("graph").agg(F.min_by("src", "pos").alias("initial")).select("graph", F.col("graph").alias("owner"), F.lit("event").alias("variable"), F.lit("Type").alias("type"), "initial")
    ends = se4_terminal_states(spark, sf_dir).select("graph", "state", F.lit(0).alias("pos"))
    return render.state_diagram(machines, moves, ends)


def gr5_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances up to 3 from the views of each graph."""
    nodes, edges = _day_graphs(spark, sf_dir)
    return traverse.reachable(nodes.where("node = 'view'"), edges, 3)


def gr6_simple_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _day_graphs(spark, sf_dir)
    return traverse.simple_cycles(nodes, edges).select("graph", F.array_join("cycle", ">").alias("cycle"))


def gr7_strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.strong_components(*_day_graphs(spark, sf_dir))


def gr9_weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.weak_components(*_day_graphs(spark, sf_dir))


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Part names as callables of their brands, and references to them in four spellings."""
    parts = table(spark, sf_dir, "part")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    known = parts.select(names.qualified_name(F.col("p_type"), F.concat_ws("_", name, F.col("p_size").cast("string"))).alias("name"))
    simple = F.concat_ws("_", name, F.col("p_size").cast("string"))
    kind = F.col("p_brand")
    raw = F.when(kind < "Brand#13", simple).when(kind < "Brand#17", F.concat(F.lit("self."), simple)).when(kind < "Brand#2", F.concat_ws(".", "p_type", simple)).otherwise(F.concat_ws(".", kind, simple, F.lit("call")))
    return parts.select("p_partkey", raw.alias("raw"), F.col("p_type").alias("owner")), known


def j2_resolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, known = _references(spark, sf_dir)
    return resolve.callables(refs, known).select("p_partkey", "raw", "target")


def j1_resolved_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, known = _references(spark, sf_dir)
    return resolve.classes(refs.select("p_partkey", F.col("raw").alias("ref")), known)


def j6_resolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's address, resolved to the longest other address that leads to it."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"^https?://", "").alias("ref"))
    known = pages.select(F.regexp_replace("ref", r"[/?#][^/?#]*$", "").alias("name"))
    return resolve.longest_prefix(pages, known, "/")


def j10_called_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, known = _references(spark, sf_dir)
    calls = resolve.callables(refs, known).select(F.col("owner").alias("caller"), "target")
    return resolve.called_by(calls).select("name", F.array_join("callers", ",").alias("callers"))


def j11_selected_workloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days' graphs whose event types hold all types of a user's first day."""
    nodes, _ = _day_graphs(spark, sf_dir)
    first = nodes.groupBy(F.substring_index("graph", ":", 1).alias("selector")).agg(F.min("graph").alias("graph"))
    kinds = first.join(nodes, "graph").groupBy("selector").agg(F.array_join(F.array_sort(F.collect_set("node")), ",").alias("kinds")).select("kinds").distinct()
    wanted = kinds.select(F.col("kinds").alias("selector"), F.explode(F.split("kinds", ",")).alias("item"))
    return resolve.containing(wanted, nodes.select(F.col("graph").alias("workload"), F.col("node").alias("item")))


def ag11_strongest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer and status, the most urgent order, the earliest key of equals."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_orderpriority", (-F.substring("o_orderpriority", 1, 1).cast("int")).alias("rank"))
    return resolve.strongest(orders, ["o_custkey", "o_orderstatus"], "rank", "o_orderkey")


def wn10_lines_after_short_ones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with text whose last line with text before has no more than 40 characters."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    short = F.last(F.when(F.trim("line") != "", F.length("line") <= 40), ignorenulls=True).over(before)
    marked = lines.select("doc_id", F.col("pos").cast("long").alias("pos"), F.trim("line").alias("t"), short.alias("after_short"))
    return marked.where("t != '' AND after_short").select("doc_id", "pos")


QUERIES = {f.__name__: f for f in (
    ag1_fan_in_out,
    gr1_edge_counts,
    gr15_isolated_customers,
    wn11_first_event,
    ag6_kind_counts,
    se4_terminal_states,
    so3_largest_documents,
    ag13_group_by_scope,
    ag7_state_statistics,
    rn7_state_diagrams,
    gr5_reachable,
    gr6_simple_cycles,
    gr7_strong_components,
    gr9_weak_components,
    j2_resolved_calls,
    j1_resolved_classes,
    j6_resolved_imports,
    j10_called_by,
    j11_selected_workloads,
    ag11_strongest_orders,
    wn10_lines_after_short_ones,
)}

_FAN = f"{STEPS}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), f AS (SELECT node, (SELECT count(DISTINCT src) FROM e WHERE dst = node) AS fan_in, (SELECT count(DISTINCT dst) FROM e WHERE src = node) AS fan_out FROM n)"
ORACLE_SQL = {
    "ag1_fan_in_out": f"{_FAN} SELECT node, fan_in, fan_out FROM f",
    "gr1_edge_counts": f"{STEPS} SELECT src, dst, count(*) AS n FROM e GROUP BY src, dst",
    "gr15_isolated_customers": "SELECT c_custkey::VARCHAR AS node FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')",
    "wn11_first_event": f"{STEPS} SELECT src, dst, min(event_id) AS event_id FROM e GROUP BY src, dst",
    "ag6_kind_counts": "SELECT user_id, count(*) AS n_events, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS n_{k}" for k in ("click", "error", "login", "purchase", "view")) + " FROM events GROUP BY user_id",
    "so3_largest_documents": "SELECT doc_id, length(text) AS chars FROM documents ORDER BY chars DESC, doc_id LIMIT 12",
    "ag13_group_by_scope": "SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id",
}

_DAYS = "WITH RECURSIVE v AS (SELECT *, user_id::VARCHAR || ':' || strftime(ts, '%Y-%m-%d') AS graph FROM events), nx AS (SELECT graph, event_type AS src, event_id AS pos, value, lead(event_type) OVER w AS dst, lead(value) OVER w AS nxt FROM v WINDOW w AS (PARTITION BY graph ORDER BY ts, event_id)), e0 AS (SELECT graph, src, dst, pos FROM nx WHERE dst IS NOT NULL AND nxt > value), n AS (SELECT DISTINCT graph, event_type AS node FROM v), e AS (SELECT DISTINCT graph, src, dst FROM e0)"
_STRONG = f"{_DAYS}, reach AS (SELECT graph, node AS a, node AS b FROM n UNION SELECT r.graph, r.a, e.dst FROM reach r JOIN e ON r.graph = e.graph AND r.b = e.src), scc AS (SELECT x.graph, x.a AS node, max(x.b) AS component, count(*) > 1 OR max(CASE WHEN o.src IS NOT NULL THEN 1 ELSE 0 END) = 1 AS cyclic FROM reach x JOIN reach y ON x.graph = y.graph AND x.a = y.b AND x.b = y.a LEFT JOIN e o ON o.graph = x.graph AND o.src = x.a AND o.dst = x.a GROUP BY x.graph, x.a)"
_SIMPLE = "replace(p_name, ' ', '_') || '_' || p_size::VARCHAR"
_REFS = f"WITH k AS (SELECT p_type || '.' || {_SIMPLE} AS name FROM part), refs AS (SELECT p_partkey, p_type AS owner, CASE WHEN p_brand < 'Brand#13' THEN {_SIMPLE} WHEN p_brand < 'Brand#17' THEN 'self.' || {_SIMPLE} WHEN p_brand < 'Brand#2' THEN p_type || '.' || {_SIMPLE} ELSE p_brand || '.' || {_SIMPLE} || '.call' END AS raw FROM part), u AS (SELECT regexp_replace(name, '^.*\\.', '') AS simple, min(name) AS name FROM k GROUP BY 1 HAVING count(*) = 1), t AS (SELECT p_partkey, owner, raw, CASE WHEN raw IN (SELECT name FROM k) THEN raw WHEN raw LIKE 'self.%' AND owner || substr(raw, 5) IN (SELECT name FROM k) THEN owner || substr(raw, 5) WHEN NOT contains(raw, '.') THEN coalesce((SELECT name FROM u WHERE simple = raw), raw) ELSE raw END AS target FROM refs)"
ORACLE_SQL |= {
    "gr5_reachable": f"{_DAYS}, d AS (SELECT graph, node AS root, node, 0 AS depth FROM n WHERE node = 'view' UNION SELECT d.graph, d.root, e.dst, d.depth + 1 FROM d JOIN e ON e.graph = d.graph AND e.src = d.node WHERE d.depth < 3) SELECT graph, root, node, min(depth) AS depth FROM d GROUP BY graph, root, node",
    "gr6_simple_cycles": f"{_DAYS}, p AS (SELECT graph, [src, dst] AS path FROM e WHERE src <= dst UNION ALL SELECT p.graph, list_append(p.path, e.dst) FROM p JOIN e ON e.graph = p.graph AND e.src = p.path[-1] WHERE p.path[1] != p.path[-1] AND (e.dst = p.path[1] OR (e.dst > p.path[1] AND NOT list_contains(p.path, e.dst)))) SELECT graph, array_to_string(path, '>') AS cycle FROM p WHERE path[1] = path[-1]",
    "gr7_strong_components": f"{_STRONG} SELECT graph, node, component, cyclic FROM scc",
    "se4_terminal_states": f"{_DAYS} SELECT graph, dst AS state FROM e EXCEPT SELECT graph, src FROM e",
    "rn7_state_diagrams": f"{_DAYS}, mv AS (SELECT graph, src, dst, count(*) AS n, min(pos) AS pos FROM e0 GROUP BY graph, src, dst), ln AS (SELECT graph, 0 AS part, 0 AS pos, '' AS x, '    %% ' || graph || '.event : Type' || chr(10) || '    [*] --> ' || min_by(src, pos) AS line FROM e0 GROUP BY graph UNION ALL SELECT graph, 2, pos, src || chr(1) || dst, '    ' || src || ' --> ' || dst || ': x' || n || CASE WHEN n > 1 THEN ' [often]' ELSE '' END FROM mv UNION ALL SELECT graph, 3, 0, dst, '    ' || dst || ' --> [*]' FROM (SELECT graph, dst FROM e EXCEPT SELECT graph, src FROM e)) SELECT graph, 'stateDiagram-v2' || chr(10) || string_agg(line, chr(10) ORDER BY part, pos, x) || chr(10) AS text FROM ln GROUP BY graph",
    "ag7_state_statistics": f"{_DAYS} SELECT n.graph, count(*) AS states, (SELECT count(*) FROM e WHERE e.graph = n.graph) AS transitions FROM n GROUP BY n.graph",
    "gr9_weak_components": f"{_DAYS}, uu AS (SELECT graph, src AS a, dst AS b FROM e UNION SELECT graph, dst, src FROM e), w AS (SELECT graph, node AS a, node AS b FROM n UNION SELECT w.graph, w.a, uu.b FROM w JOIN uu ON uu.graph = w.graph AND uu.a = w.b) SELECT graph, a AS node, min(b) AS component FROM w GROUP BY graph, a",
    "j2_resolved_calls": f"{_REFS} SELECT p_partkey, raw, target FROM t",
    "j1_resolved_classes": f"{_REFS}, kd AS (SELECT DISTINCT name FROM k), ud AS (SELECT regexp_replace(name, '^.*\\.', '') AS simple, min(name) AS name FROM kd GROUP BY 1 HAVING count(*) = 1), c AS (SELECT DISTINCT raw, string_split(raw, '.') AS p FROM refs), x AS (SELECT raw, p, unnest(range(1, len(p) + 1)) AS i FROM c), y AS (SELECT raw, i, coalesce(kd.name, ud.name) AS target FROM x LEFT JOIN kd ON kd.name = array_to_string(p[1:i], '.') LEFT JOIN ud ON ud.simple = p[i]), b AS (SELECT raw, max_by(target, i) AS target FROM y WHERE target IS NOT NULL GROUP BY raw) SELECT p_partkey, refs.raw AS ref, b.target FROM refs LEFT JOIN b ON b.raw = refs.raw",
    "j6_resolved_imports": "WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS ref FROM pages), k AS (SELECT DISTINCT regexp_replace(ref, '[/?#][^/?#]*$', '') AS name FROM p), x AS (SELECT page_id, ref, string_split(ref, '/') AS s, unnest(range(1, len(string_split(ref, '/')) + 1)) AS i FROM p), b AS (SELECT page_id, max_by(k.name, i) AS target FROM x JOIN k ON k.name = array_to_string(s[1:i], '/') GROUP BY page_id) SELECT p.page_id, p.ref, b.target FROM p LEFT JOIN b ON b.page_id = p.page_id",
    "j10_called_by": f"{_REFS} SELECT target AS name, string_agg(DISTINCT owner, ',' ORDER BY owner) AS callers FROM t GROUP BY target",
    "j11_selected_workloads": f"{_DAYS}, f AS (SELECT split_part(graph, ':', 1) AS u, min(graph) AS graph FROM n GROUP BY 1), kk AS (SELECT DISTINCT (SELECT list_sort(list(node)) FROM n WHERE n.graph = f.graph) AS ks FROM f), lb AS (SELECT graph, list(node) AS ls FROM n GROUP BY graph) SELECT array_to_string(ks, ',') AS selector, graph AS workload FROM kk JOIN lb ON list_has_all(ls, ks)",
    "ag11_strongest_orders": "SELECT o_custkey, o_orderstatus, o_orderkey, o_orderpriority, -(substr(o_orderpriority, 1, 1)::INT) AS rank FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY rank DESC, o_orderkey) = 1",
    "wn10_lines_after_short_ones": "WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM s), m AS (SELECT doc_id, pos, trim(line) AS t, last_value(CASE WHEN trim(line) != '' THEN length(line) <= 40 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after_short FROM l) SELECT doc_id, pos FROM m WHERE t != '' AND after_short",
}

for _module in (module_queries, text_queries, document_queries, source_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
