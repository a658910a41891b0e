"""Registered queries over the customers' modules (see sources/facts.py), with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetgraph.functions import names, text
from facetgraph.operators import bundles, partition, quality, relations, render, traverse, workflows
from facetgraph.sources import facts, modules
from facetgraph.sources.scratch import Scratch, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, given: str = ""):
    """Registers a query with its SQL, which may read the tables of FACTS_SQL and those of `given`."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {facts.FACTS_SQL}{', ' if given else ''}{given}\n{sql}"
        return f

    return register


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.order_lines(spark, sf_dir)


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return facts.order_graph(_lines(spark, sf_dir))


# --- resolved names -----------------------------------------------------------------

_CALLABLE = """
uq AS (SELECT graph, name, min(qualified) AS one FROM mth GROUP BY graph, name HAVING count(*) = 1),
rc AS (
  SELECT cal.graph, caller, cal.parent, raw, cal.pos,
         CASE WHEN e.qualified IS NOT NULL THEN raw WHEN o.qualified IS NOT NULL THEN o.qualified ELSE coalesce(uq.one, raw) END AS target
  FROM cal LEFT JOIN mth e ON e.graph = cal.graph AND e.qualified = raw
  LEFT JOIN mth o ON o.graph = cal.graph AND raw LIKE 'self.%' AND o.qualified = cal.parent || substr(raw, 5)
  LEFT JOIN uq ON uq.graph = cal.graph AND uq.name = raw
)
""".strip()


@query("SELECT graph, caller AS src, target AS dst, raw, pos FROM rc", _CALLABLE)
def wn1_call_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return relations.call_sequences(facts.calls(lines), facts.methods(lines))


@query("SELECT graph, caller AS src, target AS dst, min(pos) AS pos FROM rc WHERE (graph, target) IN (SELECT (graph, qualified) FROM mth) GROUP BY graph, caller, target", _CALLABLE)
def gr20_sequence_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    methods = facts.methods(lines)
    return relations.sequence_graph(relations.call_sequences(facts.calls(lines), methods), methods)[1]


_HANDLED = """
uq AS (SELECT graph, name, min(qualified) AS one FROM mth GROUP BY graph, name HAVING count(*) = 1),
hd AS (
  SELECT inp.graph, scope, component, handler, inp.pos, CASE WHEN o.qualified IS NOT NULL THEN o.qualified ELSE coalesce(uq.one, handler) END AS callable
  FROM inp LEFT JOIN mth o ON o.graph = inp.graph AND handler LIKE 'self.%' AND o.qualified = scope || substr(handler, 5)
  LEFT JOIN uq ON uq.graph = inp.graph AND uq.name = handler
)
""".strip()


@query("SELECT hd.graph, scope, component, handler, callable, (hd.graph, callable) IN (SELECT (graph, qualified) FROM mth) AS known FROM hd", _HANDLED)
def j3_use_case_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return relations.use_cases(facts.input_events(lines), facts.methods(lines)).select("graph", "scope", "component", "handler", "callable", "known")


@query("SELECT graph, count(*) AS use_case_count, count(DISTINCT scope) AS diagram_count, count(*) FILTER (WHERE callable = handler AND callable NOT IN (SELECT caller FROM rc2 WHERE rc2.graph = hd.graph)) AS unresolved_count FROM hd GROUP BY graph", _HANDLED + ", rc2 AS (SELECT DISTINCT graph, caller FROM cal)")
def ag8_use_case_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use cases, diagrams (one a scope) and those whose handler neither resolves nor calls anything."""
    lines = _lines(spark, sf_dir)
    events = relations.use_cases(facts.input_events(lines), facts.methods(lines))
    calling = facts.calls(lines).select("graph", F.col("caller").alias("callable"), F.lit(True).alias("calls")).distinct()
    events = events.join(calling, ["graph", "callable"], "left")
    return events.groupBy("graph").agg(F.count("*").alias("use_case_count"), F.countDistinct("scope").alias("diagram_count"), F.count_if((F.col("callable") == F.col("handler")) & F.col("calls").isNull()).alias("unresolved_count"))


_STATIC = """
lk AS (SELECT graph, name AS last, qualified FROM mth UNION SELECT graph, qualified, qualified FROM mth),
sr AS (SELECT DISTINCT graph, caller, parent, raw, string_split(raw, '.')[-1] AS last, len(string_split(raw, '.')) > 1 AND string_split(raw, '.')[1] IN ('self', 'cls', parent) AS owned FROM cal),
st AS (
  SELECT sr.graph, caller, sr.parent, raw, sr.last, max(o.qualified) AS own, count(DISTINCT lk.qualified) AS n, min(lk.qualified) AS one,
         count(DISTINCT lk.qualified) FILTER (WHERE starts_with(lk.qualified, sr.parent || '.')) AS n_near, min(lk.qualified) FILTER (WHERE starts_with(lk.qualified, sr.parent || '.')) AS near
  FROM sr LEFT JOIN mth o ON o.graph = sr.graph AND owned AND o.qualified = sr.parent || '.' || sr.last LEFT JOIN lk ON lk.graph = sr.graph AND lk.last = sr.last GROUP BY ALL
), sx AS (SELECT DISTINCT graph, caller, CASE WHEN own IS NOT NULL THEN own WHEN n = 1 THEN one WHEN n_near = 1 THEN near END AS target FROM st)
""".strip()


@query("SELECT graph, caller, target FROM sx WHERE target IS NOT NULL", _STATIC)
def j4_static_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return relations.static_calls(facts.calls(lines), facts.methods(lines))


@query("SELECT m.graph, m.qualified, m.visibility, coalesce(string_agg(DISTINCT a.target, ',' ORDER BY a.target), '') AS calls, coalesce(string_agg(DISTINCT b.caller, ',' ORDER BY b.caller), '') AS called_by FROM mth m LEFT JOIN sx a ON a.graph = m.graph AND a.caller = m.qualified LEFT JOIN sx b ON b.graph = m.graph AND b.target = m.qualified GROUP BY ALL", _STATIC)
def gn13_static_specification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods with what they call and what calls them, sorted."""
    lines = _lines(spark, sf_dir)
    known = relations.static_calls(facts.calls(lines), facts.methods(lines))
    shown = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = known.groupBy("graph", F.col("caller").alias("qualified")).agg(shown("target").alias("calls"))
    back = known.groupBy("graph", F.col("target").alias("qualified")).agg(shown("caller").alias("called_by"))
    rows = facts.methods(lines).join(out, ["graph", "qualified"], "left").join(back, ["graph", "qualified"], "left")
    return rows.select("graph", "qualified", "visibility", F.coalesce("calls", F.lit("")).alias("calls"), F.coalesce("called_by", F.lit("")).alias("called_by"))


# --- relation graphs ----------------------------------------------------------------

_CLASSES = """
rf AS (SELECT graph, name AS src, pos, unnest(bases) AS ref, 'inheritance' AS relation FROM cls UNION ALL SELECT graph, parent, pos, raw, 'uses' FROM cal),
rx AS (SELECT graph, ref, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT DISTINCT graph, ref, string_split(ref, '.') AS ps FROM rf)),
rz AS (
  SELECT rx.graph, ref, max_by(coalesce(a.name, b.name), i) AS target
  FROM rx LEFT JOIN cls a ON a.graph = rx.graph AND a.name = array_to_string(ps[1:i], '.') LEFT JOIN cls b ON b.graph = rx.graph AND b.name = ps[i]
  WHERE coalesce(a.name, b.name) IS NOT NULL GROUP BY rx.graph, ref
), c0 AS (
  SELECT rf.graph, src, coalesce(target, CASE WHEN relation = 'inheritance' THEN rf.ref END) AS dst, relation, pos FROM rf LEFT JOIN rz ON rz.graph = rf.graph AND rz.ref = rf.ref
), ce AS (SELECT graph, src, dst, relation, min(pos) AS pos FROM c0 WHERE dst IS NOT NULL AND dst <> src GROUP BY graph, src, dst, relation), cn AS (SELECT graph, name AS node FROM cls UNION SELECT graph, dst FROM ce WHERE relation = 'inheritance')
""".strip()


def _class_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    with Scratch(spark, "lines") as scratch:
        lines = scratch.write(_lines(spark, sf_dir), "lines")
        return relations.class_graph(facts.classes(lines), facts.methods(lines), facts.calls(lines))


@query("SELECT graph, src, dst, relation, pos FROM ce", _CLASSES)
def gr16_class_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _class_graph(spark, sf_dir)[1].select("graph", "src", "dst", "relation", "pos")


@query("SELECT graph, src, dst FROM ce WHERE relation = 'inheritance'", _CLASSES)
def pf5_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of one kind, chosen after all were built."""
    return _class_graph(spark, sf_dir)[1].where("relation = 'inheritance'").select("graph", "src", "dst")


_OBJECTS = """
ok_ AS (SELECT *, coalesce(scope, '<module>') || ':' || name AS key FROM obj),
o1 AS (SELECT graph, name, min(key) AS key FROM ok_ GROUP BY graph, name HAVING count(*) = 1),
oj AS (
  SELECT DISTINCT r.graph, r.key AS src, coalesce(i.key, o1.key) AS dst, r.label
  FROM ok_ r LEFT JOIN (SELECT DISTINCT graph, scope, name, key FROM ok_) i ON i.graph = r.graph AND i.name = r.target AND i.scope IS NOT DISTINCT FROM r.scope
  LEFT JOIN o1 ON o1.graph = r.graph AND o1.name = r.target WHERE r.target IS NOT NULL
)
""".strip()


@query("SELECT graph, src, dst, label FROM oj WHERE dst IS NOT NULL", _OBJECTS)
def gr17_object_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.object_graph(facts.objects(_lines(spark, sf_dir)))[1]


_MODULES = """
im AS (SELECT DISTINCT graph, module, component, reference FROM imp),
lv AS (SELECT *, length(reference) - length(ltrim(reference, '.')) AS lvl, string_split(module, '.') AS mp FROM im WHERE reference IS NOT NULL),
cd AS (SELECT *, string_split(CASE lvl WHEN 0 THEN reference ELSE array_to_string(mp[1:len(mp) - lvl], '.') || '.' || ltrim(reference, '.') END, '.') AS cp FROM lv),
cx AS (SELECT graph, module, component, reference, cp, unnest(range(1, len(cp) + 1)) AS i FROM cd),
mr AS (SELECT cx.graph, cx.module, reference, max_by(k.module, i) AS target FROM cx JOIN (SELECT DISTINCT graph, module FROM im) k ON k.graph = cx.graph AND k.module = array_to_string(cp[1:i], '.') GROUP BY ALL),
ms AS (SELECT im.*, mr.target FROM im LEFT JOIN mr ON mr.graph = im.graph AND mr.module = im.module AND mr.reference = im.reference)
""".strip()


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.imports(spark, sf_dir, _lines(spark, sf_dir))


@query("SELECT DISTINCT graph, module AS src, target AS dst FROM ms WHERE target <> module", _MODULES)
def gr18_package_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.package_graph(_imports(spark, sf_dir))[1]


_COMPONENTS = _MODULES + """,
hm AS (SELECT DISTINCT graph, module, component FROM im),
cg AS (
  SELECT DISTINCT ms.graph, ms.component AS src,
         CASE WHEN ms.target IS NOT NULL THEN hm.component WHEN starts_with(reference, '.') OR split_part(reference, '.', 1) IN (SELECT component FROM hm q WHERE q.graph = ms.graph) THEN NULL ELSE 'external:' || split_part(reference, '.', 1) END AS dst
  FROM ms LEFT JOIN hm ON hm.graph = ms.graph AND hm.module = ms.target WHERE reference IS NOT NULL
)"""


@query("SELECT graph, src, dst FROM cg WHERE dst IS NOT NULL AND src <> dst", _COMPONENTS)
def gr19_component_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.component_graph(_imports(spark, sf_dir))[1]


@query("SELECT graph, 'component:' || src AS source, CASE WHEN starts_with(dst, 'external:') THEN dst ELSE 'component:' || dst END AS target, 'imports' AS relation, 'inferred' AS confidence FROM cg WHERE dst IS NOT NULL AND src <> dst", _COMPONENTS)
def gr21_inferred_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.deployment_topology(*relations.component_graph(_imports(spark, sf_dir)))[1]


@query("SELECT n.graph, count(*) FILTER (WHERE NOT external) AS internal_count, count(*) FILTER (WHERE external) AS external_count, count(*) FILTER (WHERE node NOT IN (SELECT unnest([src, dst]) FROM cg WHERE cg.graph = n.graph AND dst IS NOT NULL AND src <> dst)) AS isolated_count FROM (SELECT DISTINCT graph, component AS node, false AS external FROM im UNION SELECT graph, dst, true FROM cg WHERE starts_with(dst, 'external:')) n GROUP BY n.graph", _COMPONENTS)
def ag10_external_and_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of each module's graph: internal ones, external ones, and those without relations."""
    nodes, edges = relations.component_graph(_imports(spark, sf_dir))
    ends = edges.select("graph", F.explode(F.array("src", "dst")).alias("node"), F.lit(True).alias("bound")).distinct()
    rows = nodes.join(ends, ["graph", "node"], "left")
    return rows.groupBy("graph").agg(F.count_if(~F.col("external")).alias("internal_count"), F.count_if("external").alias("external_count"), F.count_if(F.col("bound").isNull()).alias("isolated_count"))


# --- the order graph and its series ------------------------------------------------------

_SPLIT = """
fi AS (SELECT graph, dst AS node, count(DISTINCT src) AS k FROM oe GROUP BY graph, dst),
mk AS (SELECT n.graph, n.node, coalesce(k, 0) >= 3 AS shared FROM onode n LEFT JOIN fi ON fi.graph = n.graph AND fi.node = n.node),
re AS (SELECT oe.graph, oe.src, oe.dst FROM oe JOIN mk a ON a.graph = oe.graph AND a.node = oe.src AND NOT a.shared JOIN mk b ON b.graph = oe.graph AND b.node = oe.dst AND NOT b.shared),
deg AS (
  SELECT m.graph, m.node, (SELECT count(*) FROM re WHERE re.graph = m.graph AND re.dst = m.node) AS n_in, (SELECT count(*) FROM re WHERE re.graph = m.graph AND re.src = m.node) AS n_out,
         (SELECT count(DISTINCT dst) FROM re WHERE re.graph = m.graph AND re.src = m.node) AS fan_out, (SELECT min(src) FROM re WHERE re.graph = m.graph AND re.dst = m.node) AS above
  FROM mk m WHERE NOT m.shared
), uu AS (SELECT graph, src AS a, dst AS b FROM re UNION SELECT graph, dst, src FROM re),
wk AS (SELECT graph, node AS a, node AS b FROM deg UNION SELECT wk.graph, wk.a, uu.b FROM wk JOIN uu ON uu.graph = wk.graph AND uu.a = wk.b),
wc AS (SELECT graph, a AS node, min(b) AS comp FROM wk GROUP BY graph, a),
rt AS (SELECT wc.graph, comp, coalesce(min(wc.node) FILTER (WHERE n_in = 0), min(wc.node)) AS root, count(*) AS n FROM wc JOIN deg ON deg.graph = wc.graph AND deg.node = wc.node GROUP BY wc.graph, comp),
hd AS (SELECT d.graph, d.node AS head FROM deg d JOIN deg p ON p.graph = d.graph AND p.node = d.above AND p.fan_out >= 2 WHERE d.n_in = 1),
rr AS (SELECT graph, head, head AS node FROM hd UNION SELECT rr.graph, rr.head, re.dst FROM rr JOIN re ON re.graph = rr.graph AND re.src = rr.node),
br AS (
  SELECT rr.graph, rr.head, count(*) AS n FROM rr JOIN deg ON deg.graph = rr.graph AND deg.node = rr.node JOIN wc ON wc.graph = rr.graph AND wc.node = rr.head JOIN rt ON rt.graph = rr.graph AND rt.comp = wc.comp
  GROUP BY rr.graph, rr.head, rt.n HAVING sum(n_in - n_out) = 1 AND count(*) >= 3 AND count(*) < rt.n
), ow AS (SELECT rr.graph, rr.node, list(rr.head ORDER BY br.n, rr.head) AS around FROM rr JOIN br ON br.graph = rr.graph AND br.head = rr.head GROUP BY rr.graph, rr.node),
se AS (
  SELECT mk.graph, mk.node, mk.shared, CASE WHEN NOT mk.shared THEN coalesce(around[1], root) END AS series, CASE WHEN NOT mk.shared THEN coalesce(len(around), 0) END AS depth,
         CASE WHEN len(around) > 0 THEN coalesce(around[2], root) END AS parent
  FROM mk LEFT JOIN ow ON ow.graph = mk.graph AND ow.node = mk.node LEFT JOIN wc ON wc.graph = mk.graph AND wc.node = mk.node LEFT JOIN rt ON rt.graph = mk.graph AND rt.comp = wc.comp
), pe AS (
  SELECT oe.graph, oe.src, oe.dst, oe.pos, a.series AS src_series, b.series AS dst_series, a.shared AS src_shared, b.shared AS dst_shared
  FROM oe JOIN se a ON a.graph = oe.graph AND a.node = oe.src JOIN se b ON b.graph = oe.graph AND b.node = oe.dst
), sz AS (SELECT graph, series, count(*) AS n, max(depth) AS depth FROM se GROUP BY graph, series),
sn AS (
  SELECT graph, CAST(sum(n) AS BIGINT) AS node_count, count(series) AS series_count, coalesce(max(n) FILTER (WHERE series IS NOT NULL), 0) AS max_nodes_per_series,
         coalesce(avg(n) FILTER (WHERE series IS NOT NULL), 0) AS avg_nodes_per_series, CAST(coalesce(max(depth), 0) AS BIGINT) AS max_partition_depth,
         CAST(coalesce(sum(n) FILTER (WHERE series IS NULL), 0) AS BIGINT) AS shared_node_count FROM sz GROUP BY graph
), sp AS (
  SELECT graph, count(*) AS edge_count, count(*) FILTER (WHERE NOT src_shared AND NOT dst_shared) AS regular_edge_count,
         count(*) FILTER (WHERE NOT src_shared AND NOT dst_shared AND src_series <> dst_series) AS cross_series_edge_count FROM pe GROUP BY graph
), ps AS (
  SELECT sn.*, shared_node_count::DOUBLE / node_count AS shared_node_ratio, edge_count, regular_edge_count, cross_series_edge_count,
         CASE WHEN regular_edge_count = 0 THEN 0.0::DOUBLE ELSE cross_series_edge_count::DOUBLE / regular_edge_count END AS cross_series_edge_ratio
  FROM sn JOIN sp ON sp.graph = sn.graph
)
""".strip()


_NUMBERED = _SPLIT + """,
st AS (SELECT graph, root AS start FROM rt UNION SELECT graph, head FROM br),
dd AS (SELECT graph, start, start AS node, 0 AS d FROM st UNION SELECT dd.graph, dd.start, re.dst, dd.d + 1 FROM dd JOIN re ON re.graph = dd.graph AND re.src = dd.node),
dm AS (SELECT graph, start, node, min(d) AS d FROM dd GROUP BY ALL),
hp AS (
  SELECT s.graph, wc.comp, s.series, s.depth, s.parent, {'d': coalesce(dm.d, rt.n + 1), 'p': deg.above, 'h': s.series} AS place
  FROM se s JOIN wc ON wc.graph = s.graph AND wc.node = s.node JOIN rt ON rt.graph = s.graph AND rt.comp = wc.comp JOIN deg ON deg.graph = s.graph AND deg.node = s.node
  JOIN ow ON ow.graph = s.graph AND ow.node = s.node LEFT JOIN dm ON dm.graph = s.graph AND dm.start = coalesce(ow.around[2], rt.root) AND dm.node = deg.above WHERE s.depth > 0 AND s.node = s.series
), wy AS (
  SELECT graph, comp, root AS series, 0::BIGINT AS depth, []::STRUCT(d BIGINT, p VARCHAR, h VARCHAR)[] AS way FROM rt
  UNION ALL SELECT hp.graph, hp.comp, hp.series, hp.depth, list_append(wy.way, hp.place) FROM wy JOIN hp ON hp.graph = wy.graph AND hp.comp = wy.comp AND hp.parent = wy.series AND hp.depth = wy.depth + 1
), nu AS (SELECT graph, comp, series, depth, row_number() OVER (PARTITION BY graph ORDER BY comp, way) AS number FROM wy),
sk AS (SELECT se.*, nu.number FROM se LEFT JOIN wc ON wc.graph = se.graph AND wc.node = se.node LEFT JOIN nu ON nu.graph = se.graph AND nu.comp = wc.comp AND nu.series = se.series AND nu.depth = se.depth)"""


@query("SELECT graph, node, shared, series, CAST(depth AS BIGINT) AS depth, parent, number FROM sk", _NUMBERED)
def gr12_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = partition.partition(*_orders(spark, sf_dir))
    return out.withColumns({c: F.col(c).cast("long") for c in ("depth", "number")})


@query("SELECT graph, src, dst, pos, src_series, dst_series, src_shared, dst_shared FROM pe WHERE src_shared OR dst_shared OR src_series <> dst_series", _SPLIT)
def gr14_boundary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _orders(spark, sf_dir)
    return partition.boundary_edges(partition.partition(nodes, edges), edges)


@query("SELECT graph, node_count, series_count, max_nodes_per_series, avg_nodes_per_series, max_partition_depth, shared_node_count, shared_node_ratio, edge_count, regular_edge_count, cross_series_edge_count, cross_series_edge_ratio FROM ps", _SPLIT)
def ag4_series_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _orders(spark, sf_dir)
    return partition.partition_statistics(partition.partition(nodes, edges), edges)


@query("SELECT se.graph, series, root_edges.dst AS entered_from FROM (SELECT DISTINCT graph, series FROM se WHERE depth > 0) se JOIN (SELECT graph, dst AS head, src AS dst FROM re) root_edges ON root_edges.graph = se.graph AND root_edges.head = se.series", _SPLIT)
def gr13_series_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each branch is entered: the one edge that leads to its root."""
    nodes, edges = _orders(spark, sf_dir)
    members = partition.partition(nodes, edges)
    inner = partition.placed_edges(members, edges).where("NOT src_shared AND NOT dst_shared AND src_series != dst_series AND dst = dst_series")
    heads = members.where("depth > 0").select("graph", F.col("series").alias("dst")).distinct()
    return inner.join(heads, ["graph", "dst"], "left_semi").select("graph", F.col("dst").alias("series"), F.col("src").alias("entered_from"))


@query("SELECT graph, array_to_string(list(i ORDER BY i), ',') AS fan_in, array_to_string(list(o ORDER BY o), ',') AS fan_out FROM (SELECT graph, node, (SELECT count(DISTINCT src) FROM oe WHERE oe.graph = n.graph AND oe.dst = n.node) AS i, (SELECT count(DISTINCT dst) FROM oe WHERE oe.graph = n.graph AND oe.src = n.node) AS o FROM onode n) GROUP BY graph")
def ag2_degree_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.degree_distributions(*_orders(spark, sf_dir)).select("graph", F.array_join("fan_in", ",").alias("fan_in"), F.array_join("fan_out", ",").alias("fan_out"))


@query("SELECT graph, dst AS node, count(DISTINCT src) AS fan_in FROM oe GROUP BY graph, dst HAVING count(DISTINCT src) >= 3")
def gr4_high_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.high_fan_in(*_orders(spark, sf_dir))


@query("SELECT graph, 'C' AS root, node, CAST(min(d) AS BIGINT) AS depth FROM r GROUP BY graph, node", "r AS (SELECT graph, node, 0 AS d FROM onode WHERE node = 'C' UNION SELECT r.graph, oe.dst, d + 1 FROM r JOIN oe ON oe.graph = r.graph AND oe.src = r.node)")
def gr10_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all that a customer leads to, without a bound."""
    nodes, edges = _orders(spark, sf_dir)
    return traverse.reachable(nodes.where("node = 'C'"), edges).withColumn("depth", F.col("depth").cast("long"))


@query("SELECT DISTINCT graph, root, node FROM r", "r AS (SELECT graph, node AS root, node FROM onode WHERE node LIKE 'O%' UNION SELECT r.graph, r.root, oe.dst FROM r JOIN oe ON oe.graph = r.graph AND oe.src = r.node)")
def gr11_reachable_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order leads to, itself included."""
    nodes, edges = _orders(spark, sf_dir)
    return traverse.reachable(nodes.where("node LIKE 'O%'"), edges).select("graph", "root", "node")


@query("SELECT graph, src, dst, pos FROM oe WHERE src = 'C'")
def pf3_outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outgoing edges of one node of each graph."""
    return _orders(spark, sf_dir)[1].where("src = 'C'")


@query("SELECT graph, parent, name, visibility FROM mth WHERE visibility IN ('public', 'unspecified')")
def pf4_visible_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods that are public, or whose visibility is not stated."""
    return facts.methods(_lines(spark, sf_dir)).where("visibility IN ('public', 'unspecified')").select("graph", "parent", "name", "visibility")


@query("SELECT graph, (SELECT count(*) FROM cls c WHERE c.graph = m.graph) AS classes, count(*) AS functions FROM mth m GROUP BY graph")
def pf1_classes_and_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    kinds = facts.classes(lines).select("graph", F.lit("class").alias("kind")).union(facts.methods(lines).select("graph", F.lit("method")))
    return kinds.groupBy("graph").agg(F.count_if(F.col("kind") == "class").alias("classes"), F.count_if(F.col("kind").isin("function", "method")).alias("functions"))


# --- metrics and findings --------------------------------------------------------------

_METRIC_VALUES = ", ".join(f"('{m}', {c})" for m, c in [(m, "0" if m in ("strongly_connected_component_count", "largest_scc_size", "cycle_count") else m) for m in quality.METRICS])


@query(f"SELECT graph, 'call_graph' AS scope, m.metric, CAST(m.value AS DOUBLE) AS value FROM ps, LATERAL (VALUES {_METRIC_VALUES}) m(metric, value)", _SPLIT)
def ev1_order_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirteen metrics of order graphs, which have no cycles."""
    return quality.design_metrics(*_orders(spark, sf_dir), "call_graph")


@query()
def ev1_design_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings on the modules' call graphs and class graphs; tests hold it against a plain version."""
    with Scratch(spark, "lines") as scratch:
        lines = scratch.write(_lines(spark, sf_dir), "lines")
        methods = facts.methods(lines)
        calls = relations.sequence_graph(relations.call_sequences(facts.calls(lines), methods), methods)
        return quality.design_findings(calls, relations.class_graph(facts.classes(lines), methods, facts.calls(lines)))


_HUBS = """
SELECT graph, 'high-fan-in' AS code, 'info' AS severity, node AS subject, '関数・メソッドのfan-in = ' || i AS evidence FROM d WHERE i >= 3
UNION ALL SELECT graph, 'high-fan-out', 'warning', node, '関数・メソッドのfan-out = ' || o FROM d WHERE o >= 5
"""
_DEGREES = "d AS (SELECT graph, node, (SELECT count(DISTINCT src) FROM oe WHERE oe.graph = n.graph AND oe.dst = n.node) AS i, (SELECT count(DISTINCT dst) FROM oe WHERE oe.graph = n.graph AND oe.src = n.node) AS o FROM onode n)"


@query(_HUBS, _DEGREES)
def ev2_hub_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.hub_findings(*_orders(spark, sf_dir), quality.CALL_NODES).select("graph", "code", "severity", "subject", "evidence")


_CYCLES = _CLASSES + """,
ue AS (SELECT DISTINCT graph, src, dst FROM ce),
cp AS (
  SELECT graph, [src, dst] AS path FROM ue WHERE src <= dst
  UNION ALL SELECT cp.graph, list_append(cp.path, ue.dst) FROM cp JOIN ue ON ue.graph = cp.graph AND ue.src = cp.path[-1]
  WHERE cp.path[1] <> cp.path[-1] AND (ue.dst = cp.path[1] OR (ue.dst > cp.path[1] AND NOT list_contains(cp.path, ue.dst)))
), cy AS (SELECT graph, path FROM cp WHERE path[1] = path[-1])"""


@query("SELECT graph, 'class-cycle' AS code, 'warning' AS severity, array_to_string(path, ' -> ') AS subject, (len(path) - 1) || '本のedgeを持つcycleを検出しました。' AS evidence FROM cy", _CYCLES)
def ev3_class_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = traverse.simple_cycles(*_class_graph(spark, sf_dir))
    return quality.cycle_findings(cycles, "class-cycle", quality.CLASS_GRAPH).select("graph", "code", "severity", "subject", "evidence")


@query("SELECT DISTINCT graph, e.a AS src, e.b AS dst FROM (SELECT graph, unnest(list_transform(range(1, len(path)), lambda i: {'a': path[i], 'b': path[i + 1]})) AS e FROM cy)", _CYCLES)
def gr22_cycle_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.cycle_edges(traverse.simple_cycles(*_class_graph(spark, sf_dir)))


_RINGS = _CLASSES + """,
ue AS (SELECT DISTINCT graph, src, dst FROM ce),
rh AS (SELECT graph, src AS a, dst AS b FROM ue UNION SELECT rh.graph, rh.a, ue.dst FROM rh JOIN ue ON ue.graph = rh.graph AND ue.src = rh.b),
rg AS (SELECT x.graph, x.a AS node, list(DISTINCT x.b ORDER BY x.b) AS members FROM rh x JOIN rh y ON x.graph = y.graph AND x.a = y.b AND x.b = y.a GROUP BY x.graph, x.a)"""


@query("SELECT DISTINCT graph, 'strongly-connected-component' AS code, 'warning' AS severity, array_to_string(members, ', ') AS subject, '相互到達するnode数 = ' || len(members) AS evidence FROM rg", _RINGS)
def ev4_class_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = traverse.strong_components(*_class_graph(spark, sf_dir))
    return quality.component_findings(parts, quality.CLASS_GRAPH).select("graph", "code", "severity", "subject", "evidence")


@query("SELECT n.graph, n.nodes AS node_count, coalesce(e.edges, 0) AS edge_count, coalesce(c.cycles, 0) AS cycle_count FROM (SELECT graph, count(*) AS nodes FROM cn GROUP BY graph) n LEFT JOIN (SELECT graph, count(*) AS edges FROM ce GROUP BY graph) e ON e.graph = n.graph LEFT JOIN (SELECT graph, count(*) AS cycles FROM cy GROUP BY graph) c ON c.graph = n.graph", _CYCLES)
def ag3_class_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _class_graph(spark, sf_dir)
    count = lambda df, name: df.groupBy("graph").agg(F.count("*").alias(name))
    rows = count(nodes, "node_count").join(count(edges, "edge_count"), "graph", "left").join(count(traverse.simple_cycles(nodes, edges), "cycle_count"), "graph", "left")
    return rows.select("graph", "node_count", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("edge_count", "cycle_count")])


@query("SELECT graph, 'large-series' AS code, '最大partitionのnode数 = ' || max_nodes_per_series AS evidence FROM ps WHERE max_nodes_per_series >= 8 UNION ALL SELECT graph, 'shared-dependency-hubs', 'shared node = ' || shared_node_count || '; regular series = ' || series_count || '; shared比率 = ' || printf('%.1f', round(100 * shared_node_ratio, 1)) || '%' FROM ps WHERE shared_node_count > 0 AND series_count > 0 UNION ALL SELECT graph, 'cross-series-coupling', 'series境界edge = ' || cross_series_edge_count || '; 比率 = ' || printf('%.1f', round(100 * cross_series_edge_ratio, 1)) || '%' FROM ps WHERE cross_series_edge_count > 0 AND cross_series_edge_ratio >= 0.25", _SPLIT)
def ev5_series_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = quality.kept(*_orders(spark, sf_dir))
    stats = written(partition.partition_statistics(partition.partition(nodes, edges), edges), "statistics")
    return quality.partition_findings(stats, quality.CALL_GRAPH).select("graph", "code", "evidence")


# --- workflows -----------------------------------------------------------------------

_STEPS = """
sm AS (SELECT *, lower(command) SIMILAR TO '.*(test|pytest|unittest).*' AS t, lower(command) SIMILAR TO '.*(build|package|compile).*' AS b FROM stp),
jb AS (SELECT graph, job, any_value(needs) AS needs, min(i) FILTER (WHERE t) AS ft, min(i) FILTER (WHERE b) AS fb FROM sm GROUP BY graph, job),
tj AS (SELECT graph, list(job) FILTER (WHERE ft IS NOT NULL) AS tests FROM jb GROUP BY graph),
ub AS (SELECT jb.graph, job FROM jb JOIN tj ON tj.graph = jb.graph WHERE fb IS NOT NULL AND len(tests) > 0 AND NOT list_has_any(needs, tests) AND NOT coalesce(ft <= fb, false)),
rp AS (SELECT graph, trim(command) AS command, list(job ORDER BY job) AS jobs FROM stp GROUP BY ALL HAVING count(*) > 1)
""".strip()


def _workflow(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    steps = facts.workflow_steps(_lines(spark, sf_dir))
    return steps, steps.groupBy("graph", "job").agg(F.any_value("needs").alias("needs"))


@query("SELECT graph, 'missing-test' AS code, 'error' AS severity, 'No CI step appears to run tests.' AS message FROM tj WHERE tests IS NULL UNION ALL SELECT graph, 'build-without-test-dependency', 'warning', 'Build job ''' || job || ''' is not preceded by tests in the same job and does not depend on a test job.' FROM ub UNION ALL SELECT graph, 'duplicate-command', 'warning', 'Command ''' || command || ''' is repeated in jobs: ' || array_to_string(jobs, ', ') || '.' FROM rp", _STEPS)
def ev6_workflow_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflows.findings(*_workflow(spark, sf_dir))


@query("SELECT graph, job FROM ub", _STEPS)
def j17_untested_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflows.untested_builds(*_workflow(spark, sf_dir))


@query("SELECT graph, job, ft IS NOT NULL AS tests, fb IS NOT NULL AS builds, coalesce(ft <= fb, false) AS tested_first FROM jb", _STEPS)
def wn9_tests_before_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflows.test_before_build(_workflow(spark, sf_dir)[0])


@query("SELECT graph, command, array_to_string(jobs, ',') AS jobs FROM rp", _STEPS)
def ag14_repeated_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflows.repeated_commands(_workflow(spark, sf_dir)[0]).select("graph", "command", F.array_join("jobs", ",").alias("jobs"))


@query("SELECT a.graph, a.job, w.need FROM (SELECT graph, job, unnest(CASE WHEN len(needs) > 0 THEN needs ELSE [NULL] END) AS need FROM jb) w JOIN jb a ON a.graph = w.graph AND a.job = w.job JOIN jb k ON k.graph = w.graph AND k.job = w.need UNION ALL SELECT graph, job, NULL FROM jb WHERE NOT EXISTS (SELECT 1 FROM jb k WHERE k.graph = jb.graph AND list_contains(jb.needs, k.job))", _STEPS)
def j16_known_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflows.known_needs(_workflow(spark, sf_dir)[1])


# --- sequences and their text -----------------------------------------------------------

#: The resolved calls, from order to order, too.
_LINKED = _CALLABLE.replace("FROM cal LEFT JOIN", "FROM (SELECT graph, caller, parent, pos, raw FROM cal UNION ALL SELECT graph, caller, parent, pos, raw FROM lnk) cal LEFT JOIN")
_CALLS = _LINKED + """,
cq AS (SELECT graph, caller AS src, target AS dst, raw, row_number() OVER (PARTITION BY graph, caller ORDER BY pos, target, raw) AS k FROM rc),
hx AS (SELECT graph, qualified AS node FROM mth WHERE (graph, qualified) NOT IN (SELECT (graph, dst) FROM cq))"""
_MESSAGES = """,
wm AS (
  SELECT graph, node AS root, [node] AS path, []::BIGINT[] AS ord, -1 AS depth, NULL::VARCHAR AS caller, node AS callee, NULL::VARCHAR AS label, 'call' AS kind, true AS go FROM hx
  UNION ALL
  SELECT wm.graph, wm.root, list_append(wm.path, cq.dst), list_append(wm.ord, cq.k), wm.depth + 1, cq.src, cq.dst, cq.raw,
         CASE WHEN list_contains(wm.path, cq.dst) THEN 'recursive_call' WHEN wm.depth = 7 AND i.qualified IS NOT NULL THEN 'depth_truncated' ELSE 'call' END,
         wm.depth < 7 AND i.qualified IS NOT NULL AND NOT list_contains(wm.path, cq.dst)
  FROM wm JOIN cq ON cq.graph = wm.graph AND cq.src = wm.callee LEFT JOIN mth i ON i.graph = cq.graph AND i.qualified = cq.dst WHERE wm.go
), w0 AS (
  SELECT graph, root, ord, depth, caller, callee, CASE kind WHEN 'depth_truncated' THEN 'Further calls omitted: ' || label ELSE label END AS label, kind FROM wm WHERE depth >= 0
  UNION ALL SELECT wm.graph, root, list_append(ord, 2147483647), depth, callee, caller, 'return', 'return' FROM wm JOIN mth i ON i.graph = wm.graph AND i.qualified = callee WHERE depth >= 0 AND kind <> 'depth_truncated'
), ws AS (SELECT graph, root, row_number() OVER (PARTITION BY graph, root ORDER BY ord) AS position, CASE WHEN kind <> 'return' THEN array_to_string(ord, '.') END AS number, depth, caller, callee, label, kind FROM w0),
wp AS (
  SELECT graph, root, node, row_number() OVER (PARTITION BY graph, root ORDER BY w, e) AS position FROM (
    SELECT graph, root, node, min(w) AS w, min_by(e, (w, e)) AS e FROM (
      SELECT graph, root, root AS node, 0 AS w, 0 AS e FROM ws UNION ALL SELECT graph, root, caller, position, 1 FROM ws UNION ALL SELECT graph, root, callee, position, 2 FROM ws) GROUP BY graph, root, node)
)"""


_WALK = _CALLS + _MESSAGES


def _sequences(spark: SparkSession, sf_dir: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The callables that no one calls, the resolved calls, and all callables."""
    lines = scratch.write(_lines(spark, sf_dir), "lines")
    methods = facts.methods(lines)
    sequences = relations.call_sequences(facts.linked_calls(lines), methods)
    nodes = methods.select("graph", F.col("qualified").alias("node"))
    return nodes.join(sequences.select("graph", F.col("dst").alias("node")), ["graph", "node"], "left_anti"), sequences, nodes


def _messages(spark: SparkSession, sf_dir: str, once: bool = False, owners: bool = False) -> DataFrame:
    """Walks from the callables that no one calls, with returns."""
    with Scratch(spark, "lines") as scratch:
        return traverse.numbered_messages(*_sequences(spark, sf_dir, scratch), show_returns=True, once=once, owners=owners)


@query("SELECT graph, root, position, number, CAST(depth AS BIGINT) AS depth, caller, callee, label, kind FROM ws", _WALK)
def wn2_message_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("graph", "root", F.col("position").cast("long").alias("position"), "number", F.col("depth").cast("long").alias("depth"), "caller", "callee", "label", "kind")


#: The walk of wn3, a call a step: `todo` holds the calls to come, `seen` those sent.
_ONCE = _CALLS + """,
cl AS (SELECT cq.graph, src, list({'dst': dst, 'raw': raw, 'k': k, 'own': i.qualified IS NOT NULL} ORDER BY k) AS calls FROM cq LEFT JOIN mth i ON i.graph = cq.graph AND i.qualified = dst GROUP BY cq.graph, src),
wk AS (
  SELECT hx.graph, node AS root, list_transform(calls, lambda c: {'path': [node], 'ord': [c.k], 'caller': node, 'callee': c.dst, 'label': c.raw, 'kind': CASE WHEN c.dst = node THEN 'recursive_call' ELSE 'call' END, 'own': c.own}) AS todo, []::VARCHAR[] AS seen
  FROM hx JOIN cl ON cl.graph = hx.graph AND cl.src = node
  UNION ALL
  SELECT h.graph, root, list_concat(CASE WHEN fresh AND h.kind = 'call' AND h.own AND len(h.path) <= 8 AND calls IS NOT NULL THEN list_transform(calls, lambda c: {
           'path': list_append(h.path, h.callee), 'ord': list_append(h.ord, c.k), 'caller': h.callee, 'callee': c.dst,
           'label': CASE WHEN len(h.path) = 8 AND c.own AND NOT list_contains(list_append(h.path, h.callee), c.dst) THEN 'Further calls omitted: ' || c.raw ELSE c.raw END,
           'kind': CASE WHEN list_contains(list_append(h.path, h.callee), c.dst) THEN 'recursive_call' WHEN len(h.path) = 8 AND c.own THEN 'depth_truncated' ELSE 'call' END, 'own': c.own}) ELSE [] END, todo[2:]),
         CASE WHEN fresh THEN list_append(seen, sent) ELSE seen END
  FROM (SELECT *, NOT list_contains(seen, sent) AS fresh FROM (SELECT graph, root, todo, seen, todo[1].path AS path, todo[1].ord AS ord, todo[1].kind AS kind, todo[1].own AS own, todo[1].callee AS callee,
    todo[1].caller || ' ' || todo[1].callee || ' ' || todo[1].label || ' ' || todo[1].kind AS sent FROM wk WHERE len(todo) > 0)) h LEFT JOIN cl ON cl.graph = h.graph AND cl.src = h.callee
), w0 AS (
  SELECT graph, root, m.ord AS ord, m.caller AS caller, m.callee AS callee, m.label AS label, m.kind AS kind, m.own AS own FROM (
    SELECT graph, root, todo[1] AS m, seen FROM wk WHERE len(todo) > 0) WHERE NOT list_contains(seen, m.caller || ' ' || m.callee || ' ' || m.label || ' ' || m.kind)
), ws AS (SELECT graph, root, row_number() OVER (PARTITION BY graph, root ORDER BY ord) AS position, caller, callee, label, kind FROM (
  SELECT graph, root, ord, caller, callee, label, kind FROM w0 UNION ALL SELECT graph, root, list_append(ord, 2147483647), callee, caller, 'return', 'return' FROM w0 WHERE own AND kind <> 'depth_truncated'))"""


@query("SELECT graph, root, position, caller, callee, label, kind FROM ws", _ONCE)
def wn3_first_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks that send no message twice."""
    return _messages(spark, sf_dir, once=True).select("graph", "root", F.col("position").cast("long").alias("position"), "caller", "callee", "label", "kind")


@query("SELECT graph, root, node, position FROM wp", _WALK)
def wn4_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.participants(_messages(spark, sf_dir)).withColumn("position", F.col("position").cast("long"))


@query("SELECT graph, root, regexp_replace(node, '\\.[^.]*$', '') AS node, row_number() OVER (PARTITION BY graph, root ORDER BY min(position)) AS position FROM wp GROUP BY graph, root, regexp_replace(node, '\\.[^.]*$', '')", _WALK)
def wn7_communication_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = traverse.participants(_messages(spark, sf_dir, owners=True))
    return people.select("graph", "root", names.communication_name(F.col("node")).alias("node"), F.col("position").cast("long").alias("position"))


# the calls cut in the walk from any callable, then those that the given roots come to over them
_CUT = _CALLS.replace("hx AS (", "hy AS (") + ", hx AS (SELECT DISTINCT graph, src AS node FROM cq)" + _MESSAGES + """,
ct AS (SELECT DISTINCT graph, root, callee FROM ws WHERE kind = 'depth_truncated' AND (graph, callee) IN (SELECT (graph, node) FROM hx)),
co AS (SELECT graph, node FROM hy UNION SELECT ct.graph, callee FROM co JOIN ct ON ct.graph = co.graph AND ct.root = co.node)"""


@query("SELECT graph, node FROM co WHERE (graph, node) NOT IN (SELECT (graph, node) FROM hy)", _CUT)
def wn5_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roots of further diagrams, until no call is left out for depth."""
    with Scratch(spark, "lines") as scratch:
        return traverse.continuations(*_sequences(spark, sf_dir, scratch)).select("graph", "node")


_MESSAGE_LINE = "'    p' || (a.position - 1) || CASE WHEN kind = 'return' THEN '-->>' ELSE '->>' END || 'p' || (b.position - 1) || ': ' || CASE kind WHEN 'recursive_call' THEN '[recursive] ' WHEN 'depth_truncated' THEN '[depth truncated] ' ELSE '' END || label"


@query(f"""SELECT graph, root, 'sequenceDiagram' || chr(10) || string_agg(line, chr(10) ORDER BY part, position) || chr(10) AS text FROM (
  SELECT graph, root, 0 AS part, position, '    participant p' || (position - 1) || ' as ' || node AS line FROM wp
  UNION ALL SELECT ws.graph, ws.root, 1, ws.position, {_MESSAGE_LINE.replace("|| label", "|| replace(label, ':', '-')").replace("'[depth truncated] '", "'[depth truncated] '")}
  FROM ws JOIN wp a ON a.graph = ws.graph AND a.root = ws.root AND a.node = ws.caller JOIN wp b ON b.graph = ws.graph AND b.root = ws.root AND b.node = ws.callee) GROUP BY graph, root""", _WALK)
def rn3_sequence_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _messages(spark, sf_dir)
    return render.sequence_diagram(messages, traverse.participants(messages))


@query("""SELECT graph, root, '@startuml' || chr(10) || string_agg(line, chr(10) ORDER BY part, position) || chr(10) || '@enduml' || chr(10) AS text FROM (
  SELECT graph, root, 0 AS part, position, 'participant "' || node || '" as p_' || substr(sha1(node), 1, 10) AS line FROM wp
  UNION ALL SELECT graph, root, 1, position, 'p_' || substr(sha1(caller), 1, 10) || CASE WHEN kind = 'return' THEN ' --> ' ELSE ' -> ' END || 'p_' || substr(sha1(callee), 1, 10) || ' : '
    || CASE kind WHEN 'recursive_call' THEN '[recursive] ' WHEN 'depth_truncated' THEN '[depth truncated] ' ELSE '' END || label FROM ws) GROUP BY graph, root""", _WALK)
def rn11_sequence_diagrams_plantuml(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _messages(spark, sf_dir)
    return render.sequence_diagram_plantuml(messages, traverse.participants(messages))


@query("""SELECT graph, root, 'flowchart LR' || chr(10) || string_agg(line, chr(10) ORDER BY part, position) || chr(10) AS text FROM (
  SELECT graph, root, 0 AS part, position, '    p' || (position - 1) || '["' || node || '"]' AS line FROM wo
  UNION ALL SELECT ws.graph, ws.root, 1, ws.position, '    p' || (a.position - 1) || ' -->|"' || number || ': ' || CASE kind WHEN 'recursive_call' THEN '[recursive] ' WHEN 'depth_truncated' THEN '[depth truncated] ' ELSE '' END || label || '"| p' || (b.position - 1)
  FROM ws JOIN wo a ON a.graph = ws.graph AND a.root = ws.root AND a.node = regexp_replace(ws.caller, '\\.[^.]*$', '') JOIN wo b ON b.graph = ws.graph AND b.root = ws.root AND b.node = regexp_replace(ws.callee, '\\.[^.]*$', '') WHERE kind <> 'return') GROUP BY graph, root""",
    _WALK + ", wo AS (SELECT graph, root, regexp_replace(node, '\\.[^.]*$', '') AS node, row_number() OVER (PARTITION BY graph, root ORDER BY min(position)) AS position FROM wp GROUP BY graph, root, regexp_replace(node, '\\.[^.]*$', ''))")
def rn4_communication_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _messages(spark, sf_dir, owners=True)
    return render.communication_diagram(messages, traverse.participants(messages))


# --- graphs as text --------------------------------------------------------------------

_ID = "regexp_replace({}, '[^0-9A-Za-z_]', '_', 'g')"


@query(f"""SELECT graph, 'flowchart LR' || chr(10) || string_agg(line, chr(10) ORDER BY part, pos, x) || chr(10) AS text FROM (
  SELECT graph, 0 AS part, 0 AS pos, node AS x, '    n_' || {_ID.format("node")} || '["' || node || '"]' AS line FROM onode
  UNION ALL SELECT graph, 1, pos, src || ' ' || dst, '    n_' || {_ID.format("src")} || ' --> n_' || {_ID.format("dst")} FROM oe) GROUP BY graph""")
def rn1_flowcharts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.call_flowchart(*_orders(spark, sf_dir))


_CLASS_TEXT = _CLASSES + """,
mb AS (SELECT graph, parent AS node, string_agg('        ' || CASE visibility WHEN 'public' THEN '+' WHEN 'protected' THEN '#' WHEN 'private' THEN '-' ELSE '~' END || name || '()', chr(10) ORDER BY pos, name) AS body FROM mth GROUP BY graph, parent),
nt AS (SELECT cn.graph, cn.node, (cn.graph, cn.node) NOT IN (SELECT (graph, name) FROM cls) AS external, body, 'c_' || substr(sha1(cn.node), 1, 10) AS id FROM cn LEFT JOIN mb ON mb.graph = cn.graph AND mb.node = cn.node),
et AS (SELECT *, 'c_' || substr(sha1(src), 1, 10) AS a, 'c_' || substr(sha1(dst), 1, 10) AS b FROM ce)"""


@query("""SELECT graph, 'classDiagram' || chr(10) || 'direction LR' || chr(10) || string_agg(line, chr(10) ORDER BY part, pos, x) || chr(10) AS text FROM (
  SELECT graph, 0 AS part, 0 AS pos, node AS x, '    class ' || id || '["' || node || '"]' || CASE WHEN body IS NOT NULL THEN ' {' || chr(10) || body || chr(10) || '    }' WHEN external THEN chr(10) || '    class ' || id || ' <<external>>' ELSE '' END AS line FROM nt
  UNION ALL SELECT graph, 1, pos, relation || src || chr(1) || dst, CASE relation WHEN 'inheritance' THEN '    ' || b || ' <|-- ' || a ELSE '    ' || a || ' --> ' || b || ' : uses' END FROM et) GROUP BY graph""", _CLASS_TEXT)
def rn2_class_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.class_diagram(*_class_text(spark, sf_dir))


def _class_text(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = written(_lines(spark, sf_dir), "lines")
    classes, methods = facts.classes(lines), facts.methods(lines)
    nodes, edges = relations.class_graph(classes, methods, facts.calls(lines))
    known = classes.select("graph", F.col("name").alias("node"), F.lit(False).alias("external"))
    nodes = nodes.join(known, ["graph", "node"], "left").withColumn("external", F.coalesce("external", F.lit(True)))
    return nodes, edges, methods.select("graph", F.col("parent").alias("node"), "name", "visibility", "pos")


@query("""SELECT graph, '@startuml' || chr(10) || 'left to right direction' || chr(10) || string_agg(line, chr(10) ORDER BY part, pos, x) || chr(10) || '@enduml' || chr(10) AS text FROM (
  SELECT graph, 0 AS part, 0 AS pos, node AS x, 'class "' || node || '" as ' || id || CASE WHEN external THEN ' <<external>>' ELSE ' {' || chr(10) || coalesce(replace(body, '        ', '  ') || chr(10), '') || '}' END AS line FROM nt
  UNION ALL SELECT graph, 1, pos, relation || src || chr(1) || dst, CASE relation WHEN 'inheritance' THEN b || ' <|-- ' || a ELSE a || ' --> ' || b || ' : uses' END FROM et) GROUP BY graph""", _CLASS_TEXT)
def rn11_class_diagrams_plantuml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.class_diagram_plantuml(*_class_text(spark, sf_dir))


@query(f"""SELECT graph, 'flowchart LR' || chr(10) || string_agg(line, chr(10) ORDER BY part, x) || chr(10) AS text FROM (
  SELECT graph, 0 AS part, node AS x, '    component_' || {_ID.format("node")} || CASE WHEN starts_with(node, 'external:') THEN '(["' || substr(node, 10) || '"])' ELSE '["' || node || '"]' END AS line
  FROM (SELECT DISTINCT graph, component AS node FROM im UNION SELECT graph, dst FROM cg WHERE starts_with(dst, 'external:'))
  UNION ALL SELECT graph, 1, src || chr(1) || dst, '    component_' || {_ID.format("src")} || ' --> component_' || {_ID.format("dst")} FROM cg WHERE dst IS NOT NULL AND src <> dst) GROUP BY graph""", _COMPONENTS)
def rn5_component_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.component_flowchart(*relations.component_graph(_imports(spark, sf_dir)))


@query(f"""SELECT graph, 'flowchart LR' || chr(10) || string_agg(line, chr(10) ORDER BY part, x) || chr(10) AS text FROM (
  SELECT graph, 0 AS part, node AS x, '    pkg_' || {_ID.format("node")} || '["' || node || '"]' AS line FROM pn
  UNION ALL SELECT graph, 1, src || chr(1) || dst, '    pkg_' || {_ID.format("src")} || ' --> pkg_' || {_ID.format("dst")} FROM pg
  UNION ALL SELECT graph, 2, '', '    classDef cycle stroke-width:3px' || chr(10) || '    class ' || string_agg('pkg_' || {_ID.format("a")}, ',' ORDER BY a) || ' cycle' FROM (SELECT DISTINCT graph, a FROM pr WHERE a = b) GROUP BY graph
  UNION ALL SELECT graph, 3, '', '    classDef isolated stroke-dasharray: 5 5' || chr(10) || '    class ' || string_agg('pkg_' || {_ID.format("node")}, ',' ORDER BY node) || ' isolated' FROM pn WHERE NOT EXISTS (SELECT 1 FROM pg WHERE pg.graph = pn.graph AND pn.node IN (pg.src, pg.dst)) GROUP BY graph) GROUP BY graph""",
    _MODULES + """, pg AS (SELECT DISTINCT graph, module AS src, target AS dst FROM ms WHERE target <> module), pn AS (SELECT DISTINCT graph, module AS node FROM im),
pr AS (SELECT graph, src AS a, dst AS b FROM pg UNION SELECT pr.graph, pr.a, pg.dst FROM pr JOIN pg ON pg.graph = pr.graph AND pg.src = pr.b)""")
def rn5_package_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = relations.package_graph(_imports(spark, sf_dir))
    cyclic = traverse.strong_components(nodes, edges).where("cyclic").select("graph", "node")
    ends = edges.select("graph", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return render.package_flowchart(nodes, edges, cyclic, nodes.join(ends, ["graph", "node"], "left_anti"))


@query("""SELECT graph, 'flowchart LR' || chr(10) || string_agg(line, chr(10) ORDER BY part, n, x) || chr(10) AS text FROM (
  SELECT graph, 0 AS part, n, '' AS x, '    o' || n || '["' || name || ' : ' || type_name || '"]' AS line FROM op
  UNION ALL SELECT oj.graph, 1, 0, src || chr(1) || dst || chr(1) || label, '    o' || a.n || ' -->|' || label || '| o' || b.n FROM oj JOIN op a ON a.graph = oj.graph AND a.node = src JOIN op b ON b.graph = oj.graph AND b.node = dst) GROUP BY graph""",
    _OBJECTS + ", op AS (SELECT graph, key AS node, any_value(name) AS name, max_by(type_name, pos) AS type_name, row_number() OVER (PARTITION BY graph ORDER BY key) - 1 AS n FROM ok_ GROUP BY graph, key)")
def rn6_object_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = facts.objects(_lines(spark, sf_dir))
    _, edges = relations.object_graph(objects)
    key = names.object_key(F.col("scope"), F.col("name")).alias("node")
    nodes = objects.groupBy("graph", key).agg(F.any_value("name").alias("name"), F.max_by("type_name", "pos").alias("type_name"))
    return render.object_diagram(nodes, edges)


def _responsibilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence on each class, told by its supplier's number if six divides it, else by method names, which are verbs here."""
    lines = _lines(spark, sf_dir)
    verbs = F.array(*[F.lit(v) for v in ("Load", "process", "check", "show", "run", "list", "hide")])
    methods = lines.groupBy("graph", F.concat(F.lit("S"), F.col("s").cast("string")).alias("name")).agg(F.collect_set(F.get(verbs, (F.col("p") % 7).cast("int"))).alias("methods"), F.max(F.when(F.col("s") % 6 == 0, F.concat(F.lit("  Supplies, since \n"), F.col("s").cast("string")))).alias("doc"))
    rows = facts.classes(lines).join(methods, ["graph", "name"])
    shown = F.concat(F.lit("PartOf"), "name", F.lit("_list"))
    return rows.select("graph", "name", text.responsibility(F.col("doc"), names.name_words(shown), F.col("methods")).alias("responsibility"), "pos")


_TOLD = """
rs AS (SELECT graph, 'S' || s AS name, min(pos) AS pos, s, list(DISTINCT ['load', 'process', 'check', 'show', 'run', 'list', 'hide'][1 + p % 7]) AS ms FROM ln GROUP BY graph, s),
rl AS (
  SELECT graph, name, pos, CASE WHEN s % 6 = 0 THEN 'Supplies, since' WHEN list_has_any(ms, ['load', 'read', 'save', 'write']) THEN 'Handles part of s' || s || ' list data input and output.'
    WHEN list_has_any(ms, ['update', 'process', 'run', 'execute']) THEN 'Coordinates part of s' || s || ' list processing.' WHEN list_has_any(ms, ['validate', 'check', 'evaluate']) THEN 'Validates or evaluates part of s' || s || ' list state.'
    ELSE 'Manages part of s' || s || ' list state and behavior.' END AS responsibility FROM rs
)""".strip()


@query("SELECT graph, name, responsibility, pos FROM rl", _TOLD)
def fn5_responsibilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _responsibilities(spark, sf_dir)


@query("SELECT graph, '| Class | Responsibility |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || name || ' | ' || responsibility || ' |', chr(10) ORDER BY pos, name) || chr(10) AS text FROM rl GROUP BY graph", _TOLD)
def rn12_responsibility_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.responsibility_markdown(_responsibilities(spark, sf_dir))


@query("SELECT graph, 'Class,Responsibility' || chr(10) || string_agg(name || ',' || CASE WHEN contains(responsibility, ',') THEN '\"' || responsibility || '\"' ELSE responsibility END, chr(10) ORDER BY pos, name) || chr(10) AS text FROM rl GROUP BY graph", _TOLD)
def rn12_responsibility_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.responsibility_csv(_responsibilities(spark, sf_dir))


# --- modules as JSON ------------------------------------------------------------------

_REFUSED = """
mj AS (SELECT graph, s, min(i) AS line, count(*) AS n FROM (SELECT graph, s, p, min(i) AS i FROM ln GROUP BY graph, s, p) GROUP BY graph, s),
dj AS (
  SELECT graph, s, n, CASE s % 8 WHEN 0 THEN 'unsupported Common IR schema_version "2" (supported: "1")' WHEN 1 THEN 'common_ir.language is required' WHEN 2 THEN 'common_ir.imports must be a JSON array'
    WHEN 3 THEN 'common_ir.entities[0] has invalid source range line=' || least(line, 2) || ' end_line=' || (least(line, 2) - 1) WHEN 4 THEN 'decode Common IR payload' END AS error FROM mj
)""".strip()


def _coded_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph, module_id, json): suppliers of a customer as modules of their parts, of which five in eight break a rule."""
    kind = F.col("s") % 8
    parts = _lines(spark, sf_dir).groupBy("graph", "s", "p").agg(F.min("i").alias("i"))
    # all entities of a module stand on one line, so that the first one breaks a rule as any would
    grouped = parts.groupBy("graph", "s").agg(F.min("i").alias("line"), F.sort_array(F.collect_list("p")).alias("parts"))
    line = F.when(kind == 3, F.least("line", F.lit(2))).otherwise(F.col("line"))
    entities = F.transform("parts", lambda p: F.struct(F.lit("method").alias("kind"), F.concat(F.lit("p"), p.cast("string")).alias("name"), line.alias("line"), (line - (kind == 3).cast("int")).alias("end_line"), F.lit(1).alias("unknown")))
    fields = [
        F.when(kind == 0, "2").otherwise("1").alias("schema_version"),
        F.when(kind != 1, F.when(F.col("s") % 16 == 5, "go").otherwise("python")).alias("language"),
        entities.alias("entities"),
        F.when(kind != 2, F.array(F.lit("base"))).alias("imports"),
        F.array().cast("array<struct<kind:string,message:string>>").alias("diagnostics"),
    ]
    text_ = F.to_json(F.struct(*fields))
    return grouped.select("graph", F.col("s").alias("module_id"), F.when(kind == 4, F.substring(text_, 1, 40)).otherwise(text_).alias("json"))


@query("SELECT graph, s AS module_id, error, CASE WHEN error IS NULL THEN n END AS entities FROM dj", _REFUSED)
def sc7_decoded_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = modules.decoded(_coded_modules(spark, sf_dir))
    return rows.select("graph", "module_id", "error", F.when(F.col("error").isNull(), F.size("module.entities")).cast("long").alias("entities"))


@query("SELECT graph, s AS module_id, error FROM dj WHERE error IS NULL", _REFUSED)
def sc8_encoded_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound modules, encoded and decoded again; those that come back as they were."""
    once = modules.decoded(_coded_modules(spark, sf_dir)).where("error IS NULL").select("graph", "module_id", F.col("module").alias("first"))
    again = modules.decoded(modules.encoded(once.withColumn("module", F.col("first"))))
    return again.where(F.to_json("module") == F.to_json("first")).select("graph", "module_id", "error")


@query("SELECT graph, CASE WHEN count(DISTINCT s % 16 = 5) > 1 THEN 'mixed' WHEN max(s % 16) FILTER (WHERE s % 16 = 5) = 5 THEN 'go' ELSE 'python' END AS language, CAST(sum(n) AS BIGINT) AS entities FROM dj WHERE error IS NULL GROUP BY graph", _REFUSED)
def sc10_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sound modules of a customer together."""
    rows = modules.decoded(_coded_modules(spark, sf_dir))
    return modules.languages(rows).join(modules.facts_of(rows, "entities").groupBy("graph").agg(F.count("*").alias("entities")), "graph")


# --- use cases as text ------------------------------------------------------------------

_CASES = _HANDLED + """,
e1 AS (SELECT cal.graph, caller, coalesce(o.qualified, e.qualified, u.one) AS target, cal.pos FROM cal LEFT JOIN mth e ON e.graph = cal.graph AND e.qualified = raw
  LEFT JOIN mth o ON o.graph = cal.graph AND raw LIKE 'self.%' AND o.qualified = cal.parent || substr(raw, 5) LEFT JOIN uq u ON u.graph = cal.graph AND u.name = raw),
e2 AS (SELECT graph, caller, target, min(pos) AS pos FROM e1 WHERE target IS NOT NULL AND target <> caller GROUP BY graph, caller, target),
uc AS (
  SELECT hd.graph, component, callable, hd.pos, row_number() OVER (PARTITION BY hd.graph ORDER BY hd.pos) AS k,
         CASE WHEN starts_with(handler, 'on_') THEN upper(substr(handler, 4, 1)) || replace(substr(handler, 5), '_clicked', '') ELSE upper(substr(replace(handler, 'self.', ''), 1, 1)) || substr(replace(handler, 'self.', ''), 2) END AS name,
         (SELECT string_agg(' -> ' || target, '' ORDER BY e2.pos) FROM e2 WHERE e2.graph = hd.graph AND e2.caller = callable) AS chain FROM hd
)"""


@query("""SELECT graph, 'flowchart LR' || chr(10) || '    actor1["User"]' || chr(10) || string_agg('    uc' || k || '(["' || name || '"])' || chr(10) || '    actor1 -->|"' || component || ' / order"| uc' || k || chr(10) || '    %% handler-chain: ' || callable || coalesce(chain, ''), chr(10) ORDER BY k) || chr(10) AS text FROM uc GROUP BY graph""", _CASES)
def rn7_use_case_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as use cases of one actor, with what their handlers call directly."""
    lines = _lines(spark, sf_dir)
    methods = facts.methods(lines)
    cases = relations.use_cases(facts.input_events(lines), methods)
    _, edges = relations.sequence_graph(relations.call_sequences(facts.calls(lines), methods), methods)
    chains = edges.where("src != dst").groupBy("graph", F.col("src").alias("callable")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"]).alias("chain"))
    name = text.use_case_name(F.lit(None).cast("string"), F.col("handler"))
    rows = cases.join(chains, ["graph", "callable"], "left").select("graph", F.lit("User").alias("actor"), name.alias("name"), "component", F.lit("order").alias("event"), "callable", "chain", "pos")
    return render.use_case_diagram(rows)


# --- small ones --------------------------------------------------------------------------

_OUTPUT = "on_ AS (SELECT graph, node, shared, CASE WHEN shared THEN 'shared_' || substr(sha256(node), 1, 10) || '_' || node ELSE 'series_' || number || '_' || substr(sha256(series), 1, 10) || '_' || series END AS output_name FROM sk), bo AS (SELECT * FROM pe WHERE src_shared OR dst_shared OR src_series <> dst_series), be AS (SELECT graph, src AS near, dst AS node FROM bo UNION SELECT graph, dst, src FROM bo)"


@query("SELECT DISTINCT be.graph, a.output_name, be.node, b.output_name AS reference FROM be JOIN on_ a ON a.graph = be.graph AND a.node = be.near JOIN on_ b ON b.graph = be.graph AND b.node = be.node", f"{_NUMBERED}, {_OUTPUT}")
def j15_boundary_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _orders(spark, sf_dir)
    members = partition.partition(nodes, edges)
    return partition.references(partition.boundary_edges(members, edges), partition.output_names(members))


_DRAWN = f"""{_NUMBERED}, {_OUTPUT},
de AS (
  SELECT oe.graph, oe.src, oe.dst, oe.pos, a.output_name FROM oe JOIN on_ a ON a.graph = oe.graph AND a.node = oe.src
  UNION ALL SELECT oe.graph, oe.src, oe.dst, oe.pos, b.output_name FROM oe JOIN on_ b ON b.graph = oe.graph AND b.node = oe.dst WHERE b.shared AND oe.src <> oe.dst
), dn AS (
  SELECT graph, output_name, node, NULL::VARCHAR AS reference FROM on_
  UNION SELECT e.graph, e.output_name, h.node, h.output_name FROM (SELECT graph, output_name, unnest([src, dst]) AS node FROM de) e JOIN on_ h ON h.graph = e.graph AND h.node = e.node WHERE h.output_name <> e.output_name
)"""


@query(f"""SELECT graph, output_name, 'flowchart LR' || chr(10) || string_agg(line, chr(10) ORDER BY part, pos, x) || chr(10) AS text FROM (
  SELECT graph, output_name, 0 AS part, 0 AS pos, node AS x, '    n_' || {_ID.format("node")} || '["' || node || coalesce('<br/>続き: ' || reference, '') || '"]' AS line FROM dn
  UNION ALL SELECT graph, output_name, 1, pos, src || ' ' || dst, '    n_' || {_ID.format("src")} || ' --> n_' || {_ID.format("dst")} FROM de) GROUP BY graph, output_name""", _DRAWN)
def gn1_call_graph_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flowchart for each series and each shared node of the order graphs."""
    nodes, edges = (written(t, "orders") for t in _orders(spark, sf_dir))
    return bundles.call_graph_bundle(partition.partition(nodes, edges), edges)


@query("SELECT DISTINCT graph, output_name, CASE WHEN shared THEN 'shared' ELSE 'series_' || substr(sha256(series), 1, 10) || '_' || series END AS directory, CASE WHEN shared THEN node ELSE series END AS series_root, parent AS parent_series_root, coalesce(depth, 0) AS depth, shared FROM (SELECT sk.*, on_.output_name FROM sk JOIN on_ ON on_.graph = sk.graph AND on_.node = sk.node)", f"{_NUMBERED}, {_OUTPUT}")
def gn16_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = partition.partition(*_orders(spark, sf_dir))
    return bundles.placements(members, partition.output_names(members)).withColumn("depth", F.col("depth").cast("long"))


@query()
def gn2_class_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class diagrams of the customers' modules, cut into series."""
    lines = written(_lines(spark, sf_dir), "lines")
    nodes, edges = relations.class_graph(facts.classes(lines), facts.methods(lines), facts.calls(lines))
    members = partition.partition(nodes, edges.select("graph", "src", "dst"))
    classes = facts.classes(lines).select("graph", F.col("name").alias("node"))
    return bundles.class_bundle(members, edges, classes, facts.methods(lines).select("graph", F.col("parent").alias("node"), "name", "visibility", "pos"))


@query()
def gn3_object_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object diagrams of the customers' modules, cut into series."""
    objects = facts.objects(written(_lines(spark, sf_dir), "lines"))
    nodes, edges = (written(t, "objects") for t in relations.object_graph(objects))
    return bundles.object_bundle(partition.partition(nodes, edges.select("graph", "src", "dst")), edges, objects)


@query()
def gn8_package_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package diagrams of the customers' imports, cut into series."""
    nodes, edges = relations.package_graph(_imports(spark, sf_dir))
    cyclic = traverse.strong_components(nodes, edges).where("cyclic").select("graph", "node")
    ends = edges.select("graph", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return bundles.package_bundle(partition.partition(nodes, edges), edges, cyclic, nodes.join(ends.hint("merge"), ["graph", "node"], "left_anti"))


@query("SELECT DISTINCT c.graph, c.name AS source, t.target FROM (SELECT graph, name, unnest(bases) AS target FROM cls) t JOIN cls c ON c.graph = t.graph AND c.name = t.name JOIN cls k ON k.graph = t.graph AND k.name = t.target")
def j13_known_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as services: the dependencies, named like base classes, that are services of the customer."""
    classes = facts.classes(_lines(spark, sf_dir))
    return relations.known_targets(classes.select("graph", F.col("name").alias("source"), F.col("bases").alias("targets")), classes)


@query("SELECT graph, 0::BIGINT AS confirmed, count(DISTINCT node) AS inferred, 0::BIGINT AS unknown FROM (SELECT graph, component AS node FROM im UNION SELECT graph, dst FROM cg WHERE starts_with(dst, 'external:')) GROUP BY graph", _COMPONENTS)
def ag9_confidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.confidence_counts(relations.deployment_topology(*relations.component_graph(_imports(spark, sf_dir)))[0])


@query("SELECT graph, string_agg(command, ',' ORDER BY w, command) AS commands FROM (SELECT graph, command, min(i) AS w FROM stp GROUP BY graph, command) GROUP BY graph")
def ag12_ordered_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relations.ordered_distinct(facts.workflow_steps(_lines(spark, sf_dir)), "command", "i")
    return rows.select("graph", F.array_join("values", ",").alias("commands"))


_POLICY = [("r0.", "r1.", "forbidden"), ("r1.n", "r2.n", "warning"), ("r3", "r0", "forbidden")]


@query("SELECT DISTINCT ms.graph, module AS src, target AS dst, p.severity FROM ms JOIN (VALUES ('r0.', 'r1.', 'forbidden'), ('r1.n', 'r2.n', 'warning'), ('r3', 'r0', 'forbidden')) p(a, b, severity) ON starts_with(module, a) AND starts_with(target, b) WHERE target <> module", _MODULES)
def ev11_policy_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules of one region that may not, or should not, import those of another."""
    rules = spark.createDataFrame(_POLICY, "source string, target string, severity string")
    return relations.policy_findings(relations.package_graph(_imports(spark, sf_dir))[1], rules)


@query("SELECT graph, root, position, caller, callee, kind FROM ws WHERE kind IN ('call', 'async_call', 'recursive_call', 'depth_truncated')", _WALK)
def pf8_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages that a communication shows."""
    return _messages(spark, sf_dir).where("kind IN ('call', 'async_call', 'recursive_call', 'depth_truncated')").select("graph", "root", F.col("position").cast("long").alias("position"), "caller", "callee", "kind")


@query("SELECT DISTINCT cal.graph, caller AS root, e.qualified AS node FROM cal JOIN mth e ON e.graph = cal.graph AND e.qualified = raw WHERE caller <> e.qualified UNION SELECT c.graph, c.caller, target FROM rc c JOIN mth m ON m.graph = c.graph AND m.qualified = target WHERE c.caller <> target", _CALLABLE)
def wn8_direct_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each method leads to within one step."""
    with Scratch(spark, "lines") as scratch:
        lines = scratch.write(_lines(spark, sf_dir), "lines")
        methods = facts.methods(lines)
        nodes, edges = relations.sequence_graph(relations.call_sequences(facts.calls(lines), methods), methods)
        return traverse.bounded_chain(nodes, edges, 1).select("graph", "root", "node")


#: The walk of wn8, a callable a step.
_CHAIN = _LINKED + """,
el AS (SELECT graph, caller AS src, list({'node': target, 'depth': 0} ORDER BY pos, target) AS kids FROM (
  SELECT rc.graph, caller, target, min(rc.pos) AS pos FROM rc JOIN mth ON mth.graph = rc.graph AND qualified = target WHERE caller <> target GROUP BY rc.graph, caller, target) GROUP BY graph, caller),
wc AS (
  SELECT graph, src AS root, list_transform(kids, lambda c: {'node': c.node, 'depth': 1}) AS todo, [src] AS seen FROM el
  UNION ALL
  SELECT h.graph, root, list_concat(CASE WHEN fresh AND h.at.depth < 5 AND kids IS NOT NULL THEN list_transform(kids, lambda c: {'node': c.node, 'depth': h.at.depth + 1}) ELSE [] END, todo[2:]), CASE WHEN fresh THEN list_append(seen, h.at.node) ELSE seen END
  FROM (SELECT graph, root, todo, seen, todo[1] AS at, NOT list_contains(seen, todo[1].node) AS fresh FROM wc WHERE len(todo) > 0) h LEFT JOIN el ON el.graph = h.graph AND el.src = h.at.node
)"""


@query("SELECT graph, root, unnest(seen[2:]) AS node, unnest(range(1, len(seen))) AS position FROM wc WHERE len(todo) = 0", _CHAIN)
def wn8_call_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a walk of up to five steps from each method meets, in its order."""
    with Scratch(spark, "lines") as scratch:
        lines = scratch.write(_lines(spark, sf_dir), "lines")
        methods = facts.methods(lines)
        nodes, edges = relations.sequence_graph(relations.call_sequences(facts.linked_calls(lines), methods), methods)
        return traverse.bounded_chain(nodes, edges).select("graph", "root", "node", F.col("position").cast("long").alias("position"))
